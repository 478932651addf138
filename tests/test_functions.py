"""Column functions on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from epitide import schema
from epitide.functions import calendar, measures, records, text


def one(spark, expr, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("out")).first()["out"]


@pytest.mark.parametrize("raw,expected", [(" chn ", "CHN"), ("china", None), ("US1", None), (None, None)])
def test_iso3(spark, raw, expected):
    assert one(spark, text.iso3(F.lit(raw))) == expected


def test_blank_and_numbers(spark):
    assert one(spark, text.blank_to_null(F.lit("  "))) is None
    assert one(spark, text.parse_number(F.lit("No data"))) is None
    assert one(spark, text.parse_grouped_number(F.lit(" 1,234.5 "))) == 1234.5


@pytest.mark.parametrize("raw,expected", [
    ("2020-01-05", date(2020, 1, 5)), ("2020/1/5", date(2020, 1, 5)), ("1/5/2020", date(2020, 1, 5)), ("2020-01-05 10:11:12", date(2020, 1, 5)),
    ("1/22/2020 17:00", date(2020, 1, 22)), ("13/40/2020", None), ("", None),
])
def test_date_formats(spark, raw, expected):
    assert one(spark, text.parse_date(F.lit(raw), *schema.RAW_DATE_FORMATS)) == expected


@pytest.mark.parametrize("raw,clean,flag", [(-12.0, 0.0, True), (5.0, 5.0, False), (None, None, False)])
def test_negative_clip_keeps_missing(spark, raw, clean, flag):
    df = spark.createDataFrame([(raw,)], "raw double")
    row = measures.clip_negative(df, "raw", "clean", "flag").first()
    assert (row["raw"], row["clean"], row["flag"]) == (raw, clean, flag)


@pytest.mark.parametrize("raw,expected", [("新冠肺炎", "COVID-19"), ("流感", "Influenza"), (" FLU ", "Influenza"), (" Zika ", "Zika"), ("  ", None)])
def test_disease_alias(spark, raw, expected):
    assert one(spark, text.canonical_name(F.lit(raw), schema.DISEASE_ALIASES)) == expected


@pytest.mark.parametrize("sentence,term,expected", [
    ("Seasonal flu vaccination", "seasonal flu", True), ("People with HIV", "hiv", True), ("TB treatment", "tb", True),
    ("Magnetic flux density", "flu", False), ("Fluoride in water", "flu", False), ("ARCHIVED data", "hiv", False),
    ("cost (US$) per case", "us$", True), ("sars-cov-2 tests", "sars-cov-2", True),
])
def test_whole_terms(spark, sentence, term, expected):
    assert one(spark, text.matches_term(F.lit(sentence), term)) is expected
    assert one(spark, text.matches_any_term(F.lit(sentence), [term, "zzz"])) is expected


def test_growth_guards(spark):
    assert one(spark, measures.growth(F.lit(5.0), F.lit(None).cast("double"))) is None
    assert one(spark, measures.growth(F.lit(5.0), F.lit(0.5))) == 4.5
    assert one(spark, measures.growth(F.lit(5.0), F.lit(-10.0))) == 1.5


def test_rates(spark):
    assert one(spark, measures.per_million(F.lit(5.0), F.lit(0.0))) is None
    assert one(spark, measures.per_million(F.lit(5.0), F.lit(None).cast("double"), F.lit("incidence_per_100k"))) == 50.0
    assert one(spark, measures.smape_term(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, measures.to_percent(F.lit(0.5))) == 50.0
    assert one(spark, measures.to_percent(F.lit(12.0))) == 12.0


@pytest.mark.parametrize("score,label", [(0.0, "低风险"), (35.0, "中风险"), (55.0, "较高风险"), (75.0, "高风险"), (100.0, "高风险")])
def test_risk_buckets(spark, score, label):
    assert one(spark, measures.risk_bucket(F.lit(score))) == label


def test_calendar(spark):
    d = F.lit(date(2024, 2, 4))  # a Sunday
    assert one(spark, calendar.day_of_week(d)) == 7
    assert one(spark, calendar.week_end(d)) == date(2024, 2, 10)
    assert one(spark, calendar.week_end(F.lit(date(2024, 2, 3)))) == date(2024, 2, 3)
    assert one(spark, calendar.target_date(F.lit(date(2024, 2, 29)), F.lit("annual"), 1)) == date(2025, 2, 28)
    assert one(spark, calendar.target_date(d, F.lit("weekly"), 2)) == date(2024, 2, 18)
    assert one(spark, calendar.target_date(d, F.lit("daily"), 0)) == date(2024, 2, 5)


@pytest.mark.parametrize("raw,ok", [
    ('{"Id": 5}', True), ("[1]", False), ("5", False), ('{"Id": 5', False), ("{'Id': 5}", False), ('{"Id": 5} x', False), ("", False), (None, False), ("null", False),
])
def test_json_record_validity(spark, raw, ok):
    row = records.json_record(spark.createDataFrame([(raw,)], "j string"), "j").first()
    assert row["raw_json_valid"] is ok
    assert row["who_record_id"] == ("5" if ok else None)


def test_dimension_backfill(spark):
    df = records.json_record(spark.createDataFrame([('{"Dim1Type":"REGION","Dim1":"X","Dim2Type":"sex","Dim2":"SEX_MLE"}',)], "j string"), "j")
    row = df.withColumn("sex", F.lit(None).cast("string")).select(records.backfill_dimension("sex", "SEX").alias("s")).first()
    assert row["s"] == "SEX_MLE"


def test_record_normaliser_takes_first_non_empty(spark):
    df = spark.createDataFrame([("", "I2", "AUS", 2020, 1.5)], "IndicatorCode string, Indicator string, SpatialDim string, TimeDim int, NumericValue double")
    row = records.normalise_record(df, F.lit("EP")).first()
    assert row["indicator_code"] == "I2" and row["location_code"] == "AUS" and row["year"] == "2020" and row["numeric_value"] == "1.5"
    assert tuple(row.asDict()) == schema.INDICATOR_COLUMNS


def test_page_metadata(spark):
    html = (
        "<html><head><title>Site</title><script>var x='2020-01-01';</script></head><body><h1>Week <b>3</b> report</h1><p>Published 2026年7月9日</p>"
        "<a class='x' href=\"files/b.PDF\">b</a><a href='/a.xlsx?v=1'>a</a><a href='/a.xlsx?v=1'>a</a><a href='other.html'>o</a></body></html>"
    )
    df = spark.createDataFrame([("https://h.test/dir/page.html", html)], "url string, html string")
    row = text.page_metadata(df, "url", "html", 800).first()
    assert row["title"] == "Week 3 report"
    assert row["published_date"] == "2026-07-09"
    assert row["attachment_urls"] == ["https://h.test/a.xlsx?v=1", "https://h.test/dir/files/b.PDF"]


def test_link_candidates(spark):
    html = '<a href="/d/1.html">流感监测周报 第1周</a><a href="https://else.test/x">流感监测周报</a><a href="/d/2.html">其他</a>'
    df = spark.createDataFrame([("https://www.cdc.test/list/", html)], "url string, html string")
    rows = text.link_candidates(df, "url", "html", schema.REPORT_LINK_KEYWORDS, "cdc.test").collect()
    assert [(r["detail_url"], r["anchor_title"]) for r in rows] == [("https://www.cdc.test/d/1.html", "流感监测周报 第1周")]


def test_topic_discovery_is_unique_per_code(spark):
    df = spark.createDataFrame([("A1", "Influenza deaths"), ("A1", "Influenza deaths"), ("B", "Magnetic flux"), ("C", "HIV and TB"), ("", "hiv")], "code string, name string")
    rows = {(r["topic"], r["code"]) for r in text.discover_topics(df, "code", "name", schema.TOPIC_KEYWORDS).collect()}
    assert rows == {("influenza", "A1"), ("hiv", "C"), ("tuberculosis", "C")}


def test_units(spark):
    def unit(code, name, given=None):
        return one(spark, text.resolve_unit(F.lit(given), F.lit(code), F.lit(name), schema.INDICATOR_UNITS))

    assert unit("TB_1", "Tuberculosis treatment coverage") == "percent"
    assert unit("X", "Deaths (per 100 000 population)") == "per_100k"
    assert unit("X", "Number of cases") == "count"
    assert unit("X", "Death rate") == "rate"
    assert unit("X", "Other", "mg") == "mg"
    assert unit("X", "Other") == "unspecified"
