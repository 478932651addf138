"""Cleaning, feature, risk, forecasting and serving plans on small fixtures."""

import json
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from epitide import schema
from epitide.operators import joins
from epitide.plans import cleaning, features as gold, forecasting, quality, risk, serving
from epitide.sources import readers, scratch, sinks

S = ["location_code", "disease"]


def mapping(spark):
    return spark.createDataFrame(
        [("US", "United States", "USA"), ("Mainland China", "China", "CHN"), ("China", "China", "CHN"), ("Diamond Princess", "Diamond Princess", None)],
        "name string, standard_name string, mapped_code string",
    )


def reports(spark):
    rows = [
        (1, "01/22/2020", "", "US", "1/22/2020 17:00", 1.0, 0.0, 0.0), (2, "01/23/2020", "Ohio", " US", "2020-01-23 10:00:00", 5.0, 1.0, 0.0),
        (3, "01/23/2020", "Ohio", "US", "2020-01-23 12:00:00", 7.0, 1.0, 0.0), (4, "01/24/2020", "Ohio", "US", "2020-01-24 12:00:00", 4.0, 1.0, 0.0),
        (5, "01/22/2020", "Hubei", "Mainland China", "2020-01-22 12:00:00", 10.0, 2.0, 0.0), (6, "01/22/2020", None, "China", "2020-01-22 12:00:00", 3.0, 0.0, 0.0),
        (7, "01/22/2020", None, "Diamond Princess", None, 6.0, 0.0, 0.0), (8, "bad", None, "US", None, 99.0, 0.0, 0.0),
    ]
    return spark.createDataFrame(rows, "SNo int, ObservationDate string, province_raw string, country_region string, last_update_raw string, Confirmed double, Deaths double, Recovered double")


def test_cumulative_reports(spark):
    out = {(r["location_key"], r["date"]): r for r in cleaning.cumulative_reports(reports(spark), mapping(spark)).collect()}
    us = [out[("USA", date(2020, 1, d))] for d in (22, 23, 24)]
    assert [r["total_cases"] for r in us] == [1.0, 7.0, 4.0]
    assert [r["new_cases_raw"] for r in us] == [1.0, 6.0, -3.0]
    assert [r["new_cases_clean"] for r in us] == [1.0, 6.0, 0.0]
    assert [r["is_negative_case_correction"] for r in us] == [False, False, True]
    assert out[("CHN", date(2020, 1, 22))]["total_cases"] == 13.0
    assert out[("UNMAPPED:Diamond Princess", date(2020, 1, 22))]["location_code"] is None
    assert len(out) == 5


def test_validation_series_prefers_provinces(spark):
    rows = {(r["location_code"], r["date"]): r["total_cases"] for r in cleaning.validation_series(reports(spark), mapping(spark)).collect()}
    assert rows == {("USA", date(2020, 1, 22)): 1.0, ("USA", date(2020, 1, 23)): 7.0, ("USA", date(2020, 1, 24)): 4.0, ("CHN", date(2020, 1, 22)): 13.0}


def test_name_mapping_rows(spark):
    raw = spark.createDataFrame(
        [("US", "United States", "United States", "usa", "true", ""), ("UK", "United Kingdom", "United Kingdom", "GBR", "True", ""), ("Others", "", "Others", "XXX", "false", "cruise")],
        schema.NAME_MAPPING_SCHEMA,
    )
    rows = {r["name"]: (r["mapped_code"], r["mapping_enabled"]) for r in readers.name_mapping(raw).collect()}
    assert rows == {"US": ("USA", True), "UK": ("GBR", True), "Others": (None, False)}


def test_published_series_fills_from_total_and_flags_before_clipping(spark):
    raw = spark.createDataFrame(
        [("A", "2020-01-01", "aaa", 5.0, None, -2.0), ("A", "2020-01-02", "aaa", 9.0, None, 1.0), ("A", "2020-01-03", "aaa", 8.0, -1.0, None), ("B", "2020-01-01", "b1", 1.0, 1.0, None)],
        "country string, date string, code string, total_cases double, new_cases double, new_deaths double",
    )
    rows = cleaning.published_series(raw, None, "2020-01-01", "2020-12-31").orderBy("date").collect()
    assert [r["value"] for r in rows] == [None, 4.0, 0.0]
    assert [r["quality_flag"] for r in rows] == ["ok", "ok", "negative_revision_clipped"]
    assert [r["is_negative_death_correction"] for r in rows] == [True, False, False]
    assert [r["new_deaths"] for r in rows] == [0.0, 1.0, None]
    assert tuple(rows[0].asDict()) == schema.OBSERVATION_COLUMNS


def test_hourly_weather_golden(spark):
    stamps = ["2012-01-01 00:00:00", "2012-06-01 00:00:00", "2013-01-01 00:00:00"]
    values = {"temperature": [283.15, 285.15, 293.15], "humidity": [50.0, 60.0, 70.0], "pressure": [1000.0, 1010.0, 1020.0], "wind_speed": [3.0, 4.0, 5.0]}
    matrices = {
        name: spark.createDataFrame([(s, x, 999.0) for s, x in zip(stamps, xs)], "at string, `New York` double, Vancouver double")
        .withColumn("at", F.to_timestamp("at")).withColumnRenamed("New York", "ny")
        for name, xs in values.items()
    }
    annual = cleaning.hourly_weather(matrices, "at", {"USA": ["ny"]}, "annual").orderBy("year").collect()
    daily = cleaning.hourly_weather(matrices, "at", {"USA": ["ny"]}, "daily").orderBy("date").collect()
    assert [(r["year"], r["temperature_mean"], r["date"]) for r in annual] == [(2012, 11.0, date(2012, 12, 31)), (2013, 20.0, date(2013, 12, 31))]
    assert [r["temperature_mean"] for r in daily] == [10.0, 12.0, 20.0]
    assert [r["temperature_mean_observations"] for r in daily] == [1, 1, 1]
    assert daily[0]["temperature_min"] == 10.0 and daily[0]["pressure_mean_hpa"] == 1000.0 and daily[0]["wind_speed_max"] == 3.0


def test_report_pages_golden(spark, tmp_path):
    record = {
        "page_url": "https://example.test/report.html", "title": "站点", "anchor_title": "2026年第27周第916期中国流感监测周报", "published_date": "2026-07-09",
        "downloaded_at": "2026-07-10T00:00:00+00:00", "local_html_path": "html\\report.html", "attachment_urls": ["https://example.test/report.pdf"],
        "local_attachment_paths": ["attachments\\report.pdf"], "text_preview": "全国共报告7起流感样病例暴发疫情。南方省份哨点医院报告的ILI%为5.8%。",
    }
    later = {**record, "downloaded_at": "2026-07-10T01:00:00+00:00", "published_date": "2026-07-08"}
    (tmp_path / "pages.jsonl").write_text("\n".join([json.dumps(record, ensure_ascii=False), "{broken", "", json.dumps(later, ensure_ascii=False)]), encoding="utf-8")
    lines = readers.read_json_lines(spark, str(tmp_path / "pages.jsonl"), schema.REPORT_PAGE_SCHEMA)
    assert lines.where("_corrupt_record IS NOT NULL").count() == 1 and lines.count() == 3
    inventory = spark.createDataFrame([("html/report.html",), ("attachments/report.pdf",)], "path string")
    rows = cleaning.report_pages(lines, inventory).collect()
    assert len(rows) == 1
    row = rows[0]
    assert row["report_category"] == "Influenza surveillance" and row["disease"] == "Influenza"
    assert (row["report_week"], row["stat_period"], row["reported_ili_outbreaks"], row["south_ili_percent"]) == (27, "2026-W27", 7, 5.8)
    assert row["attachments_complete"] and row["local_html_exists"] and row["published_date"] == date(2026, 7, 8)
    missing = cleaning.report_pages(lines, inventory.where("path LIKE 'html%'")).first()
    assert not missing["attachments_complete"] and missing["existing_attachment_count"] == 0


def indicator(code, name, year, value, record_id, topic, low=None, high=None, dim=None, updated=None):
    raw = {"Id": record_id, "SpatialDim": "AUS", "Dim1Type": dim[0] if dim else None, "Dim1": dim[1] if dim else None, "Date": updated}
    text = None if value is None else str(value)
    fields = ("GHO", code, code, name, "AUS", None, "COUNTRY", str(year), text or "No data", text, low, high, None, None, None, None, json.dumps(raw))
    return (*fields, f"who_{topic}_{code}_20260711T000000Z.csv", topic, code)


def indicator_frame(spark, rows):
    names = [*schema.INDICATOR_COLUMNS, "source_file", "topic", "indicator"]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_indicator_catalog_golden(spark):
    tb = ("MDG_0000000017", "Deaths due to tuberculosis among HIV-negative people (per 100 000 population)", 2020, 0.3, 4)
    raw = indicator_frame(spark, [
        indicator("HIV_0000000026", "Number of new HIV infections", 2020, 100.0, 1, "hiv", "80.0", "120.0"), indicator("HIV_0000000026", "Number of new HIV infections", 2021, None, 2, "hiv"),
        indicator("MDG_0000000029", "Prevalence of HIV among adults aged 15 to 49 (%)", 2020, 0.2, 3, "hiv"), indicator(*tb, "tuberculosis"), indicator(*tb, "hiv"),
        indicator("TB_1", "Tuberculosis treatment coverage", 2020, 75.0, 5, "tuberculosis"), indicator("TB_c_newinc", "Tuberculosis - new and relapse cases", 2020, 1400.0, 6, "tuberculosis"),
        indicator("EMFLIMITMAGNETIC", "Magnetic flux density (microT)", 2018, 50.0, 7, "influenza", dim=("SEX", "SEX_MLE")),
    ])
    catalog = cleaning.indicator_catalog(raw, spark.createDataFrame([("AUS",)], "location_code string"), 2026)
    rows = {(r["indicator_code"], r["year"]): r for r in catalog.collect()}
    assert len(rows) == 7
    double = rows[("MDG_0000000017", 2020)]
    assert (double["duplicate_source_count"], double["duplicate_content_variant_count"], double["duplicate_content_conflict"]) == (2, 1, False)
    assert "who_hiv_MDG_0000000017" in double["duplicate_source_files"] and "who_tuberculosis_MDG_0000000017" in double["duplicate_source_files"]
    assert double["collector_topic"] == "tuberculosis"
    false_hit = rows[("EMFLIMITMAGNETIC", 2018)]
    assert false_hit["usage_class"] == "keyword_false_positive" == false_hit["quality_flag"] and false_hit["sex"] == "SEX_MLE"
    assert rows[("HIV_0000000026", 2021)]["quality_flag"] == "non_numeric_reference"
    places = spark.createDataFrame([("AUS", "Australia")], "location_code string, location string")
    primary = cleaning.primary_observations(catalog, places).collect()
    assert [(r["value"], r["hiv_prevalence_adults_percent"], r["location"], r["quality_flag"]) for r in primary] == [(100.0, 0.2, "Australia", "who_estimate_with_interval")]
    auxiliary = cleaning.auxiliary_indicators(catalog).collect()
    assert len(auxiliary) == 1 and auxiliary[0]["who_tb_new_relapse_cases"] == 1400.0 and auxiliary[0]["who_tb_treatment_coverage_percent"] == 75.0
    assert sum(1 for c in auxiliary[0].asDict() if c.startswith("who_tb_")) == 3 * len(schema.AUXILIARY_INDICATORS)
    report = {r["metric"]: r["value"] for r in quality.catalog_report(catalog, cleaning.primary_observations(catalog, places), cleaning.auxiliary_indicators(catalog), 2026).collect()}
    assert (report["input_rows"], report["duplicate_rows_removed"], report["primary_no_data_rows"], report["primary_observation_rows"]) == (8, 1, 1, 1)
    audit = sinks.duplicate_audit(catalog).collect()
    assert len(audit) == 1 and list(audit[0].asDict()) == list(sinks.DUPLICATE_AUDIT_COLUMNS)


def test_indicator_conflict_keeps_latest(spark):
    raw = indicator_frame(spark, [
        indicator("TB_1", "Tuberculosis treatment coverage", 2020, 75.0, 5, "tuberculosis", updated="2024-01-01T00:00:00"),
        indicator("TB_1", "Tuberculosis treatment coverage", 2020, 80.0, 5, "hiv", updated="2025-01-01T00:00:00"),
    ])
    row = cleaning.indicator_catalog(raw, spark.createDataFrame([("AUS",)], "location_code string"), 2026).first()
    assert row["numeric_value_clean"] == 80.0 and row["quality_flag"] == "duplicate_content_conflict_latest_kept"


def test_weekly_hospital_uses_the_national_row_only(spark):
    raw = spark.createDataFrame(
        [("2024-01-06", "USA", 100.0, -5.0), ("2024-01-06", "OH", 60.0, 1.0), ("2024-01-13", "USA", None, 7.0)],
        "`Week Ending Date` string, `Geographic aggregation` string, `Total Influenza Admissions` double, `Total RSV Admissions` double",
    )
    rows = {(r["disease"], r["date"]): (r["value"], r["quality_flag"]) for r in cleaning.weekly_hospital(raw).collect()}
    assert rows == {
        ("Influenza", date(2024, 1, 6)): (100.0, "ok"), ("RSV", date(2024, 1, 6)): (0.0, "negative_revision_clipped"), ("RSV", date(2024, 1, 13)): (7.0, "ok"),
    }


def test_population_interpolates_inside_only(spark):
    first = spark.createDataFrame([("AAA", "A", 2000, 100.0), ("AAA", "A", 2004, 140.0)], "location_code string, location string, year int, population double")
    second = spark.createDataFrame([("aaa ", "A", 2004, 180.0)], "location_code string, location string, year int, population double")
    rows = cleaning.yearly_population([first, second], (1998, 2006)).orderBy("year").collect()
    assert [(r["year"], r["population"], r["population_is_interpolated"]) for r in rows] == [
        (2000, 100.0, False), (2001, 120.0, True), (2002, 140.0, True), (2003, 160.0, True), (2004, 180.0, False),
    ]


def test_canonical_key_is_unique_and_later_source_wins(spark):
    rows = [("AAA", "X", date(2020, 1, 1), 1.0, "a"), ("AAA", "X", date(2020, 1, 2), 2.0, "a")]
    a = spark.createDataFrame(rows, "location_code string, disease string, date date, value double, source string")
    b = spark.createDataFrame([("AAA", "X", date(2020, 1, 2), 9.0, "b", 1)], "location_code string, disease string, date date, value double, source string, extra int")
    out = {r["date"]: (r["value"], r["extra"]) for r in cleaning.canonical([a, b]).collect()}
    assert out == {date(2020, 1, 1): (1.0, None), date(2020, 1, 2): (9.0, 1)}


def observations(spark):
    days = [("AAA", "X", date(2020, 3, 1) + timedelta(days=i), "daily", "new_cases", float(i)) for i in range(10)]
    weeks = [("AAA", "Y", date(2020, 3, 7) + timedelta(days=7 * i), "weekly", "hospital_admissions", 5.0) for i in range(3)]
    years = [("AAA", "Z", date(2020, 12, 31), "annual", "incidence_per_100k", 4.0), ("BBB", "Z", date(2020, 12, 31), "annual", "incidence_per_100k", 4.0)]
    df = spark.createDataFrame([*days, *weeks, *years], "location_code string, disease string, date date, frequency string, metric string, value double")
    return cleaning.observation(df, source="t", quality_flag="ok")


def covariates(spark):
    rows = [("AAA", date(2020, 3, 1) + timedelta(days=i), float(i), 50.0) for i in range(14)]
    df = spark.createDataFrame(rows, "location_code string, date date, temperature_mean double, relative_humidity_mean double")
    return df.withColumns({c: F.lit(1.0) for c in schema.WEATHER_VALUES if c not in df.columns})


def test_multi_frequency_features(spark):
    population = spark.createDataFrame([("AAA", 2019, 1000.0), ("AAA", 2021, 5.0)], "location_code string, year int, population double")
    catalog = spark.createDataFrame([("AAA", "Aland", "City", 1.0, 2.0)], "location_code string, location string, representative_city string, latitude double, longitude double")
    archive = spark.createDataFrame([("AAA", "annual", date(2020, 12, 31), 99.0, 1.0, "historical", "archive")],
                                    "location_code string, frequency string, join_date date, temperature_mean double, relative_humidity_mean double, weather_match_level string, weather_source string")
    out = gold.build_features(observations(spark), covariates(spark), population, catalog, archive)
    rows = {(r["location_code"], r["disease"], r["date"]): r for r in out.collect()}
    assert len(rows) == 15
    day, week = rows[("AAA", "X", date(2020, 3, 3))], rows[("AAA", "Y", date(2020, 3, 7))]
    assert (day["temperature_mean"], day["weather_match_level"], day["population"]) == (2.0, "exact_day", 1000.0)
    assert (week["temperature_mean"], week["weather_match_level"]) == (3.0, "weekly_mean_to_saturday")
    year, lost = rows[("AAA", "Z", date(2020, 12, 31))], rows[("BBB", "Z", date(2020, 12, 31))]
    assert (year["temperature_mean"], year["weather_source"], year["cases_per_million"]) == (99.0, "archive", 40.0)
    assert (lost["weather_match_level"], lost["has_weather"], lost["population"]) == ("unmatched", False, None)
    assert set(schema.FEATURE_COLUMNS) <= set(out.columns)
    assert day["cases_per_million"] == 2000.0 and day["location"] == "Aland"


def test_leak_guard():
    gold.check_no_leak()
    with pytest.raises(ValueError):
        gold.check_no_leak((*schema.FEATURE_COLUMNS, "target_t_plus_7"))


def test_risk_golden(spark):
    rows = [
        ("AAA", "COVID-19", 1.0, 1.0, 1.0, 1.0, 0.0), ("BBB", "COVID-19", 3.0, 3.0, 4.0, 3.0, 0.2), ("CCC", "COVID-19", 8.0, 8.0, 10.0, 8.0, 0.5), ("USA", "Influenza", 2.0, 2.0, 2.0, 2.0, 0.1),
    ]
    df = spark.createDataFrame(rows, "location_code string, disease string, cases_per_million double, value double, prediction_t_plus_7 double, rolling_mean_7 double, growth_rate_7 double")
    old = df.withColumns({"date": F.lit(date(2025, 12, 30)), "value": F.lit(500.0), "cases_per_million": F.lit(500.0)})
    out = {r["location_code"]: r for r in risk.risk_score(risk.latest_rows(df.withColumn("date", F.lit(date(2025, 12, 31))).unionByName(old))).collect()}
    assert [out[c]["risk_score"] for c in ("AAA", "BBB", "CCC")] == [0.0, 32.38, 100.0]
    assert out["CCC"]["risk_level"] == "高风险" and all(out[c]["risk_comparable"] for c in ("AAA", "BBB", "CCC"))
    assert (out["USA"]["risk_score"], out["USA"]["risk_level"], out["USA"]["risk_comparable"]) == (0.0, "不可比较", False)


def test_source_status_golden(spark):
    rows = [(name, rule, 27 if rule == "index" else 1887, 96) for name, _, rule in schema.SOURCE_STATUS_ITEMS]
    parts = spark.createDataFrame(rows, "name string, rule string, rows long, primary_rows long")
    status = {r["name"]: r["status"] for r in quality.source_status(parts).collect()}
    assert "warn" not in status.values() and list(status.values()).count("info") == 1
    empty = quality.source_status(parts.withColumn("rows", F.lit(0))).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in empty} == {"ok": 6, "warn": 2, "not_configured": 1}
    no_primary = quality.source_status(parts.withColumn("primary_rows", F.lit(0))).where("rule = 'catalog'").first()
    assert no_primary["status"] == "info"


def feature_series(spark, codes=("CHN", "USA"), n=180, frequency="daily", step=1, skip=()):
    rows = []
    for k, code in enumerate(codes):
        for i in range(n):
            if i not in skip:
                rows.append((code, "D", date(2020, 1, 4) + timedelta(days=i * step), frequency, float(i + 10 * k)))
    df = spark.createDataFrame(rows, "location_code string, disease string, date date, frequency string, value double")
    return df.withColumn("new_cases_smoothed", F.col("value") + 1000)


def test_sequence_partitions_are_chronological(spark):
    rows = forecasting.sequence_set(feature_series(spark), 28)
    forecasting.require_partitions(rows)
    spans = {r["split"]: (r["lo"], r["hi"]) for r in rows.groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).collect()}
    assert spans["train"][1] < spans["validation"][0] <= spans["validation"][1] < spans["test"][0]
    assert rows.where("size(input_window) <> 28").count() == 0 and rows.where("split = 'forecast_only'").count() == 14


def test_weekly_sequence_gap(spark):
    df = feature_series(spark, ("USA",), 60, "weekly", 7, skip=(20,))
    counters = forecasting.sequence_counters(df, 8, "weekly", "value", 1).first()
    assert (counters["calendar_rows_inserted"], counters["input_values_imputed"], counters["windows_skipped"]) == (1, 1, 0)
    rows = forecasting.sequence_set(df, 8, "weekly", 1, 1)
    assert rows.where(F.col("date") == F.lit(date(2020, 1, 4) + timedelta(days=7 * 19))).first()["target"] is None
    assert rows.agg(F.max("current_value")).first()[0] <= 60 and rows.agg(F.max("target")).first()[0] <= 60
    assert {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "validation", "test", "forecast_only"}


def test_scaler_counts_a_value_once_per_window(spark):
    rows = forecasting.sequence_set(feature_series(spark, n=60), 5, "daily", 7, 3, "value")
    windows_ = np.array([r["input_window"] for r in rows.where("split = 'train'").collect()])
    got = forecasting.log_scaler(rows).first()
    assert got["mean"] == pytest.approx(np.log1p(windows_).mean()) and got["std"] == pytest.approx(np.log1p(windows_).std())
    one = forecasting.standardise(rows).first()
    assert one["input_scaled"][0] == pytest.approx((math.log1p(one["input_window"][0]) - got["mean"]) / got["std"])


def test_empty_partition_is_an_error(spark):
    rows = forecasting.time_split(feature_series(spark, n=2))
    with pytest.raises(ValueError, match="validation"):
        forecasting.require_partitions(rows)


def test_baseline_test_rows_of_a_single_date(spark):
    df = spark.createDataFrame([(f"L{i:02d}", "D", date(2020, 1, 1), "annual", 1.0, 1.0, 1.0, 2.0) for i in range(20)],
                               "location_code string, disease string, date date, frequency string, value double, new_cases_smoothed double, rolling_mean_7 double, target_t_plus_7 double")
    assert sorted(r["location_code"] for r in forecasting.baseline_test_rows(df).collect()) == ["L17", "L18", "L19"]


def gold_points(spark):
    rows = [("CHN", "COVID-19", date(2025, 1, i), "daily", 10.0 * (i % 3), 11.0, 14.0, 12.0, 13.0, 7, 0.1) for i in range(1, 6)]
    return spark.createDataFrame(rows, "location_code string, disease string, date date, frequency string, value double, rolling_mean_7 double, target_t_plus_7 double, prediction_gbt double, prediction_lstm double, horizon_steps int, growth_rate_7 double")


def test_trend_and_predictions_use_the_selected_model(spark):
    df = gold_points(spark)
    row = serving.trend(df, "chn", "covid-19", model="lstm").orderBy("date").first()
    assert (row["prediction"], row["forecast_target_date"]) == (13.0, date(2025, 1, 8))
    assert row["lower"] == pytest.approx(11.05) and row["upper"] == pytest.approx(14.95)
    naive = serving.trend(df, "CHN", "COVID-19", model="naive_last_value").orderBy("date").first()
    assert (naive["prediction"], naive["lower"], naive["upper"]) == (10.0, None, None)
    prediction = serving.predictions(df, model="lstm").first()
    assert (prediction["prediction"], prediction["error"]) == (13.0, -1.0)
    with pytest.raises(serving.ValidationError):
        serving.trend(df, "CHN", "COVID-19", model="nope")


def test_question_arguments(spark):
    df = gold_points(spark)
    catalog = spark.createDataFrame([("CHN", "China"), ("USA", "United States")], "location_code string, location string")
    assert serving.resolve_location(catalog, " china ") == "CHN" and serving.resolve_location(catalog, "usa") == "USA"
    with pytest.raises(serving.ValidationError):
        serving.resolve_location(catalog, "Atlantis")
    with pytest.raises(serving.ValidationError):
        serving.filter_series(df, start="2025-02-01", end="2025-01-01")
    with pytest.raises(serving.ValidationError):
        serving.filter_series(df, start="01/02/2025")
    assert serving.filter_series(df, "CHN", "COVID-19", "2025-01-02", "2025-01-03").count() == 2


def test_weather_correlation_falls_back_to_the_full_range(spark):
    df = gold_points(spark).withColumns({
        "temperature_mean": F.dayofmonth("date").cast("double"), "relative_humidity_mean": F.lit(50.0), "new_cases_smoothed": F.dayofmonth("date") * 2.0,
    })
    inside = serving.weather_correlation(df, start="2025-01-01", end="2025-01-04").first()
    assert (inside["sample_size"], inside["temperature_correlation"], inside["humidity_correlation"], inside["fallback_used"]) == (4, 1.0, None, False)
    outside = serving.weather_correlation(df, start="2024-01-01", end="2024-02-01").first()
    assert (outside["sample_size"], outside["fallback_used"], outside["matched_start"]) == (5, True, date(2025, 1, 1))


def test_reporting_profile(spark):
    rows = [("A", date(2025, 1, 1), 0.0), ("A", date(2025, 1, 2), 5.0), ("A", date(2025, 1, 3), 0.0), ("B", date(2025, 1, 1), 0.0), ("B", date(2025, 1, 4), 0.0)]
    df = spark.createDataFrame(rows, "k string, date date, v double")
    got = {r["k"]: (r["expected_calendar_days"], r["date_gap_count"], r["zero_day_share"], r["sparse_reporting"]) for r in quality.reporting_profile(df, ["k"], "date", "v").collect()}
    assert got == {"A": (3, 0, 0.6667, True), "B": (4, 2, 1.0, False)}


def test_latest_files_and_tolerant_reading(spark, tmp_path):
    names = ["who_hiv_A_1_20260101T000000Z.csv", "who_hiv_A_1_20260201T000000Z.csv", "who_covid_B_20260101T000000Z.csv", "notes.csv"]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    kept = readers.latest_files(files, "file_name", schema.INDICATOR_FILE_PATTERN, [1, 2], 3)
    assert sorted(r["file_name"] for r in kept.collect()) == sorted([names[1], names[2], names[3]])
    assert readers.stale_file_count(files, kept).first()["stale_file_count"] == 1
    (tmp_path / "a.csv").write_text("x,y,z\n1,abc,3\n")
    (tmp_path / "b.csv").write_text("x\n2\n")
    (tmp_path / "c.csv").write_text("y\n2\n")
    rows, rejected = readers.read_tolerant(spark, [str(tmp_path / f"{n}.csv") for n in "abc"], {"x": "int", "y": "double"}, ["x"])
    assert sorted((r["x"], r["y"]) for r in rows.collect()) == [(1, None), (2, None)]
    assert [p.rsplit("/", 1)[1] for p in rejected] == ["c.csv"]


def test_read_latest_drops_superseded_files(spark, tmp_path):
    for stamp, value in (("20260101T000000Z", 1), ("20260201T000000Z", 2)):
        (tmp_path / f"who_hiv_A_{stamp}.csv").write_text(f"v\n{value}\n")
    from pyspark.sql import types as T

    rows = readers.read_latest(spark, str(tmp_path), schema.INDICATOR_FILE_PATTERN, T.StructType([T.StructField("v", T.IntegerType())]), [1, 2], 3)
    assert [(r["v"], r["topic"], r["indicator"]) for r in rows.collect()] == [(2, "hiv", "A")]


def test_arrays_to_rows_pads_short_arrays(spark):
    df = spark.createDataFrame([("A", ["2020-01-01", "2020-01-02"], [1.0], None)], "code string, time array<string>, temperature_2m_mean array<double>, precipitation_sum array<double>")
    rows = readers.arrays_to_rows(df, ["code"], "time", ["temperature_2m_mean", "precipitation_sum"], schema.WEATHER_API_NAMES).orderBy("date").collect()
    assert [(r["date"], r["temperature_mean"], r["precipitation_sum"]) for r in rows] == [("2020-01-01", 1.0, None), ("2020-01-02", None, None)]


def test_partitioned_overwrite_is_dynamic(spark, tmp_path):
    path = str(tmp_path / "silver")
    df = spark.createDataFrame([("A", 1), ("B", 2)], "k string, v int")
    sinks.write_partitioned(df, path, ["k"])
    sinks.write_partitioned(spark.createDataFrame([("B", 9)], "k string, v int"), path, ["k"])
    assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == {"A": 1, "B": 9}


def test_json_has_null_for_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, v double")
    assert sorted(r["document"] for r in sinks.as_json(df).collect()) == ['{"k":1,"v":null}', '{"k":2,"v":3.0}']


def test_kept_things_follow_their_inputs(spark, tmp_path):
    import glob
    import os

    from epitide.sources import scratch

    source, calls = str(tmp_path / "in"), []

    def read():
        def write(path):
            calls.append(1)
            spark.read.parquet(source).write.parquet(path)

        return scratch.kept(spark, "t", [source], write)

    spark.range(3).write.parquet(source)
    assert spark.read.parquet(read()).count() == 3 and spark.read.parquet(read()).count() == 3 and len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(source)  # changed input
    path = read()
    assert spark.read.parquet(path).count() == 5 and len(calls) == 2
    os.remove(glob.glob(f"{path}/part-*")[0])  # a lost file
    assert spark.read.parquet(read()).count() == 5 and len(calls) == 3


def test_a_cluster_without_a_shared_folder_fails():
    from types import SimpleNamespace

    from epitide.sources import scratch

    def session(master):
        conf = {"spark.master": master}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(applicationId="x"))

    for master in ("local-cluster[2,1,1024]", "spark://h:7077", "yarn"):
        with pytest.raises(ValueError):
            scratch.shared_dir(session(master), "t")
    assert scratch.shared_dir(session("local[4]"), "t").startswith("/tmp/spark-")


def test_quoted_csv_by_header(spark, tmp_path):
    """Doubled quotes, commas in quotes, swapped columns, a backslash, and line breaks where asked for."""
    from epitide.sources import sinks

    (tmp_path / "a.csv").write_text('name,code,raw_json\nAland,1,"{""Id"": 1, ""x"": ""a\\b""}"\n')
    (tmp_path / "b.csv").write_text('raw_json,name,extra,code\n"{""Id"": 2}","B, land",zz,2\n')
    layout = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("raw_json", T.StringType())])
    rows = readers.read_csv(spark, str(tmp_path / "*.csv"), layout).orderBy("code").collect()
    assert [tuple(r) for r in rows] == [(1, "Aland", '{"Id": 1, "x": "a\\b"}'), (2, "B, land", '{"Id": 2}')]
    out = str(tmp_path / "out")
    sinks.write_csv(spark.createDataFrame(rows), out)
    import csv
    import glob

    back = [r for f in glob.glob(f"{out}/*.csv") for r in csv.DictReader(open(f, newline=""))]
    assert sorted(r["raw_json"] for r in back) == sorted(r["raw_json"] for r in rows)
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "a.csv"), T.StructType([T.StructField("absent", T.StringType())]))
    (tmp_path / "c.csv").write_text('code,name,raw_json\n3,"two\nlines",\n')
    assert readers.read_csv(spark, str(tmp_path / "c.csv"), layout, multi_line=True).first()["name"] == "two\nlines"


def test_no_ranking_or_series_is_cut(spark):
    from epitide.operators import reshape

    df = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("k"), ((F.col("id") * 7919) % 3000).cast("double").alias("x"))
    rows = reshape.rankings(df, {"x": "x"}, ["k"]).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(1, 3001)) and [r["x"] for r in rows] == [float(x) for x in range(2999, -1, -1)]
    series = spark.range(3000).select(F.lit("AAA").alias("location_code"), F.lit("COVID-19").alias("disease"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("date"), *(
        F.lit(x).alias(c) for c, x in (("frequency", "daily"), ("metric", "m"), ("source", "s"), ("value", 1.0), ("rolling_mean_7", 1.0), ("growth_rate_7", 0.0), ("target_t_plus_7", 1.0))))
    assert serving.trend_documents(series, None).selectExpr("size(points)").first()[0] == 3000


def test_correlation_takes_complete_pairs_and_null_is_not_empty(spark):
    from epitide.operators import aggregates

    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (None, 4.0), (2.0, 5.0)], "a double, b double")
    assert df.agg(aggregates.safe_corr("a", "b").alias("c")).first()["c"] is None
    more = df.unionByName(spark.createDataFrame([(3.0, 8.0), (4.0, None)], "a double, b double"))
    assert more.agg(aggregates.safe_corr("a", "b").alias("c")).first()["c"] == 1.0
    rows = spark.createDataFrame([("a", None), ("a", ""), ("a", "")], "x string, y string")
    assert aggregates.duplicate_rows(rows).first()["duplicate_rows"] == 1


def test_scratch_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/spark-"
    assert scratch.shared_dir(spark, "x").startswith(root)
    out = scratch.materialise(spark.range(5), "numbers")
    assert out.count() == 5 and root in out.inputFiles()[0]


def test_year_grid_and_hospital_percent(spark):
    df = spark.createDataFrame([("A", 2001, 1.0)], "k string, year int, v double")
    assert [(r["year"], r["v"]) for r in joins.year_grid(df, ["k"], "year", 2000, 2002).orderBy("year").collect()] == [(2000, None), (2001, 1.0), (2002, None)]
    wide = spark.createDataFrame([(0.5, 60.0)], "`Percent A` double, `Percent B` double")
    assert tuple(cleaning.percent_columns(wide).first()) == (50.0, 60.0)
