"""Registered queries: projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from epitide import schema
from epitide.catalog.registry import Registry
from epitide.functions import calendar, measures, records, text
from epitide.operators import aggregates
from epitide.plans import serving

Q = Registry()
ALIAS_TEXT = "case event_type when 'click' then ' flu ' when 'view' then 'tb' when 'error' then '新冠肺炎' when 'signup' then 'Unknown X ' else '  ' end"


@Q.add("sca01_blank_to_null", """select p_partkey, nullif(trim(case when p_size < 5 then '   ' else '  ' || p_name || ' ' end), '') as name from part""")
def _(v):
    padded = F.when(F.col("p_size") < 5, "   ").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" ")))
    return v.table("part").select("p_partkey", text.blank_to_null(padded).alias("name"))


@Q.add("sca02_iso3", """select c_custkey, case when regexp_full_match(code, '[A-Z]{3}') then code end as location_code
    from (select c_custkey, upper(trim(case when c_acctbal < 0 then c_name else ' na' || chr(97 + c_nationkey) || ' ' end)) as code from customer)""")
def _(v):
    raw = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(
        F.concat(F.lit(" na"), F.char((F.col("c_nationkey") + 97).cast("long")), F.lit(" "))
    )
    return v.table("customer").select("c_custkey", text.iso3(raw).alias("location_code"))


@Q.add("sca03_date_fixed_format", """select o_orderkey, cast(try_strptime(case when o_orderstatus = 'P' then 'n/a' else strftime(o_orderdate, '%m/%d/%Y') end, '%m/%d/%Y') as date) as date from orders""")
def _(v):
    raw = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    return v.table("orders").select("o_orderkey", text.parse_date(raw, "MM/dd/yyyy").alias("date"))


@Q.add("sca04_date_mixed_formats", """select o_orderkey, case when o_orderpriority = '5-LOW' then null else cast(o_orderdate as date) end as date from orders""")
def _(v):
    raw = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format("o_orderdate", "yyyy/M/d"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format("o_orderdate", "M/d/yyyy"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("soon"))
    )
    return v.table("orders").select("o_orderkey", text.parse_date(raw, *schema.RAW_DATE_FORMATS).alias("date"))


@Q.add("sca05_timestamp_parse", """select event_id, case when event_type = 'error' then null else date_trunc('second', ts) end as at from events""")
def _(v):
    raw = F.when(F.col("event_type") == "error", "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return v.table("events").select("event_id", text.parse_timestamp(raw).cast("timestamp_ntz").alias("at"))


@Q.add("sca06_number_parse", """select p_partkey, case when p_type = 'PROMO' then null else p_retailprice end as price from part""")
def _(v):
    raw = F.when(F.col("p_type") == "PROMO", "No data").otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string")))
    return v.table("part").select("p_partkey", text.parse_number(raw).alias("price"))


@Q.add("sca07_number_with_separators", """select l_orderkey, l_linenumber, l_extendedprice as price, l_partkey from lineitem""")
def _(v):
    raw = F.format_number("l_extendedprice", 2)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", text.parse_grouped_number(raw).alias("price"), "l_partkey")


@Q.add("sca08_negative_clip", """select l_orderkey, l_linenumber, l_partkey, raw, case when raw < 0 then 0.0 else raw end as clean, coalesce(raw < 0, false) as is_negative
    from (select *, case when l_returnflag = 'R' then -l_quantity when l_returnflag = 'A' and l_linestatus = 'O' then null else l_quantity end as raw from lineitem)""")
def _(v):
    raw = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).when(
        ~((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")), F.col("l_quantity")
    )
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw"))
    return measures.clip_negative(rows, "raw", "clean", "is_negative")


@Q.add("sca09_quality_flag", """select l_orderkey, l_linenumber, l_partkey, case when l_quantity < 5 then 'invalid_year' when year(l_shipdate) > 2000 then 'future_year'
    when l_returnflag = 'R' then 'keyword_false_positive' when l_tax = 0 then 'non_numeric_reference' else 'ok' end as quality_flag from lineitem""")
def _(v):
    rules = [
        (F.col("l_quantity") < 5, "invalid_year"), (F.year("l_shipdate") > 2000, "future_year"),
        (F.col("l_returnflag") == "R", "keyword_false_positive"), (F.col("l_tax") == 0, "non_numeric_reference"),
    ]
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", measures.quality_flag(rules).alias("quality_flag"))


@Q.add("sca10_fallback_fill", """select d.doc_id, coalesce(l.quality, d.n_chars) as score from documents d left join labels l on l.doc_id = d.doc_id""")
def _(v):
    docs, labels = v.table("documents").select("doc_id", "n_chars"), v.table("labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("long"), "n_chars").alias("score"))


@Q.add("sca11_to_percent", """select l_orderkey, l_linenumber, l_partkey, round(case when x > 1 then x else x * 100 end, 4) as percent
    from (select *, case when l_linestatus = 'O' then l_discount else l_discount * 100 end as x from lineitem)""")
def _(v):
    x = F.when(F.col("l_linestatus") == "O", F.col("l_discount")).otherwise(F.col("l_discount") * 100)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(measures.to_percent(x), 4).alias("percent"))


@Q.add("sca12_kelvin_to_celsius", "select p_partkey, cast(round(p_size + 273.15 - 273.15, 4) as double) as celsius from part")
def _(v):
    return v.table("part").select("p_partkey", F.round(measures.kelvin_to_celsius(F.col("p_size") + F.lit(273.15)), 4).alias("celsius"))


@Q.add("sca13_per_million", """select t.location_code, t.date, round(case when t.n > 3 then day_total * 10.0 else day_total / nullif(case when t.n = 2 then 0 else p.population end, 0) * 1000000.0 end, 4) as rate
    from v_totals t left join v_population p on p.location_code = t.location_code and p.year = year(t.date)""")
def _(v):
    rows = v.totals_daily.withColumn("year", F.year("date")).join(v.population, ["location_code", "year"], "left")
    population = F.when(F.col("n") == 2, F.lit(0.0)).otherwise(F.col("population"))
    metric = F.when(F.col("n") > 3, "incidence_per_100k").otherwise("new_cases")
    return rows.select("location_code", "date", F.round(measures.per_million("day_total", population, metric), 4).alias("rate"))


@Q.add("sca14_growth", """select location_code, disease, date, round((value - p) / greatest(abs(p), 1.0), 4) as growth
    from (select *, lag(value, 3) over (partition by location_code, disease order by date) as p from v_series) where p is not null
    union all select location_code, disease, date, null from (select *, lag(value, 3) over (partition by location_code, disease order by date) as p from v_series) where p is null""")
def _(v):
    from epitide.operators import windows

    rows = windows.lags(v.series_daily, ["location_code", "disease"], "date", "value", (3,))
    return rows.select("location_code", "disease", "date", F.round(measures.growth("value", "lag_3"), 4).alias("growth"))


@Q.add("sca15_calendar_features", """select o_orderkey, year(o_orderdate) as year, month(o_orderdate) as month, isodow(o_orderdate) as day_of_week,
    case when isodow(o_orderdate) >= 6 then 1 else 0 end as is_weekend from orders""")
def _(v):
    return v.table("orders").select("o_orderkey", *(c.alias(n) for n, c in calendar.calendar_features(F.to_date("o_orderdate")).items()))


@Q.add("sca16_period_end", """select o_orderkey, cast(cast(o_orderdate as date) + cast(6 - dayofweek(o_orderdate) as int) as date) as week_end, make_date(year(o_orderdate), 12, 31) as year_end from orders""")
def _(v):
    d = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", calendar.period_end(d, F.lit("weekly")).alias("week_end"), calendar.period_end(d, F.lit("annual")).alias("year_end"))


@Q.add("sca17_log_transform", """select location_code, disease, date, round(ln(1 + value), 4) as target_log, round(greatest(exp(-value / 1000.0) - 1, 0.0), 4) as clipped, round(exp(ln(1 + value)) - 1, 2) as restored from v_series""")
def _(v):
    log = measures.log_target("value")
    return v.series_daily.select(
        "location_code", "disease", "date", F.round(log, 4).alias("target_log"),
        F.round(measures.inverse_log_target(-F.col("value") / 1000.0), 4).alias("clipped"), F.round(measures.inverse_log_target(log), 2).alias("restored"),
    )


@Q.add("sca18_range_and_membership_filter", """select o_orderkey, cast(o_orderdate as date) as date, o_orderpriority from orders
    where o_orderdate between '1996-01-01' and '1997-06-30' and o_orderpriority in ('1-URGENT', '2-HIGH')""")
def _(v):
    orders = v.table("orders")
    return orders.where(
        F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz"))
        & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    ).select("o_orderkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority")


@Q.add("sca19_disease_alias", """select event_id, case event_type when 'click' then 'Influenza' when 'view' then 'Tuberculosis' when 'error' then 'COVID-19' when 'signup' then 'Unknown X' end as disease from events""")
def _(v):
    return v.table("events").select("event_id", text.canonical_name(F.expr(ALIAS_TEXT), schema.DISEASE_ALIASES).alias("disease"))


@Q.add("sca20_unmapped_key", "select name, coalesce(mapped_code, 'UNMAPPED:' || standard_name) as location_key from v_mapping")
def _(v):
    return v.mapping.select("name", text.unmapped_key("mapped_code", "standard_name").alias("location_key"))


@Q.add("sca21_required_columns", """select location_code, disease, date, value, lag_7, target from v_short where lag_1 is not null and lag_7 is not null and target is not null""")
def _(v):
    return v.short_series.dropna(subset=["lag_1", "lag_7", "target"]).select("location_code", "disease", "date", "value", "lag_7", "target")


@Q.add("sca23_target_date", """select o_orderkey, case o_orderstatus when 'F' then cast(o_orderdate + interval 7 day as date) when 'O' then cast(o_orderdate + interval 14 day as date)
    else cast(o_orderdate + interval 1 year as date) end as target_date from orders""")
def _(v):
    status = F.col("o_orderstatus")
    frequency = F.when(status == "F", "daily").when(status == "O", "weekly").otherwise("annual")
    steps = F.when(status == "F", 7).when(status == "O", 2).otherwise(0)
    return v.table("orders").select("o_orderkey", calendar.target_date(F.to_date("o_orderdate"), frequency, steps).alias("target_date"))


@Q.add("sca24_interval", """select location_code, disease, date, round(greatest(x * 0.85, 0.0), 4) as lower, round(x * 1.15, 4) as upper
    from (select *, value - 300 as x from v_series)""")
def _(v):
    rows = v.series_daily.withColumn("x", F.col("value") - 300)
    lower, upper = measures.interval("x")
    return rows.select("location_code", "disease", "date", F.round(lower, 4).alias("lower"), F.round(upper, 4).alias("upper"))


@Q.add("sca25_prediction_errors", """select location_code, disease, date, round(value - target, 4) as error_naive, round(rolling_mean_7 - target, 4) as error_mean from v_short""")
def _(v):
    return v.short_series.select(
        "location_code", "disease", "date", F.round(measures.error("value", "target"), 4).alias("error_naive"),
        F.round(measures.error("rolling_mean_7", "target"), 4).alias("error_mean"),
    )


@Q.add("sca26_risk_bucket", """select p_partkey, case when p_size * 2 < 35 then '低风险' when p_size * 2 < 55 then '中风险' when p_size * 2 < 75 then '较高风险' else '高风险' end as risk_level from part""")
def _(v):
    return v.table("part").select("p_partkey", measures.risk_bucket(F.col("p_size") * 2).alias("risk_level"))


REPORT_TEXT_SQL = """case when lang = 'en' then '2025年第' || cast(n_chars % 53 as varchar) || '周 ' || text when lang = 'fr' then '2024年 ' || cast(n_chars % 12 + 1 as varchar) || '月 ' || text else text end"""
REPORT_TEXT = """case when lang = 'en' then concat('2025年第', n_chars % 53, '周 ', text) when lang = 'fr' then concat('2024年 ', n_chars % 12 + 1, '月 ', text) else text end"""


@Q.add("sca27_report_period", f"""select doc_id, coalesce(wy, my) as report_year, w as report_week, m as report_month,
    case when wy is not null then wy || '-W' || lpad(cast(w as varchar), 2, '0') when my is not null then my || '-' || lpad(cast(m as varchar), 2, '0') end as stat_period
    from (select doc_id, try_cast(nullif(regexp_extract(t, '(20[0-9]{{2}})年第\\s*([0-9]{{1,2}})\\s*周', 1), '') as int) as wy,
        try_cast(nullif(regexp_extract(t, '(20[0-9]{{2}})年第\\s*([0-9]{{1,2}})\\s*周', 2), '') as int) as w,
        try_cast(nullif(regexp_extract(t, '(20[0-9]{{2}})年\\s*([0-9]{{1,2}})\\s*月', 1), '') as int) as my,
        try_cast(nullif(regexp_extract(t, '(20[0-9]{{2}})年\\s*([0-9]{{1,2}})\\s*月', 2), '') as int) as m from (select doc_id, {REPORT_TEXT_SQL} as t from documents))""")
def _(v):
    rows = v.table("documents").select("doc_id", F.expr(REPORT_TEXT).alias("t"))
    week_year = text.extract_field("t", schema.REPORT_WEEK_PATTERN, "int", 1)
    month_year = text.extract_field("t", schema.REPORT_MONTH_PATTERN, "int", 1)
    rows = rows.select(
        "doc_id", F.coalesce(week_year, month_year).alias("report_year"),
        text.extract_field("t", schema.REPORT_WEEK_PATTERN, "int", 2).alias("report_week"),
        text.extract_field("t", schema.REPORT_MONTH_PATTERN, "int", 2).alias("report_month"),
    )
    return rows.withColumn("stat_period", text.period_label(F.col("report_year"), F.col("report_week"), F.col("report_month")))


@Q.add("sca28_numbers_from_prose", """select doc_id, case when lang = 'en' then n_chars end as reported_ili_outbreaks, case when lang = 'fr' then cast(n_chars as double) / 10 end as south_ili_percent,
    case when lang = 'de' then cast(0.5 as double) end as north_ili_percent, case when lang = 'es' then n_chars end as influenza_samples_tested from documents""")
def _(v):
    prose = F.expr("""concat(text, case lang when 'en' then concat('全国共报告 ', n_chars, '起流感样病例暴发疫情')
        when 'fr' then concat('南方省份哨点医院报告的ILI%为', n_chars div 10, '.', n_chars % 10, '%')
        when 'de' then '北方省份哨点医院报告的ILI%为 0.5%' else concat('共检测流感样病例监测标本', n_chars, '份') end)""")
    return v.table("documents").select("doc_id", *text.extract_fields(prose, schema.REPORT_NUMBER_PATTERNS))


@Q.add("sca29_keyword_category", """select doc_id, case when contains(text, ' und ') then 'german' when contains(text, 'tion') then 'latin' when contains(text, 'the ') then 'english' else 'other' end as category from documents""")
def _(v):
    rules = [(" und ", "german"), ("tion", "latin"), ("the ", "english")]
    return v.table("documents").select("doc_id", text.classify("text", rules, "other").alias("category"))


@Q.add("sca30_json_record", """select event_id, case when ok then json_extract_string(raw_json, '$.Id') end as who_record_id, case when ok then json_extract_string(raw_json, '$.Dim1Type') end as dimension_1_type,
    case when ok then json_extract_string(raw_json, '$.Dim1') end as dimension_1_value, case when ok then json_extract_string(raw_json, '$.ParentLocationCode') end as parent_location_code,
    case when ok then json_extract_string(raw_json, '$.Dim3') end as dimension_3_value, ok as raw_json_valid
    from (select *, event_type not in ('error', 'view') as ok, case when event_type in ('error', 'view') then null else raw_json end as j from v_records)""".replace("(raw_json,", "(j,"))
def _(v):
    return records.json_record(v.records, "raw_json").select(
        "event_id", "who_record_id", "dimension_1_type", "dimension_1_value", "parent_location_code", "dimension_3_value", "raw_json_valid"
    )


@Q.add("sca31_unit_inference", """select p_partkey, case when p_type = 'PROMO' then 'count' when p_type = 'LARGE' then 'given' when contains(lower(name), 'per 100 000') then 'per_100k' when contains(lower(name), 'percent') or contains(lower(name), '(%)') then 'percent'
    when contains(lower(name), 'number') or contains(lower(name), 'cases') then 'count' when contains(lower(name), 'rate') then 'rate' else 'unspecified' end as unit
    from (select *, case p_type when 'ECONOMY' then 'Deaths per 100 000 ' when 'MEDIUM' then 'Coverage (%) ' when 'SMALL' then 'Number of ' when 'STANDARD' then case when p_size > 25 then 'Growth rate ' else '' end else '' end || p_name as name from part)""")
def _(v):
    t = F.col("p_type")
    prefix = (
        F.when(t == "ECONOMY", "Deaths per 100 000 ").when(t == "MEDIUM", "Coverage (%) ").when(t == "SMALL", "Number of ")
        .when((t == "STANDARD") & (F.col("p_size") > 25), "Growth rate ").otherwise("")
    )
    given = F.when(t == "LARGE", "given")
    return v.table("part").select("p_partkey", text.resolve_unit(given, t, F.concat(prefix, "p_name"), {"PROMO": "count"}).alias("unit"))


@Q.add("sca32_whole_term_match", """select doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') as has_the, regexp_matches(lower(text), '(^|[^a-z0-9])on([^a-z0-9]|$)') as has_on,
    contains(lower(text), 'on') as contains_on from documents""")
def _(v):
    return v.table("documents").select(
        "doc_id", text.matches_term("text", "the").alias("has_the"), text.matches_term("text", "on").alias("has_on"), F.lower("text").contains("on").alias("contains_on"),
    )


@Q.add("sca33_topic_discovery", """select topic, p_name, max(p_brand) as p_brand from (
    select 'metal' as topic, p_name, p_brand, regexp_matches(lower(p_name || ' ' || p_brand), '(^|[^a-z0-9])(bolt|gear|ring)([^a-z0-9]|$)') as hit from part
    union all select 'colour', p_name, p_brand, regexp_matches(lower(p_name || ' ' || p_brand), '(^|[^a-z0-9])(red|blue)([^a-z0-9]|$)') from part
    union all select 'brand', p_name, p_brand, regexp_matches(lower(p_name || ' ' || p_brand), '(^|[^a-z0-9])brand#1([^a-z0-9]|$)') from part) where hit group by 1, 2""")
def _(v):
    topics = {"metal": ["bolt", "gear", "ring"], "colour": ["red", "blue"], "brand": ["brand#1"]}
    return text.discover_topics(v.table("part"), "p_name", "p_brand", topics)


@Q.add("sca34_usage_class", """select doc_id, case when code = 'HIV_0000000026' then 'primary_hiv_observation' when code in ('MDG_0000000029', 'TB_1') then 'auxiliary_feature' when code like 'PRISON_%' then 'special_population_reference'
    when topic <> 'unknown' and not (case when topic = 'hiv' then code like 'HIV_%' or regexp_matches(name, '\\b(hiv|aids)\\b') when topic = 'tuberculosis' then code like 'TB_%' or regexp_matches(name, '\\b(tuberculosis|tb)\\b')
        when topic = 'covid' then regexp_matches(name, '\\bcovid(?:-19)?\\b|\\bcoronavirus\\b|\\bsars-cov-2\\b') else regexp_matches(name, '\\binfluenza\\b|\\bseasonal flu\\b') end) then 'keyword_false_positive' else 'catalog_only' end as usage_class
    from (select doc_id, case lang when 'en' then 'hiv' when 'fr' then 'tuberculosis' when 'de' then 'covid' when 'es' then 'unknown' else 'influenza' end as topic,
        case source when 'src0' then 'HIV_0000000026' when 'src1' then 'TB_1' when 'src2' then 'PRISON_X' when 'src3' then 'HIV_9' else 'X' || source end as code,
        lower(case source when 'src4' then 'Deaths from TB ' when 'src5' then 'New covid-19 cases ' else '' end || text) as name from documents)""")
def _(v):
    topic = F.expr("case lang when 'en' then 'hiv' when 'fr' then 'tuberculosis' when 'de' then 'covid' when 'es' then 'unknown' else 'influenza' end")
    code = F.expr("case source when 'src0' then 'HIV_0000000026' when 'src1' then 'TB_1' when 'src2' then 'PRISON_X' when 'src3' then 'HIV_9' else concat('X', source) end")
    name = F.expr("concat(case source when 'src4' then 'Deaths from TB ' when 'src5' then 'New covid-19 cases ' else '' end, text)")
    rows = v.table("documents").select("doc_id", topic.alias("topic"), code.alias("code"), name.alias("name"))
    return rows.select("doc_id", text.usage_class("topic", "code", "name").alias("usage_class"))


@Q.add("sca35_dimension_backfill", """select event_id, case when event_type = 'click' then 'V' || k when event_type in ('signup') then 'given' end as sex, case when event_type in ('purchase', 'signup') then 'V' || k end as age from v_records""")
def _(v):
    rows = records.json_record(v.records, "raw_json").withColumns({
        "sex0": F.when(F.col("event_type") == "signup", "given"), "age0": F.lit(None).cast("string"),
    })
    return rows.select("event_id", records.backfill_dimension("sex0", "SEX").alias("sex"), records.backfill_dimension("age0", "AGEGROUP").alias("age"))


@Q.add("sca36_key_and_signature", """select d.doc_id, case when l.quality is not null then d.lang || '|id:' || d.doc_id else d.source || '|' || d.lang || '|' || coalesce(cast(l.quality as varchar), '') end as record_key,
    sha256(d.source || '|' || d.text || '|' || coalesce(cast(l.toxic as varchar), '')) as signature from documents d left join labels l on l.doc_id = d.doc_id""")
def _(v):
    rows = v.table("documents").join(v.table("labels"), "doc_id", "left")
    record_id = F.when(F.col("quality").isNotNull(), F.col("doc_id"))
    return rows.select(
        "doc_id", records.record_key("lang", record_id, ["source", "lang", "quality"]).alias("record_key"),
        F.sha2(records.joined(["source", "text", "toxic"]), 256).alias("signature"),
    )


@Q.add("sca37_location_resolution", """select s_suppkey, c.location_code as code from (select s_suppkey, upper(trim(case when s_acctbal > 5000 then lower(n_name) when s_acctbal > 0 then ' na' || chr(97 + s_nationkey) else s_name end)) as k
    from supplier join nation on s_nationkey = n_nationkey) r left join v_catalog c on r.k = c.location_code or r.k = upper(c.location)""")
def _(v):
    rows = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    request = F.when(F.col("s_acctbal") > 5000, F.lower("n_name")).when(
        F.col("s_acctbal") > 0, F.concat(F.lit(" na"), F.char((F.col("s_nationkey") + 97).cast("long")))
    ).otherwise(F.col("s_name"))
    return serving.resolve_locations(rows.select("s_suppkey", request.alias("request")), v.catalog, "request").select("s_suppkey", "code")


@Q.add("sca38_column_types", """select column_name, case when filled = 0 then 'all_missing' when dates = filled then 'date' when dates > 0 or numbers < filled then 'string' when whole = filled then 'integer' else 'float' end as inferred_type
    from (select column_name, count(v) as filled, count(case when column_name = 'l_shipdate' then try_cast(v as date) end) as dates, count(n) as numbers, count(case when n = floor(n) then 1 end) as whole
    from (select column_name, v, try_cast(v as double) as n from (select columns(*)::varchar from (select * replace (strftime(l_shipdate, '%Y-%m-%d') as l_shipdate) from lineitem)) unpivot include nulls (v for column_name in (*))) group by 1)""")
def _(v):
    items = v.table("lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return aggregates.column_types(items.select(*(F.col(c).cast("string").alias(c) for c in items.columns)), ["l_shipdate"])


@Q.add("sca39_anomaly_label", """select c_custkey, case when c_acctbal < 0 then 'negative_public_health_or_population_value' end as cases_reason, case when c_acctbal / 10 not between -90 and 90 then 'latitude_out_of_range' end as lat_reason,
    case when c_acctbal / 10 not between -180 and 180 then 'longitude_out_of_range' end as lon_reason, case when c_acctbal / 10 not between 0 and 100 then 'humidity_out_of_range' end as humidity_reason from customer""")
def _(v):
    tenth = F.col("c_acctbal") / 10
    return v.table("customer").select(
        "c_custkey", measures.anomaly_label(F.lit("public_health"), "c_acctbal").alias("cases_reason"), measures.anomaly_label(F.lit("latitude"), tenth).alias("lat_reason"),
        measures.anomaly_label(F.lit("longitude"), tenth).alias("lon_reason"), measures.anomaly_label(F.lit("humidity"), tenth).alias("humidity_reason"),
    )


@Q.add("sca41_page_metadata", """select page_id, replace(replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1), ''), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as title,
    '2024-0' || (page_id % 9 + 1) || '-05' as published_date,
    case when contains(html, '">The</a>') then regexp_extract(url, '^[a-z]+://[^/?#]*') || '/The.pdf' else '' end as attachments, contains(html, '">The</a>') as has_attachment from pages""")
def _(v):
    rows = v.table("pages").withColumn("html", F.concat(
        F.replace(F.col("html"), F.lit('">The</a>'), F.lit('.pdf">The</a>')), F.lit("<p>2024年"), F.col("page_id") % 9 + 1, F.lit("月5日</p>")
    ))
    out = text.page_metadata(rows, "url", "html", 800)
    return out.select("page_id", "title", "published_date", F.array_join("attachment_urls", " | ").alias("attachments"), (F.size("attachment_urls") > 0).alias("has_attachment"))


@Q.add("sca42_page_role", "select page_id, case when url like '%/' then 'listing' else 'detail' end as record_role from pages")
def _(v):
    return v.table("pages").select("page_id", text.page_role("url").alias("record_role"))


@Q.add("sca43_link_candidates", """select root || href as detail_url, max(t) as anchor_title from (select regexp_extract(url, '^[a-z]+://[^/?#]*') as root, regexp_extract(a, 'href="([^"]*)"', 1) as href,
    regexp_extract(a, '>([^<]*)<', 1) as t from (select url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) as a from pages)) where contains(t, 'th') and regexp_matches(root, 'example\\.com$') group by 1""")
def _(v):
    return text.link_candidates(v.table("pages"), "url", "html", ["th"], "example.com")
