"""Registered queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from epitide import schema
from epitide.catalog.registry import Registry
from epitide.catalog.views import EVENT_TYPES, NATIONS, SERIES
from epitide.functions import text
from epitide.operators import aggregates, joins
from epitide.plans import forecasting, quality

Q = Registry()
TOTALS = ["total_cases", "total_deaths"]
# A country-like province name in the demo data: the priority '5-LOW' of NATION_3 is renamed to it.
LEVELS_SQL = """select trim(country_region) as country, strptime(ObservationDate, '%m/%d/%Y')::date as date,
    case when trim(province_raw) = '' then null when trim(province_raw) = '5-LOW' and trim(country_region) = 'NATION_3' then 'nation_3' else trim(province_raw) end as province, Confirmed as total_cases, Deaths as total_deaths from v_reports"""


def leveled(v):
    """Order rows per (country, year) with blank and named provinces."""
    country = F.trim("country_region")
    province = text.blank_to_null("province_raw")
    named = F.when((province == "5-LOW") & (country == "NATION_3"), "nation_3").otherwise(province)
    return v.reports.select(
        country.alias("country"), text.parse_date("ObservationDate", "MM/dd/yyyy").alias("date"), named.alias("province"),
        F.col("Confirmed").alias("total_cases"), F.col("Deaths").alias("total_deaths"),
    )


SPLIT_SQL = f"""select country, date, sum(case when province is null then total_cases else 0.0 end) as national_total_cases, sum(case when province is not null then total_cases else 0.0 end) as province_total_cases,
    sum(case when province is null then total_deaths else 0.0 end) as national_total_deaths, sum(case when province is not null then total_deaths else 0.0 end) as province_total_deaths,
    bool_or(province is null) as has_national_row, bool_or(province is not null) as has_province_rows,
    cast(count(case when lower(province) in ('uk', 'united kingdom') or lower(province) = lower(country) then 1 end) as bigint) as country_like_province_count from ({LEVELS_SQL}) group by 1, 2"""
RESOLVED_SQL = f"""select country, date, has_national_row, has_province_rows, has_national_row and has_province_rows as aggregation_conflict,
    case when has_national_row and has_province_rows and country_like_province_count > 0 then province_total_cases when has_national_row and has_province_rows then national_total_cases + province_total_cases when has_national_row then national_total_cases else province_total_cases end as total_cases,
    case when has_national_row and has_province_rows and country_like_province_count > 0 then province_total_deaths when has_national_row and has_province_rows then national_total_deaths + province_total_deaths when has_national_row then national_total_deaths else province_total_deaths end as total_deaths
    from ({SPLIT_SQL})"""


def split(v):
    return aggregates.split_levels(leveled(v), ["country", "date"], "province", "country", TOTALS)


@Q.add("agg01_national_and_province_sums", SPLIT_SQL)
def _(v):
    return split(v)


@Q.add("agg02_level_resolution", RESOLVED_SQL)
def _(v):
    return aggregates.resolve_levels(split(v), TOTALS).select("country", "date", "has_national_row", "has_province_rows", "aggregation_conflict", *TOTALS)


@Q.add("agg03_province_wins", f"""select country, date, case when count(province) > 0 then sum(case when province is not null then total_cases end) else sum(total_cases) end as cases from ({LEVELS_SQL}) group by 1, 2""")
def _(v):
    return aggregates.province_wins(leveled(v), ["country", "date"], "province", ["country", "date"], {"total_cases": "cases"})


@Q.add("agg04_many_names_one_code", f"""select r_name as region, date, sum(total_cases) as total_cases, sum(total_deaths) as total_deaths, bool_or(has_province_rows) as has_province_rows, bool_or(has_national_row) as has_national_row,
    bool_or(aggregation_conflict) as aggregation_conflict from ({RESOLVED_SQL}) join v_nations on n_name = country group by 1, 2""")
def _(v):
    resolved = aggregates.resolve_levels(split(v), TOTALS)
    regions = v.nations.select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    return aggregates.merge_names(resolved.join(regions, "country"), ["region", "date"], TOTALS)


@Q.add("agg05_yearly_statistics", """select location_code, location, disease, year, sum(value) as year_cases, sum(new_deaths) as year_deaths, round(avg(cases_per_million), 6) as avg_cases_per_million, round(avg(growth_rate_7), 6) as avg_growth_rate_7,
    round(avg(temperature_mean), 6) as avg_temperature_mean, max(date) as latest_date from v_features group by 1, 2, 3, 4""")
def _(v):
    out = aggregates.statistics(v.gold, list(schema.YEARLY_KEYS), schema.YEARLY_STATISTICS)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_cases_per_million", "avg_growth_rate_7", "avg_temperature_mean")})


@Q.add("agg06_covariate_roll_up", "select location_code, frequency, join_date, round(temperature_mean, 4) as temperature_mean, round(precipitation_sum, 4) as precipitation_sum, weather_match_level from v_covariates")
def _(v):
    out = joins.roll_up(v.weather, ["location_code"], "date", ["temperature_mean", "precipitation_sum"])
    return out.withColumns({c: F.round(c, 4) for c in ("temperature_mean", "precipitation_sum")})


def city_sql(period: str, bounds: bool) -> str:
    long = " union all ".join(f"select {period} as period, city_{k} as x from v_hourly" for k in NATIONS)
    extra = "round(min(x) - 273.15, 6) as temperature_mean_min, round(max(x) - 273.15, 6) as temperature_mean_max, " if bounds else ""
    return f"select period, round(sum(x) / count(x) - 273.15, 6) as temperature_mean, {extra}count(x) as temperature_mean_observations from ({long}) where x is not null group by 1"


@Q.add("agg07_matrix_daily", city_sql("date", True))
def _(v):
    out = aggregates.matrix_mean(v.hourly, F.col("date"), "period", [f"city_{k}" for k in NATIONS], "temperature_mean", -273.15)
    return out.withColumns({c: F.round(c, 6) for c in ("temperature_mean", "temperature_mean_min", "temperature_mean_max")})


@Q.add("agg08_matrix_annual", city_sql("year(date)", False))
def _(v):
    out = aggregates.matrix_mean(v.hourly, F.year("date"), "period", [f"city_{k}" for k in NATIONS], "temperature_mean", -273.15, bounds=False)
    return out.withColumn("temperature_mean", F.round("temperature_mean", 6))


@Q.add("agg09_wide_matrix_sum", "select location_code, " + ", ".join(f"sum({t}) as {t}" for t in EVENT_TYPES) + " from v_wide group by 1")
def _(v):
    return aggregates.sum_columns(v.wide, ["location_code"], EVENT_TYPES)


@Q.add("agg10_row_sum", "select location_code, date, case when coalesce(" + ", ".join(EVENT_TYPES) + ") is not null then " + " + ".join(f"coalesce({t}, 0)" for t in EVENT_TYPES) + " end as row_total from v_wide")
def _(v):
    from epitide.functions.measures import row_sum

    return v.wide.select("location_code", "date", row_sum(EVENT_TYPES).alias("row_total"))


@Q.add("agg11_sum_null_when_empty", "select event_type, sum(case when event_type not in ('error', 'view') then floor(value) end) as total from events group by 1")
def _(v):
    kept = F.when(~F.col("event_type").isin("error", "view"), F.floor("value").cast("double"))
    return v.table("events").groupBy("event_type").agg(F.sum(kept).alias("total"))


@Q.add("agg12_counts_and_bounds", "select event_type, count(*) as rows, count(distinct user_id) as users, min(value) as value_min, max(value) as value_max, min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day from events group by 1")
def _(v):
    day = F.to_date("ts")
    return v.table("events").groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.min("value").alias("value_min"), F.max("value").alias("value_max"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
    )


@Q.add("agg13_row_counts", "select user_id, event_type, count(*) as rows from events group by 1, 2")
def _(v):
    return quality.rows_by(v.table("events"), ["user_id", "event_type"])


@Q.add("agg14_duplicate_keys", "select user_id, event_type, cast(ts as date) as date, count(*) as row_count from events group by 1, 2, 3 having count(*) > 1")
def _(v):
    return aggregates.duplicate_keys(v.table("events").withColumn("date", F.to_date("ts")), ["user_id", "event_type", "date"])


@Q.add("agg14_duplicate_summary", """select count(*) as total_rows, count(distinct text) as distinct_keys, count(*) - count(distinct text) as surplus_rows, (select count(*) from (select text from documents group by 1 having count(*) > 1)) as duplicated_keys from documents""")
def _(v):
    return aggregates.duplicate_summary(v.table("documents").select(F.sha2("text", 256).alias("digest")), ["digest"])


@Q.add("agg15_duplicate_rows", """select count(*) as total_rows, count(*) - (select count(*) from (select distinct user_id, event_type, note from (select *, case event_id % 3 when 0 then null when 1 then '' else props end as note from events))) as duplicate_rows from events""")
def _(v):
    return aggregates.duplicate_rows(v.table("events").select("user_id", "event_type", F.when(F.col("event_id") % 3 == 1, "").when(F.col("event_id") % 3 == 2, F.col("props")).alias("note")))


@Q.add("agg16_duplicate_provenance", """select md5(text) as key, count(*) as duplicate_source_count, string_agg(distinct source, ' | ' order by source) as duplicate_source_files, string_agg(distinct lang, ' | ' order by lang) as duplicate_collector_topics,
    count(distinct n_chars || lang) as duplicate_content_variant_count, count(distinct n_chars || lang) > 1 as duplicate_content_conflict from documents group by text""")
def _(v):
    docs = v.table("documents").select(F.md5("text").alias("key"), "source", "lang", F.concat("n_chars", "lang").alias("signature"))
    return aggregates.provenance(docs, "key", "source", "lang", "signature")


@Q.add("agg17_indicator_summary", """select p_type as indicator_code, min(p_name) as indicator_name, coalesce(string_agg(distinct p_brand, ' | ' order by p_brand) filter (p_brand in ('Brand#1', 'Brand#2', 'Brand#3')), '') as usage_class, count(*) as rows, count(case when p_size > 10 then 1 end) as numeric_rows,
    count(case when p_size > 25 then 1 end) as selected_country_rows, count(case when p_size > 25 and p_size > 10 then 1 end) as selected_country_numeric_rows, count(distinct case when p_retailprice > 1000 then p_name end) as country_count,
    count(distinct case when p_size > 25 then p_name end) as selected_country_count, min(p_size) as year_min, max(p_size) as year_max, 'u' as units, 't' as collector_topics, count(distinct p_brand) as source_file_count,
    cast(sum(greatest(p_size - 1, 0)) as bigint) as duplicate_raw_rows, count(case when p_size = 50 then 1 end) as duplicate_content_conflict_groups from part group by 1""")
def _(v):
    catalog = v.table("part").select(
        F.col("p_type").alias("indicator_code"), F.col("p_name").alias("indicator_name"), F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), F.col("p_brand")).alias("usage_class"),
        F.when(F.col("p_size") > 10, F.col("p_size")).alias("numeric_value_clean"), (F.col("p_size") > 25).alias("is_selected_country"), F.col("p_name").alias("location_code"),
        F.when(F.col("p_retailprice") > 1000, "COUNTRY").alias("location_type"), F.col("p_size").alias("year"), F.lit("u").alias("unit"), F.lit("t").alias("collector_topic"),
        F.col("p_brand").alias("source_file"), F.col("p_size").alias("duplicate_source_count"), (F.col("p_size") == 50).alias("duplicate_content_conflict"),
    )
    return aggregates.indicator_summary(catalog)


PAIRS_SQL = "(select cast(floor(o_totalprice) as bigint) as a, t as b from orders join (select l_orderkey, cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as t from lineitem group by 1) on l_orderkey = o_orderkey)"


@Q.add("agg18_reconciliation_statistics", f"""select count(*) as overlap_rows, round(median(r), 6) as median_relative_difference, round(avg(case when r <= 0.05 then 1.0 else 0.0 end), 6)::double as within_5_percent_share from (select abs(a - b) / cast(greatest(a, b, 1) as double) as r from {PAIRS_SQL} where a > 0 and b > 0)""")
def _(v):
    orders = v.table("orders").select("o_orderkey", F.floor("o_totalprice").cast("double").alias("total"))
    items = v.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.floor("l_extendedprice")).cast("double").alias("total"))
    return quality.reconcile(orders, items, ["o_orderkey"], "total")


@Q.add("agg19_null_rates", " union all ".join(f"select '{c}' as column_name, round(avg(case when {c} is null then 1.0 else 0.0 end), 6)::double as null_rate from v_wide" for c in EVENT_TYPES))
def _(v):
    return aggregates.null_rates(v.wide, EVENT_TYPES)


def metrics_sql(source: str, by: str) -> str:
    return f"""select {by}, count(*) as rows, round(avg(abs(a - p)), 6) as mae, round(sqrt(avg((a - p) * (a - p))), 6) as rmse, round(coalesce(1 - sum((a - p) * (a - p)) / nullif(var_pop(a) * count(*), 0), 0), 6) as r2,
        round(coalesce(avg(abs((a - p) / nullif(a, 0))), 0), 6) as mape, round(avg(case when abs(a) + abs(p) = 0 then 0 else 2 * abs(p - a) / (abs(a) + abs(p)) end), 6) as smape from ({source}) where a is not null and p is not null group by {by}"""


MODELS_SQL = "select disease, 'naive_last_value' as model, target as a, value as p from v_short union all select disease, 'moving_average', target, rolling_mean_7 from v_short"


def model_metrics(v):
    rows = v.short_series.withColumns({"prediction_naive_last_value": F.col("value"), "prediction_moving_average": F.col("rolling_mean_7")})
    long = forecasting.long_predictions(rows, ["disease", "target"], ["naive_last_value", "moving_average"])
    return aggregates.regression_metrics(long, "target", "prediction", ["disease", "model"])


@Q.add("agg20_regression_metrics", metrics_sql(MODELS_SQL, "disease, model"))
def _(v):
    return model_metrics(v)


@Q.add("agg21_guarded_correlation", """select location_code, case when count(t) >= 3 and stddev_pop(d) > 0 and stddev_pop(t) > 0 then round(corr(d, t), 4) end as correlation, count(*) as n
    from (select location_code, case when t is not null then day_total end as d, t, day_total from (select location_code, day_total, case when day(date) % 3 <> 0 then temperature_max end as t from v_totals join v_weather using (location_code, date))) group by 1""")
def _(v):
    pairs = v.totals_daily.join(v.weather, ["location_code", "date"])
    pairs = pairs.withColumn("temperature_max", F.when(F.dayofmonth("date") % 3 != 0, F.col("temperature_max")))  # some are missing
    return pairs.groupBy("location_code").agg(aggregates.safe_corr("day_total", "temperature_max").alias("correlation"), F.count("*").alias("n"))


@Q.add("agg22_missing_years", "select cast(sum(g) as bigint) as missing_year_count from (select max(year) - min(year) + 1 - count(distinct year) as g from v_population group by location_code)")
def _(v):
    return aggregates.missing_years(v.population, ["location_code"], "year")


@Q.add("agg23_snapshot_at_latest_date", "select date, count(*) as locations, sum(day_total) as total from v_totals where date = (select max(date) from v_totals) group by 1")
def _(v):
    return aggregates.at_latest_date(v.totals_daily, "date").groupBy("date").agg(F.count("*").alias("locations"), F.sum("day_total").alias("total"))


@Q.add("agg23_latest_row_per_series", "select location_code, disease, max(date) as date, arg_max(value, date) as value from v_series group by 1, 2")
def _(v):
    return aggregates.latest_per_series(v.series_daily, SERIES, "date", ["value"])


@Q.add("agg24_disease_share", "select disease, count(*) as record_count, count(distinct location_code) as location_count, min(date) as start_date, max(date) as end_date from v_series group by 1")
def _(v):
    from epitide.plans.serving import disease_share

    return disease_share(v.series_daily)


@Q.add("agg25_completeness", "select round(1 - (" + " + ".join(f"avg(case when {t} is null then 1.0 else 0.0 end)" for t in EVENT_TYPES) + f") / {len(EVENT_TYPES)}, 4)::double as completeness from v_wide")
def _(v):
    return v.wide.agg(aggregates.completeness(v.wide, EVENT_TYPES).alias("completeness"))


STAT_ROLES = {"l_quantity": "latitude", "l_tax": "humidity", "l_extendedprice": "public_health"}


@Q.add("agg26_numeric_statistics", " union all ".join(
    f"select '{c}' as column_name, min({c}) as min_value, max({c}) as max_value, count(case when {c} < 0 then 1 end) as negative_count, count(case when {c} = 0 then 1 end) as zero_count, count(case when {c} not between {lo} and {hi} then 1 end) as anomaly_count from lineitem2"
    for c, lo, hi in (("l_quantity", -90, 90), ("l_tax", 0, 100), ("l_extendedprice", 0, 1e12))).replace("lineitem2", "(select l_quantity * 2 as l_quantity, l_tax - 0.01 as l_tax, l_extendedprice from lineitem)"))
def _(v):
    items = v.table("lineitem").select((F.col("l_quantity") * 2).alias("l_quantity"), (F.col("l_tax") - 0.01).alias("l_tax"), "l_extendedprice")
    return aggregates.numeric_stats(items, STAT_ROLES)


@Q.add("agg26_anomaly_examples", """select c_custkey, 'c_acctbal' as column_name, c_acctbal as value, 'negative_public_health_or_population_value' as reason, row_number() over (order by c_custkey) as example_no from customer where c_acctbal < 0 order by c_custkey limit 5""")
def _(v):
    return aggregates.numeric_anomalies(v.table("customer"), "c_custkey", {"c_acctbal": "public_health"})


@Q.add("agg27_best_model", f"""select disease, arg_min(model, (mae, model)) as best_model, min(mae) as best_mae, 'test' as selected_on from ({metrics_sql(MODELS_SQL, "disease, model")}) group by 1""")
def _(v):
    return aggregates.best_model(model_metrics(v), ["disease"])


@Q.add("agg28_country_date_profile", f"""select count(*) as country_dates, cast(sum(r) as bigint) as rows, cast(sum(b) as bigint) as blank_province_rows, cast(sum(p) as bigint) as named_province_rows, count(case when b > 0 and p > 0 then 1 end) as keys_with_both,
    count(case when p > 1 then 1 end) as keys_with_several from (select country, date, count(*) as r, count(*) - count(province) as b, count(province) as p from ({LEVELS_SQL}) group by 1, 2)""")
def _(v):
    return aggregates.country_date_profile(leveled(v), "country", "date", "province")


