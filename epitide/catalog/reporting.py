"""Registered queries: quality reports, profiles, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from epitide.catalog import assembling
from epitide.catalog.assembling import EPIDEMIC_SQL, VALIDATION_SQL, WEATHER_SILVER_SQL
from epitide.catalog.registry import Registry
from epitide.catalog.summarising import LEVELS_SQL
from epitide.functions import text
from epitide.operators import aggregates
from epitide.plans import cleaning, features as gold, quality, serving
from epitide.schema import REQUIRED_OBSERVATION, SOURCE_STATUS_ITEMS

Q = Registry()
SILVER_POPULATION = "select location_code, year, population from v_population"


def epidemic(v):
    return cleaning.cumulative_reports(v.reports, v.mapping)


def weather(v):
    return cleaning.weather_silver(assembling.weather_raw(v))


def population(v):
    return cleaning.population_silver(assembling.population_wide(v))


@Q.add("qlt01_epidemic_report", f"""select count(*) as output_rows, min(date) as date_min, max(date) as date_max, count(distinct location) as country_count, count(*) - count(distinct (location_key, location, date)) as duplicate_count, count(distinct case when location_code is null then location end) as unmapped_country_count,
    count(case when aggregation_conflict then 1 end) as national_province_conflict_count, count(case when is_negative_case_correction then 1 end) as negative_case_correction_count, count(case when is_negative_death_correction then 1 end) as negative_death_correction_count from ({EPIDEMIC_SQL})""")
def _(v):
    return quality.epidemic_report(epidemic(v))


@Q.add("qlt01_epidemic_null_rates", " union all ".join(f"select '{c}' as column_name, round(avg(case when {c} is null then 1.0 else 0.0 end), 6)::double as null_rate from ({EPIDEMIC_SQL})" for c in assembling.EPIDEMIC))
def _(v):
    return aggregates.null_rates(epidemic(v), list(assembling.EPIDEMIC))


@Q.add("qlt02_population_report", f"select count(*) as output_rows, count(distinct location_code) as country_count, min(year) as year_min, max(year) as year_max, count(*) - count(distinct (location_code, year)) as duplicate_count from ({SILVER_POPULATION})")
def _(v):
    return quality.keyed_report(population(v), ["location_code", "year"], "location_code", "year")


@Q.add("qlt03_weather_report", f"select count(*) as output_rows, count(distinct location_code) as country_count, min(date) as date_min, max(date) as date_max, count(*) - count(distinct (location_code, date)) as duplicate_count from ({WEATHER_SILVER_SQL})")
def _(v):
    return quality.keyed_report(weather(v), ["location_code", "date"], "location_code", "date")


@Q.add("qlt03_weather_rows_by_country", f"select location_code, count(*) as rows from ({WEATHER_SILVER_SQL}) group by 1")
def _(v):
    return quality.rows_by(weather(v), ["location_code"])


@Q.add("qlt04_layer_gate", f"""select true as can_enter_next_layer, cast(e + p + w as bigint) as total_rows, cast(se as bigint) as surplus_rows from (select (select count(*) from ({EPIDEMIC_SQL})) as e, (select count(*) - count(distinct (coalesce(location_code, '-'), date)) from ({EPIDEMIC_SQL})) as se,
    (select count(*) from ({SILVER_POPULATION})) as p, (select count(*) from ({WEATHER_SILVER_SQL})) as w)""")
def _(v):
    return quality.layer_gate(epidemic(v), population(v), weather(v))


_NAMED = f"(select distinct country, mapped_code from ({LEVELS_SQL}) left join v_mapping on name = country)"
_POPULATED = "(select distinct location_code from v_population)"


@Q.add("qlt05_dataset_overlap", f"""select *, round(cast(mapped_population_count as double) / country_count, 6) as mapping_success_rate, common_locations >= 3 as enough_locations, max_common_days >= 300 as enough_common_days, weather_without_population = 0 as weather_population_mapped, case_duplicate_keys > 0 as reports_need_deduplication,
    date_parse_errors = 0 as dates_parse, weather_duplicate_keys = 0 and population_duplicate_codes = 0 as keys_unique, common_locations >= 3 and max_common_days >= 300 and weather_without_population = 0 and date_parse_errors = 0 and weather_duplicate_keys = 0 and population_duplicate_codes = 0 as can_enter_cleaning from (select
    (select count(*) from {_NAMED}) as country_count, (select count(*) from {_NAMED} where mapped_code in {_POPULATED}) as mapped_population_count, (select count(*) from {_NAMED} where mapped_code is null) as unmapped_count,
    count(*) as common_locations, max(d) as max_common_days, (select count(distinct location_code) from v_weather where location_code in (select mapped_code from {_NAMED}) and location_code not in {_POPULATED}) as weather_without_population,
    (select count(*) from v_reports where try_strptime(ObservationDate, '%m/%d/%Y') is null) + (select count(*) from v_weather where date is null) as date_parse_errors, (select count(*) from (select location_code, date from v_weather group by 1, 2 having count(*) > 1)) as weather_duplicate_keys,
    (select count(*) from (select location_code from {_POPULATED} group by 1 having count(*) > 1)) as population_duplicate_codes, (select count(*) from (select trim(country_region), ObservationDate, trim(province_raw) from v_reports group by all having count(*) > 1)) as case_duplicate_keys
    from (select w.location_code, count(*) as d from v_weather w where w.location_code in (select mapped_code from {_NAMED} where mapped_code in {_POPULATED}) and w.date in (select date from v_totals) group by 1))""")
def _(v):
    cases = v.reports.select(F.trim("country_region").alias("name"), text.parse_date("ObservationDate", "M/d/yyyy").alias("date"), F.trim("province_raw").alias("province"))
    codes = v.population.select("location_code").distinct()
    return quality.overlap_report(cases, codes, v.weather, v.mapping)


ITEM_COLUMNS = {
    "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_extendedprice": "number",
    "l_discount": "number", "l_tax": "number", "l_returnflag": "region", "l_linestatus": "region", "l_shipdate": "date",
}


def profile_sql(table: str) -> str:
    """One row per column of ITEM_COLUMNS."""
    rows = []
    for c, kind in ITEM_COLUMNS.items():
        number = f"min({c})::double as min_value, max({c})::double as max_value, count(case when {c} < 0 then 1 end) as negative_count, count(case when {c} = 0 then 1 end) as zero_count"
        number = number if kind == "number" else "null::double as min_value, null::double as max_value, 0::bigint as negative_count, 0::bigint as zero_count"
        dates = f"min({c})::date as date_min, max({c})::date as date_max, count(case when {c}::date > '2000-01-01' then 1 end) as future_dates" if kind == "date" else "null::date as date_min, null::date as date_max, 0::bigint as future_dates"
        regions = f"count(distinct {c})" if kind == "region" else "null::bigint"
        rows.append(f"select count(*) as row_count, '{c}' as column_name, round(avg(case when {c} is null then 1.0 else 0.0 end), 6)::double as null_rate, {number}, {dates}, {regions} as distinct_regions from {table}")
    return " union all ".join(rows)


@Q.add("qlt06_table_profile", profile_sql("lineitem"))
def _(v):
    return quality.profile(v.table("lineitem").select(*ITEM_COLUMNS), ["l_shipdate"], ["l_returnflag", "l_linestatus"], "2000-01-01")


RECONCILE_SQL = f"""select count(*) as overlap_rows, round(median(r), 6) as median_relative_difference, round(avg(case when r <= 0.05 then 1.0 else 0.0 end), 6)::double as within_5_percent_share from (select abs(a.total_cases - b.total_cases) / greatest(a.total_cases, b.total_cases, 1.0) as r
    from (select location_code, date, total_cases from ({EPIDEMIC_SQL}) where location_code is not null) a join ({VALIDATION_SQL}) b using (location_code, date) where a.total_cases > 0 and b.total_cases > 0)"""


@Q.add("qlt08_source_reconciliation", RECONCILE_SQL)
def _(v):
    main = epidemic(v).where("location_code IS NOT NULL").select("location_code", "date", "total_cases")
    return quality.reconcile(main, cleaning.validation_series(v.reports, v.mapping), ["location_code", "date"], "total_cases")


@Q.add("qlt09_serving_report", "select count(*) as total_records, min(date) as start_date, max(date) as end_date, count(distinct location_code) as region_count, count(distinct disease) as disease_count, count(case when neg then 1 end) as negative_correction_count, count(case when has_weather then 1 end) as weather_matched_count, count(*) - count(population) as population_unmatched_count, "
    + ", ".join(f"round(avg(case when {c} is null then 1.0 else 0.0 end), 6)::double as missing_{c}" for c in (*REQUIRED_OBSERVATION, "temperature_mean", "relative_humidity_mean", "population", "gdp_per_capita", "target_t_plus_7"))
    + ", count(*) - count(distinct (location_code, disease, date)) as duplicate_count from v_features")
def _(v):
    return quality.serving_report(v.gold)


def status_parts(v):
    """The ledger of the given tables: every source is counted, with its raw rows and the rows of its curated series."""
    catalog = assembling.silver_catalog(v)
    primary = cleaning.primary_observations(catalog, v.catalog).where("date IS NOT NULL")
    hours = v.hourly.select("date", "l_linenumber")
    tables = {
        "owid": (v.totals_daily, v.table("orders"), None), "kaggle_covid": (epidemic(v), v.reports, None), "tuberculosis": (v.annual_obs, None, None),
        "respiratory": (v.weekly_obs, None, None), "weather": (v.weather, v.table("lineitem"), None), "population": (population(v), None, None),
        "china_cdc": (v.table("pages").select("url").distinct(), v.table("pages"), None), "who": (catalog, v.table("events"), primary),
        "historical_weather": (hours.select("date").distinct(), hours, None),
    }
    return quality.named_sources(quality.ledger(tables))


#: Cleaned, raw and curated rows of each source, in the order of SOURCE_STATUS_ITEMS.
_COUNTED = (
    ("v_totals", "orders", None), (f"({EPIDEMIC_SQL})", "v_reports", None), ("(select * from v_obs where frequency = 'annual')", None, None), ("(select * from v_obs where frequency = 'weekly')", None, None), ("v_weather", "lineitem", None),
    (f"({SILVER_POPULATION})", None, None), ("(select distinct url from pages)", "pages", None), (f"({assembling.CATALOG_SQL})", "events", f"(select * from ({assembling.PRIMARY_SQL}) where year is not null)"), ("(select distinct date from v_hourly)", "v_hourly", None),
)
STATUS_SQL = "select *, case rule when 'index' then case when rows > 0 then 'info' else 'warn' end when 'catalog' then case when rows > 0 and primary_rows > 0 then 'ok' when rows > 0 then 'info' else 'not_configured' end when 'archive' then case when rows > 0 then 'ok' else 'warn' end else 'ok' end as status from (" + " union all ".join(
    f"select '{name}' as name, '{rule}' as rule, (select count(*) from {rows}) as rows, {f'(select count(*) from {raw})' if raw else 'null::bigint'} as raw_rows, {f'(select count(*) from {primary})' if primary else '0::bigint'} as primary_rows"
    for (name, part, rule), (rows, raw, primary) in zip(SOURCE_STATUS_ITEMS, _COUNTED)) + ")"


@Q.add("qlt10_source_status", STATUS_SQL)
def _(v):
    return quality.source_status(status_parts(v))


@Q.add("qlt11_model_coverage", """select disease, string_agg(distinct frequency, ',' order by frequency) as frequency, count(*) as feature_rows, count(distinct location_code) as location_count, min(date) as date_start, max(date) as date_end, count(case when has_weather then 1 end) as weather_matched_rows,
    count(population) as population_matched_rows, count(target_t_plus_7) as target_rows from v_features group by 1""")
def _(v):
    return quality.model_coverage(v.gold)


@Q.add("qlt12_feature_join_report", "select weather_match_level, weather_source, count(*) as rows, count(case when has_weather then 1 end) as matched_rows, count(case when not has_weather then 1 end) as unmatched_rows from v_features group by 1, 2")
def _(v):
    return gold.join_report(v.gold)


@Q.add("qlt12_feature_join_totals", """select count(*) as feature_rows, count(distinct location_code) as location_count, count(distinct disease) as disease_count, count(case when has_weather then 1 end) as weather_matched_rows, count(case when not has_weather then 1 end) as weather_unmatched_rows,
    round(avg(case when has_weather then 1.0 else 0.0 end), 6)::double as weather_match_rate, count(*) - count(population) as population_unmatched_rows from v_features""")
def _(v):
    return gold.join_totals(v.gold)


@Q.add("qlt13_reporting_profile", """select *, e_gap as date_gap_count, e_gap = 0 and zero_day_count >= 0.5 * observed_rows and p > 0 as sparse_reporting from (select location_code, disease, cast(max(date) - min(date) + 1 as int) as expected_calendar_days, count(*) as observed_rows, count(case when value = 0 then 1 end) as zero_day_count,
    round(cast(count(case when value = 0 then 1 end) as double) / count(*), 4) as zero_day_share, greatest(max(date) - min(date) + 1 - count(*), 0) as e_gap, count(case when value > 0 then 1 end) as p from v_filled where reported or disease <> 'view' group by 1, 2)""".replace("select *, e_gap", "select location_code, disease, expected_calendar_days, observed_rows, zero_day_count, zero_day_share, e_gap"))
def _(v):
    rows = v.series_filled.where("reported OR disease <> 'view'")
    return quality.reporting_profile(rows, ["location_code", "disease"], "date", "value")


@Q.add("qlt14_catalog_report", f"""select metric, value from (select cast(sum(duplicate_source_count) as bigint) as input_rows, count(*) as output_rows, cast(sum(duplicate_source_count - 1) as bigint) as duplicate_rows_removed, count(case when duplicate_source_count > 1 then 1 end) as duplicate_key_groups,
    count(case when duplicate_content_conflict then 1 end) as duplicate_content_conflict_groups, count(case when indicator_code = 'TB_c_newinc' and numeric_value_clean % 10 = 7 then 1 end) as invalid_raw_json_rows, count(distinct indicator_code) as indicator_count, count(numeric_value_clean) as numeric_rows, count(case when is_selected_country then numeric_value_clean end) as selected_country_numeric_rows,
    count(case when year > {assembling.YEAR_NOW} then 1 end) as future_date_rows, count(case when indicator_code = 'HIV_0000000026' and is_selected_country then 1 end) as primary_candidate_rows, count(case when indicator_code = 'HIV_0000000026' and is_selected_country and numeric_value_clean is null then 1 end) as primary_no_data_rows,
    (select count(*) from ({assembling.PRIMARY_SQL}) where year is not null) as primary_observation_rows, (select cast(sum(g) as bigint) from (select max(year) - min(year) + 1 - count(distinct year) as g from ({assembling.PRIMARY_SQL}) group by location_code)) as primary_year_gap_count,
    (select count(*) from (select distinct location_code, year from ({assembling.CATALOG_SQL}) where is_selected_country and numeric_value_clean is not null and indicator_code in ('TB_1', 'TB_c_newinc'))) as auxiliary_rows from ({assembling.CATALOG_SQL}))
    unpivot (value for metric in (input_rows, output_rows, duplicate_rows_removed, duplicate_key_groups, duplicate_content_conflict_groups, invalid_raw_json_rows, indicator_count, numeric_rows, selected_country_numeric_rows, future_date_rows, primary_candidate_rows, primary_no_data_rows, primary_observation_rows, primary_year_gap_count, auxiliary_rows))""")
def _(v):
    rows = assembling.silver_catalog(v)
    return quality.catalog_report(rows, cleaning.primary_observations(rows, v.catalog), cleaning.auxiliary_indicators(rows), assembling.YEAR_NOW)


_DAYS_OF_HOURS = "(select distinct date from v_hourly)"


@Q.add("qlt15_invariants", f"""select * from (values ('unique observation keys', (select count(*) = count(distinct (location_code, disease, date)) from v_features)), ('non-empty features', (select count(*) > 0 from v_features)), ('unique weather days', (select count(*) = count(distinct (location_code, date)) from v_weather)),
    ('more daily than annual rows', (select count(*) > count(distinct year(date)) from {_DAYS_OF_HOURS})), ('default range is the full range', (select bool_and(a <= b) from (select min(date) as a, max(date) as b from v_features group by location_code, disease)))) t(check_name, passed)""")
def _(v):
    """Daily against annual rows of the hourly matrix; every served series starts with its full range."""
    daily = v.hourly.select("date").distinct()
    annual = daily.select(F.year("date").alias("year")).distinct()
    return quality.invariants(v.gold, v.weather, daily, annual, serving.option_pages(v.scored, 10))
