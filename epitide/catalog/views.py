"""Role views: the given tables seen as epidemic, weather, population and catalog data.

Every view exists twice with the same meaning: as a DataFrame (class Views) and as SQL (VIEW_SQL), so a
query and its SQL start from the same rows. Measures are whole numbers, which keeps sums exact in any
order of addition.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from epitide.functions import calendar
from epitide.operators import reshape, windows
from epitide.plans import cleaning, features, forecasting, risk
from epitide.sources import scratch, sinks

SERIES = ["location_code", "disease"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NATIONS = list(range(25))
#: Tables the features are derived from.
GOLD_INPUTS = ("orders", "customer", "events", "lineitem", "supplier", "nation", "region")


def code_of(nation: str) -> Column:
    """Three-letter code of a nation key."""
    return F.concat(F.lit("NA"), F.char((F.col(nation) + 65).cast("long")))


def whole(column: str) -> Column:
    return F.floor(column).cast("long")


class Views:
    """Lazy role views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def kept(self, key: str, tables: tuple[str, ...], write) -> str:
        """Path of a table or model derived from the given tables."""
        return scratch.kept(self.spark, key, [f"{self.folder}/{t}.parquet" for t in tables], write)

    @cached_property
    def orders_located(self) -> DataFrame:
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        return (
            self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                code_of("c_nationkey").alias("location_code"), F.col("c_nationkey").alias("nation"),
                F.to_date("o_orderdate").alias("date"), whole("o_totalprice").alias("amount"),
                "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
            )
        )

    @cached_property
    def series_daily(self) -> DataFrame:
        """Events per location, type and day. Pre-aggregated per user and day before the join, so a
        user with a large share of the events reaches the shuffle as a few rows."""
        per_user = self.table("events").groupBy(
            "user_id", F.col("event_type").alias("disease"), F.to_date("ts").alias("date")
        ).agg(F.sum(whole("value")).alias("value"), F.count("*").alias("n"))
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        return (
            per_user.join(customers, F.col("user_id") == F.col("c_custkey"))
            .groupBy(code_of("c_nationkey").alias("location_code"), "disease", "date")
            .agg(F.sum("value").cast("double").alias("value"), F.sum("n").alias("n"))
        )

    @cached_property
    def series_filled(self) -> DataFrame:
        """series_daily on the full calendar, missing days as zero."""
        daily = self.series_daily
        lo, hi = daily.agg(F.min("date")).scalar(), daily.agg(F.max("date")).scalar()
        bounds = daily.select(*SERIES).distinct().withColumns({"_a": lo, "_b": hi})
        grid = bounds.select(*SERIES, F.explode(F.sequence("_a", "_b")).alias("date"))
        return grid.join(daily, [*SERIES, "date"], "left").select(
            *SERIES, "date", F.coalesce("value", F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("reported")
        )

    @cached_property
    def totals_daily(self) -> DataFrame:
        """Orders per location and day."""
        return self.orders_located.groupBy("location_code", "date").agg(
            F.sum("amount").cast("double").alias("day_total"), F.count("*").alias("n")
        )

    @cached_property
    def orders_by_day(self) -> DataFrame:
        """Orders per location, day and status, from which the daily, weekly and annual observations are added up.

        Kept as a silver table: orders are read and located once, and it is bounded by the calendar.
        """
        def write(path):
            rows = self.orders_located.groupBy("location_code", "date", "o_orderstatus")
            sinks.write_parquet(rows.agg(F.sum("amount").alias("amount"), F.count("*").alias("n")), path)

        return self.spark.read.parquet(self.kept("orders_by_day", ("orders", "customer"), write))

    @cached_property
    def cumulative(self) -> DataFrame:
        """Running total per location, as cumulative case reports publish it."""
        return windows.running_total(self.totals_daily, ["location_code"], "date", "day_total", "total_cases")

    @cached_property
    def reports(self) -> DataFrame:
        """Orders as cumulative report rows: a country name, a province that may be blank, text dates."""
        nation = self.table("nation").select("n_nationkey", "n_name")
        orders = self.orders_located.join(nation, F.col("nation") == F.col("n_nationkey"))
        return orders.select(
            F.col("o_orderkey").alias("SNo"),
            F.date_format("date", "MM/dd/yyyy").alias("ObservationDate"),
            F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "  ").otherwise(F.col("o_orderpriority")).alias("province_raw"),
            F.concat(F.lit(" "), F.col("n_name")).alias("country_region"),
            F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 10:00:00")).alias("last_update_raw"),
            F.col("amount").cast("double").alias("Confirmed"),
            (F.col("o_custkey") % 100).cast("double").alias("Deaths"),
            F.length("o_orderpriority").cast("double").alias("Recovered"),
        )

    @cached_property
    def mapping(self) -> DataFrame:
        """Name mapping: African names are disabled; two names share one code."""
        return self.nations.select(
            F.col("n_name").alias("name"),
            F.concat(F.lit("Std NATION_"), F.least("n_nationkey", F.lit(23))).alias("standard_name"),
            F.when(F.col("r_name") != "AFRICA", F.when(F.col("n_nationkey") == 24, "NAX").otherwise(code_of("n_nationkey"))).alias("mapped_code"),
        )

    @cached_property
    def nations(self) -> DataFrame:
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def locations(self) -> DataFrame:
        """Raw location catalog with an enabled flag and text coordinates."""
        return self.nations.select(
            code_of("n_nationkey").alias("location_code"), F.col("n_name").alias("location"),
            F.col("r_name").alias("representative_city"),
            (F.col("n_nationkey") * 3 - 36).cast("string").alias("latitude"),
            (F.col("n_nationkey") * 10 - 120).cast("string").alias("longitude"),
            F.when(F.col("r_name") == "AFRICA", "no").otherwise("Yes").alias("enabled"),
        )

    @cached_property
    def catalog(self) -> DataFrame:
        from epitide.sources.readers import location_catalog

        return location_catalog(self.locations)

    @cached_property
    def weather(self) -> DataFrame:
        """Line items per supplier location and ship date, as daily weather.

        Kept as a silver table: it is rolled up to several frequencies, each of which would read the line items again.
        """
        return self.spark.read.parquet(self.kept("weather", ("lineitem", "supplier"), lambda path: sinks.write_parquet(self.daily_weather(), path)))

    def daily_weather(self) -> DataFrame:
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        items = self.table("lineitem").select(
            "l_suppkey", F.to_date("l_shipdate").alias("date"), "l_quantity",
            F.round(F.col("l_discount") * 100).cast("int").alias("d"), F.round(F.col("l_tax") * 100).cast("int").alias("t"),
        )
        return (
            items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(code_of("s_nationkey").alias("location_code"), "date")
            .agg(
                F.avg("l_quantity").alias("temperature_mean"),
                F.max("l_quantity").alias("temperature_max"),
                F.min("l_quantity").alias("temperature_min"),
                F.sum("t").cast("double").alias("precipitation_sum"),
                (F.sum("d") / F.count("*")).alias("relative_humidity_mean"),
                F.max("t").cast("double").alias("wind_speed_max"),
            )
        )

    @cached_property
    def hourly(self) -> DataFrame:
        """Wide matrix: one column per nation, one row per ship date and line number ("hour"), in Kelvin."""
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        items = self.table("lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_linenumber", "l_quantity")
        cities = [
            F.max(F.when(F.col("s_nationkey") == k, F.col("l_quantity") + 273.15)).alias(f"city_{k}") for k in NATIONS
        ]
        return items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("date", "l_linenumber").agg(*cities)

    @cached_property
    def population(self) -> DataFrame:
        """Totals per location for even years only.

        Kept as a silver table: read from files, its size is known when a join is planned.
        """
        return self.spark.read.parquet(self.kept("population", ("orders", "customer"), lambda path: sinks.write_parquet(self.yearly_totals(), path)))

    def yearly_totals(self) -> DataFrame:
        return (
            self.orders_by_day.where(F.year("date") % 2 == 0)
            .groupBy("location_code", F.year("date").alias("year"))
            .agg(F.sum("amount").cast("double").alias("population"), F.sum("n").cast("double").alias("gdp_per_capita"))
        )

    @cached_property
    def records(self) -> DataFrame:
        """Event properties as JSON records with typed dimensions; error events are cut short."""
        k = F.get_json_object("props", "$.k")
        slot = F.when(F.col("event_type") == "click", F.lit("SEX")).otherwise(F.lit("AGEGROUP"))
        full = F.concat(
            F.lit('{"Id":'), F.col("event_id").cast("string"), F.lit(',"Dim1Type":"'), slot, F.lit('","Dim1":"V'), k,
            F.lit('","ParentLocationCode":"'), F.col("event_type"), F.lit('","NumericValue":'), k, F.lit("}"),
        )
        return self.table("events").select(
            "event_id", "event_type", F.to_date("ts").alias("date"),
            F.when(F.col("event_type") == "error", F.concat(F.lit("["), k, F.lit("]")))
            .when(F.col("event_type") == "view", F.substring(full, 1, 20))
            .otherwise(full).alias("raw_json"),
            k.cast("int").alias("k"),
        )

    @cached_property
    def wide(self) -> DataFrame:
        """series_daily with one column per event type."""
        return self.series_daily.groupBy("location_code", "date").agg(
            *(F.max(F.when(F.col("disease") == t, F.col("value"))).alias(t) for t in EVENT_TYPES)
        )

    # -- canonical observations and gold -------------------------------------------

    @cached_property
    def daily_obs(self) -> DataFrame:
        totals = self.orders_by_day.groupBy("location_code", "date").agg(
            F.sum("amount").cast("double").alias("day_total"), F.sum("n").alias("n")
        )
        return cleaning.observation(
            totals, location=F.lit(None), disease="COVID-19", frequency="daily", period_days=1, metric="new_cases",
            metric_label="daily", value=F.col("day_total"), new_deaths=F.col("n"), year=F.year("date"), source="orders",
            quality_flag="ok", is_negative_case_correction=F.col("n") > 3, total_cases=F.col("day_total"),
            total_deaths=F.col("n") * 2,
        )

    @cached_property
    def event_obs(self) -> DataFrame:
        return cleaning.observation(
            self.series_daily, location=F.lit(None), frequency="daily", period_days=1, metric="new_cases", metric_label="daily",
            year=F.year("date"), source="events", quality_flag="ok", is_negative_case_correction=F.lit(False),
        )

    def rolled(self, disease: str, frequency: str, metric: str, period: Column, where: str) -> DataFrame:
        rows = self.orders_by_day.where(where).groupBy("location_code", period.alias("date")).agg(
            F.sum("n").cast("double").alias("value"), F.sum("amount").cast("double").alias("total_cases")
        )
        return cleaning.observation(
            rows, location=F.lit(None), disease=disease, frequency=frequency, period_days=7 if frequency == "weekly" else 365,
            metric=metric, metric_label=frequency, year=F.year("date"), source="orders", quality_flag="ok",
            is_negative_case_correction=F.lit(False),
        )

    @cached_property
    def weekly_obs(self) -> DataFrame:
        return self.rolled("Influenza", "weekly", "hospital_admissions", calendar.week_end("date"), "o_orderstatus = 'F'")

    @cached_property
    def annual_obs(self) -> DataFrame:
        return self.rolled("Tuberculosis", "annual", "incidence_per_100k", calendar.year_end(F.year("date")), "true")

    @cached_property
    def obs(self) -> DataFrame:
        """The sources have disjoint diseases here, so the union needs no precedence."""
        return reshape.union_all([self.daily_obs, self.event_obs, self.weekly_obs, self.annual_obs])

    @cached_property
    def features(self) -> DataFrame:
        return features.build_features(self.obs, self.weather, self.population, self.catalog)

    @cached_property
    def gold(self) -> DataFrame:
        """The feature table as the serving questions see it: written once, partitioned by year."""
        return self.spark.read.parquet(self.kept("gold", GOLD_INPUTS, lambda path: sinks.write_partitioned(self.features, path, ["year"])))

    @cached_property
    def scored(self) -> DataFrame:
        """Gold with both baselines and the moving average as the chosen prediction."""
        rows = forecasting.baselines(self.gold)
        return rows.withColumn("prediction_t_plus_7", F.col("prediction_moving_average"))

    @cached_property
    def risk(self) -> DataFrame:
        return risk.risk_score(risk.latest_rows(self.scored))

    @cached_property
    def short_series(self) -> DataFrame:
        """Daily series with lags, target and moving average, straight from the events."""
        rows = windows.lags(self.series_daily, SERIES, "date", "value")
        rows = windows.rolling_mean(rows, SERIES, "date", "value")
        return windows.exact_target(rows, SERIES, "date", "value", "target", horizon=7)


# ---------------------------------------------------------------------------
# The same views as SQL
# ---------------------------------------------------------------------------
W = "partition by location_code, disease order by date"
_CITIES = ", ".join(
    f"max(case when s_nationkey = {k} then l_quantity + 273.15 end) as city_{k}" for k in NATIONS
)
_TYPES = ", ".join(f"max(case when disease = '{t}' then value end) as {t}" for t in EVENT_TYPES)


def _kinds(expr: str) -> str:
    """Choose the frame by frequency; expr has {n} (narrow rows back) and {w} (wide rows back)."""
    return (
        f"case frequency when 'daily' then {expr.format(n=6, w=13)} "
        f"when 'weekly' then {expr.format(n=3, w=7)} else {expr.format(n=2, w=5)} end"
    )


VIEW_SQL = {
    "v_orders": """select 'NA' || chr(65 + c_nationkey) as location_code, c_nationkey as nation, cast(o_orderdate as date) as date,
        cast(floor(o_totalprice) as bigint) as amount, o_orderkey, o_custkey, o_orderstatus, o_orderpriority
        from orders join customer on o_custkey = c_custkey""",
    "v_series": """select 'NA' || chr(65 + c_nationkey) as location_code, event_type as disease, cast(ts as date) as date,
        cast(sum(cast(floor(value) as bigint)) as double) as value, count(*) as n
        from events join customer on user_id = c_custkey group by 1, 2, 3""",
    "v_filled": """select k.location_code, k.disease, g.date, coalesce(s.value, 0.0) as value, s.value is not null as reported
        from (select distinct location_code, disease from v_series) k
        cross join (select cast(unnest(generate_series((select min(date) from v_series), (select max(date) from v_series), interval 1 day)) as date) as date) g
        left join v_series s on s.location_code = k.location_code and s.disease = k.disease and s.date = g.date""",
    "v_totals": """select location_code, date, cast(sum(amount) as double) as day_total, count(*) as n from v_orders group by 1, 2""",
    "v_cumulative": """select *, sum(day_total) over (partition by location_code order by date rows unbounded preceding) as total_cases from v_totals""",
    "v_nations": "select * from nation join region on n_regionkey = r_regionkey",
    "v_reports": """select o_orderkey as SNo, strftime(date, '%m/%d/%Y') as ObservationDate,
        case when o_orderpriority = '4-NOT SPECIFIED' then '  ' else o_orderpriority end as province_raw, ' ' || n_name as country_region,
        strftime(date, '%Y-%m-%d') || ' 10:00:00' as last_update_raw, cast(amount as double) as Confirmed,
        cast(o_custkey % 100 as double) as Deaths, cast(length(o_orderpriority) as double) as Recovered
        from v_orders join nation on nation = n_nationkey""",
    "v_mapping": """select n_name as name, 'Std NATION_' || least(n_nationkey, 23) as standard_name,
        case when r_name <> 'AFRICA' then case when n_nationkey = 24 then 'NAX' else 'NA' || chr(65 + n_nationkey) end end as mapped_code from v_nations""",
    "v_locations": """select 'NA' || chr(65 + n_nationkey) as location_code, n_name as location, r_name as representative_city,
        cast(n_nationkey * 3 - 36 as varchar) as latitude, cast(n_nationkey * 10 - 120 as varchar) as longitude,
        case when r_name = 'AFRICA' then 'no' else 'Yes' end as enabled from v_nations""",
    "v_catalog": """select location_code, location, representative_city, cast(latitude as double) as latitude, cast(longitude as double) as longitude
        from v_locations where lower(enabled) in ('1', 'true', 'yes', 'y')""",
    "v_weather": """select 'NA' || chr(65 + s_nationkey) as location_code, cast(l_shipdate as date) as date, avg(l_quantity) as temperature_mean,
        max(l_quantity) as temperature_max, min(l_quantity) as temperature_min, cast(sum(cast(round(l_tax * 100) as int)) as double) as precipitation_sum,
        cast(sum(cast(round(l_discount * 100) as int)) as double) / count(*) as relative_humidity_mean, cast(max(cast(round(l_tax * 100) as int)) as double) as wind_speed_max
        from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2""",
    "v_hourly": f"""select cast(l_shipdate as date) as date, l_linenumber, {_CITIES} from lineitem join supplier on l_suppkey = s_suppkey group by 1, 2""",
    "v_population": """select location_code, year(date) as year, cast(sum(amount) as double) as population, cast(count(*) as double) as gdp_per_capita
        from v_orders where year(date) % 2 = 0 group by 1, 2""",
    "v_records0": """select *, cast(ts as date) as date, json_extract_string(props, '$.k') as ks from events""",
    "v_records": """select event_id, event_type, date, case when event_type = 'error' then '[' || ks || ']' when event_type = 'view' then substr(f, 1, 20) else f end as raw_json, cast(ks as int) as k
        from (select *, '{"Id":' || event_id || ',"Dim1Type":"' || case when event_type = 'click' then 'SEX' else 'AGEGROUP' end || '","Dim1":"V' || ks ||
        '","ParentLocationCode":"' || event_type || '","NumericValue":' || ks || '}' as f from v_records0)""",
    "v_wide": f"select location_code, date, {_TYPES} from v_series group by 1, 2",
    "v_obs": """select location_code, 'COVID-19' as disease, date, 'daily' as frequency, 'new_cases' as metric, day_total as value, cast(n as double) as new_deaths, day_total as total_cases, cast(n * 2 as double) as total_deaths, n > 3 as neg, 'orders' as source from v_totals
        union all select location_code, disease, date, 'daily', 'new_cases', value, null, null, null, false, 'events' from v_series
        union all select location_code, 'Influenza', cast(date + cast((6 - dayofweek(date)) as int) as date), 'weekly', 'hospital_admissions', cast(count(*) as double), null, cast(sum(amount) as double), null, false, 'orders' from v_orders where o_orderstatus = 'F' group by 1, 3
        union all select location_code, 'Tuberculosis', make_date(year(date), 12, 31), 'annual', 'incidence_per_100k', cast(count(*) as double), null, cast(sum(amount) as double), null, false, 'orders' from v_orders group by 1, 3""",
    "v_rolled": f"""select *, avg(value) over ({W} rows 2 preceding) as rolling_mean_3,
        {_kinds(f'avg(value) over ({W} rows {{n}} preceding)')} as rolling_mean_7,
        {_kinds(f'avg(value) over ({W} rows {{w}} preceding)')} as rolling_mean_14,
        {_kinds(f'case when count(value) over ({W} rows {{n}} preceding) >= 2 then stddev_pop(value) over ({W} rows {{n}} preceding) end')} as rolling_std_7,
        {_kinds(f'case when count(value) over ({W} rows {{w}} preceding) >= 2 then stddev_pop(value) over ({W} rows {{w}} preceding) end')} as rolling_std_14
        from v_obs""",
    "v_lagged": f"""select *, rolling_mean_7 as new_cases_smoothed, lag(rolling_mean_7, 1) over ({W}) as lag_1, lag(rolling_mean_7, 3) over ({W}) as lag_3,
        lag(rolling_mean_7, 7) over ({W}) as lag_7, lag(rolling_mean_7, 14) over ({W}) as lag_14,
        case when frequency = 'daily' then rolling_mean_7 else value end as ts,
        case when frequency = 'daily' then 7 else 1 end as horizon_steps,
        case frequency when 'daily' then date + 7 when 'weekly' then date + 7 else cast(date + interval 1 year as date) end as target_day from v_rolled""",
    "v_targeted": """select a.*, b.ts as target_t_plus_7, (a.new_cases_smoothed - a.lag_1) / greatest(abs(a.lag_1), 1.0) as growth_rate_1,
        case when a.frequency = 'daily' then (a.new_cases_smoothed - a.lag_7) / greatest(abs(a.lag_7), 1.0) else (a.new_cases_smoothed - a.lag_1) / greatest(abs(a.lag_1), 1.0) end as growth0
        from v_lagged a left join v_lagged b on a.location_code = b.location_code and a.disease = b.disease and b.date = a.target_day""",
    "v_covariates": """select location_code, frequency, join_date, avg(temperature_mean) as temperature_mean, avg(temperature_max) as temperature_max, avg(temperature_min) as temperature_min,
        avg(precipitation_sum) as precipitation_sum, avg(relative_humidity_mean) as relative_humidity_mean, avg(wind_speed_max) as wind_speed_max,
        case frequency when 'daily' then 'exact_day' when 'weekly' then 'weekly_mean_to_saturday' else 'annual_mean' end as weather_match_level
        from (select *, case frequency when 'daily' then date when 'weekly' then cast(date + cast((6 - dayofweek(date)) as int) as date) else make_date(year(date), 12, 31) end as join_date
              from v_weather cross join (values ('daily'), ('weekly'), ('annual')) f(frequency)) group by 1, 2, 3""",
    "v_features": """select t.*, case when t.frequency = 'daily' then case when t.lag_7 is null then null else t.growth0 end else case when t.lag_1 is null then null else t.growth0 end end as growth_rate_7,
        c.temperature_mean, c.temperature_max, c.temperature_min, c.precipitation_sum, c.relative_humidity_mean, c.wind_speed_max,
        coalesce(c.weather_match_level, 'unmatched') as weather_match_level, case when c.weather_match_level is null then 'unmatched' else 'daily weather' end as weather_source,
        c.temperature_mean is not null and c.relative_humidity_mean is not null as has_weather,
        p.population, p.gdp_per_capita, k.location, k.representative_city, k.latitude, k.longitude,
        case when t.metric = 'incidence_per_100k' then t.value * 10.0 else t.value / nullif(p.population, 0) * 1000000.0 end as cases_per_million,
        t.new_deaths / nullif(p.population, 0) * 1000000.0 as deaths_per_million,
        year(t.date) as year, month(t.date) as month, isodow(t.date) as day_of_week, case when isodow(t.date) >= 6 then 1 else 0 end as is_weekend
        from (select *, year(date) as oy from v_targeted) t
        left join v_covariates c on c.location_code = t.location_code and c.frequency = t.frequency and c.join_date = t.date
        asof left join v_population p on p.location_code = t.location_code and t.oy >= p.year
        left join v_catalog k on k.location_code = t.location_code""",
    "v_scored": """select *, coalesce(ts, 0.0) as prediction_naive_last_value, coalesce(rolling_mean_7, ts, 0.0) as prediction_moving_average,
        coalesce(rolling_mean_7, ts, 0.0) as prediction_t_plus_7 from v_features""",
    "v_latest": """select * from (select *, row_number() over (partition by location_code, disease order by date desc) as rn from v_scored) where rn = 1""",
    "v_risk1": """select *, coalesce(cases_per_million, value) as recent, coalesce(prediction_t_plus_7, rolling_mean_7, value) as forecast_cases,
        coalesce(case when growth_rate_7 < 0 then 0.0 else growth_rate_7 end, 0.0) as g from v_latest""",
    "v_risk2": """select *, 0.55 * coalesce((recent - min(recent) over d) / nullif(max(recent) over d - min(recent) over d, 0), 0)
        + 0.25 * coalesce((g - min(g) over d) / nullif(max(g) over d - min(g) over d, 0), 0)
        + 0.20 * coalesce((forecast_cases - min(forecast_cases) over d) / nullif(max(forecast_cases) over d - min(forecast_cases) over d, 0), 0) as comp
        from v_risk1 window d as (partition by disease)""",
    "v_risk": """select *, round(case when comparable then 100.0 * (comp - lo) / (hi - lo) else 0.0 end, 2) as risk_score,
        case when not comparable then '不可比较' when round(100.0 * (comp - lo) / (hi - lo), 2) < 35 then '低风险' when round(100.0 * (comp - lo) / (hi - lo), 2) < 55 then '中风险'
        when round(100.0 * (comp - lo) / (hi - lo), 2) < 75 then '较高风险' else '高风险' end as risk_level
        from (select *, count(*) over d as risk_region_count, min(comp) over d as lo, max(comp) over d as hi,
              count(*) over d >= 2 and max(comp) over d - min(comp) over d > 1e-9 as comparable from v_risk2 window d as (partition by disease))""",
    "v_short": f"""select s.*, lag(s.value, 1) over w as lag_1, lag(s.value, 3) over w as lag_3, lag(s.value, 7) over w as lag_7, lag(s.value, 14) over w as lag_14,
        avg(s.value) over (partition by s.location_code, s.disease order by s.date rows 2 preceding) as rolling_mean_3,
        avg(s.value) over (partition by s.location_code, s.disease order by s.date rows 6 preceding) as rolling_mean_7,
        avg(s.value) over (partition by s.location_code, s.disease order by s.date rows 13 preceding) as rolling_mean_14, t.value as target
        from v_series s left join v_series t on t.location_code = s.location_code and t.disease = s.disease and t.date = s.date + 7
        window w as (partition by s.location_code, s.disease order by s.date)""",
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_[a-z0-9]+\b", text):
            if name in VIEW_SQL and name not in needed:
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} as ({VIEW_SQL[name]})" for name in needed)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
