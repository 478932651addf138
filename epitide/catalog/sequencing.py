"""Registered queries: window functions over series."""

from __future__ import annotations

from pyspark.sql import functions as F

from epitide.catalog.registry import Registry
from epitide.catalog.views import SERIES
from epitide.functions import measures
from epitide.operators import aggregates, joins, reshape, windows

Q = Registry()
W = "partition by location_code, disease order by date"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


@Q.add("win01_keep_latest", """select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by case when value < 20 then null else value end desc nulls last, event_id desc) as r from events) where r = 1""")
def _(v):
    events = v.table("events").select("user_id", "event_type", "event_id", "value")
    stamp = F.when(F.col("value") >= 20, F.col("value"))
    return windows.keep_latest(events, ["user_id", "event_type"], [stamp.desc_nulls_last(), F.desc("event_id")])


@Q.add("win02_cumulative_to_daily", "select location_code, date, day_total as change from v_totals")
def _(v):
    out = windows.diff_cumulative(v.cumulative, ["location_code"], "date", {"total_cases": "change"})
    return out.select("location_code", "date", "change")


@Q.add("win03_published_or_difference", """select location_code, date, case when n > 1 then cast(n as double) else case when row_number() over (partition by location_code order by date) = 1 then null else day_total end end as new_cases from v_totals""")
def _(v):
    rows = v.cumulative.withColumn("published", F.when(F.col("n") > 1, F.col("n").cast("double")))
    return windows.published_or_difference(rows, ["location_code"], "date", "published", "total_cases", "new_cases").select("location_code", "date", "new_cases")


@Q.add("win04_wide_matrix_difference", """select location_code, date, case when change < 0 then 0 else change end as change from (select location_code, date, coalesce(total - lag(total) over (partition by location_code order by date), total) as change
    from (select location_code, date, sum(value) as total from v_series group by 1, 2))""")
def _(v):
    out = windows.dense_difference(v.series_daily, ["location_code"], "date", "value")
    return out.select("location_code", "date", measures.clip_zero("change").alias("change"))


@Q.add("win05_lags", "select location_code, disease, date, lag_1, lag_3, lag_7, lag_14 from v_short")
def _(v):
    return windows.lags(v.series_daily, SERIES, "date", "value").drop("value", "n")


@Q.add("win06_rolling_means", "select location_code, disease, date, round(rolling_mean_3, 4) as rolling_mean_3, round(rolling_mean_7, 4) as rolling_mean_7, round(rolling_mean_14, 4) as rolling_mean_14 from v_short")
def _(v):
    return rounded(windows.rolling_mean(v.series_daily, SERIES, "date", "value"), "rolling_mean_3", "rolling_mean_7", "rolling_mean_14").drop("value", "n")


@Q.add("win07_frequency_aware_rolling", "select location_code, disease, date, frequency, round(rolling_mean_7, 4) as rolling_mean_7, round(rolling_mean_14, 4) as rolling_mean_14 from v_rolled")
def _(v):
    out = windows.frequency_features(v.obs, SERIES, published=None)
    return rounded(out.select(*SERIES, "date", "frequency", "rolling_mean_7", "rolling_mean_14"), "rolling_mean_7", "rolling_mean_14")


@Q.add("win08_rolling_deviation", f"""select location_code, disease, date, round(case when count(*) over ({W} rows 6 preceding) >= 2 then stddev_pop(value) over ({W} rows 6 preceding) end, 4) as rolling_std_7,
    round(case when count(*) over ({W} rows 13 preceding) >= 2 then stddev_pop(value) over ({W} rows 13 preceding) end, 4) as rolling_std_14 from v_series""")
def _(v):
    return rounded(windows.rolling_std(v.series_daily, SERIES, "date", "value"), "rolling_std_7", "rolling_std_14").drop("value", "n")


@Q.add("win09_growth_rates", "select location_code, disease, date, round(growth_rate_1, 4) as growth_rate_1, round(growth_rate_7, 4) as growth_rate_7 from v_features")
def _(v):
    out = windows.frequency_features(v.obs, SERIES)
    return rounded(out.select(*SERIES, "date", "growth_rate_1", "growth_rate_7"), "growth_rate_1", "growth_rate_7")


@Q.add("win10_lead_target", f"select location_code, disease, date, lead(value, 7) over ({W}) as target from v_series")
def _(v):
    return windows.lead_target(v.series_daily, SERIES, "date", "value", 7).select(*SERIES, "date", "target")


@Q.add("win11_exact_date_target", "select location_code, disease, date, frequency, round(target_t_plus_7, 4) as target_t_plus_7 from v_targeted")
def _(v):
    out = windows.frequency_features(v.obs, SERIES)
    return rounded(out.select(*SERIES, "date", "frequency", "target_t_plus_7"), "target_t_plus_7")


@Q.add("win12_latest_row", "select location_code, disease, max(date) as date, arg_max(value, date) as value, arg_max(n, date) as n from v_series group by 1, 2")
def _(v):
    return windows.keep_latest(v.series_daily, SERIES, [F.desc("date")])


@Q.add("win13_last_rows_per_series", f"select location_code, date, day_total from (select *, row_number() over (partition by location_code order by date desc) as r from v_totals) where r <= 250")
def _(v):
    return windows.last_n(v.totals_daily, ["location_code"], [F.desc("date")], 250).select("location_code", "date", "day_total")


TRAILING_SQL = """select s.location_code, s.disease, max(s.date) as latest_date, max(case when value <> 0 then s.date end) as last_nonzero_date, arg_max(value, case when value <> 0 then s.date end) filter (value <> 0) as last_nonzero_value,
    count(case when b is null or s.date > b then 1 end) as trailing_zero_periods, count(case when b is null or s.date > b then 1 end) >= 2 as reporting_stale
    from {src} s left join (select location_code, disease, max(case when value is null or value <> 0 then date end) as b from {src} group by 1, 2) k on k.location_code = s.location_code and k.disease = s.disease group by 1, 2"""


@Q.add("win14_trailing_zero_run", TRAILING_SQL.format(src="v_filled"))
def _(v):
    return windows.trailing_run(v.series_filled, SERIES, "date", "value", stale_after={"daily": 2})


GAPS_SQL = """(select g.location_code, g.year, p.population from (select location_code, cast(unnest(generate_series(min(year) - 1, max(year) + 1)) as bigint) as year from v_population group by 1) g left join v_population p on p.location_code = g.location_code and p.year = g.year)"""


def gaps(v):
    bounds = v.population.groupBy("location_code").agg((F.min("year") - 1).alias("a"), (F.max("year") + 1).alias("b"))
    grid = bounds.select("location_code", F.explode(F.sequence("a", "b")).alias("year"))
    return grid.join(v.population.select("location_code", "year", "population"), ["location_code", "year"], "left")


@Q.add("win15_linear_interpolation", f"""select a.location_code, a.year, coalesce(a.population, (b.population + c.population) / 2) as population, a.population is null and b.population is not null and c.population is not null as is_interpolated
    from {GAPS_SQL} a left join v_population b on b.location_code = a.location_code and b.year = a.year - 1 left join v_population c on c.location_code = a.location_code and c.year = a.year + 1""")
def _(v):
    return windows.interpolate(gaps(v), ["location_code"], "year", "population")


BOUNDED_SQL = """with g as (select k.location_code, k.disease, k.date, s.value, row_number() over (partition by k.location_code, k.disease order by k.date) as pos from (select location_code, disease, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from v_series group by 1, 2) k
    left join v_series s on s.location_code = k.location_code and s.disease = k.disease and s.date = k.date),
    h as (select *, last_value(case when value is not null then pos end ignore nulls) over (partition by location_code, disease order by date rows between unbounded preceding and current row) as p0,
        first_value(case when value is not null then pos end ignore nulls) over (partition by location_code, disease order by date rows between current row and unbounded following) as p1 from g)
    select h.location_code, h.disease, h.date, round(coalesce(h.value, case when h.pos - h.p0 <= 1 then a.value + (b.value - a.value) * ((h.pos - h.p0) / (h.p1 - h.p0)) end), 4) as value, h.value is null and h.pos - h.p0 <= 1 and h.p1 is not null as is_interpolated
    from h left join g a on a.location_code = h.location_code and a.disease = h.disease and a.pos = h.p0 left join g b on b.location_code = h.location_code and b.disease = h.disease and b.pos = h.p1"""


@Q.add("win16_bounded_interpolation", BOUNDED_SQL)
def _(v):
    grid = joins.calendar_grid(v.series_daily.select(*SERIES, "date", "value"), SERIES, "date")
    out = windows.interpolate(grid, SERIES, F.unix_date("date"), "value", limit=1, order="date")
    return out.select(*SERIES, "date", F.round("value", 4).alias("value"), "is_interpolated")


@Q.add("win17_fill_forward", f"select location_code, year, last_value(population ignore nulls) over (partition by location_code order by year) as population from {GAPS_SQL}")
def _(v):
    return windows.fill(gaps(v), ["location_code"], "year", ["population"])


@Q.add("win17_fill_both", f"""select location_code, year, coalesce(last_value(population ignore nulls) over (partition by location_code order by year), first_value(population ignore nulls) over (partition by location_code order by year rows between current row and unbounded following)) as population from {GAPS_SQL}""")
def _(v):
    return windows.fill(gaps(v), ["location_code"], "year", ["population"], "both")


@Q.add("win18_minmax_per_group", """select location_code, disease, date, round(coalesce((x - min(x) over (partition by disease)) / nullif(max(x) over (partition by disease) - min(x) over (partition by disease), 0), 0), 4) as scaled
    from (select *, case when disease = 'view' then 5.0 else coalesce(case when n > 5 then null else value end, 0) end as x from v_series)""")
def _(v):
    x = F.when(F.col("disease") == "view", F.lit(5.0)).when(F.col("n") <= 5, F.col("value"))
    out = windows.minmax(v.series_daily.withColumn("x", x), ["disease"], {"x": "scaled"})
    return rounded(out.select(*SERIES, "date", "scaled"), "scaled")


@Q.add("win19_group_flag", """select o_orderkey, bool_or(o_orderpriority <> '4-NOT SPECIFIED') over (partition by o_custkey, o_orderstatus) as has_province from orders""")
def _(v):
    # The flag is aggregated and joined back, so a customer with very many orders is never one window.
    orders = v.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    flags = orders.groupBy("o_custkey", "o_orderstatus").agg(F.bool_or(F.col("o_orderpriority") != "4-NOT SPECIFIED").alias("has_province"))
    return orders.join(flags, ["o_custkey", "o_orderstatus"]).select("o_orderkey", "has_province")


@Q.add("win20_window_arrays", f"""with g as (select k.location_code, k.disease, k.date, s.value from (select location_code, disease, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from v_series group by 1, 2) k
    left join v_series s on s.location_code = k.location_code and s.disease = k.disease and s.date = k.date)
    select location_code, disease, date, first_of as first_value, sum_of as window_sum, t as target, value as current_value from (select *, count(value) over ({W} rows 4 preceding) as c, lag(value, 4) over ({W}) as first_of, sum(value) over ({W} rows 4 preceding) as sum_of, lead(value, 3) over ({W}) as t from g) where c = 5 and value is not null""")
def _(v):
    grid = joins.calendar_grid(v.series_daily.select(*SERIES, "date", "value"), SERIES, "date")
    out = windows.window_arrays(grid, SERIES, "date", "value", 5, 3)
    return out.select(
        *SERIES, "date", F.element_at("input_window", 1).alias("first_value"), F.aggregate("input_window", F.lit(0.0), lambda a, x: a + x).alias("window_sum"), "target", "current_value"
    )


@Q.add("win21_running_totals", "select location_code, date, total_cases from v_cumulative")
def _(v):
    return windows.running_total(v.totals_daily, ["location_code"], "date", "day_total", "total_cases").select("location_code", "date", "total_cases")


@Q.add("win22_positional_split", """select o_orderkey, case when pos <= lt then 'train' when pos <= greatest(lt + 1, least(n - 1, cast(floor(n * 0.85) as int) - 1)) then 'validation' else 'test' end as split from (select o_orderkey, o_orderdate from orders) o
    join (select *, greatest(0, least(n - 1, cast(floor(n * 0.7) as int) - 1)) as lt from (select d, row_number() over (order by d) - 1 as pos, count(*) over () as n from (select distinct o_orderdate as d from orders))) k on k.d = o.o_orderdate""")
def _(v):
    orders = v.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return windows.positional_split(orders, "date").select("o_orderkey", "split")


