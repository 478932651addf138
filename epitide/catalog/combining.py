"""Registered queries: joins, set operations, reshaping and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from epitide.catalog.registry import Registry
from epitide.catalog.views import EVENT_TYPES, NATIONS, PRIORITIES, SERIES, code_of

from epitide.operators import aggregates, joins, reshape
from epitide.plans import serving
from epitide.schema import WEATHER_VALUES

Q = Registry()
W = "partition by location_code, disease order by date"


@Q.add("joi01_left_dimension", "select s.s_suppkey, n.n_name as nation, n.n_regionkey as n_regionkey from supplier s left join (select * from nation where n_regionkey <> 0) n on s.s_nationkey = n.n_nationkey")
def _(v):
    dim = v.table("nation").where("n_regionkey <> 0").withColumnRenamed("n_name", "nation")
    return joins.left_dimension(v.table("supplier"), dim, "s_nationkey", "n_nationkey", ["nation", "n_regionkey"]).select("s_suppkey", "nation", "n_regionkey")


@Q.add("joi02_left_multi_key", """select t.location_code, t.date, t.day_total, w.temperature_max, w.precipitation_sum from v_totals t left join v_weather w on w.location_code = t.location_code and w.date = t.date""")
def _(v):
    return v.totals_daily.join(v.weather, ["location_code", "date"], "left").select("location_code", "date", "day_total", "temperature_max", "precipitation_sum")


@Q.add("joi03_asof_backward", """select t.location_code, t.date, p.population, p.year as matched_year from (select *, year(date) as y from v_totals) t asof left join v_population p on p.location_code = t.location_code and t.y >= p.year""")
def _(v):
    out = joins.asof_backward(v.totals_daily, v.population, ["location_code"], F.year("date"), "year", ["population"])
    return out.select("location_code", "date", "population", "matched_year")


@Q.add("joi04_same_year_with_fallback", """select t.location_code, t.date, coalesce(p.population, t.day_total) as population from v_totals t left join v_population p on p.location_code = t.location_code and p.year = year(t.date)""")
def _(v):
    rows = v.totals_daily.withColumn("year", F.year("date"))
    return joins.same_key_with_fallback(rows, v.population, ["location_code", "year"], {"population": "day_total"}).select("location_code", "date", "population")


@Q.add("joi05_frequency_covariates", """select location_code, disease, date, round(temperature_mean, 4) as temperature_mean, round(relative_humidity_mean, 4) as relative_humidity_mean, weather_match_level, weather_source from v_features""")
def _(v):
    out = joins.join_by_period(v.obs.select(*SERIES, "date", "frequency"), v.weather, ["location_code"], list(WEATHER_VALUES), source="daily weather")
    return out.select(*SERIES, "date", F.round("temperature_mean", 4).alias("temperature_mean"), F.round("relative_humidity_mean", 4).alias("relative_humidity_mean"), "weather_match_level", "weather_source")


@Q.add("joi06_source_precedence", """select coalesce(a.location_code, b.location_code) as location_code, coalesce(a.date, b.date) as date, case when b.location_code is not null then b.temperature_max + 100 else a.temperature_max end as temperature_max,
    case when b.location_code is not null then 'archive' else 'daily' end as level from v_weather a full join (select * from v_weather where temperature_min < 10) b on a.location_code = b.location_code and a.date = b.date""")
def _(v):
    main = v.weather.select("location_code", "date", "temperature_max", F.lit("daily").alias("level"))
    archive = v.weather.where("temperature_min < 10").select("location_code", "date", (F.col("temperature_max") + 100).alias("temperature_max"), F.lit("archive").alias("level"))
    return joins.merge_by_precedence([main, archive], ["location_code", "date"])


@Q.add("joi07_cross_source_pairs", """select o_orderkey as order_key, cast(floor(o_totalprice) as bigint) as total_orders, t as total_items from orders join
    (select l_orderkey, cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as t from lineitem group by 1) on l_orderkey = o_orderkey""")
def _(v):
    orders = v.table("orders").select(F.col("o_orderkey").alias("order_key"), F.floor("o_totalprice").alias("total"))
    items = v.table("lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.sum(F.floor("l_extendedprice")).alias("total"))
    return joins.reconcile_pairs(orders, items, ["order_key"], "total", ("_orders", "_items"))


@Q.add("joi08_indicator_left_joins", """select y.location_code, y.year, y.n, a.total as deaths_all_ages, b.total as case_detection_rate, c.total as treatment_success from v_y y
    left join v_y a on a.location_code = y.location_code and a.year = y.year and a.n > 80 left join v_y b on b.location_code = y.location_code and b.year = y.year and b.n > 85
    left join v_y c on c.location_code = y.location_code and c.year = y.year and c.n > 90""".replace("v_y", "(select location_code, year(date) as year, count(*) as n, cast(sum(amount) as double) as total from v_orders group by 1, 2)"))
def _(v):
    yearly = v.orders_located.groupBy("location_code", F.year("date").alias("year")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))
    files = {name: yearly.where(F.col("n") > limit) for name, limit in (("deaths_all_ages", 80), ("case_detection_rate", 85), ("treatment_success", 90))}
    wide = joins.stack_indicators(files, ["location_code", "year"], ["total"])
    return yearly.drop("total").join(wide, ["location_code", "year"], "left")


@Q.add("joi09_indicator_outer_pivot", """select location_code, year, """ + ", ".join(
    f"max(case when o_orderpriority = '{p}' then total end) as p{p[0]}, max(case when o_orderpriority = '{p}' then n end) as p{p[0]}_n" for p in PRIORITIES
) + """ from (select location_code, year(date) as year, o_orderpriority, cast(sum(amount) as double) as total, count(*) as n from v_orders group by 1, 2, 3) group by 1, 2""")
def _(v):
    long = v.orders_located.groupBy("location_code", F.year("date").alias("year"), "o_orderpriority").agg(F.sum("amount").cast("double").alias("total"), F.count("*").alias("n"))
    return joins.pivot_indicators(long, ["location_code", "year"], "o_orderpriority", {p: f"p{p[0]}" for p in PRIORITIES}, ["total", "n"])


@Q.add("joi10_metric_outer_join", """select coalesce(a.date, b.date) as date, a.total as orders_total, b.quantity as shipped from (select cast(o_orderdate as date) as date, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as total from orders group by 1) a
    full join (select cast(l_shipdate as date) as date, sum(l_quantity) as quantity from lineitem group by 1) b on a.date = b.date""")
def _(v):
    a = v.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum(F.floor("o_totalprice")).alias("orders_total"))
    b = v.table("lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("shipped"))
    return a.join(b, "date", "outer")


@Q.add("joi11_many_to_one", "select doc_id, c as copies, v as variants from documents d join (select text as t, count(*) as c, count(distinct lang) as v from documents group by 1) on t = text")
def _(v):
    docs = v.table("documents").select("doc_id", F.sha2("text", 256).alias("digest"), "lang")
    counts = aggregates.variant_counts(docs, "digest", "lang").select(
        "digest", F.col("duplicate_source_count").alias("copies"), F.col("duplicate_content_variant_count").alias("variants")
    )
    return joins.many_to_one(docs, counts, "digest", ["copies", "variants"]).select("doc_id", "copies", "variants")


@Q.add("joi12_calendar_grid", """select k.location_code, k.disease, k.date, s.value, s.value is not null as is_observed from (select location_code, disease, cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
    from v_series group by 1, 2) k left join v_series s on s.location_code = k.location_code and s.disease = k.disease and s.date = k.date""")
def _(v):
    return joins.calendar_grid(v.series_daily.select(*SERIES, "date", "value"), SERIES, "date")


@Q.add("joi12_year_grid", """select k.location_code, k.year, p.population from (select location_code, unnest(generate_series(least(min(year), 1994), greatest(max(year), 2002))) as year from v_population group by 1) k
    left join v_population p on p.location_code = k.location_code and p.year = k.year""")
def _(v):
    return joins.year_grid(v.population.select("location_code", "year", "population"), ["location_code"], "year", 1994, 2002)


@Q.add("joi13_self_join_target", "select location_code, disease, date, value, target from v_short")
def _(v):
    return joins.exact_target_by_join(v.series_daily, SERIES, "date", "value", 7).select(*SERIES, "date", "value", "target")


@Q.add("joi14_catalog_enrichment", """select t.location_code, t.date, coalesce(case when t.n > 1 then 'own' end, c.location) as location, c.representative_city, c.latitude, c.longitude from v_totals t left join v_catalog c on c.location_code = t.location_code""")
def _(v):
    rows = v.totals_daily.withColumn("location", F.when(F.col("n") > 1, "own"))
    return joins.enrich_location(rows, v.catalog).select("location_code", "date", "location", "representative_city", "latitude", "longitude")


@Q.add("joi15_semi_join", "select c_custkey, c_nationkey from customer where c_nationkey in (select n_nationkey from v_nations where r_name = 'ASIA')")
def _(v):
    asia = v.nations.where("r_name = 'ASIA'").select(F.col("n_nationkey").alias("c_nationkey"))
    return joins.semi(v.table("customer").select("c_custkey", "c_nationkey"), asia, ["c_nationkey"])


@Q.add("joi16_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def _(v):
    orders = v.table("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.anti(v.table("customer").select("c_custkey"), orders, ["c_custkey"])


@Q.add("joi16_unmapped_names", "select distinct trim(country_region) as name from v_reports where trim(country_region) in (select name from v_mapping where mapped_code is null)")
def _(v):
    return joins.unmapped_names(v.reports.select(F.trim("country_region").alias("name")), v.mapping, "name")


@Q.add("joi17_history_with_predictions", """select s.location_code, s.disease, s.date, s.value, round(p.prediction, 4) as prediction, round(case when p.prediction is not null then greatest(p.prediction * 0.85, 0.0) end, 4) as lower, round(p.prediction * 1.15, 4) as upper, round(p.prediction - s.target, 4) as prediction_error
    from v_short s left join (select location_code, disease, date, rolling_mean_7 as prediction from v_short where target is not null) p on p.location_code = s.location_code and p.disease = s.disease and p.date = s.date""")
def _(v):
    history = v.short_series.select(*SERIES, "date", "value", F.col("target").alias("target_t_plus_7"))
    predicted = v.short_series.where("target IS NOT NULL").select(*SERIES, "date", F.col("rolling_mean_7").alias("prediction"))
    out = serving.history_with_predictions(history, predicted)
    return out.select(*SERIES, "date", "value", *(F.round(c, 4).alias(c) for c in ("prediction", "lower", "upper", "prediction_error")))


@Q.add("joi18_listed_files_present", """select page_id, cast(count(h) as bigint) as listed_count, cast(count(case when u.path is not null then 1 end) as bigint) as existing_count, count(h) = count(case when u.path is not null then 1 end) as complete
    from (select page_id, unnest(case when len(l) = 0 then [null] else l end) as h from (select page_id, regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>', 1) as l from pages)) left join (select distinct '/' || split_part(p_name, ' ', 1) as path from part union select '/the' union select '/The' union select '/and') u on u.path = h group by 1""")
def _(v):
    from epitide.functions import text

    pages = v.table("pages").select("page_id", F.transform(text.anchors("html"), lambda a: a["href"]).alias("links"))
    words = v.table("part").select(F.concat(F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("path"))
    inventory = reshape.union_all([words, *(v.table("region").select(F.lit(p).alias("path")).distinct() for p in ("/the", "/The", "/and"))])
    return joins.listed_files_present(pages, "page_id", "links", inventory, "path")


@Q.add("joi19_id_to_code", "select vec_id, label, 'NA' || chr(65 + n_nationkey) as location_code from embeddings left join nation on n_nationkey = label")
def _(v):
    index = v.table("nation").select("n_nationkey", code_of("n_nationkey").alias("location_code"))
    return joins.left_dimension(v.table("embeddings").select("vec_id", "label"), index, "label", "n_nationkey", ["location_code"])


# -- set operations --------------------------------------------------------------

@Q.add("set01_union_of_projections", """select location_code, year, population as amount, 'population' as source from v_population union all select location_code, year, gdp_per_capita, 'gdp' from v_population""")
def _(v):
    pop = v.population
    return reshape.union_all([
        pop.select("location_code", "year", F.col("population").alias("amount"), F.lit("population").alias("source")),
        pop.select(F.lit("gdp").alias("source"), "location_code", "year", F.col("gdp_per_capita").alias("amount")),
    ])


@Q.add("set02_union_missing_columns", """select event_id as id, event_type, value, cast(null as varchar) as o_orderpriority from events union all select o_orderkey, null, null, o_orderpriority from orders""")
def _(v):
    events = v.table("events").select(F.col("event_id").alias("id"), "event_type", "value")
    return reshape.union_all([events, v.table("orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")], missing=True)


@Q.add("set03_union_with_precedence", """select coalesce(a.location_code, b.location_code) as location_code, coalesce(a.year, b.year) as year, coalesce(b.population, a.population) as population, case when b.population is not null then 'orders' else 'even years' end as source
    from v_population a full join (select location_code, year(date) as year, cast(count(*) as double) as population from v_orders where year(date) > 1997 group by 1, 2) b on a.location_code = b.location_code and a.year = b.year""")
def _(v):
    first = v.population.select("location_code", "year", "population", F.lit("even years").alias("source"))
    later = v.orders_located.where("year(date) > 1997").groupBy("location_code", F.year("date").alias("year")).agg(F.count("*").cast("double").alias("population"))
    return joins.merge_by_precedence([first, later.withColumn("source", F.lit("orders"))], ["location_code", "year"])


@Q.add("set04_drop_duplicates", "select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1")
def _(v):
    return reshape.drop_duplicates(v.table("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.desc("o_orderkey")])


@Q.add("set05_key_overlap", """select coalesce(a.k, b.k) as date, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end as side from (select distinct cast(o_orderdate as date) as k from orders) a full join (select distinct cast(l_shipdate as date) as k from lineitem) b on a.k = b.k""")
def _(v):
    left = v.table("orders").select(F.to_date("o_orderdate").alias("date"))
    return reshape.key_overlap(left, v.table("lineitem").select(F.to_date("l_shipdate").alias("date")), ["date"])


@Q.add("set05_common_dates", """select t.location_code, count(*) as common_date_count, min(t.date) as common_start, max(t.date) as common_end from v_totals t join v_weather w on w.location_code = t.location_code and w.date = t.date group by 1""")
def _(v):
    return reshape.common_range(v.totals_daily, v.weather, ["location_code"], "date")


# -- reshape ---------------------------------------------------------------------

@Q.add("rsh01_year_columns_to_long", "select location_code, year, population from v_population")
def _(v):
    years = sorted(r["year"] for r in v.population.select("year").distinct().collect())  # the header: calendar years
    wide = v.population.groupBy("location_code").agg(*(F.max(F.when(F.col("year") == y, F.col("population"))).alias(f"{y} Population") for y in years))
    columns = reshape.columns_matching(wide, r"\d{4} Population")
    return reshape.wide_to_long(wide, ["location_code"], columns, "year", "population", r"(\d{4})").where("population IS NOT NULL")


@Q.add("rsh02_city_columns_to_long", """select date, l_linenumber, 'city_' || s_nationkey as city, max(l_quantity) + 273.15 as kelvin from (select cast(l_shipdate as date) as date, l_linenumber, s_nationkey, l_quantity from lineitem join supplier on l_suppkey = s_suppkey) group by all""".replace("max(l_quantity) + 273.15", "round(max(l_quantity) + 273.15, 4)"))
def _(v):
    cities = [f"city_{k}" for k in NATIONS]
    long = reshape.wide_to_long(v.hourly, ["date", "l_linenumber"], cities, "city", "kelvin").where("kelvin IS NOT NULL")
    return long.withColumn("kelvin", F.round("kelvin", 4))


@Q.add("rsh03_long_to_wide", "select location_code, date, click, error, purchase, signup, view from v_wide")
def _(v):
    return reshape.long_to_wide(v.series_daily, ["location_code", "date"], "disease", "value", EVENT_TYPES)


@Q.add("rsh04_row_to_measures", """select l_orderkey, l_linenumber, l_partkey, 'admissions' as disease, l_quantity as value, l_tax as share from lineitem union all select l_orderkey, l_linenumber, l_partkey, 'influenza', l_extendedprice, l_discount from lineitem""")
def _(v):
    items = v.table("lineitem")
    return reshape.split_measures(items, ["l_orderkey", "l_linenumber", "l_partkey"], [
        ("admissions", {"value": F.col("l_quantity"), "share": F.col("l_tax")}),
        ("influenza", {"value": F.col("l_extendedprice"), "share": F.col("l_discount")}),
    ], "disease")


@Q.add("rsh05_series_document", """select location_code, disease, '[' || string_agg('{"date":"' || date || '","value":' || cast(value as bigint) || '}', ',' order by date) || ']' as points from v_series group by 1, 2""")
def _(v):
    rows = v.series_daily.withColumn("value", F.col("value").cast("long"))
    docs = reshape.series_documents(rows, SERIES, [], ["date", "value"], "date")
    return docs.select(*SERIES, F.to_json("points").alias("points"))


@Q.add("rsh06_availability_map", """select disease, (row_number() over (partition by disease order by location_code) - 1) // 10 as page, location_code, full_start, full_end, full_start as default_start, full_end as default_end, last_nonzero_date
    from (select disease, location_code, min(date) as full_start, max(date) as full_end, max(case when abs(value) > 1e-9 then date end) as last_nonzero_date from v_features group by 1, 2)""")
def _(v):
    """The pages of each disease, one row per entry."""
    return serving.option_pages(v.scored, 10).select("disease", "page", F.inline("entries"))


@Q.add("rsh07_explode_links", """select page_id, h as link from (select page_id, unnest(case when len(l) = 0 then [null] else l end) as h from (select page_id, regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>', 1) as l from pages))""")
def _(v):
    from epitide.functions import text

    links = F.transform(text.anchors("html"), lambda a: a["href"])
    return v.table("pages").select("page_id", F.explode_outer(links).alias("link"))


# -- ordering --------------------------------------------------------------------

@Q.add("top01_global_order", "select location_code, date, day_total from v_totals order by 1, 2")
def _(v):
    return v.totals_daily.select("location_code", "date", "day_total").orderBy("location_code", "date")


@Q.add("top02_top_200", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 200")
def _(v):
    return reshape.top_n(v.table("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 200)


@Q.add("top03_three_rankings", " union all ".join(
    f"select * from (select '{n}' as ranking, row_number() over (order by coalesce({c}, 0) desc, location_code, disease) as position, location_code, disease, round({c}, 4) as score from v_risk) where position <= 50"
    for n, c in (("risk", "risk_score"), ("growth", "growth_rate_7"), ("forecast", "forecast_cases"))))
def _(v):
    rows = reshape.rankings(v.risk, {"risk": "risk_score", "growth": "growth_rate_7", "forecast": "forecast_cases"}, SERIES, 50)
    score = F.when(F.col("ranking") == "risk", F.col("risk_score")).when(F.col("ranking") == "growth", F.col("growth_rate_7")).otherwise(F.col("forecast_cases"))
    return rows.select("ranking", "position", *SERIES, F.round(score, 4).alias("score"))


@Q.add("top04_mixed_direction_order", "select p_brand, count(*) as rows, min(p_size) as size_min from part group by 1 order by 2 desc, 1")
def _(v):
    return v.table("part").groupBy("p_brand").agg(F.count("*").alias("rows"), F.min("p_size").alias("size_min")).orderBy(F.desc("rows"), "p_brand")


@Q.add("top05_first_examples", "select event_id, event_type from events order by event_id limit 5")
def _(v):
    return reshape.top_n(v.table("events").select("event_id", "event_type"), [F.col("event_id")], 5)


@Q.add("top06_worst_null_rates", """select * from (values {}) t(column_name, null_rate) order by null_rate desc, column_name limit 3""".format(
    ", ".join(f"('{t}', (select round(avg(case when {t} is null then 1.0 else 0.0 end), 6) from v_wide))" for t in EVENT_TYPES)).replace("select * from", "select column_name, cast(null_rate as double) as null_rate from"))
def _(v):
    return reshape.top_n(aggregates.null_rates(v.wide, EVENT_TYPES), [F.desc("null_rate"), F.col("column_name")], 3)


