"""Registered queries: sources and sinks.

Raw files are derived from the given tables, written to the shared scratch folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from epitide import schema
from epitide.catalog.registry import Registry
from epitide.catalog.views import SERIES
from epitide.sources import readers, scratch, sinks

Q = Registry()
_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()


def layout(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


@Q.add("src01_csv_schema_and_renames", "select o_orderkey as order_id, o_orderpriority as province_raw, strftime(o_orderdate, '%m/%d/%Y') as observation_date, o_totalprice as confirmed from orders")
def _(v):
    path = scratch.shared_dir(v.spark, "reports-csv")
    v.table("orders").select(
        F.col("o_orderkey").alias("SNo"), F.col("o_orderpriority").alias("Province/State"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("ObservationDate"), F.col("o_totalprice").alias("Confirmed"),
    ).write.option("header", True).csv(path)
    fields = layout(("SNo", _L), ("Province/State", _S), ("ObservationDate", _S), ("Confirmed", _D))
    return readers.read_csv(v.spark, path, fields, {
        "SNo": "order_id", "Province/State": "province_raw", "ObservationDate": "observation_date", "Confirmed": "confirmed",
    })


@Q.add("src02_glob_scan", "select event_type, count(*) as rows, round(sum(value), 2) as total, true as has_file from events group by 1")
def _(v):
    root = scratch.shared_dir(v.spark, "events-per-type")
    v.table("events").select("event_id", "value", "event_type").write.partitionBy("event_type").option("header", True).csv(root)
    rows = readers.read_glob(v.spark, root, layout(("event_id", _L), ("value", _D)))
    kind = F.regexp_extract("source_file", "event_type=([a-z]+)", 1)
    return rows.groupBy(kind.alias("event_type")).agg(
        F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("total"), F.bool_and(F.length("file_name") > 0).alias("has_file")
    )


@Q.add("src03_tolerant_projection", """select event_type, count(*) as rows, cast(sum(case when event_type in ('click', 'view') then 1 else 0 end) as bigint) as without_value, 1 as rejected_files
    from events where event_type <> 'error' group by 1""")
def _(v):
    root = scratch.shared_dir(v.spark, "tolerant")
    events = v.table("events").select("event_id", "event_type", "value", "user_id")
    parts = {
        "full": events.where("event_type NOT IN ('click', 'view', 'error')"),
        "short": events.where("event_type IN ('click', 'view')").drop("value"),
        "broken": events.where("event_type = 'error'").drop("event_type"),
    }
    for name, part in parts.items():
        part.write.option("header", True).csv(f"{root}/{name}")
    rows, rejected = readers.read_tolerant(
        v.spark, [f"{root}/{name}" for name in parts], {"event_id": "bigint", "event_type": "string", "value": "double"}, ["event_id", "event_type"]
    )
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("without_value")).withColumn(
        "rejected_files", F.lit(len(rejected))
    )


FILE_NAME_SQL = """'who_' || case lang when 'en' then 'covid' when 'fr' then 'influenza' when 'de' then 'tuberculosis' when 'es' then 'hiv' else lang end || '_' || source || '_202607' || lpad(cast(doc_id % 28 + 1 as varchar), 2, '0') || 'T' || lpad(cast(n_chars % 1000000 as varchar), 6, '0') || 'Z.csv'"""
FILE_NAME = """concat('who_', case lang when 'en' then 'covid' when 'fr' then 'influenza' when 'de' then 'tuberculosis' when 'es' then 'hiv' else lang end, '_', source, '_202607', lpad(string(doc_id % 28 + 1), 2, '0'), 'T', lpad(string(n_chars % 1000000), 6, '0'), 'Z.csv')"""


@Q.add("src04_latest_file_per_key", f"""select topic, indicator, count(*) as rows, sum(v) as total, bool_and(true) as quoted from (select *, max(stamp) over (partition by topic, indicator) as newest from (select n_chars as v, regexp_extract(f, 'who_([a-z]+)_', 1) as topic, regexp_extract(f, 'who_[a-z]+_(.+)_[0-9]+T', 1) as indicator,
    regexp_extract(f, '_([0-9]+T[0-9]+Z)', 1) as stamp from (select n_chars, {FILE_NAME_SQL.replace("n_chars % 1000000", "doc_id % 4")} as f from documents))) where stamp = newest group by 1, 2""")
def _(v):
    """Files with quotes and commas in values and two column orders; only the newest of each key is read."""
    root = scratch.shared_dir(v.spark, "versions")
    rows = v.table("documents").select(
        F.col("n_chars").alias("value"), F.concat(F.lit('{"a, b": "'), F.col("doc_id").cast("string"), F.lit('"}')).alias("raw_json"),
        F.expr(FILE_NAME.replace("n_chars % 1000000", "doc_id % 4")).alias("file"),
    )
    for part in (rows.where("file < 'who_h'"), rows.where("file >= 'who_h'").select("raw_json", "value", "file")):
        part.write.mode("append").partitionBy("file").options(**readers.CSV).csv(root)
    read = readers.read_latest(v.spark, root, schema.INDICATOR_FILE_PATTERN, layout(("value", _L), ("raw_json", _S)), [1, 2], 3)
    whole = F.get_json_object("raw_json", "$['a, b']").cast("long").isNotNull()
    return read.groupBy("topic", "indicator").agg(F.count("*").alias("rows"), F.sum("value").cast("decimal(38,0)").alias("total"), F.bool_and(whole).alias("quoted"))


@Q.add("src04_stale_file_count", f"""select count(*) as input_files, cast(count(distinct k) as bigint) as kept_files, cast(count(*) - count(distinct k) as bigint) as stale_file_count
    from (select regexp_extract(f, '(who_[a-z]+_.+)_[0-9]+T', 1) as k from (select {FILE_NAME_SQL} as f from documents))""")
def _(v):
    files = v.table("documents").select(F.expr(FILE_NAME).alias("file_name"))
    return readers.stale_file_count(files, readers.latest_files(files, "file_name", schema.INDICATOR_FILE_PATTERN, [1, 2], 3))


@Q.add("src05_json_lines", """select case when event_type in ('error', 'view') then null else cast(event_id as varchar) end as who_id, case when event_type in ('error', 'view') then null else 'V' || k end as dimension_value,
    event_type in ('error', 'view') as broken, true as has_provenance from v_records""")
def _(v):
    path = scratch.shared_dir(v.spark, "records-jsonl")
    v.records.select("raw_json").write.text(path)
    rows = readers.read_json_lines(v.spark, path, schema.RAW_RECORD_SCHEMA)
    return rows.select(
        F.col("Id").alias("who_id"), F.col("Dim1").alias("dimension_value"), F.col("_corrupt_record").isNotNull().alias("broken"),
        ((F.length("source_file") > 0) & (F.length("content_hash") == 64)).alias("has_provenance"),
    )


@Q.add("src06_parquet_partition_scan", "select location_code, year(date) as year, count(*) as rows, cast(sum(amount) as bigint) as total from v_orders where year(date) = 1997 and location_code in ('NAA', 'NAB') group by 1, 2")
def _(v):
    path = scratch.shared_dir(v.spark, "orders-partitioned")
    sinks.write_partitioned(v.orders_located.select("location_code", "amount", F.year("date").alias("year")), path, ["year", "location_code"])
    rows = readers.read_table(v.spark, path).where("year = 1997 AND location_code IN ('NAA', 'NAB')")
    return rows.groupBy("location_code", "year").agg(F.count("*").alias("rows"), F.sum("amount").alias("total"))


@Q.add("src07_name_mapping", """select n_name as name, case when n_nationkey % 2 = 0 then 'Std ' || n_name else 'Pop ' || n_name end as standard_name, case when r_name <> 'AFRICA' then 'NA' || chr(65 + n_nationkey) end as mapped_code,
    r_name <> 'AFRICA' as mapping_enabled from v_nations""")
def _(v):
    raw = v.nations.select(
        F.concat(F.lit(" "), "n_name").alias("epidemic_name"), F.concat(F.lit("Pop "), "n_name").alias("population_name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Std "), "n_name")).otherwise("").alias("standard_name"),
        F.concat(F.lit("na"), F.char((F.col("n_nationkey") + 97).cast("long"))).alias("location_code"),
        F.when(F.col("r_name") == "AFRICA", "False").otherwise("TRUE ").alias("enabled"),
    )
    return readers.name_mapping(raw)


@Q.add("src08_location_catalog", "select * from v_catalog")
def _(v):
    return v.catalog


@Q.add("src09_payload_arrays_to_rows", """select location_code, date, case when r > 5 then temperature_mean end as temperature_mean, precipitation_sum
    from (select *, row_number() over (partition by location_code order by date desc) as r from v_weather)""")
def _(v):

    rows = v.weather.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    # One row per date, so an array is as long as the calendar.
    points = F.array_sort(F.collect_list(F.struct("date", "temperature_mean", "precipitation_sum")))
    payload = rows.groupBy("location_code").agg(points.alias("p")).select(
        "location_code", F.col("p.date").alias("time"),
        F.expr("slice(p.temperature_mean, 1, greatest(size(p) - 5, 0))").alias("temperature_2m_mean"), F.col("p.precipitation_sum").alias("precipitation_sum"),
    )
    out = readers.arrays_to_rows(payload, ["location_code"], "time", ["temperature_2m_mean", "precipitation_sum"], schema.WEATHER_API_NAMES)
    return out.withColumn("date", F.to_date("date"))


@Q.add("src10_long_indicators_to_years", """select location_code, year, population, gdp_per_capita from v_population where location_code <> 'NAC'""")
def _(v):
    pop = v.population
    code = F.when(F.col("location_code") != "NAC", F.col("location_code")).otherwise("")
    long = pop.select(code.alias("countryiso3code"), F.col("year").cast("string").alias("date"), F.expr("stack(2, 'POP', population, 'GDP', gdp_per_capita) as (indicator, value)"))
    noise = long.withColumn("date", F.concat("date", F.lit("Q1")))
    return readers.indicators_to_years(long.unionByName(noise), "countryiso3code", "date", "indicator", "value", {"POP": "population", "GDP": "gdp_per_capita"})


@Q.add("src11_record_normaliser", """select event_id, case when event_type = 'click' then 'E1' else 'alt_' || event_type end as indicator_code, case when value > 100 then 'LOC' || user_id else 'C' || user_id end as location_code,
    cast(year(ts) as varchar) as year, cast(cast(floor(value) as bigint) as varchar) as value, cast(null as varchar) as sex, 'ep' as endpoint, true as has_raw from events""")
def _(v):
    raw = v.table("events").select(
        "event_id", F.when(F.col("event_type") == "click", "E1").otherwise("").alias("IndicatorCode"), F.concat(F.lit("alt_"), "event_type").alias("Indicator"),
        F.when(F.col("value") > 100, F.concat(F.lit("LOC"), "user_id")).alias("SpatialDim"), F.concat(F.lit("C"), "user_id").alias("CountryCode"),
        F.year("ts").alias("TimeDim"), F.floor("value").cast("long").alias("NumericValue"),
    )
    from epitide.functions.records import normalise_record

    out = normalise_record(raw, F.lit("ep"))
    return out.select(
        F.get_json_object("raw_json", "$.event_id").cast("long").alias("event_id"), "indicator_code", "location_code", "year", "value", "sex", "endpoint",
        F.col("raw_json").isNotNull().alias("has_raw"),
    )


@Q.add("snk01_partitioned_overwrite", """select location_code, disease, date, case when location_code = 'NAB' then value + 1 else value end as value from v_series""")
def _(v):
    path = scratch.shared_dir(v.spark, "silver")
    rows = v.series_daily.select(*SERIES, "date", "value")
    sinks.write_partitioned(rows, path, ["location_code"])
    # The second write only replaces the partition it holds.
    sinks.write_partitioned(rows.where("location_code = 'NAB'").withColumn("value", F.col("value") + 1), path, ["location_code"])
    return readers.read_table(v.spark, path).select(*SERIES, "date", "value")


@Q.add("snk02_parquet_overwrite", "select location_code, disease, date, target as actual, rolling_mean_7 as prediction from v_short where target is not null".replace("rolling_mean_7", "round(rolling_mean_7, 4)"))
def _(v):
    path = scratch.shared_dir(v.spark, "predictions")
    rows = v.short_series.where("target IS NOT NULL")
    sinks.write_parquet(rows.select(*SERIES, "date", F.col("target").alias("actual"), F.round("rolling_mean_7", 4).alias("prediction")), path)
    return readers.read_table(v.spark, path)


@Q.add("snk03_csv_export", "select location_code, disease, date, value, n from v_series")
def _(v):
    path = scratch.shared_dir(v.spark, "export-csv")
    sinks.write_csv(v.series_daily, path)
    fields = layout(("location_code", _S), ("disease", _S), ("date", T.DateType()), ("value", _D), ("n", _L))
    return readers.read_csv(v.spark, path, fields)


@Q.add("snk04_series_documents", """select location_code, disease, count(*) as points, min(date) as first_date, max(date) as last_date, sum(value) as total from v_series group by 1, 2""")
def _(v):
    from epitide.operators import reshape

    path = scratch.shared_dir(v.spark, "documents")
    docs = reshape.series_documents(v.series_daily, SERIES, [], ["date", "value"], "date")
    sinks.write_documents(docs, path)
    points = T.ArrayType(layout(("date", T.DateType()), ("value", _D)))
    back = v.spark.read.schema(layout(("location_code", _S), ("disease", _S), ("points", points))).json(path)
    return back.select(
        *SERIES, F.size("points").cast("long").alias("points"), F.element_at("points", 1)["date"].alias("first_date"), F.element_at("points", -1)["date"].alias("last_date"),
        F.aggregate("points", F.lit(0.0), lambda a, p: a + p["value"]).alias("total"),
    )


@Q.add("snk05_nan_to_null_json", """select '{"location_code":"' || location_code || '","disease":"' || disease || '","n":' || n || ',"x":' || case when n > 3 then 'null' else n || '.0' end || '}' as document from v_series""")
def _(v):
    x = F.when(F.col("n") > 3, F.lit(float("nan"))).otherwise(F.col("n").cast("double"))
    return sinks.as_json(v.series_daily.select(*SERIES, "n", x.alias("x")))


@Q.add("snk06_external_table", "select location_code, year(date) as year, count(*) as rows, sum(day_total) as total from v_totals group by 1, 2")
def _(v):
    path = scratch.shared_dir(v.spark, "external")
    rows = v.totals_daily.withColumn("year", F.year("date"))
    sinks.write_partitioned(rows, path, ["year", "location_code"])
    name = "epitide_" + path.rsplit("-", 1)[-1][:12]
    sinks.register_table(v.spark, name, rows.schema, path, ["year", "location_code"])
    return v.spark.table(name).groupBy("location_code", "year").agg(F.count("*").alias("rows"), F.sum("day_total").alias("total"))


@Q.add("snk08_duplicate_audit", """select source as indicator_code, text as value, c as duplicate_source_count, v as duplicate_content_variant_count, v > 1 as duplicate_content_conflict
    from (select d.*, p.c, p.v from (select text, min(source) as source, count(*) as c, count(distinct lang) as v from documents group by text) p join (select distinct text as t from documents) d on d.t = p.text join (select text, source from (select text, source, row_number() over (partition by text order by source) as r from documents) where r = 1) s on s.text = p.text) where c > 1""".replace(
    "select d.*, p.c, p.v", "select s.source, p.text, p.c, p.v"))
def _(v):
    from epitide.operators import aggregates, windows

    docs = v.table("documents").select("text", "lang", "source", F.sha2("text", 256).alias("digest"))
    origin = aggregates.variant_counts(docs, "digest", "lang").where("duplicate_source_count > 1")
    unique = windows.keep_latest(docs.select("digest", "text", "source"), ["digest"], [F.col("source")])
    rows = unique.join(origin, "digest").drop("digest").withColumnsRenamed({"source": "indicator_code", "text": "value"})
    return sinks.duplicate_audit(rows)
