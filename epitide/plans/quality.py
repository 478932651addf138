"""Quality reports, profiling, reconciliation and gates, each as one small result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epitide import schema
from epitide.functions import text
from epitide.operators import aggregates, joins, reshape
from epitide.sources import scratch


def epidemic_report(silver: DataFrame) -> DataFrame:
    """Counters of the country-day table in one aggregate."""
    per_key = silver.groupBy("location_key", "location", "date").agg(
        F.count("*").alias("_n"),
        F.first("location_code").alias("location_code"),
        F.bool_or("aggregation_conflict").alias("_conflict"),
        F.count_if("is_negative_case_correction").alias("_neg"),
        F.count_if("is_negative_death_correction").alias("_negd"),
    )
    return per_key.agg(
        F.sum("_n").alias("output_rows"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.count_distinct("location").alias("country_count"),
        F.sum(F.col("_n") - 1).alias("duplicate_count"),
        F.count_distinct(F.when(F.col("location_code").isNull(), F.col("location"))).alias("unmapped_country_count"),
        F.count_if("_conflict").alias("national_province_conflict_count"),
        F.sum("_neg").alias("negative_case_correction_count"),
        F.sum("_negd").alias("negative_death_correction_count"),
    )


def keyed_report(silver: DataFrame, keys: list[str], location: str, axis: str) -> DataFrame:
    """Rows, locations, range and surplus rows of a keyed table."""
    per_key = silver.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("output_rows"),
        F.count_distinct(location).alias("country_count"),
        F.min(axis).alias(f"{axis}_min"),
        F.max(axis).alias(f"{axis}_max"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_count"),
    )


def rows_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def layer_gate(epidemic: DataFrame, population: DataFrame, weather: DataFrame) -> DataFrame:
    """May the next layer be built? All inputs filled, no duplicate keys in the dimensions."""
    reports = [
        (population, ["location_code", "year"], "population"),
        (weather, ["location_code", "date"], "weather"),
        (epidemic, ["location_code", "date"], "epidemic"),
    ]
    parts = [
        aggregates.duplicate_summary(df, keys).select(F.lit(name).alias("input"), "total_rows", "surplus_rows")
        for df, keys, name in reports
    ]
    checked = reshape.union_all(parts)
    ok = (F.col("total_rows") > 0) & ((F.col("input") == "epidemic") | (F.col("surplus_rows") == 0))
    return checked.agg(
        F.bool_and(ok).alias("can_enter_next_layer"),
        F.sum("total_rows").alias("total_rows"),
        F.sum("surplus_rows").alias("surplus_rows"),
    )


#: Bits of the sources that know a location.
IN_CASES, IN_POPULATION, IN_WEATHER = 1, 2, 4


def overlap_report(
    cases: DataFrame, population: DataFrame, weather: DataFrame, mapping: DataFrame,
    min_locations: int = 3, min_days: int = 300,
) -> DataFrame:
    """Do the three sources overlap enough? One row with the counts and the gates.

    cases: name, date (null when unparseable), province; population: location_code; weather: location_code, date;
    mapping: name, mapped_code. Evidence is one row per location: a bit for each source that knows it, and a bitmap of
    its weather dates, which is set against the bitmap of the report dates.
    """
    names = cases.select("name").distinct().join(mapping.select("name", "mapped_code"), "name", "left")
    pop = population.groupBy("location_code").agg(F.count("*").alias("_pop_rows"))
    mapped = names.join(pop, F.col("mapped_code") == F.col("location_code"), "left")
    name_counts = mapped.agg(
        F.count("*").alias("country_count"),
        F.count_if(F.col("_pop_rows").isNotNull()).alias("mapped_population_count"),
        F.count_if(F.col("mapped_code").isNull()).alias("unmapped_count"),
    )
    seen = [
        (IN_CASES, mapped.select(F.col("mapped_code").alias("location_code"))), (IN_POPULATION, population.select("location_code")),
        (IN_WEATHER, weather.select("location_code")),
    ]
    bits = reshape.union_all([df.where("location_code IS NOT NULL").select("location_code", F.lit(bit).alias("_bit")) for bit, df in seen])
    masks = bits.groupBy("location_code").agg(F.bit_or("_bit").alias("_mask"))
    both = F.col("_mask").bitwiseAND(IN_CASES | IN_WEATHER) == (IN_CASES | IN_WEATHER)
    lacking = F.col("_mask").bitwiseAND(IN_POPULATION) == 0
    # Case dates count for every location: the reports share one calendar.
    day = F.unix_date("date").cast("long") + 1
    place, bucket = F.bitmap_bit_position(day), F.bitmap_bucket_number(day)
    of_cases = cases.where("date IS NOT NULL").groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_case"))
    of_weather = weather.where("date IS NOT NULL").groupBy("location_code", bucket.alias("_bucket")).agg(F.bitmap_construct_agg(place).alias("_weather"))
    pairs = of_weather.join(of_cases, "_bucket").select("location_code", "_bucket", F.explode(F.array("_weather", "_case")).alias("_map"))
    common = pairs.groupBy("location_code", "_bucket").agg(F.bitmap_count(F.bitmap_and_agg("_map")).alias("_days"))
    per_code = common.groupBy("location_code").agg(F.sum("_days").alias("_days"))
    evidence = masks.join(per_code, "location_code", "left").withColumn("_days", F.when(both & ~lacking, F.coalesce("_days", F.lit(0))))
    days = evidence.agg(
        F.count_if(F.col("_days") > 0).alias("common_locations"), F.coalesce(F.max("_days"), F.lit(0)).alias("max_common_days"),
        F.count_if(both & lacking).alias("weather_without_population"),
    )
    repeated = aggregates.duplicate_summary(cases, ["name", "date", "province"]).select(F.col("duplicated_keys").alias("case_duplicate_keys"))
    errors = reshape.union_all([
        cases.select(F.col("date").isNull().cast("long").alias("_e")), weather.select(F.col("date").isNull().cast("long").alias("_e"))
    ]).agg(F.coalesce(F.sum("_e"), F.lit(0)).alias("date_parse_errors"))
    doubled = aggregates.duplicate_summary(weather, ["location_code", "date"]).select(F.col("duplicated_keys").alias("weather_duplicate_keys"))
    doubled_pop = pop.agg(F.count_if(F.col("_pop_rows") > 1).alias("population_duplicate_codes"))
    out = name_counts
    for part in (days, errors, doubled, doubled_pop, repeated):
        out = aggregates.attach(out, part)
    return out.withColumns({
        "mapping_success_rate": F.round(F.coalesce(F.try_divide(F.col("mapped_population_count"), F.col("country_count")), F.lit(0.0)), 6),
        "enough_locations": F.col("common_locations") >= min_locations,
        "enough_common_days": F.col("max_common_days") >= min_days,
        "weather_population_mapped": F.col("weather_without_population") == 0,
        "reports_need_deduplication": F.col("case_duplicate_keys") > 0,
        "dates_parse": F.col("date_parse_errors") == 0,
        "keys_unique": (F.col("weather_duplicate_keys") == 0) & (F.col("population_duplicate_codes") == 0),
    }).withColumn(
        "can_enter_cleaning",
        F.col("enough_locations") & F.col("enough_common_days") & F.col("weather_population_mapped") & F.col("dates_parse") & F.col("keys_unique"),
    )


def profile(df: DataFrame, date_columns: list[str], region_columns: list[str], today: str) -> DataFrame:
    """Per column: null rate, range, distinct values, negatives, zeros, future dates; one pass.

    Distinct region values are exact; all other statistics are plain partial aggregates.
    """
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short")}
    aggs = [F.count("*").alias("n")]
    for c in df.columns:
        col = F.col(c)
        number = col.cast("double") if c in numeric else F.lit(None).cast("double")
        day = col.cast("date") if c in date_columns else F.lit(None).cast("date")
        aggs.append(F.struct(
            F.lit(c).alias("column_name"),
            F.round(F.avg(col.isNull().cast("double")), 6).alias("null_rate"),
            F.min(number).alias("min_value"),
            F.max(number).alias("max_value"),
            F.count_if(number < 0).alias("negative_count"),
            F.count_if(number == 0).alias("zero_count"),
            F.min(day).alias("date_min"),
            F.max(day).alias("date_max"),
            F.count_if(day > F.lit(today).cast("date")).alias("future_dates"),
            (F.count_distinct(col) if c in region_columns else F.lit(None).cast("long")).alias("distinct_regions"),
        ).alias(c))
    wide = df.agg(*aggs)
    return wide.select(F.col("n").alias("row_count"), F.inline(F.array(*(F.col(c) for c in df.columns))))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 0.05) -> DataFrame:
    """Two sources compared, never summed: overlap, median relative difference, share within 5 %."""
    pairs = joins.reconcile_pairs(a, b, keys, value, ("_a", "_b")).where((F.col(f"{value}_a") > 0) & (F.col(f"{value}_b") > 0))
    relative = F.abs(F.col(f"{value}_a") - F.col(f"{value}_b")) / F.greatest(
        F.col(f"{value}_a"), F.col(f"{value}_b"), F.lit(1.0)
    )
    # Everything is read off the written value counts, so the join of the two sources runs once.
    counts = scratch.materialise(aggregates.value_counts(pairs.select(relative.alias("r")), "r"), "counts")
    share = F.sum(F.when(F.col("v") <= tolerance, F.col("c")).otherwise(0)) / F.sum("c")
    summary = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("overlap_rows"), F.round(share, 6).alias("within_5_percent_share")
    )
    median = aggregates.exact_medians(counts, ["v"], "c").select(F.round("median", 6).alias("median_relative_difference"))
    return aggregates.attach(summary, median)


def serving_report(features: DataFrame) -> DataFrame:
    """Rates, duplicates and coverage of the gold table in one row."""
    required, optional = schema.REQUIRED_OBSERVATION, ("temperature_mean", "relative_humidity_mean", "population", "gdp_per_capita", "target_t_plus_7")
    rate = [F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias(f"missing_{c}") for c in (*required, *optional)]
    main = features.agg(
        F.count("*").alias("total_records"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count_distinct("location_code").alias("region_count"),
        F.count_distinct("disease").alias("disease_count"),
        F.count_if(F.coalesce("is_negative_case_correction", F.lit(False))).alias("negative_correction_count"),
        F.count_if("has_weather").alias("weather_matched_count"),
        F.count_if(F.col("population").isNull()).alias("population_unmatched_count"),
        *rate,
    )
    doubled = aggregates.duplicate_summary(features, ["location_code", "disease", "date"]).select(
        F.col("surplus_rows").alias("duplicate_count")
    )
    return aggregates.attach(main, doubled)


def serving_report_by(features: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the served report per group. Rows collapse by key first, so duplicates cost no second pass."""
    per_key = features.groupBy(*by, "location_code", "disease", "date").agg(
        F.count("*").alias("_n"), F.count_if(F.coalesce("is_negative_case_correction", F.lit(False))).alias("_neg"), F.count_if("has_weather").alias("_weather"),
        F.count("population").alias("_population"), F.count("target_t_plus_7").alias("_target"),
    )
    rows = F.sum("_n")
    return per_key.groupBy(*by).agg(
        rows.alias("rows"), F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.sum("_neg").alias("negative_correction_count"),
        F.sum("_weather").alias("weather_matched_count"), (rows - F.sum("_weather")).alias("weather_unmatched_count"), (rows - F.sum("_population")).alias("population_unmatched_count"),
        F.round(1 - F.sum("_target") / rows, 6).alias("missing_target"), (rows - F.count("*")).alias("duplicate_count"),
    )


def ledger(tables: dict[str, tuple[DataFrame, DataFrame | None, DataFrame | None]]) -> DataFrame:
    """Counts of each source as rows: part, rows (cleaned), raw_rows (as read), primary_rows (of its curated series).

    Tables are counted from their files, which Parquet answers from its footers; an accumulator filled while writing would
    count a repeated task twice. A part without raw or primary table has none of them (null, 0).
    """
    parts = [
        (part, name, df.agg(F.count("*").alias("n")))
        for part, three in tables.items() for name, df in zip(("rows", "raw_rows", "primary_rows"), three) if df is not None
    ]
    long = reshape.union_all([df.select(F.lit(part).alias("part"), F.lit(name).alias("name"), "n") for part, name, df in parts])

    def of(name):
        return F.max(F.when(F.col("name") == name, F.col("n")))

    return long.groupBy("part").agg(of("rows").alias("rows"), of("raw_rows").alias("raw_rows"), F.coalesce(of("primary_rows"), F.lit(0)).alias("primary_rows"))


def named_sources(counted: DataFrame) -> DataFrame:
    """The ledger by name and status rule, one row for each known source; rows are null where it was not configured."""
    known = counted.sparkSession.createDataFrame(schema.SOURCE_STATUS_ITEMS, "name string, part string, rule string")
    return known.join(counted, "part", "left").select("name", "rule", "rows", "raw_rows", F.coalesce("primary_rows", F.lit(0)).alias("primary_rows"))


def model_status(rows: DataFrame, name: str) -> DataFrame:
    """Status of a learned model from its rows with a split: ok if every part has rows, else info."""
    parts = [F.count_if(F.col("split") == p) for p in ("train", "validation", "test")]
    status = F.when(F.least(*parts) > 0, "ok").otherwise("info")
    return rows.agg(
        F.lit(name).alias("name"), F.lit("model").alias("rule"), F.count("*").alias("rows"), F.lit(None).cast("long").alias("raw_rows"),
        F.lit(0).cast("long").alias("primary_rows"), status.alias("status"),
    )


def source_status(parts: DataFrame) -> DataFrame:
    """ok / info / warn / not_configured per source.

    parts: name, rule, rows, raw_rows, primary_rows (rows of the curated series).
    """
    filled = F.col("rows") > 0
    status = (
        F.when(F.col("rule") == "index", F.when(filled, "info").otherwise("warn"))
        .when(
            F.col("rule") == "catalog",
            F.when(filled & (F.col("primary_rows") > 0), "ok").when(filled, "info").otherwise("not_configured"),
        )
        .when(F.col("rule") == "archive", F.when(filled, "ok").otherwise("warn"))
        .when(F.col("rows").isNull(), "not_configured")
        .otherwise("ok")
    )
    return parts.withColumn("status", status)


def model_coverage(features: DataFrame) -> DataFrame:
    """Rows usable by models, per disease."""
    return features.groupBy("disease").agg(
        F.array_join(F.array_sort(F.collect_set("frequency")), ",").alias("frequency"),
        F.count("*").alias("feature_rows"),
        F.count_distinct("location_code").alias("location_count"),
        F.min("date").alias("date_start"),
        F.max("date").alias("date_end"),
        F.count_if("has_weather").alias("weather_matched_rows"),
        F.count("population").alias("population_matched_rows"),
        F.count("target_t_plus_7").alias("target_rows"),
    )


def model_inputs(features: DataFrame, baselines: list[str], training: DataFrame, learned: str) -> DataFrame:
    """What each model reads: kind, diseases, rows by part of the split, range, and whether weather is an input."""
    def one(rows: DataFrame, name: str, kind: str, parts: bool) -> DataFrame:
        split = {f"{p}_rows": (F.count_if(F.col("split") == p) if parts else F.lit(0).cast("long")) for p in ("train", "validation", "test")}
        return rows.agg(
            F.count_distinct("disease").alias("diseases"), F.count("*").alias("input_rows"), *(c.alias(n) for n, c in split.items()),
            F.min("date").alias("date_start"), F.max("date").alias("date_end"),
        ).select(F.lit(name).alias("model"), F.lit(kind).alias("kind"), "*", F.lit(parts).alias("uses_weather"))

    return reshape.union_all([*(one(features, m, "baseline", False) for m in baselines), one(training, learned, "learned", True)])


def model_rows(coverage: DataFrame, metrics: DataFrame) -> DataFrame:
    """Coverage joined with the models evaluated for each disease."""
    return metrics.select("disease", "model", "mae").join(coverage, "disease", "left")


def reporting_profile(series: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    """Calendar gaps and zero days of daily series."""
    per_day = series.groupBy(*by, date).agg(
        F.count(value).alias("_n"),
        F.count_if(F.abs(F.col(value)) <= 1e-12).alias("_z"),
        F.count_if(F.col(value) > 0).alias("_p"),
    )
    span = (F.datediff(F.max(date), F.min(date)) + 1).alias("expected_calendar_days")
    out = per_day.groupBy(*by).agg(
        span, F.count("*").alias("observed_rows"), F.sum("_z").alias("zero_day_count"),
        F.sum("_n").alias("_n"), F.sum("_p").alias("_p"),
    )
    share = F.coalesce(F.try_divide(F.col("zero_day_count"), F.col("_n")), F.lit(0.0))
    return out.withColumns({
        "date_gap_count": F.greatest(F.col("expected_calendar_days") - F.col("observed_rows"), F.lit(0)),
        "zero_day_share": F.round(share, 4),
    }).withColumn(
        "sparse_reporting", (F.col("date_gap_count") == 0) & (share >= 0.5) & (F.col("_p") > 0)
    ).drop("_n", "_p")


def catalog_report(catalog: DataFrame, primary: DataFrame, auxiliary: DataFrame, current_year: int) -> DataFrame:
    """Counters of the indicator catalog as (metric, value) rows."""
    numeric = F.col("numeric_value_clean").isNotNull()
    main = catalog.agg(
        F.sum("duplicate_source_count").cast("long").alias("input_rows"),
        F.count("*").alias("output_rows"),
        F.sum(F.col("duplicate_source_count") - 1).cast("long").alias("duplicate_rows_removed"),
        F.count_if(F.col("duplicate_source_count") > 1).alias("duplicate_key_groups"),
        F.count_if("duplicate_content_conflict").alias("duplicate_content_conflict_groups"),
        F.count_if(~F.col("raw_json_valid")).alias("invalid_raw_json_rows"),
        F.count_distinct("indicator_code").alias("indicator_count"),
        F.count_if(numeric).alias("numeric_rows"),
        F.count_if(F.col("is_selected_country") & numeric).alias("selected_country_numeric_rows"),
        F.count_if(F.col("year") > current_year).alias("future_date_rows"),
        F.count_if((F.col("indicator_code") == schema.PRIMARY_INDICATOR) & F.col("is_selected_country")).alias("primary_candidate_rows"),
        F.count_if(
            (F.col("indicator_code") == schema.PRIMARY_INDICATOR) & F.col("is_selected_country") & ~numeric
        ).alias("primary_no_data_rows"),
    )
    gaps = aggregates.missing_years(primary, ["location_code"], "year").withColumnRenamed("missing_year_count", "primary_year_gap_count")
    sizes = [
        primary.agg(F.count("*").alias("primary_observation_rows")), gaps,
        auxiliary.agg(F.count("*").alias("auxiliary_rows")),
    ]
    parts = [p.unpivot([], p.columns, "metric", "value").withColumn("value", F.col("value").cast("long")) for p in (main, *sizes)]
    return reshape.union_all(parts)


def invariants(features: DataFrame, weather: DataFrame, daily: DataFrame, annual: DataFrame, pages: DataFrame) -> DataFrame:
    """Checks every build must pass, as (check_name, passed) rows.

    `daily` and `annual` are the tables derived from hours; `pages` are the served option pages with their ranges.
    """
    unique = aggregates.duplicate_summary(features, ["location_code", "disease", "date"])
    full = F.col("default_start").eqNullSafe(F.col("full_start")) & F.col("default_end").eqNullSafe(F.col("full_end"))
    series = features.groupBy("location_code", "disease").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    served = series.join(pages.select("disease", F.inline("entries")), ["location_code", "disease"], "full").select(
        (F.col("default_start").eqNullSafe(F.col("_from")) & F.col("default_end").eqNullSafe(F.col("_to")) & full).alias("ok")
    )
    checks = [
        unique.select(F.lit("unique observation keys").alias("check_name"), (F.col("surplus_rows") == 0).alias("passed")),
        unique.select(F.lit("non-empty features").alias("check_name"), (F.col("total_rows") > 0).alias("passed")),
        aggregates.duplicate_summary(weather, ["location_code", "date"]).select(
            F.lit("unique weather days").alias("check_name"), (F.col("surplus_rows") == 0).alias("passed")
        ),
        daily.select(F.lit(1).alias("d"), F.lit(0).alias("a")).unionByName(
            annual.select(F.lit(0).alias("d"), F.lit(1).alias("a"))
        ).agg((F.sum("d") > F.sum("a")).alias("passed")).select(F.lit("more daily than annual rows").alias("check_name"), "passed"),
        served.agg(F.bool_and("ok").alias("passed")).select(F.lit("default range is the full range").alias("check_name"), "passed"),
    ]
    return reshape.union_all(checks)
