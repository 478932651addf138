"""Join operators.

No broadcast hints: Spark broadcasts a side whose measured size is under its threshold (from file
statistics at planning, from shuffle statistics at run time) and otherwise sorts and merges, where
adaptive execution splits hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from epitide.functions import calendar, text
from epitide.operators.windows import keep_latest


def left_dimension(df: DataFrame, dim: DataFrame, key: str, dim_key: str, cols: list[str]) -> DataFrame:
    """Add columns of a dimension; rows without a match are kept."""
    right = dim.select(F.col(dim_key).alias("_key"), *cols)
    return df.join(right, F.col(key) == F.col("_key"), "left").drop("_key")


def map_names(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Names to codes through a mapping table with columns name, standard_name, mapped_code."""
    joined = left_dimension(df, mapping, key, "name", ["standard_name", "mapped_code"])
    return joined.withColumns({
        "location": F.coalesce("standard_name", key),
        "location_code": F.col("mapped_code"),
        "location_key": text.unmapped_key("mapped_code", F.coalesce("standard_name", key)),
    }).drop("standard_name", "mapped_code")


def unmapped_names(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Distinct names without an enabled code."""
    usable = mapping.where("mapped_code IS NOT NULL").select(F.col("name").alias(key))
    return df.select(key).distinct().join(usable, key, "left_anti")


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], left_key: Column, right_key: str, cols: list[str]
) -> DataFrame:
    """Latest right row at or before the left key, one match per left row.

    The dimension becomes half-open validity intervals first, so every left row meets exactly one
    interval instead of all earlier ones.
    """
    dim = keep_latest(right, [*by, right_key], [F.col(c).asc_nulls_last() for c in cols])
    w = Window.partitionBy(*by).orderBy(right_key)
    spans = dim.select(
        *(F.col(k).alias(f"_r_{k}") for k in by),
        F.col(right_key).alias("_from"),
        F.lead(right_key).over(w).alias("_to"),
        *cols,
    )
    on = [F.col(k) == F.col(f"_r_{k}") for k in by]
    on += [F.col("_lk") >= F.col("_from"), F.col("_to").isNull() | (F.col("_lk") < F.col("_to"))]
    return (
        left.withColumn("_lk", left_key)
        .join(spans, on, "left")
        .withColumn("matched_" + right_key, F.col("_from"))
        .drop("_lk", "_from", "_to", *(f"_r_{k}" for k in by))
    )


def roll_up(covariates: DataFrame, by: list[str], date: str, cols: list[str]) -> DataFrame:
    """Means of covariates at all three frequencies: day, week to Saturday, year to 31 Dec.

    Rows collapse to sums and counts per day first; weeks and years are summed from those days.
    """
    day = covariates.groupBy(*by, date).agg(*(F.sum(c).alias(f"_s_{c}") for c in cols), *(F.count(c).alias(f"_n_{c}") for c in cols))
    frames = []
    for kind in ("daily", "weekly", "annual"):
        rows = day.withColumn("frequency", F.lit(kind)).withColumn("join_date", calendar.period_end(date, "frequency"))
        if kind != "daily":
            rows = rows.groupBy(*by, "frequency", "join_date").agg(*(F.sum(f"_{x}_{c}").alias(f"_{x}_{c}") for c in cols for x in "sn"))
        means = (F.try_divide(F.col(f"_s_{c}"), F.nullif(F.col(f"_n_{c}"), F.lit(0))).alias(c) for c in cols)
        frames.append(rows.select(*by, "frequency", "join_date", *means))
    return reduce(DataFrame.union, frames).withColumn("weather_match_level", match_level("frequency"))


def match_level(frequency: str) -> Column:
    f = F.col(frequency)
    return (
        F.when(f == "daily", "exact_day").when(f == "weekly", "weekly_mean_to_saturday").otherwise("annual_mean")
    )


def merge_by_precedence(frames: list[DataFrame], keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Union of sources with one row per key; a later source wins."""
    tagged = [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    merged = tagged[0]
    for frame in tagged[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return keep_latest(merged, keys, [F.col("_priority").desc(), *(order or [])]).drop("_priority")


def join_by_period(
    obs: DataFrame, covariates: DataFrame, by: list[str], cols: list[str], date: str = "date",
    overrides: DataFrame | None = None, source: str = "covariates",
) -> DataFrame:
    """Covariates at the frequency of each observation, in one left join.

    `overrides` are extra period rows (by, frequency, join_date, cols, weather_match_level,
    weather_source); for a key that has both, the alphabetically last match level wins.
    """
    rolled = roll_up(covariates, by, date, cols).withColumn("weather_source", F.lit(source))
    if overrides is not None:
        both = rolled.unionByName(overrides, allowMissingColumns=True)
        rolled = keep_latest(
            both, [*by, "frequency", "join_date"],
            [F.col("weather_match_level").desc_nulls_last(), F.col("weather_source").desc_nulls_last()],
        )
    joined = obs.withColumn("join_date", F.col(date)).join(rolled, [*by, "frequency", "join_date"], "left")
    return joined.drop("join_date").withColumns({
        "weather_match_level": F.coalesce("weather_match_level", F.lit("unmatched")),
        "weather_source": F.coalesce("weather_source", F.lit("unmatched")),
    })


def calendar_grid(
    df: DataFrame, by: list[str], date: str, frequency: str = "daily",
    start: Column | None = None, end: Column | None = None, flag: str = "is_observed",
) -> DataFrame:
    """Every period between the first and last one per group; missing periods get null measures.

    The grid is generated per group from its bounds, so it is bounded by the calendar.
    """
    step = {"daily": "interval 1 day", "weekly": "interval 7 days", "annual": "interval 12 months"}[frequency]
    # Weekly grids start on the first observed Saturday, annual grids on 31 December.
    bounds = df.groupBy(*by).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    lo = start if start is not None else F.col("_lo")
    hi = end if end is not None else F.col("_hi")
    grid = bounds.select(*by, F.explode(F.sequence(lo, hi, F.expr(step))).alias(date))
    return grid.join(df.withColumn(flag, F.lit(True)), [*by, date], "left").withColumn(
        flag, F.coalesce(flag, F.lit(False))
    )


def year_grid(df: DataFrame, by: list[str], year: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Every year per group from min(first, start) to max(last, end)."""
    bounds = df.groupBy(*by).agg(F.min(year).alias("_lo"), F.max(year).alias("_hi"))
    lo = F.least("_lo", F.lit(start)) if start is not None else F.col("_lo")
    hi = F.greatest("_hi", F.lit(end)) if end is not None else F.col("_hi")
    grid = bounds.select(*by, F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias(year))
    return grid.join(df, [*by, year], "left")


def exact_target_by_join(
    df: DataFrame, by: list[str], date: str, value: str, horizon: int, frequency: str = "daily", out: str = "target"
) -> DataFrame:
    """Self join on the shifted date; cross-check for the range-frame form."""
    later = df.select(*by, F.col(date).alias("_target_date"), F.col(value).alias(out))
    return (
        df.withColumn("_target_date", calendar.target_date(date, F.lit(frequency), horizon))
        .join(later, [*by, "_target_date"], "left")
        .drop("_target_date")
    )


def same_key_with_fallback(df: DataFrame, dim: DataFrame, keys: list[str], fallbacks: dict[str, str]) -> DataFrame:
    """Left join; each dimension column falls back to a column of the row itself."""
    joined = df.join(dim, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(alt)) for c, alt in fallbacks.items()})


def enrich_location(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Name and city fall back to the catalog; coordinates come from the catalog only."""
    dim = catalog.select(
        "location_code",
        F.col("location").alias("_location"),
        F.col("representative_city").alias("_city"),
        F.col("latitude").alias("_lat"),
        F.col("longitude").alias("_lon"),
    )
    city = F.col("representative_city") if "representative_city" in df.columns else F.lit(None).cast("string")
    return (
        df.join(dim, "location_code", "left")
        .withColumns({
            "location": F.coalesce("location", "_location"),
            "representative_city": F.coalesce(city, "_city"),
            "latitude": F.col("_lat"),
            "longitude": F.col("_lon"),
        })
        .drop("_location", "_city", "_lat", "_lon")
    )


def many_to_one(df: DataFrame, right: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Left join that fails when the right key is not unique."""
    checked = right.groupBy(key).agg(
        F.count("*").alias("_n"), *(F.first(c, ignorenulls=False).alias(c) for c in cols)
    )
    guard = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))).cast("boolean"))
    return df.join(checked.withColumn("_ok", guard), key, "left").where(F.col("_ok").isNull()).drop("_n", "_ok")


def reconcile_pairs(a: DataFrame, b: DataFrame, keys: list[str], value: str, suffixes: tuple[str, str]) -> DataFrame:
    """Inner join of two sources, the shared measure under two names."""
    left = a.select(*keys, F.col(value).alias(value + suffixes[0]))
    right = b.select(*keys, F.col(value).alias(value + suffixes[1]))
    return left.join(right, keys)


def stack_indicators(frames: dict[str, DataFrame], keys: list[str], cols: list[str]) -> DataFrame:
    """Many single-indicator tables to one wide table: one union and one pivot, not a chain of joins.

    The column prefix of each indicator is its name in `frames`.
    """
    names = list(frames)
    tagged = [
        f.select(*keys, F.lit(name).alias("_indicator"), *cols) for name, f in frames.items()
    ]
    merged = tagged[0]
    for frame in tagged[1:]:
        merged = merged.unionByName(frame)
    return pivot_indicators(merged, keys, "_indicator", {n: n for n in names}, cols)


def pivot_indicators(df: DataFrame, keys: list[str], key: str, names: dict[str, str], cols: list[str]) -> DataFrame:
    """Long indicator rows to wide columns `<name>` (first measure) and `<name>_<measure>`."""
    aggs = []
    for value, name in names.items():
        for i, c in enumerate(cols):
            picked = F.max(F.when(F.col(key) == value, F.col(c)))
            aggs.append(picked.alias(name if i == 0 else f"{name}_{c}"))
    return df.where(F.col(key).isin(*names)).groupBy(*keys).agg(*aggs)


def listed_files_present(df: DataFrame, id_col: str, listed: str, inventory: DataFrame, path: str) -> DataFrame:
    """Per row: how many listed files there are, how many exist, and whether all do."""
    rows = df.select(id_col, F.explode_outer(listed).alias("_path"))
    present = inventory.select(F.col(path).alias("_path")).distinct().withColumn("_there", F.lit(True))
    counts = (
        rows.join(present, "_path", "left")
        .groupBy(id_col)
        .agg(F.count("_path").alias("listed_count"), F.count_if(F.col("_there")).alias("existing_count"))
    )
    return counts.withColumn("complete", F.col("listed_count") == F.col("existing_count"))


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")
