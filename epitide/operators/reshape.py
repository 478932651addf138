"""Reshaping, set operations, ordering and nesting."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from epitide.sources.scratch import materialise


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str], key: str, value: str, pattern: str | None = None, dtype: str = "int") -> DataFrame:
    """Value columns to rows; the key can be a number parsed from the column name."""
    # Columns must share one type to be unpivoted.
    typed = df.select(*ids, *(F.col(f"`{c}`").cast("double").alias(c) for c in columns))
    long = typed.unpivot(ids, [F.col(f"`{c}`") for c in columns], key, value)
    if pattern is None:
        return long
    return long.withColumn(key, F.regexp_extract(key, pattern, 1).cast(dtype))


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def long_to_wide(df: DataFrame, ids: list[str], key: str, value: str, values: list[str], how=F.first) -> DataFrame:
    """Pivot with a fixed value list, so the keys need no extra pass."""
    return df.groupBy(*ids).pivot(key, values).agg(how(value))


def split_measures(df: DataFrame, keep: list[str], definitions: list[tuple[str, dict[str, Column]]], name: str) -> DataFrame:
    """One wide row to one row per definition, without a second scan."""
    structs = [
        F.struct(F.lit(label).alias(name), *(c.alias(out) for out, c in cols.items()))
        for label, cols in definitions
    ]
    return df.select(*keep, F.inline(F.array(*structs)))


def union_all(frames: list[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def drop_duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key by an explicit order, so the result does not depend on the input order."""
    from epitide.operators.windows import keep_latest

    return keep_latest(df, keys, order)


def key_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every key with the side it occurs on: both, left_only or right_only."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    flags = sides.groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = (
        F.when((F.col("_l") == 1) & (F.col("_r") == 1), "both").when(F.col("_l") == 1, "left_only").otherwise("right_only")
    )
    return flags.select(*keys, side.alias("side"))


def common_range(left: DataFrame, right: DataFrame, by: list[str], date: str) -> DataFrame:
    """Number and range of the dates both sides share, per group."""
    shared = left.select(*by, date).intersect(right.select(*by, date))
    return shared.groupBy(*by).agg(
        F.count("*").alias("common_date_count"), F.min(date).alias("common_start"), F.max(date).alias("common_end")
    )


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Global top n; Spark keeps n rows per task and merges those."""
    return df.orderBy(*order).limit(n)


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Every row with its position (from 1) inside its group in the given order, however large the group.

    Rows are sorted by range once and written with the number of their range and their place in it; the written ranges
    are counted, and a position is the place plus the rows of the group in the ranges before. Counts and rows so come
    from the same ranges, however these were cut.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # The lower 33 bits count the rows of a partition in their order.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialise(ranged.withColumns({"_range": F.spark_partition_id(), "_place": place}), "ranges")
    counts = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    offsets = counts.select(*by, "_range", shift.alias("_shift"))
    return rows.join(offsets, [*by, "_range"]).withColumn(name, F.col("_place") + F.col("_shift")).drop("_range", "_place", "_shift")


def rankings(df: DataFrame, measures: dict[str, str], ties: list[str], n: int | None = None) -> DataFrame:
    """Several rankings of the same rows, missing values counted as 0; with n, the first n of each.

    Rows are tagged once per ranking in one pass. With n, the rank filter becomes a group limit inside each task, so at
    most n rows per ranking and task are shuffled. Without, positions come from written ranges.
    """
    scores = [
        F.struct(F.lit(name).alias("ranking"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("_score"))
        for name, c in measures.items()
    ]
    tagged = df.select("*", F.inline(F.array(*scores)))
    order = [F.desc("_score"), *(F.col(t) for t in ties)]
    if n is not None:
        w = Window.partitionBy("ranking").orderBy(*order)
        rows = tagged.withColumn("position", F.row_number().over(w).cast("long"))
        return rows.where(F.col("position") <= n).drop("_score")
    return positions(tagged, ["ranking"], order).drop("_score")


def pages(df: DataFrame, by: list[str], key: str, columns: list[str], size: int) -> DataFrame:
    """Documents of at most `size` entries: per group numbered pages (from 0) in the order of the key, with the first and
    last key of each. No row holds a whole group."""
    placed = positions(df, by, [F.col(key)])
    entry = F.struct(key, *columns)
    out = placed.groupBy(*by, ((F.col("position") - 1) / size).cast("long").alias("page")).agg(
        F.count("*").alias("entry_count"), F.array_sort(F.collect_list(entry)).alias("entries")
    )
    return out.withColumns({f"first_{key}": F.element_at("entries", 1)[key], f"last_{key}": F.element_at("entries", -1)[key]})


def series_documents(df: DataFrame, by: list[str], header: list[str], points: list[str], date: str) -> DataFrame:
    """One row per series: header columns plus the points as an array ordered by date.

    Call it on series rows (one per date), whose number is bounded by the calendar or by last_n.
    """
    point = F.struct(F.col(date), *(F.col(c) for c in points if c != date))
    first = F.min(F.struct(F.col(date), *(F.col(c) for c in header))).alias("_h")
    return (
        df.groupBy(*by)
        .agg(first, F.array_sort(F.collect_list(point)).alias("points"))
        .select(*by, *(F.col(f"_h.{c}").alias(c) for c in header), "points")
    )
