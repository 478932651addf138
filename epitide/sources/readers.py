"""Scans: CSV, JSON lines, Parquet, file selection, payload shaping."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from epitide.functions import records, text
from epitide.operators.windows import keep_latest


#: Quotes are doubled, as standard CSV writers do; a backslash is an ordinary character.
CSV = {"header": True, "quote": '"', "escape": '"'}


def headers_of(spark: SparkSession, paths: str | list[str]) -> dict[str, tuple[str, ...]]:
    """Column names of every CSV file below the paths, in one job; the driver holds a line per file."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    # Lines of a file's first block come in order, so the first one met is the header.
    first = lines.where("at = 0").groupBy(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("file")).agg(F.first("value").alias("line"))
    return {r["file"]: tuple(next(csv.reader([r["line"].lstrip("\ufeff")]), ())) for r in first.collect()}


def _by_header(spark: SparkSession, headers: dict[str, tuple[str, ...]], layout: T.StructType, with_file: bool = False, multi_line: bool = False) -> DataFrame:
    """Columns of the layout, found by their names in each file's header; one scan per header. Absent ones are null."""
    kinds = {f.name: f.dataType for f in layout.fields}
    files: dict[tuple[str, ...], list[str]] = {}
    for path, header in headers.items():
        files.setdefault(header, []).append(path)
    extra = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("file_name")] if with_file else []
    frames = []
    for header, paths in sorted(files.items()):
        fields = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
        rows = spark.read.options(**CSV, multiLine=multi_line).schema(fields).csv(paths)
        frames.append(rows.select(*((F.col(f"`{c}`") if c in header else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()), *extra))
    if not frames:
        names = [T.StructField(n, T.StringType()) for n in ("source_file", "file_name")] if with_file else []
        return spark.createDataFrame([], T.StructType([*layout.fields, *names]))
    return reduce(DataFrame.unionByName, frames)


def _complete(headers: dict[str, tuple[str, ...]], layout: T.StructType) -> dict[str, tuple[str, ...]]:
    for path, header in headers.items():
        if missing := [f.name for f in layout.fields if f.name not in header]:
            raise ValueError(f"columns {missing} are missing in {path}")
    return headers


def read_csv(spark: SparkSession, path: str | list[str], layout: T.StructType, renames: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with header and explicit types; columns are matched by name, and a missing one is an error."""
    df = _by_header(spark, _complete(headers_of(spark, path), layout), layout, multi_line=multi_line)
    return df.withColumnsRenamed(renames or {})


def read_annual_values(spark: SparkSession, path: str, columns: list[str] | None = None, code: str = "Code", year: str = "Year") -> DataFrame:
    """An annual file to location_code, location, year, v: the sum of the given value columns, by default of all behind
    the first three; missing if all of them are. Repeated keys keep their largest value."""
    rows = read_text_csv(spark, path)
    columns = columns or rows.columns[3:]
    numbers = [text.parse_number(F.col(f"`{c}`")) for c in columns]
    total = reduce(lambda a, b: a + b, (F.coalesce(n, F.lit(0.0)) for n in numbers))
    value = F.when(F.coalesce(*numbers).isNotNull(), total)
    typed = rows.select(
        F.upper(F.trim(code)).alias("location_code"), F.trim(F.col(f"`{rows.columns[0]}`")).alias("location"), text.parse_number(year).cast("int").alias("year"), value.alias("v"),
    )
    return keep_latest(typed.where("location_code <> '' AND year IS NOT NULL"), ["location_code", "year"], [F.col("v").desc_nulls_last(), F.col("location")])


def read_text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with every column as text; the files share one header."""
    return spark.read.options(**CSV).csv(path)


def read_glob(spark: SparkSession, root: str, layout: T.StructType, pattern: str = "*/*.csv") -> DataFrame:
    """All files below a root as one table, each row with its file; every file has all columns, in any order."""
    return _by_header(spark, _complete(headers_of(spark, f"{root.rstrip('/')}/{pattern}"), layout), layout, with_file=True)


def read_tolerant(
    spark: SparkSession, paths: list[str], wanted: dict[str, str], required: list[str]
) -> tuple[DataFrame, list[str]]:
    """Wanted columns that exist, the others as null; paths with a file that lacks a required column are listed.

    Files are read together per header layout, so the number of scans is the number of layouts.
    """
    headers = headers_of(spark, paths)
    owner = {file: next(p for p in sorted(paths, key=len, reverse=True) if p.rstrip("/") in file) for file in headers}
    bad = {owner[file] for file, header in headers.items() if any(c not in header for c in required)}
    good = {file: header for file, header in headers.items() if owner[file] not in bad}
    texts = _by_header(spark, good, T.StructType([T.StructField(c, T.StringType()) for c in wanted]))
    return tolerant_select(texts, wanted), [p for p in paths if p in bad]


def tolerant_select(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    available = set(df.columns)
    return df.select(*(
        (F.col(f"`{c}`").try_cast(t) if c in available else F.lit(None).cast(t)).alias(c) for c, t in wanted.items()
    ))


def latest_files(files: DataFrame, name: str, pattern: str, key_groups: list[int], stamp_group: int) -> DataFrame:
    """Newest file per key found in the file name; names off the pattern are all kept."""
    parts = files.withColumns({
        "topic": F.lower(F.regexp_extract(name, pattern, key_groups[0])),
        "indicator": F.regexp_extract(name, pattern, key_groups[1]),
        "stamp": F.regexp_extract(name, pattern, stamp_group),
    })
    named = keep_latest(parts.where("stamp <> ''"), ["topic", "indicator"], [F.col("stamp").desc(), F.col(name).desc()])
    return named.unionByName(parts.where("stamp = ''").withColumn("topic", F.lit("unknown")))


def stale_file_count(files: DataFrame, kept: DataFrame) -> DataFrame:
    """Total, kept and superseded files as one row."""
    tagged = files.select(F.lit(1).alias("t"), F.lit(0).alias("k")).unionByName(
        kept.select(F.lit(0).alias("t"), F.lit(1).alias("k"))
    )
    return tagged.agg(
        F.sum("t").alias("input_files"), F.sum("k").alias("kept_files"), (F.sum("t") - F.sum("k")).alias("stale_file_count")
    )


def read_latest(spark: SparkSession, root: str, pattern: str, layout: T.StructType, key_groups: list[int], stamp_group: int) -> DataFrame:
    """Rows of the newest file per key. File names are listed first; superseded files are never read.

    A folder whose name ends in .csv counts as one file.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    steps = F.split("path", "/")
    folder = F.regexp_replace(F.element_at(steps, -2), "^[^=]*=", "")
    named = listed.select("path", F.when(folder.endswith(".csv"), folder).otherwise(F.element_at(steps, -1)).alias("file_name"))
    kept = latest_files(named.select("file_name").distinct(), "file_name", pattern, key_groups, stamp_group)
    chosen = {r["path"]: r for r in named.join(kept, "file_name").collect()}  # a line per file that is read
    if not chosen:
        return _by_header(spark, {}, layout, with_file=True).drop("source_file").withColumns({"topic": F.lit(""), "indicator": F.lit("")})
    rows = _by_header(spark, headers_of(spark, list(chosen)), layout, with_file=True).drop("file_name")
    rows = rows.withColumn("_file", F.regexp_replace(F.url_decode(F.replace("source_file", F.lit("+"), F.lit("%2B"))), "^file:/+", "/")).drop("source_file")
    table = spark.createDataFrame(
        [(re.sub("^file:/+", "/", p), r["file_name"], r["topic"], r["indicator"]) for p, r in chosen.items()], "_file string, file_name string, topic string, indicator string"
    )
    return rows.join(F.broadcast(table), "_file").drop("_file")


def read_json_lines(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame:
    """JSON lines with the broken ones kept in `_corrupt_record`, plus file and content hash.

    The hash replaces a line number as tie-breaker, so files stay splittable.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    lines = lines.select("value", F.col("_metadata.file_path").alias("source_file"))
    return parse_json_lines(lines, "value", layout)


def parse_json_lines(lines: DataFrame, column: str, layout: T.StructType) -> DataFrame:
    parsed = lines.withColumn("_r", records.parse_object(column, layout))
    ok = records.is_object("_r")
    others = [c for c in lines.columns if c != column]
    return parsed.select(
        *(F.when(ok, F.col(f"_r.{f.name}")).alias(f.name) for f in layout.fields),
        *others,
        F.when(~ok, F.col(column)).alias("_corrupt_record"),
        F.sha2(column, 256).alias("content_hash"),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with its partition columns."""
    return spark.read.parquet(path)


def name_mapping(df: DataFrame) -> DataFrame:
    """Mapping table: a disabled row keeps its names but loses its code."""
    return df.select(
        F.trim("epidemic_name").alias("name"),
        text.first_non_empty(F.trim("standard_name"), F.trim("population_name"), F.trim("epidemic_name")).alias("standard_name"),
        F.when(F.lower(F.trim("enabled")) == "true", text.blank_to_null(F.upper("location_code"))).alias("mapped_code"),
        (F.lower(F.trim("enabled")) == "true").alias("mapping_enabled"),
    )


def location_catalog(df: DataFrame) -> DataFrame:
    """Enabled locations, coordinates as numbers, one row per code."""
    rows = df.where(text.is_enabled("enabled")).select(
        F.upper(F.trim("location_code")).alias("location_code"),
        F.trim("location").alias("location"),
        F.trim("representative_city").alias("representative_city"),
        text.parse_number(F.col("latitude").cast("string")).alias("latitude"),
        text.parse_number(F.col("longitude").cast("string")).alias("longitude"),
    )
    return keep_latest(rows, ["location_code"], [F.col("location"), F.col("representative_city")])


def arrays_to_rows(df: DataFrame, keep: list[str], time_col: str, value_cols: list[str], renames: dict[str, str]) -> DataFrame:
    """Parallel arrays to rows; an array shorter than the time axis is padded with nulls."""
    n = F.size(time_col)
    aligned = [F.slice(F.coalesce(F.col(c), F.array().cast("array<double>")), F.lit(1), n).alias(renames.get(c, c)) for c in value_cols]
    zipped = F.arrays_zip(F.col(time_col).alias("date"), *aligned)
    return df.select(*keep, F.inline_outer(zipped)).where("date IS NOT NULL")


def indicators_to_years(df: DataFrame, code: str, year_text: str, indicator: str, value: str, names: dict[str, str], location: str | None = None) -> DataFrame:
    """Long API records to one row per (code, year); records without code or numeric year are dropped."""
    rows = df.where((text.blank_to_null(code).isNotNull()) & F.col(year_text).rlike(r"^\d+$"))
    aggs = [F.max(F.when(F.col(indicator) == key, F.col(value))).alias(out) for key, out in names.items()]
    if location:
        aggs.insert(0, F.min(location).alias("location"))
    return rows.groupBy(F.col(code).alias("location_code"), F.col(year_text).cast("int").alias("year")).agg(*aggs)
