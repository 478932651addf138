"""Sinks: partitioned Parquet, CSV, nested JSON, external tables, fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from epitide.sources.readers import CSV

DUPLICATE_AUDIT_COLUMNS = (  # fixed values
    "indicator_code", "indicator_name", "location_type", "location_code", "year", "value",
    "numeric_value_clean", "unit", "duplicate_source_count", "duplicate_content_variant_count",
    "duplicate_content_conflict", "duplicate_collector_topics", "duplicate_source_files",
)


def write_partitioned(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite only the partitions present in the data.

    The rebalance hint groups rows of a partition into few files and lets adaptive execution split a
    partition that holds far more than the others.
    """
    (
        df.hint("rebalance", *(F.col(c) for c in partition_by))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; quotes inside a value are doubled."""
    df.write.mode("overwrite").options(**CSV).csv(path)


def append_csv_folders(df: DataFrame, path: str, folder: str, folders: int) -> None:
    """Append CSV, one folder for each value of a column with up to about `folders` values.

    Every task keeps a file open in each folder, so rows are neither shuffled nor sorted by folder.
    """
    spark, setting = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting)
    spark.conf.set(setting, folders)
    try:
        df.write.mode("append").partitionBy(folder).options(**CSV).csv(path)
    finally:
        spark.conf.set(setting, before)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is not valid JSON; it means missing here."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def as_json(df: DataFrame, out: str = "document", keep: list[str] | None = None) -> DataFrame:
    """Each row as one JSON object with explicit nulls."""
    clean = nan_to_null(df)
    return clean.select(*(keep or []), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per line, nulls kept."""
    nan_to_null(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def register_table(spark: SparkSession, name: str, df_schema: T.StructType, path: str, partition_by: list[str]) -> None:
    """External Parquet table over written files, partitions recovered from the folders."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df_schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    partitions = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {partitions} LOCATION '{path}'")
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {name}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def duplicate_audit(catalog: DataFrame) -> DataFrame:
    """Only keys that were collected more than once, fixed audit columns."""
    columns = [c for c in DUPLICATE_AUDIT_COLUMNS if c in catalog.columns]
    return catalog.where("duplicate_source_count > 1").select(*columns)
