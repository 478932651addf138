"""Column functions for records hidden in JSON text, their keys and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from epitide import schema
from epitide.functions import text


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_object(column: Column | str, layout: T.StructType) -> Column:
    """JSON object as a struct in one parse, null for anything that is not exactly one object."""
    column = _col(column)
    tested = T.StructType([*layout.fields, T.StructField("_broken", T.StringType())])
    options = {"columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"}
    shape = F.trim(column)
    record = F.from_json(column, tested, options)
    return F.when(shape.startswith("{") & shape.endswith("}"), record)


def is_object(record: str) -> Column:
    """Did :func:`parse_object` accept the text?"""
    return F.col(record).isNotNull() & F.col(f"{record}._broken").isNull()


def json_record(df: DataFrame, column: str) -> DataFrame:
    """Thirteen fields of a JSON object plus a validity flag.

    Text that is not a JSON object (broken, an array, a scalar) gives nulls and false.
    """
    staged = df.withColumn("_record", parse_object(column, schema.RAW_RECORD_SCHEMA))
    ok = is_object("_record")
    fields = {out: F.when(ok, F.col(f"_record.{name}")) for name, out in schema.RAW_RECORD_NAMES.items()}
    return staged.withColumns({**fields, "raw_json_valid": ok}).drop("_record")


def backfill_dimension(target: Column | str, dimension: str) -> Column:
    """Value from whichever of the three typed slots carries the dimension."""
    slots = [
        F.when(F.upper(F.col(f"dimension_{i}_type")) == dimension, F.col(f"dimension_{i}_value"))
        for i in (1, 2, 3)
    ]
    return F.coalesce(_col(target), *slots)


def joined(columns: list[str], separator: str = "|") -> Column:
    """Columns as one text; a missing value keeps its place as an empty string."""
    return F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def record_key(code: Column | str, record_id: Column | str, fallback: list[str]) -> Column:
    """Business key of an indicator record: its own id, else a composite of columns."""
    record_id = _col(record_id)
    return F.when(
        record_id.isNotNull(), F.concat(_col(code), F.lit("|id:"), record_id.cast("string"))
    ).otherwise(joined(fallback))


def normalise_record(df: DataFrame, endpoint: Column, indicator_name: Column | None = None) -> DataFrame:
    """Records with varying field names to the fixed indicator columns, raw record kept."""
    available = set(df.columns)

    def pick(name: str) -> Column:
        found = [F.col(c).cast("string") for c in schema.RECORD_FIELD_CANDIDATES[name] if c in available]
        return text.first_non_empty(*found) if found else F.lit(None).cast("string")

    fields = {name: pick(name) for name in schema.RECORD_FIELD_CANDIDATES}
    fields["indicator_code"] = F.coalesce(fields["indicator_code"], endpoint)
    if indicator_name is not None:
        fields["indicator_name"] = F.coalesce(fields["indicator_name"], indicator_name)
    fields |= {
        "source": F.lit("WHO GHO OData"),
        "endpoint": endpoint,
        "raw_json": F.to_json(F.struct("*"), {"ignoreNullFields": "false"}),
    }
    return df.select(*(fields[name].alias(name) for name in schema.INDICATOR_COLUMNS))
