"""Where intermediate tables are written."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}


def _local_root(application: str) -> str:
    """One temporary folder for a session that is a single process; removed when that process ends."""
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL[application], ignore_errors=True)
    return _LOCAL[application]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names in spark.checkpoint.dir.

    Without that setting only a session that runs in one process has a folder of its own; any other fails.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/epitide/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Number, size, age and a hash of the files below the paths; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return tuple(files.agg(
        F.count("*"), F.sum("length"), F.max("modificationTime"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")),
    ).first())


_KEPT: dict[tuple, tuple[str, tuple]] = {}


def kept(spark: SparkSession, key: str, inputs: list[str], write: Callable[[str], None]) -> str:
    """Path of something that is derived from input files and shared by the questions of one application.

    It is written by the first question, and again when an input file has changed or a written file is gone.
    """
    slot = (spark.sparkContext.applicationId, key, state_of(spark, inputs))
    if slot in _KEPT:
        path, state = _KEPT[slot]
        try:
            if state_of(spark, [path]) == state:
                return path
        except AnalysisException:
            pass
    path = shared_dir(spark, "kept")
    write(path)
    _KEPT[slot] = (path, state_of(spark, [path]))
    return path
