"""Helpers shared by the operators: tables, row keys, and word and gram hashes over Arrow text without copying it.

Hashes are 64-bit. A byte range is hashed by prefix sums: every byte value has a random weight, position i is scaled
by an odd base to the power i, and a range is the difference of two sums scaled back to position 0.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epitide.sources.scratch import materialise

#: Fixed constants of the splitmix64 generator.
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes of text that are worked on at once: each takes about 100 bytes of arrays, in every worker of an executor.
CHUNK_BYTES = 1 << 17
MAX_LONG = (1 << 63) - 1


#: Rows and bytes that Spark hands to Python at once; whole texts would otherwise make batches of tens of megabytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def small_batches(spark: SparkSession) -> None:
    """Set the size of batches for whole texts, unless the session was launched with sizes of its own."""
    launched = spark.sparkContext.getConf()
    for key, value in BATCHES.items():
        if not launched.contains(key):
            spark.conf.set(key, value)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Rows of one file, and files whose numbers are broadcast.
FILE_BITS, BROADCAST_FILES = 33, 50_000


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with _row, a number that a row keeps in every job: the place of its file among the file names and its place
    in that file. Numbers of the scan would follow the file splits, which change when executors come or go.

    `docs` is a read of Parquet files from which columns and rows may have been chosen; anything else is written first.
    The file names are numbered once and written, one row for each file.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    try:
        placed = docs.select("*", *place)
    except AnalysisException:  # not a read of files
        placed = materialise(docs, "documents").select("*", *place)
    number = F.row_number().over(Window.orderBy("_file")).cast("long")
    files = materialise(placed.select("_file").distinct().withColumn("_number", number), "files")
    files = F.broadcast(files) if files.count() <= BROADCAST_FILES else files
    row = F.shiftleft("_number", FILE_BITS) + F.col("_at")
    return placed.join(files, "_file").withColumn("_row", row).drop("_file", "_at", "_number")


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


def splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN) + np.uint64(seed))


BYTE_WEIGHT = splitmix(256, 11)
BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64; kept and extended between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        out = np.empty(size, np.uint64)
        out[0], done = 1, 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        _POWERS[base] = have = out
    return have


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that hands free memory back when a task ends; Spark keeps its Python workers for the
    next stage, which would otherwise find less room."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim is not None:
                trim(0)

    return whole


class Ranges:
    """Hashes of byte ranges of one chunk."""

    def __init__(self, data: np.ndarray):
        self.back = powers(pow(BASE, -1, 1 << 64), len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_WEIGHT[data] * powers(BASE, len(data))[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into the bytes) for runs of whole rows of about `limit` bytes. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, body[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def is_space(data: np.ndarray) -> np.ndarray:
    """White space as in [\\x20\\x09-\\x0D]."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (one more than rows)."""
    solid = ~is_space(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    finishes[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, at)
