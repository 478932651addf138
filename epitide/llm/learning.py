"""Shared frame of the classifiers: pick bounded training rows, fit in one task, score every whole text by partition."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import held_out, tidy
from epitide.sources.scratch import materialise


def marks(labels: DataFrame, name: str) -> DataFrame:
    """doc_id, mark: one row for each labelled id of the learning folds. Null ids and labels don't count; of several
    labels of one id the largest counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(name).cast("int").alias("mark"))


def pick(rows: DataFrame, limit: int, seed: int) -> DataFrame:
    """Up to `limit` rows of (doc_id, ...), the same for the same ids."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)


def training_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, mark, text of the chosen rows (doc_id, mark), whose number the caller bounds. A repeated doc_id stands for
    its last text in byte order; equal texts with equal marks are one row, with the smallest id."""
    chosen = materialise(chosen.select("doc_id", "mark"), "sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "mark").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    return rows.groupBy("mark", "text").agg(F.min("doc_id").alias("doc_id"))


def fit(texts: DataFrame, extract: Callable[[pa.Array], list[pa.Array]], layout: str, train: Callable[[pa.Table, np.ndarray], dict]) -> dict[str, np.ndarray]:
    """What `train` returns for the features and marks of `training_texts`.

    `extract` turns texts into the columns named in `layout` (a schema) where Spark holds the texts, so the one task that
    fits reads features only: its input is bounded by rows times the size of a row of features, however long texts are.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()
    names = [f.split()[0] for f in layout.split(", ")]

    def features(batches):
        for batch in batches:
            doc, mark, text = (batch.column(batch.schema.names.index(c)) for c in ("doc_id", "mark", "text"))
            yield pa.RecordBatch.from_arrays([doc, mark, *extract(text)], names=["doc_id", "mark", *names])

    def run(batches):
        parts = list(batches)
        if parts:
            whole = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending"), ("mark", "ascending")])
            out = io.BytesIO()
            np.savez(out, **train(whole, whole["mark"].to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    rows = texts.mapInArrow(tidy(features), f"doc_id {kind}, mark int, {layout}").repartition(1)
    got = rows.mapInArrow(tidy(run), "model binary").first()  # one row of fixed size; none without rows
    empty = pa.table({name: pa.array([], pa.list_(pa.float64())) for name in names})
    return dict(np.load(io.BytesIO(got["model"]))) if got else train(empty, np.zeros(0, np.int32))


def score(docs: DataFrame, model: dict[str, np.ndarray], apply: Callable[[pa.Array, dict], np.ndarray]) -> DataFrame:
    """Every column of `docs`, and score (double) by `apply` over its texts. A column named score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c != "score"]
    schema = docs.select(*own, F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            values = apply(batch.column(names.index("text")), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(np.clip(values, 0.0, 1.0), pa.float64())], names=[*names, "score"])

    return docs.select(*own).mapInArrow(tidy(run), schema)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Adam:
    def __init__(self, *params: np.ndarray, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, *grads: np.ndarray) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
