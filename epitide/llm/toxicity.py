"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, texts of any kind the unlabelled ones. With p the share of toxic texts, a loss
l and scores z, the risk of the negatives is estimated as mean_U l(-z) - p mean_P l(-z); the classifier minimises
p mean_P l(z) plus that estimate, and steps the other way whenever it falls below zero, where it could only overfit.

Features are presences of words and word beginnings (4, 5 and 6 bytes; A-Z lower-cased). Those that stand in
positives more often than chance explains are kept, by their whole 64-bit hash; the weights are linear. Neither labels, lang,
source nor doc_id enter a score. A null or empty text has no features and scores the bias; without any positive text
every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import Ranges, held_out, lower, text_chunks, tidy, word_spans
from epitide.llm.learning import Adam, fit, marks, pick, score, sigmoid, training_texts
from epitide.sources.scratch import materialise

#: Bounds of the training sample.
POSITIVES, UNLABELLED = 4_000, 8_000
FEATURES, ROUNDS = 4_096, 400
#: A feature is kept if its surplus among positives has this log-likelihood ratio (chance: about 1 in 10,000).
SURPLUS = 18
HEADS = (4, 5, 6)
TABLE_BITS = 22
THRESHOLD = 0.7


def _features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each feature of a chunk, with repeats."""
    low = lower(data)
    starts, ends, before = word_spans(low, at)
    ranges = Ranges(low)
    row = np.repeat(np.arange(len(at) - 1), np.diff(before))
    found = [ranges.of(starts, ends)]
    found += [ranges.of(starts, np.minimum(ends, starts + n)) ^ np.uint64(n) for n in HEADS]
    return np.tile(row, len(found)), np.concatenate(found)


def _parts(texts: pa.Array, table: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and hashes, each pair once; with a table, only hashes whose slot is set."""
    for first, data, at in text_chunks(texts):
        row, h = _features(data, at)
        if table is not None:
            hit = table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
            row, h = row[hit], h[hit]
        by = np.lexsort((h, row))
        row, h = row[by], h[by]
        new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
        yield row[new] + first, h[new]


def _presences(texts: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    parts = list(_parts(texts, table))
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash, pos, un: how many positive and unlabelled texts of a batch hold a feature."""
    for batch in batches:
        mark = batch.column(batch.schema.names.index("mark")).to_numpy()
        row, h = _presences(batch.column(batch.schema.names.index("text")))
        kinds, which = np.unique(h, return_inverse=True)
        pos = np.bincount(which, mark[row] == 1, len(kinds)).astype(np.int64)
        un = np.bincount(which, mark[row] == 0, len(kinds)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(pos), pa.array(un)], names=["hash", "pos", "un"])


def surplus_features(texts: DataFrame, n_pos: int, n_un: int) -> np.ndarray:
    """Sorted hashes of the FEATURES features with the greatest surplus among positives above SURPLUS, ties to the smaller.

    Counts are partial sums by batch, then by feature; at most FEATURES numbers reach the driver."""
    counts = texts.mapInArrow(tidy(_count), "hash long, pos long, un long").groupBy("hash").agg(F.sum("pos").alias("pos"), F.sum("un").alias("un"))
    rate = (F.col("pos") + F.col("un")) / (n_pos + n_un)
    gain = 2 * (F.col("pos") * F.log(F.col("pos") / (n_pos * rate)) + F.when(F.col("un") > 0, F.col("un") * F.log(F.col("un") / (n_un * rate))).otherwise(0.0))
    able = counts.where((F.col("pos") > 1) & (F.col("pos") > n_pos * rate)).withColumn("gain", gain).where(F.col("gain") > SURPLUS)
    best = able.orderBy(F.desc("gain"), "hash").limit(FEATURES).select("hash").collect()
    return np.sort(np.array([r["hash"] for r in best], np.int64).view(np.uint64))


def extract(texts: pa.Array, hashes: np.ndarray) -> list[pa.Array]:
    """Numbers of the features that each text holds, at most as many as there are hashes."""
    row, col = _known(texts, hashes)
    by = np.lexsort((col, row))
    ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))]
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(col[by], pa.int32()))]


def train(features: pa.Table, mark: np.ndarray, size: int, prior: float) -> dict[str, np.ndarray]:
    """Weights of `size` features and the bias. mark: 1 for a positive text, 0 for an unlabelled one."""
    n_pos, n_un = int((mark == 1).sum()), int((mark == 0).sum())
    row = np.repeat(np.arange(len(mark)), pc.list_value_length(features["col"]).to_numpy())
    col = pc.list_flatten(features["col"]).to_numpy()
    w, b = np.zeros(size), np.zeros(1)
    is_pos = (mark == 1).astype(float)
    to_pos, to_un = is_pos / n_pos, (1 - is_pos) / max(1, n_un)
    adam = Adam(w, b, rate=0.05)
    for _ in range(ROUNDS):
        z = np.bincount(row, w[col], len(mark)) + b[0]
        loss_neg = np.logaddexp(0, z)  # of score z for a negative
        negative = to_un @ loss_neg - prior * (to_pos @ loss_neg)
        up = sigmoid(z)
        g_neg = (to_un - prior * to_pos) * up
        g = prior * to_pos * (up - 1) + g_neg if negative >= 0 else -g_neg
        adam.step(np.bincount(col, g[row], len(w)) + 1e-4 * w, np.array([g.sum()]))
    return {"weights": w, "bias": b}


def _known(texts: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each feature of the texts that is one of the sorted hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    row, h = _presences(texts, table)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hit = hashes[at] == h
    return row[hit], at[hit]


def apply(texts: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    if not np.isfinite(model["bias"][0]):
        return np.zeros(len(texts))
    row, col = _known(texts, model["hashes"])
    return sigmoid(np.bincount(row, model["weights"][col], len(texts)) + model["bias"][0])


def learned(learn_from: DataFrame, chosen: DataFrame, prior: float) -> dict[str, np.ndarray]:
    """Hashes, weights and bias from the chosen rows (doc_id, mark); their texts are written once and never leave Spark."""
    texts = materialise(training_texts(learn_from, chosen), "training-texts")
    n_pos, n_un = texts.agg(F.count_if(F.col("mark") == 1), F.count_if(F.col("mark") == 0)).first()
    if not n_pos:
        return {"hashes": np.zeros(0, np.uint64), "weights": np.zeros(0), "bias": np.array([-np.inf])}
    hashes = surplus_features(texts, n_pos, n_un)
    size = len(hashes)
    return {"hashes": hashes, **fit(texts, lambda part: extract(part, hashes), "col array<int>", lambda features, mark: train(features, mark, size, prior))}


def scores(docs: DataFrame, learn_from: DataFrame, labels: DataFrame) -> DataFrame:
    """Every column of `docs`, and score: likeness to the toxic texts. Learns from `learn_from` (doc_id, text), labels."""
    known = marks(labels, "toxic")
    count = known.agg(F.count("*"), F.sum((F.col("mark") == 1).cast("int"))).first()
    prior = min(0.5, max(0.01, (count[1] or 0) / max(1, count[0])))
    positive = pick(known.where("mark = 1"), POSITIVES, 1)
    other = pick(learn_from.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct(), UNLABELLED, 2)
    chosen = positive.select("doc_id", F.lit(1).alias("mark")).union(other.select("doc_id", F.lit(0).alias("mark")))
    return score(docs, learned(learn_from, chosen, prior), apply)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`."""
    rows = scores(docs.select("doc_id", "text"), docs, labels)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
