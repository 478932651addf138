"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

The score of a text with features x is w0 + w x + sum over pairs i < j of <v_i, v_j> x_i x_j, with vectors of RANK
numbers; the pairs cost linear time, since twice their sum is sum_f (sum_i v_if x_i)^2 - sum_f sum_i (v_if x_i)^2.
Words (A-Z lower-cased) are hashed to SLOTS features that hold their share of the text's words; the statistics and the
metadata of the text (its length in bytes and words) are scaled by mean and deviation of the training sample. Neither
labels, lang, source nor doc_id enter a score. A null text is empty; an empty one has no words and zero statistics.
Without labels of both kinds the score is the share of good labels, or 0.5 without labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import Ranges, held_out, lower, text_chunks, word_spans
from epitide.llm.learning import Adam, fit, marks, pick, score, sigmoid, training_texts

#: Bound of the training sample.
SAMPLE = 8_000
SLOTS, RANK, ROUNDS, BATCH = 4_096, 8, 12, 256
STATISTICS = 14


def _chunk(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and share of the words of each row (each slot once), and the statistics of each row."""
    n = len(at) - 1
    low = lower(data)
    starts, ends, before = word_spans(low, at)
    words = np.diff(before)
    row = np.repeat(np.arange(n), words)
    ranges = Ranges(low)
    hashes = ranges.of(starts, ends)
    pair, count = np.unique(row * SLOTS + (hashes >> np.uint64(52)).astype(np.int64), return_counts=True)
    slot_row, slot = pair // SLOTS, pair % SLOTS

    sums = lambda flag: np.diff(np.r_[0, np.cumsum(flag, dtype=np.int64)][at]).astype(float)
    size, count_words = np.diff(at).astype(float), words.astype(float)
    upper, small = sums(data != low), sums((data >= 97) & (data <= 122))
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    symbol = ((last >= 33) & (last <= 47) & (last != 44) & (last != 46)) | (last == 64)
    by = np.lexsort((hashes, row))
    fresh = np.r_[True, (row[by][1:] != row[by][:-1]) | (hashes[by][1:] != hashes[by][:-1])] if len(row) else np.zeros(0, bool)
    per_row = lambda values, where=row: np.bincount(where, values, n)
    bytes_, w = np.maximum(size, 1), np.maximum(count_words, 1)
    stats = np.stack([
        np.log1p(size), np.log1p(count_words), per_row(ends - starts) / w, upper / np.maximum(upper + small, 1),
        sums((data >= 48) & (data <= 57)) / bytes_, sums(data == 33) / bytes_, sums(data == 124) / w,
        sums((data >= 35) & (data <= 42)) / w, sums((data == 46) | (data == 44)) / w, sums(data == 10) / w,
        sums(data >= 128) / bytes_, per_row(symbol) / w, per_row(fresh.astype(float), row[by]) / w, per_row((ends - starts) == 1) / w,
    ], axis=1)
    stats[count_words == 0] = 0
    return slot_row, slot, count / w[slot_row], stats


def _machine(n: int, row, col, x, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of each of n rows by the sum-of-squares identity, and sum_i v_if x_i of each row."""
    inner = np.stack([np.bincount(row, v[col, f] * x, n) for f in range(v.shape[1])], axis=1)
    squares = np.bincount(row, (v * v).sum(1)[col] * x * x, n)
    return w0 + np.bincount(row, w[col] * x, n) + 0.5 * ((inner * inner).sum(1) - squares), inner


def _sparse(slot_row, slot, share, stats, mean, scale):
    """Features of all kinds as row, column and value; columns: SLOTS words, then the statistics."""
    n = len(stats)
    dense = np.clip((stats - mean) / scale, -8, 8)
    row = np.r_[slot_row, np.repeat(np.arange(n), STATISTICS)]
    return row, np.r_[slot, np.tile(SLOTS + np.arange(STATISTICS), n)], np.r_[share, dense.ravel()]


def extract(texts: pa.Array) -> list[pa.Array]:
    """Slots, shares and statistics of each text: at most SLOTS pairs and STATISTICS numbers, however long it is."""
    parts = [_chunk(data, at) for _, data, at in text_chunks(texts)]
    width = np.concatenate([np.zeros(1, int), *(np.bincount(p[0], minlength=len(p[3])) for p in parts)])
    ends = pa.array(np.cumsum(width), pa.int32())
    slot, share, stats = (np.concatenate([np.zeros(0, kind), *(p[i].ravel() for p in parts)]) for i, kind in ((1, int), (2, float), (3, float)))
    return [
        pa.ListArray.from_arrays(ends, pa.array(slot, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(share)),
        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * STATISTICS, pa.int32()), pa.array(stats)),
    ]


#: The columns of `extract`.
LAYOUT = "slot array<int>, share array<double>, stats array<double>"


def train(features: pa.Table, mark: np.ndarray) -> dict[str, np.ndarray]:
    """Weights, vectors and scaling from the columns of `extract`, one row for each mark."""
    slot, share, stats = (pc.list_flatten(features[c]).to_numpy() for c in ("slot", "share", "stats"))
    stats, slot_row = stats.reshape(-1, STATISTICS), np.repeat(np.arange(len(mark)), pc.list_value_length(features["slot"]).to_numpy())
    good = float((mark == 1).mean()) if len(mark) else 0.5
    w, v = np.zeros(SLOTS + STATISTICS), np.random.default_rng(7).normal(0, 0.02, (SLOTS + STATISTICS, RANK))
    w0 = np.array([np.log((good + 1e-3) / (1 - good + 1e-3))])
    mean = stats.mean(0) if len(stats) else np.zeros(STATISTICS)
    scale = stats.std(0) + 1e-6 if len(stats) else np.ones(STATISTICS)
    model = {"w0": w0, "w": w, "v": v, "mean": mean, "scale": scale}
    if good in (0.0, 1.0) or not len(mark):
        v[:] = 0
        w0[:] = 60 * np.sign(good - 0.5)
        return model
    row, col, x = _sparse(slot_row, slot, share, stats, mean, scale)
    by = np.argsort(row, kind="stable")
    row, col, x = row[by], col[by], x[by]
    edge = np.searchsorted(row, np.arange(len(mark) + 1))
    y, adam, rng = mark.astype(float), Adam(w0, w, v, rate=0.01), np.random.default_rng(5)
    for _ in range(ROUNDS):
        mixed = rng.permutation(len(mark))
        for lo in range(0, len(mark), BATCH):
            rows = mixed[lo : lo + BATCH]
            width = edge[rows + 1] - edge[rows]
            take = np.repeat(edge[rows] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
            r, c, value = np.repeat(np.arange(len(rows)), width), col[take], x[take]
            z, inner = _machine(len(rows), r, c, value, w0[0], w, v)
            g = (sigmoid(z) - y[rows]) / len(rows)
            gx = g[r] * value
            gv = np.stack([np.bincount(c, gx * (inner[r, f] - v[c, f] * value), len(w)) for f in range(RANK)], axis=1)
            adam.step(np.array([g.sum()]), np.bincount(c, gx, len(w)) + 1e-5 * w, gv + 1e-5 * v)
    return model


def apply(texts: pa.Array, model: dict[str, np.ndarray]) -> np.ndarray:
    out = np.empty(len(texts))
    for first, data, at in text_chunks(texts):
        slot_row, slot, share, stats = _chunk(data, at)
        features = _sparse(slot_row, slot, share, stats, model["mean"], model["scale"])
        out[first : first + len(stats)] = sigmoid(_machine(len(stats), *features, model["w0"][0], model["w"], model["v"])[0])
    return out


def scores(docs: DataFrame, learn_from: DataFrame, labels: DataFrame) -> DataFrame:
    """Every column of `docs`, and score. Learns from `learn_from` (doc_id, text) and labels."""
    texts = training_texts(learn_from, pick(marks(labels, "quality"), SAMPLE, 3))
    return score(docs, fit(texts, extract, LAYOUT, train), apply)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`."""
    rows = scores(docs.select("doc_id", "text"), docs, labels)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
