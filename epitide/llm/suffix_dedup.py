"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts earlier.

Earlier means a smaller doc_id, or the same document and an earlier start. Texts are UTF-8 bytes, null is empty, and
strings never cross documents. A null doc_id comes after all others; rows with equal ids keep the order of the scan.

A string of 100 bytes is called a window. How windows that are equal meet, wherever they stand:

1. The anchor of a window is its smallest gram of 40 bytes by hash (leftmost on ties), which depends on the window
   alone. Neighbouring windows with one anchor form a context: the bytes they span. Anchors that occur once in the
   corpus are dropped; nothing can repeat there.
2. Equal contexts collapse by hash to their earliest occurrence; the windows of all later ones are covered.
3. Anchors with several different contexts are dealt to shards by anchor. A shard concatenates its contexts in corpus
   order, each closed by the smallest symbol, and sorts their suffixes in two stages: directly those smaller than
   their successor, the rest by scanning the buckets of first symbols. Neighbours in that order whose common prefix
   reaches 100 bytes are equal windows; all but the first of such a run are covered.
4. An anchor with more contexts than fit a shard sends the hash of each window through an aggregate instead, which
   has no group to collect: the exact way for passages that very many documents embed differently.
5. Covered ranges meet their documents once; only texts with such ranges are shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import MAX_LONG, Ranges, mix, numbered, text_chunks, tidy
from epitide.sources.scratch import materialise

GRAM = 40
POSITION = np.uint64((1 << 28) - 1)
#: Contexts of one anchor that a shard sorts; anchors with more take step 4.
ANCHOR_CONTEXTS = 2_000
#: Contexts of a shard, each of at most 160 bytes that take some 60 bytes of arrays apiece in the worker that sorts them.
SHARD_CONTEXTS = 4_000
#: Up to so many row numbers (8 bytes each) are broadcast to pick texts from the scan; beyond it texts are shuffled.
BROADCAST_ROWS = 500_000


def contexts(data: np.ndarray, at: np.ndarray, length: int):
    """For each context of a chunk: row, first and last window start in the row, anchor hash, context hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    ranges = Ranges(data)
    pos = np.arange(len(data) - GRAM + 1)
    grams = ranges.of(pos, pos + GRAM)
    low = (grams & ~POSITION) | pos.astype(np.uint64)
    span, width = 1, length - GRAM + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    inside = np.zeros(len(data) + 1, np.int8)
    full = at[1:] - at[:-1] >= length
    np.add.at(inside, at[:-1][full], 1)
    np.add.at(inside, at[1:][full] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: len(low)], dtype=np.int8))
    if not len(window):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (low[window] & POSITION).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(window)] - 1
    lo, hi = window[first], window[last]
    row = np.searchsorted(at, lo, "right") - 1
    return row, lo - at[row], hi - at[row], grams[anchor[first]], mix(ranges.of(lo, hi + length))


def two_stage_order(text: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of `text` (uint8, ends with 0, the smallest symbol) in order of at least their first `depth` symbols.

    words[i] holds the 8 symbols from i on, most significant first, zeros past the end.
    """
    n = len(text)
    change = np.flatnonzero(text[:-1] != text[1:])
    up = text[change] < text[change + 1]
    small = np.ones(n, bool)  # smaller than the successor; the last suffix counts as such
    if len(change):
        nearest = np.searchsorted(change, np.arange(n - 1))
        tail = nearest == len(change)
        small[:-1] = np.where(tail, False, up[np.minimum(nearest, len(change) - 1)])
    else:
        small[:-1] = False
    order = np.flatnonzero(small)
    key = words[order]
    by = np.argsort(key, kind="stable")
    order, key = order[by], key[by]
    group = np.cumsum(np.r_[0, (key[1:] != key[:-1]).astype(np.int64)])
    for step in range(8, depth + 8, 8):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        if not len(tied):
            break
        key = words[np.minimum(order[tied] + step, n - 1)]
        by = np.lexsort((key, group[tied]))
        order[tied], key, own = order[tied][by], key[by], group[tied][by]
        new = np.zeros(len(order), bool)
        new[tied[1:]] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        new[tied[0]] = tied[0] > 0
        new[1:] |= group[1:] != group[:-1]
        group = np.cumsum(new)
    heads = text[order]
    edges = np.searchsorted(heads, np.arange(257))
    queued: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, symbol: int) -> np.ndarray:
        """Queues the larger predecessors by their first symbol; returns those of the same bucket."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        first = text[before]
        mine = before[first == symbol]
        before, first = before[first != symbol], first[first != symbol]
        if len(before):
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(before)]):
                queued[first[a]].append(before[a:b])
        return mine

    for symbol in range(256):
        wave = np.concatenate(queued[symbol]) if queued[symbol] else order[:0]
        while len(wave):
            out.append(wave)
            wave = induce(wave, symbol)
        direct = order[edges[symbol] : edges[symbol + 1]]
        if len(direct):
            out.append(direct)
            induce(direct, symbol)
    return np.concatenate(out)


def repeated_windows(parts: list[bytes], length: int) -> np.ndarray:
    """Starts, in the concatenation of `parts` with one closing byte each, of windows equal to an earlier one."""
    raw = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    text = raw + np.uint8(1)  # 0xFF never stands in UTF-8, so the closing byte becomes 0
    padded = np.r_[text, np.zeros(8, np.uint8)]
    words = np.zeros(len(text), np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | padded[j : j + len(text)]
    order = two_stage_order(text, words, length)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, order)] - order
    order = order[left >= length]
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    alive = np.arange(len(a))
    for step in [*range(0, length - 7, 8), length - 8]:  # common prefixes of neighbours, as far as `length`
        hit = words[a[alive] + step] == words[b[alive] + step]
        same[alive[~hit]] = False
        alive = alive[hit]
    if not len(order):
        return order
    run = np.cumsum(np.r_[0, ~same])
    least = np.minimum.reduceat(order, np.flatnonzero(np.r_[True, ~same]))
    return np.sort(order[order != least[run]])


def _anchors(docs: DataFrame, length: int, hashes_only: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, at in text_chunks(batch.column(2)):
                row, lo, hi, h, x = contexts(data, at, length)
                if hashes_only:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])
                else:
                    at_row = row + first
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(x.view(np.int64)), pa.array(ids[at_row]), pa.array(rows[at_row]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                        names=["h", "x", "_id", "_row", "lo", "hi"],
                    )

    return docs.mapInArrow(tidy(run), "h long" if hashes_only else "h long, x long, _id long, _row long, lo int, hi int")


def _pick(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` (one for each _row), ready to be joined, and a filter of that size to be applied to the scan."""
    rows = materialise(rows, "rows")
    few = rows.count() <= BROADCAST_ROWS
    keys = rows.select("_row")
    return rows, F.broadcast(keys) if few else keys


def covered(docs: DataFrame, length: int) -> DataFrame:
    """_row, lo, hi: ranges of window starts that are covered. docs: _id, _row, text."""
    twice = materialise(_anchors(docs, length, True).groupBy("h").count().where("count > 1").select("h"), "anchors")
    found = materialise(_anchors(docs, length, False).join(twice, "h"), "contexts")
    distinct = materialise(
        found.groupBy("h", "x").agg(F.min(F.struct("_id", "_row", "lo", "hi")).alias("f"), F.count("*").alias("n")).select("h", "x", "f.*", "n"), "contexts"
    )
    firsts = distinct.where("n > 1").select("h", "x", F.col("_row").alias("r"), F.col("lo").alias("l"))
    copies = found.join(firsts, ["h", "x"]).where("_row <> r or lo <> l").select("_row", "lo", "hi")

    crowd = distinct.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    several = distinct.join(crowd, "h")
    spans = several.groupBy("_row").agg(F.first("_id").alias("_id"), F.collect_list(F.struct("lo", "hi", "h", "m")).alias("spans"))
    spans, keys = _pick(spans)
    texts = docs.select("_row", "text").join(keys, "_row", "left_semi").join(spans, "_row")

    def cut(batches):
        for batch in batches:
            rows = {"h": [], "m": [], "_id": [], "_row": [], "lo": [], "body": []}
            for r in batch.to_pylist():
                raw = r["text"].encode("utf-8", "surrogatepass")
                for s in r["spans"]:
                    rows["h"].append(s["h"]), rows["m"].append(s["m"]), rows["_id"].append(r["_id"]), rows["_row"].append(r["_row"])
                    rows["lo"].append(s["lo"]), rows["body"].append(raw[s["lo"] : s["hi"] + length])
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("h", pa.int64()), ("m", pa.int64()), ("_id", pa.int64()), ("_row", pa.int64()), ("lo", pa.int32()), ("body", pa.binary())]))

    bodies = materialise(texts.mapInArrow(tidy(cut), "h long, m long, _id long, _row long, lo int, body binary"), "bodies")
    sized = bodies.where(F.col("m") <= ANCHOR_CONTEXTS)
    shards = max(1, -(-sized.count() // SHARD_CONTEXTS))

    def sort(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_row", "lo"], kind="stable")
        parts = rows["body"].tolist()
        begins = np.cumsum([0] + [len(p) + 1 for p in parts])
        hits = repeated_windows(parts, length)
        part = np.searchsorted(begins, hits, "right") - 1
        start = hits - begins[part] + rows["lo"].to_numpy()[part]
        if not len(hits):
            return pd.DataFrame({"_row": [], "lo": [], "hi": []})
        head = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1)])
        tail = np.r_[head[1:], len(hits)] - 1
        return pd.DataFrame({"_row": rows["_row"].to_numpy()[part[head]], "lo": start[head], "hi": start[tail]})

    sorted_out = sized.groupBy(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard")).applyInPandas(sort, "_row long, lo int, hi int")

    def windows(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for i, r, lo, body in zip(*(batch.column(c).to_pylist() for c in ("_id", "_row", "lo", "body"))):
                sums, n = Ranges(np.frombuffer(body, np.uint8)), len(body) - length + 1
                at = np.arange(n)
                half = length // 2
                for k, v in enumerate((sums.of(at, at + length).view(np.int64), sums.of(at, at + half).view(np.int64), np.full(n, i), np.full(n, r), at + lo)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)).cast(pa.int64()) for v in out], names=["w", "w2", "_id", "_row", "lo"])

    hot = bodies.where(F.col("m") > ANCHOR_CONTEXTS).select("_id", "_row", "lo", "body").mapInArrow(tidy(windows), "w long, w2 long, _id long, _row long, lo long")
    earliest = hot.groupBy("w", "w2").agg(F.min(F.struct("_id", "_row", "lo")).alias("f"), F.count("*").alias("n")).where("n > 1").select("w", "w2", F.col("f._row").alias("r"), F.col("f.lo").alias("l"))
    aggregated = hot.join(earliest, ["w", "w2"]).where("_row <> r or lo <> l").select("_row", F.col("lo").cast("int").alias("lo"), F.col("lo").cast("int").alias("hi"))
    return copies.union(sorted_out).union(aggregated)


def dedup(docs: DataFrame, length: int = 100, characters: bool = False) -> DataFrame:
    """All columns of `docs`, and kept (binary: the remaining bytes), n_removed, n_spans (maximal removed runs).

    With `characters`, kept is text, without the characters that lost a byte. It is made where texts are cut: a second
    Python step in the same task would take a second worker."""
    own = [c for c in docs.columns if c not in ("kept", "n_removed", "n_spans")]
    kind, arrow = ("string", pa.string()) if characters else ("binary", pa.binary())
    placed = numbered(docs)
    rows = placed.select(F.struct(*own).alias("doc"), "_row", F.coalesce("text", F.lit("")).alias("text"))
    ids = placed.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG)).alias("_id"), "_row", F.coalesce("text", F.lit("")).alias("text"))
    ranges, keys = _pick(covered(ids, length).groupBy("_row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    touched = rows.join(keys, "_row", "left_semi").join(ranges, "_row").select("doc", "text", F.sort_array("ranges").alias("ranges"))
    schema = touched.select("doc", F.lit(None).cast(kind).alias("kept"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans")).schema

    def cut(batches):
        for batch in batches:
            kept, removed, spans = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                parts, at, n, gone = [], 0, 0, 0
                lo = np.array([r["lo"] for r in ranges])
                hi = np.maximum.accumulate(np.array([r["hi"] for r in ranges])) + length
                head = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
                for a, b in zip(lo[head].tolist(), hi[np.r_[head[1:], len(lo)] - 1].tolist()):
                    parts.append(raw[at:a])
                    gone, n, at = gone + b - a, n + 1, b
                left = b"".join([*parts, raw[at:]])
                kept.append(left.decode("utf-8", "ignore") if characters else left), removed.append(gone), spans.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, arrow), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], names=["doc", "kept", "n_removed", "n_spans"])

    whole = rows.join(keys, "_row", "left_anti").select("doc", F.col("text").cast(kind).alias("kept"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    return touched.mapInArrow(tidy(cut), schema).union(whole).select("doc.*", "kept", "n_removed", "n_spans")
