"""Ranked lexical search over a length-stratified index.

A term is a maximal run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. With N documents that hold a
term, L terms in all of them, n terms in a document and df documents that hold a term, a term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))), a document has the normaliser m = 25 + (75 n N) div L, and scores the sum of
w * impact(tf, m) over the item's terms (repeats included), impact(tf, m) = (10^9 tf) div (1000 tf + 8 m).

1. Every document becomes one row: n and the terms of the items that it holds, with their tf. Written once; N, L and df
   come from this table. A term of no item changes no score, so it is not kept.
2. Rows are dealt by ranges of (m, digest of the row), so that documents of equal m stand together and a common m is
   spread over tasks. Runs of equal m become strata of at most STRATUM_ROWS documents: postings sorted by (term, tf),
   where the impact of a tf is computed once for all documents that share it. The strata are written: this is the index.
3. A first visit scores, in each batch of strata, the stratum with the highest bound of each item (the sum over its
   terms of weight times the highest impact there). The k-th best score found this way is a floor for the answer.
4. The full visit takes the strata of a batch by falling bound and scores an item only in strata whose bound reaches its
   floor or the k-th best score found so far. Floors never exclude an answer: a stratum is left out only if its bound is
   below k scores that exist. Each batch returns at most k rows for each item, and these are merged.

Items are taken in blocks of bounded rows and terms, each block against all documents; only a block's terms are
broadcast. Terms are matched by a hash and then byte by byte.

A null or empty text has no terms and is no document of N. A null item text has no terms and no result; every row of the
items is an item of its own, also with a repeated or null id. Documents with equal or null ids are separate documents;
equal scores go by id, null last. Without documents or items the result has no rows. Other columns are not read. Memory
of a task: one batch of texts, or one text, with 1 byte a byte and 16 a term; one batch of strata.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epitide.llm.common import CHUNK_BYTES, Ranges, lower, text_chunks, tidy
from epitide.sources.scratch import materialise

STRATUM_ROWS, BATCH_STRATA, SLICE = 2048, 64, 1 << 21
#: Items of a block, and terms at which a block ends.
BLOCK_ITEMS, BLOCK_TERMS = 500, 200_000

TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[128:] = True
for _first, _last in (b"09", b"AZ", b"az"):
    TERM_BYTE[_first : _last + 1] = True


def term_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all terms of the rows that `at` delimits."""
    solid = TERM_BYTE[data]
    begins, finishes = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    finishes[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(data))]
    begins[inner] |= solid[inner]
    finishes[inner - 1] |= solid[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def terms_of(text: str | None) -> list[bytes]:
    data = lower(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))
    starts, ends = term_spans(data, np.array([0, len(data)]))
    return [data[s:e].tobytes() for s, e in zip(starts, ends)]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Vocabulary:
    """The terms of a block of items, numbered in byte order."""

    def __init__(self, terms: list[bytes]):
        self.bytes = np.frombuffer(b"".join(terms), np.uint8)
        self.length = np.array([len(t) for t in terms], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.longest = int(self.length.max()) if len(terms) else 0
        keys = Ranges(self.bytes).of(self.start, self.start + self.length) if len(terms) else np.zeros(0, np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each term, -1 if no item has it."""
        out = np.full(len(starts), -1, np.int64)
        fits = np.flatnonzero(ends - starts <= self.longest)
        done = 0
        while done < len(fits):
            low = starts[fits[done]]
            last = int(np.searchsorted(starts[fits], low + CHUNK_BYTES, "right"))
            some = fits[done:last]
            hashes = Ranges(data[low : ends[some[-1]]]).of(starts[some] - low, ends[some] - low)
            place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[place] == hashes
            out[some[hit]] = self.order[place[hit]]
            done = last
        hit = np.flatnonzero(out >= 0)
        hit_length = ends[hit] - starts[hit]
        same = hit_length == self.length[out[hit]]
        out[hit[~same]] = -1
        hit, hit_length = hit[same], hit_length[same]
        for first in range(0, len(hit), SLICE // 8):  # byte by byte: equal hashes alone don't make equal terms
            some, n = hit[first : first + SLICE // 8], hit_length[first : first + SLICE // 8]
            differs = data[_spread(starts[some], n)] != self.bytes[_spread(self.start[out[some]], n)]
            if differs.any():
                out[np.repeat(some, n)[differs]] = -1
        return out


def vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n, terms and tfs (little-endian int32, sorted by term) of each document that has a term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # one block of items

    def run(batches):
        known = Vocabulary(shared.value)
        for batch in batches:
            column = batch.column(1)
            n, pairs = np.zeros(batch.num_rows, np.int64), []
            for first, data, at in text_chunks(column):
                data = lower(data)
                starts, ends = term_spans(data, at)
                n[first : first + len(at) - 1] = np.diff(np.searchsorted(starts, at))
                if known.longest:
                    number = known.find(data, starts, ends)
                    row = np.searchsorted(at, starts, "right") - 1 + first
                    pairs.append(row[number >= 0] << 32 | number[number >= 0])
            code, tf = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
            cut = np.searchsorted(code >> 32, np.arange(batch.num_rows + 1))
            term, tf = (code & 0xFFFFFFFF).astype("<i4"), tf.astype("<i4")
            rows = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows)), pa.array(n[rows]),
                pa.array([term[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()),
                pa.array([tf[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()),
            ], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, n long, terms binary, tfs binary")


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of each term."""
    whole = rows.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()

    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for part in batch.column(0):
                df[np.frombuffer(part.as_buffer(), "<i4")] += 1  # a document holds a term once
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    df = np.zeros(n_terms, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a block's terms
        df[r["term"]] = r["df"]
    return int(whole["N"]), int(whole["L"]), df


def _stratum(m: int, ids: pa.Array, terms: list[bytes], tfs: list[bytes]) -> tuple:
    """(m, document ids, then per (term, tf): term, tf, number of documents; and the documents)."""
    size = np.array([len(t) // 4 for t in terms], np.int64)
    term, tf = np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(tfs), "<i4")
    doc = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((doc, tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
    heads = np.flatnonzero(new)
    return m, ids, term[heads].astype("<i4").tobytes(), tf[heads].astype("<i4").tobytes(), np.diff(np.append(heads, len(term))).astype("<i4").tobytes(), doc.astype("<i4").tobytes()


INDEX = "m long, docs array<long>, terms binary, tfs binary, sizes binary, postings binary"


def strata(rows: DataFrame, N: int, L: int) -> DataFrame:
    """The index: one row for each run of at most STRATUM_ROWS documents of equal m."""
    m = F.expr(f"25 + (75 * cast(n as decimal(18, 0)) * cast({N} as decimal(18, 0))) div cast({max(L, 1)} as decimal(19, 0))")
    keyed = rows.withColumn("m", m).withColumn("_deal", F.xxhash64("doc_id", "n", "terms", "tfs"))
    dealt = keyed.repartitionByRange("m", "_deal").sortWithinPartitions("m", "_deal", "doc_id").drop("_deal", "n")

    def run(batches):
        at, ids, terms, tfs = None, [], [], []

        def close():
            kept = _stratum(at, ids, terms, tfs)
            return pa.RecordBatch.from_arrays([
                pa.array([kept[0]], pa.int64()), pa.array([kept[1]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in kept[2:]),
            ], names=["m", "docs", "terms", "tfs", "sizes", "postings"])

        for batch in batches:
            for doc_id, t, f, m in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if ids and (m != at or len(ids) == STRATUM_ROWS):
                    yield close()
                    ids, terms, tfs = [], [], []
                at = m
                ids.append(doc_id)
                terms.append(t)
                tfs.append(f)
        if ids:
            yield close()

    return dealt.select("doc_id", "terms", "tfs", "m").mapInArrow(tidy(run), INDEX)


class Items:
    """The terms of a block of items as one sparse matrix: item, term, weight times repeats."""

    def __init__(self, terms: list[list[int]], df: np.ndarray, N: int):
        w = np.array([math.floor(1000 * math.log((2 * N + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        pairs = [np.unique(np.array(t, np.int64), return_counts=True) for t in terms]
        self.n = len(terms)
        self.item = np.repeat(np.arange(self.n), [len(p[0]) for p in pairs])
        self.term = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
        self.weight = np.concatenate([p[1] for p in pairs]) * w[self.term] if pairs else np.zeros(0, np.int64)


class Stratum:
    def __init__(self, m: int, docs, terms: bytes, tfs: bytes, sizes: bytes, postings: bytes, items: Items):
        group_term, tf, size = (np.frombuffer(x, "<i4").astype(np.int64) for x in (terms, tfs, sizes))
        self.ids = np.array([(1 << 63) - 1 if d is None else d for d in docs], np.int64)
        self.null = np.array([d is None for d in docs], bool)
        self.docs = np.frombuffer(postings, "<i4")
        distinct, which = np.unique(tf, return_inverse=True)
        per_tf = 1_000_000_000 * distinct // (1000 * distinct + 8 * m)  # once for each tf of the stratum
        impact = per_tf[which]
        self.impact = np.repeat(impact, size)
        start = np.append(0, np.cumsum(size))
        low, high = np.searchsorted(group_term, items.term, "left"), np.searchsorted(group_term, items.term, "right")
        self.first, self.count = start[low], start[high] - start[low]
        held = high > low  # tf rises inside a term, so its last group has the highest impact
        bound = np.zeros(items.n, np.int64)
        np.add.at(bound, items.item[held], items.weight[held] * impact[high[held] - 1])
        self.bound = bound

    def scores(self, items: Items, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, document, score above 0) for the wanted items (a mask)."""
        use = np.flatnonzero(wanted[items.item] & (self.count > 0) & (items.weight > 0))
        if not len(use):
            return
        item, first, count, weight = items.item[use], self.first[use], self.count[use], items.weight[use]
        ends = np.flatnonzero(np.append(item[1:] != item[:-1], True)) + 1  # slices end with an item
        total = np.cumsum(count)
        begin = 0
        while begin < len(use):
            before = total[begin - 1] if begin else 0
            fit = ends[np.searchsorted(total[ends - 1], before + SLICE, "right") - 1]
            end = int(fit if fit > begin else ends[np.searchsorted(ends, begin, "right")])
            part = slice(begin, end)
            rows, local = np.unique(item[part], return_inverse=True)
            at = _spread(first[part], count[part])
            cell = np.repeat(local, count[part]) * len(self.ids) + self.docs[at]
            value = self.impact[at] * np.repeat(weight[part], count[part])
            if self.bound[rows].max() < 1 << 53:
                sums = np.bincount(cell, value, len(rows) * len(self.ids)).astype(np.int64)  # exact below 2**53
            else:
                sums = np.zeros(len(rows) * len(self.ids), np.int64)
                np.add.at(sums, cell, value)
            hit = np.flatnonzero(sums)
            yield rows[hit // len(self.ids)], hit % len(self.ids), sums[hit]
            begin = end


def _best(item, doc, null, score, k):
    """The k best of each item: score falling, id rising, null ids last."""
    order = np.lexsort((doc, null, -score, item))
    item, doc, null, score = item[order], doc[order], null[order], score[order]
    place = np.arange(len(item)) - np.searchsorted(item, item, "left")
    keep = place < k
    return item[keep], doc[keep], null[keep], score[keep]


def _visit(index: DataFrame, items, floor: np.ndarray, k: int, every: bool) -> DataFrame:
    """item, doc_id, score: at most k rows of each item and batch of strata."""
    shared = index.sparkSession.sparkContext.broadcast((items, floor))  # one block of items

    def run(batches):
        items, floor = shared.value
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for first in range(0, batch.num_rows, BATCH_STRATA):
                yield from visit([Stratum(*row, items) for row in zip(*(c[first : first + BATCH_STRATA] for c in columns))], items, floor)

    def visit(group, items, floor):
        found = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        need = np.maximum(floor, 1)
        bounds = np.array([s.bound for s in group])
        top = bounds.argmax(axis=0)
        for i in np.argsort(-bounds.max(axis=1), kind="stable"):
            s = group[i]
            wanted = s.bound >= need if every else (top == i) & (s.bound >= need)
            for item, doc, score in s.scores(items, wanted):
                good = score >= need[item]
                item, doc, score = item[good], doc[good], score[good]
                found = _best(*(np.concatenate(x) for x in zip(found, (item, s.ids[doc], s.null[doc], score))), k)
                full = np.flatnonzero(np.bincount(found[0], minlength=items.n) == k)
                last = np.searchsorted(found[0], full, "right") - 1
                need[full] = np.maximum(need[full], found[3][last])
        item, doc, null, score = found
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null), pa.array(score)], names=["item", "doc_id", "score"])

    return index.mapInArrow(tidy(run), "item long, doc_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        terms = terms_of(r["text"])
        block.append((r["item_id"], terms))
        size += len(terms)
        if len(block) == BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


RESULT = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents (doc_id, text) of highest score above 0 for each item
    (item_id, text)."""
    spark = docs.sparkSession
    out = []
    for block in _blocks(items):
        terms = sorted({t for _, ts in block for t in ts})
        number = {t: i for i, t in enumerate(terms)}
        rows = materialise(vectors(docs, terms), "vectors")
        N, L, df = statistics(rows, len(terms))
        wanted = Items([[number[t] for t in ts] for _, ts in block], df, N)
        index = materialise(strata(rows.where(F.length("terms") > 0), N, L), "strata")
        seen = _ranked(_visit(index, wanted, np.zeros(len(block), np.int64), k, every=False), k).where(F.col("rank") == k)
        floor = np.zeros(len(block), np.int64)
        for r in seen.select("item", "score").collect():  # at most one row for each item of the block
            floor[r["item"]] = r["score"]
        best = materialise(_ranked(_visit(index, wanted, floor, k, every=True), k), "found")
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # names: one block
    if not out:
        return spark.createDataFrame([], RESULT)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
