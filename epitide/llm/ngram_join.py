"""Grouped prefix join on word shingles: exact components of the graph of documents whose shingle sets are alike.

1. Shingles get an order of their own: a fixed table of slots counts how often hashes fall into each slot over the
   whole corpus; common slots come last, ties in order of the hash. Any order gives right results; this one keeps
   common passages out of the prefixes.
2. A set of n shingles needs the first n - ceil(t n) + 1 as prefix: two sets with likeness t or more share one of
   those. Documents with equal sets are one class; classes with equal prefix and size are one group.
3. An inverted list of each prefix shingle holds groups. Lists with one group are dropped.
4. In each list one group is the pivot (the one with the most shared shingles): the pairs of pivot and member, and of
   a group's classes with its first class, are expanded to classes and verified on whole texts. Their number follows
   the lists' length. Pairs need fitting sizes and enough common prefix shingles: of the k shingles two sets of sizes
   n >= m must share, at most ceil(t n) - 1 stand behind the prefix of either, so the first k - ceil(t n) + 1 stand in both.
5. Only lists whose classes are not one component by then are opened: pairs of different groups and components that
   were not tried yet are verified by the same rules; a list is joined by buckets of size, the smaller set by fewer of its
   shingles, and long lists are dealt over several tasks. Groups whose classes are not one component are joined inside:
   their sets have one size n and must share k shingles, so the n - k + 1 that are rarest in the group hold one of
   those. A pair inside a component needs no check, any other pair that could link has been verified, so no link
   between components is lost.

Rows without words have an empty set, no links and their own id as component. Repeated rows are one class. A null
doc_id is linked like any other; its component is the smallest id of the component that is not null, else null.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epitide.llm.common import MAX_LONG, mix, numbered, tidy
from epitide.llm.components import components
from epitide.llm.shingles import shingle_sets
from epitide.sources.scratch import materialise

SLOT_BITS, PARTS = 22, 64
#: Up to so many row numbers (8 bytes each) are broadcast to pick texts from the scan; beyond it texts are shuffled.
BROADCAST_ROWS = 500_000
#: Rows of a list that one task joins with the other side.
LIST_ROWS = 4_096


def common_slots(docs: DataFrame, words: int) -> np.ndarray:
    """For each slot a level: 0 for slots that hold their share of shingles, else the doublings above it. Fixed size."""
    size = 1 << SLOT_BITS

    def count(batches):
        counts = np.zeros(size, np.uint32)
        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                np.add.at(counts, (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
        parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(PARTS, -1)] if counts.any() else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size // PARTS, np.uint64)
        for x in rows["counts"]:
            raw = zlib.decompress(x)
            total += np.frombuffer(raw, np.uint32 if len(raw) == 4 * len(total) else np.uint64)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "part int, counts binary"
    rows = docs.select("text").mapInArrow(tidy(count), kind).withColumn("branch", F.spark_partition_id() % 256)
    rows = rows.groupBy("part", "branch").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind)
    total = np.zeros(size, np.uint64)
    for r in rows.collect():  # always PARTS rows that hold one table of fixed size
        total.reshape(PARTS, -1)[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    share = total.sum() / size
    base = share + 6 * math.sqrt(share) + 1
    return np.ceil(np.log2(np.maximum(total, base) / base)).astype(np.uint8)


def prefixes(docs: DataFrame, words: int, per_cent: int) -> DataFrame:
    """_row, doc_id, cls (hash of the set), size, gk (hash of prefix and size), prefix for each row; nulls if empty."""
    levels = docs.sparkSession.sparkContext.broadcast(common_slots(docs, words))

    def run(batches):
        level = levels.value
        for batch in batches:
            cls, sizes, gks, pre = [], [], [], []
            for s in shingle_sets(batch.column(2), words):
                n = len(s)
                sizes.append(n)
                if not n:
                    cls.append(None), gks.append(None), pre.append(None)
                    continue
                salt = np.uint64(n)
                cls.append(int(mix((mix(s + salt)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]))
                slots = level[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                take = n - (per_cent * n + 99) // 100 + 1
                own = s[np.lexsort((s, slots))[:take]] if slots.any() else s[:take]
                gks.append(int(mix((mix(own + salt)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]))
                pre.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gks, pa.int64()), pa.array(pre, pa.list_(pa.int64()))],
                names=["_row", "doc_id", "cls", "size", "gk", "prefix"],
            )

    return docs.select("_row", "doc_id", "text").mapInArrow(tidy(run), "_row long, doc_id long, cls long, size long, gk long, prefix array<long>")


def verified(pairs: DataFrame, docs: DataFrame, words: int, per_cent: int) -> DataFrame:
    """The pairs (a, b: classes; ra, rb: a row of each) that link, by their whole texts."""
    texts = materialise(_chosen(docs, pairs.select(F.col("ra").alias("_row")).union(pairs.select(F.col("rb").alias("_row")))), "texts")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(x) + len(y) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    rows = (
        pairs.join(texts.select(F.col("_row").alias("ra"), F.col("text").alias("ta")), "ra")
        .join(texts.select(F.col("_row").alias("rb"), F.col("text").alias("tb")), "rb").select("a", "b", "ta", "tb")
    )
    return materialise(rows.mapInArrow(tidy(run), "u long, v long"), "links")


def _fits(a: str, b: str, per_cent: int) -> F.Column:
    return (F.col(a) * 100 >= F.col(b) * per_cent) & (F.col(b) * 100 >= F.col(a) * per_cent)


def _overlap(a: str, b: str, per_cent: int) -> F.Column:
    """Shingles that sets of sizes a and b must share."""
    return F.ceil((F.col(a) + F.col(b)) * per_cent / (100 + per_cent))


def _enough(n: F.Column, a: str, b: str, per_cent: int) -> F.Column:
    """Whether n common prefix shingles suffice for sets of sizes a and b."""
    return n > _overlap(a, b, per_cent) - F.ceil(F.greatest(a, b) * per_cent / 100)


def _level(size: str, per_cent: int) -> F.Column:
    """A bucket of sizes; sets that link stand in the same or in neighbouring ones. A little wider than the likeness, so that
    rounding cannot put them two apart."""
    return F.floor(F.log(F.col(size)) / math.log(100 / per_cent * (1 + 1e-9)))


def _salted(a: DataFrame, b: DataFrame, key: list[str], count: str) -> DataFrame:
    """Join of `a` and `b` on `key`, long lists dealt over several tasks: a row of `a` goes to one salt of its list, a row of `b`
    to all. Rows of equal keys hold the same `count`, the number of rows of `a` in the list."""
    salts = F.ceil(F.col(count) / LIST_ROWS).cast("int")
    one = a.withColumn("_salt", F.pmod(F.xxhash64("a"), salts).cast("int")).drop(count)
    each = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(count)
    return one.join(each, [*key, "_salt"]).drop("_salt")


def _chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """_row, text of the rows whose numbers stand in `rows`."""
    need = materialise(rows.distinct(), "rows")
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    return docs.select("_row", "text").join(need, "_row", "left_semi")


def group_pairs(named: DataFrame, docs: DataFrame, words: int, per_cent: int) -> DataFrame:
    """a, ra, b, rb: the pairs of classes of one group (`named`: cls, row, gk, size, root) and different roots that share
    one of the shingles which are rarest in their group. All pairs that link are among them."""
    several = named.groupBy("gk").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gk")
    inside = materialise(named.join(several, "gk", "left_semi").select("cls", "row", "gk", "size", "root"), "inside")

    def run(batches):
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row", "tokens"])

    texts = _chosen(docs, inside.select(F.col("row").alias("_row")))
    grams = inside.join(texts.mapInArrow(tidy(run), "row long, tokens array<long>"), "row").select("cls", "row", "gk", "size", "root", F.explode("tokens").alias("token"))
    grams = materialise(grams, "grams")
    counts = grams.groupBy("gk", "token").agg(F.count("*").alias("n"))
    rare = grams.join(counts, ["gk", "token"]).groupBy("cls", "row", "gk", "size", "root").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
    rare = rare.select("cls", "row", "gk", "root", F.explode(F.slice("own", F.lit(1), (F.col("size") - _overlap("size", "size", per_cent) + 1).cast("int"))).alias("t"))
    rare = materialise(rare.where("t.n > 1").select("cls", "row", "gk", "root", F.col("t.token").alias("token"), F.col("t.n").alias("n")), "rare")
    other = rare.select(F.col("cls").alias("b"), F.col("row").alias("rb"), "gk", F.col("root").alias("other"), "token", "n")
    both = _salted(rare.withColumnsRenamed({"cls": "a", "row": "ra"}), other, ["gk", "token"], "n")
    return both.where("root < other").select("a", "ra", "b", "rb").distinct()


def linked(docs: DataFrame, words: int = 5, per_cent: int = 80) -> tuple[DataFrame, DataFrame]:
    """_row, doc_id, cls, size of each row of `docs` (_row, doc_id, text), and cls, root, component_id of each class."""
    members = materialise(prefixes(docs, words, per_cent), "prefixes")
    solid = members.where("size > 0")
    classes = materialise(
        solid.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("_row").alias("row"), F.first("gk").alias("gk"), F.first("size").alias("size")), "classes"
    )
    groups = solid.select("gk", "prefix").groupBy("gk").agg(F.first("prefix").alias("prefix"))
    postings = groups.select(F.posexplode("prefix").alias("pos", "token"), "gk")
    shared = postings.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    lists = materialise(postings.join(shared, "token"), "lists")

    heads = classes.groupBy("gk").agg(F.min(F.struct("cls", "row")).alias("h"), F.first("size").alias("size")).select("gk", "size", F.col("h.cls").alias("a"), F.col("h.row").alias("ra"))
    ranked = lists.join(lists.groupBy("gk").agg((-F.count("*")).alias("fewer")), "gk").join(heads.select("gk", "size"), "gk")
    pivots = ranked.groupBy("token").agg(F.min(F.struct("fewer", "gk", "size")).alias("p")).select("token", F.col("p.gk").alias("pk"), F.col("p.size").alias("psize"))
    stars = ranked.join(pivots, "token").where((F.col("gk") != F.col("pk")) & _fits("size", "psize", per_cent)).groupBy("pk", "gk", "psize", "size").agg(F.count("*").alias("n")).where(_enough(F.col("n"), "psize", "size", per_cent)).select("pk", "gk")
    one = classes.select("gk", F.col("cls").alias("b"), F.col("row").alias("rb"))
    star_pairs = heads.select(F.col("gk").alias("pk"), "a", "ra").join(stars, "pk").join(one, "gk").select("a", "ra", "b", "rb")
    inner_pairs = heads.select("gk", "a", "ra").join(one, "gk").where("a <> b").select("a", "ra", "b", "rb")
    tried = materialise(star_pairs.union(inner_pairs), "pairs")
    links = verified(tried, docs, words, per_cent)
    roots = components(links)

    named = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "row", "gk", "size", F.coalesce("root", "cls").alias("root"))
    spread = lists.join(named, "gk")
    split = spread.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    opened = materialise(spread.join(split, "token"), "open")
    mixed = opened.join(opened.groupBy("cls").agg(F.count("*").alias("k")), "cls")  # no pair of two groups shares more than it has here
    side = lambda p, c: mixed.select("token", F.col("cls").alias(c), F.col("row").alias(f"r{c}"), *(F.col(n).alias(f"{p}_{n}") for n in ("root", "size", "k", "pos", "gk")))
    # x is the smaller set. It must share at least what two sets of its size must, so its list ends earlier.
    small = materialise(side("x", "a").where(F.col("x_size") - F.col("x_pos") >= _overlap("x_size", "x_size", per_cent)).withColumn("level", _level("x_size", per_cent)), "small")
    held = small.groupBy("token", "level").agg(F.count("*").alias("held"))
    level = _level("y_size", per_cent)
    large = side("y", "b").withColumn("level", F.explode(F.array(level, level - 1)))
    pairs = _salted(small.join(held, ["token", "level"]), large.join(held, ["token", "level"]), ["token", "level"], "held").where(
        ((F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("a") < F.col("b"))))
        & (F.col("x_root") != F.col("y_root")) & (F.col("x_gk") != F.col("y_gk")) & _fits("x_size", "y_size", per_cent) & _enough(F.least("x_k", "y_k"), "x_size", "y_size", per_cent)
        # The first shared shingle of a linked pair leaves room for all they share, on both sides.
        & (F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos")) >= _overlap("x_size", "y_size", per_cent))
    ).drop("token", "level", "x_pos", "y_pos", "x_root", "y_root", "x_k", "y_k").distinct()
    fronts = groups.join(opened.select("gk").distinct(), "gk", "left_semi")
    pairs = pairs.join(fronts.select(F.col("gk").alias("x_gk"), F.col("prefix").alias("xp")), "x_gk").join(fronts.select(F.col("gk").alias("y_gk"), F.col("prefix").alias("yp")), "y_gk")
    more = pairs.where(_enough(F.size(F.array_intersect("xp", "yp")), "x_size", "y_size", per_cent)).select("a", "ra", "b", "rb").union(group_pairs(named, docs, words, per_cent))
    done = tried.select("a", "b").union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = materialise(more.join(done, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        roots = components(links.union(verified(more, docs, words, per_cent)))

    named = classes.join(roots, classes["cls"] == roots["node"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return members, materialise(named.join(least, "root").select("cls", "root", "component_id"), "components")


def join_components(docs: DataFrame, words: int = 5, per_cent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs` (doc_id, text)."""
    members, named = linked(numbered(docs.select("doc_id", "text")), words, per_cent)
    return members.select("doc_id", "size", "cls").join(named.select("cls", "component_id"), "cls", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def representatives(docs: DataFrame, words: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of `docs` that are the first of their component, by doc_id (null last) and then their place in the files;
    rows without words stay."""
    placed = numbered(docs)
    members, named = linked(placed.select("doc_id", "text", "_row"), words, per_cent)
    solid = members.where("size > 0").join(named.select("cls", "root"), "cls")
    first = solid.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(MAX_LONG)).alias("id"), "_row")).alias("f")).select("f._row")
    gone = materialise(members.where("size > 0").select("_row").join(first, "_row", "left_anti"), "rows")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = placed.select(F.struct(*docs.columns).alias("doc"), "_row")
    return rows.join(gone, "_row", "left_anti").select("doc.*")
