"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Sizes are words. Sources, by code point with null last, weigh by a repeating pattern and share a multiple of all
   words; a target stops at twice its source's size and the excess is reshared by weight until none is above.
2. Seats are blocks of equal numbers of words. They go one by one to the source with the highest quotient target /
   (2 seats + 1), never beyond twice a source's words.
3. A source's documents are dealt to shards by a hash; its seats go to its shards the same way, by shard size, so every
   shard has an integer quota.
4. In a shard the documents stand in a seeded order and are cut into blocks; the shard takes all its blocks once if the
   quota allows, then the first of the rest. A document's share is the overlap of its words with the blocks taken.

So a source takes its target within half a block, no document is taken more than twice, and reruns agree. A null text
has size 0 and is not taken; a null source is a source of its own. Rows with equal ids and texts are interchangeable.
The driver holds one number for each source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from epitide.llm.common import numbered
from epitide.sources.scratch import materialise

WEIGHTS, TOTAL, LIMIT = (5, 2, 1), 1.5, 2
#: Largest block in words; with a small source, a hundredth of it.
BLOCK = 256
SHARD_DOCS, MOST_SHARDS = 1_000, 4_096
SEED = 17
#: Up to so many sources are broadcast, a few dozen bytes each.
MOST_BROADCAST = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, total: float = TOTAL, limit: int = LIMIT) -> dict[str | None, float]:
    """Words each source should give."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    cap = {s: float(limit * n) for s, n in order}
    out: dict[str | None, float] = {}
    left = total * sum(n for _, n in order)
    while True:
        free = [s for s in weight if s not in out]
        share = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / share > cap[s]]
        if not above:
            return out | {s: left * weight[s] / share for s in free}
        for s in above:
            out[s] = cap[s]
            left -= cap[s]


def sainte_lague(sizes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotient size / (2 seats + 1), ties to the first; never above caps."""
    seats = int(min(seats, caps.sum()))
    total = sizes.sum()
    if total <= 0 or seats <= 0:
        return np.zeros(len(sizes), np.int64)
    got = np.minimum(np.floor(sizes * (seats / total) + 0.5).astype(np.int64), caps)  # the rounding of a first divisor
    while (gap := seats - int(got.sum())) != 0:
        if gap > 0:
            quotient = np.where(got < caps, sizes / (2 * got + 1), -1.0)
            got[np.argmax(quotient)] += 1
        else:
            quotient = np.where(got > 0, sizes / np.maximum(2 * got - 1, 1), np.inf)
            got[len(got) - 1 - np.argmin(quotient[::-1])] -= 1
    return got


def mixed(docs: DataFrame) -> DataFrame:
    """_row (a stable number), doc_id, size, source_size, target, taken for each row of `docs` (doc_id, text, source)."""
    return _mixed(numbered(docs.select("doc_id", "text", "source")))


def _mixed(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = docs.select(
        "doc_id", key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        "_row", F.xxhash64("doc_id", F.lit(SEED)).alias("place"), F.xxhash64("text").alias("tie"),
    )
    sized = materialise(sized, "sizes")
    sources = [(r["key"], r["words"], r["docs"]) for r in sized.groupBy("key").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()]
    named = [(k[1:] if k[0] == "s" else None, n) for k, n, _ in sources]
    goal = targets(named) if sources else {}
    solid = [n for _, n, _ in sources if n]
    block = max(1, min(BLOCK, min(solid, default=1) // 100))
    words = np.array([n for _, n, _ in sources], np.int64)
    wanted = np.array([goal[s] for s, _ in named])
    seats = sainte_lague(wanted, round(wanted.sum() / block), -(-LIMIT * words // block)) if sources else []
    rows = [(k, int(n), float(t), int(q), min(MOST_SHARDS, -(-d // SHARD_DOCS))) for (k, n, d), t, q in zip(sources, wanted if sources else [], seats)]
    kinds = {"key": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "seats": pa.int64(), "shards": pa.int64()}
    # From Arrow, not from a list: Spark would start Python workers of a second kind for that and keep them beside the others.
    plan = docs.sparkSession.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())}))
    plan = F.broadcast(plan) if len(sources) <= MOST_BROADCAST else plan
    dealt = sized.join(plan, "key").withColumn("shard", F.pmod("place", "shards"))

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        size = rows["shard_size"].to_numpy()
        quota = sainte_lague(size.astype(float), int(rows["seats"].iloc[0]), -(-LIMIT * size // block))
        return pd.DataFrame({"key": rows["key"], "shard": rows["shard"], "shard_size": size, "quota": quota})

    shards = dealt.groupBy("key", "shard", "seats").agg(F.sum("size").alias("shard_size"))
    quotas = materialise(shards.groupBy("key").applyInPandas(deal, "key string, shard long, shard_size long, quota long"), "quotas")
    stream = Window.partitionBy("key", "shard").orderBy("place", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("start", F.sum("size").over(stream) - F.col("size")).join(quotas, ["key", "shard"])
    give = F.least(F.col("quota") * block, LIMIT * F.col("shard_size"))
    once = F.when(give >= F.col("shard_size"), 1).otherwise(0)
    rest = give - once * F.col("shard_size")
    taken = once * F.col("size") + F.greatest(F.lit(0), F.least(rest - F.col("start"), F.col("size")))
    return placed.select("_row", "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of `docs`, a row for each time a document is taken whole, and one with its first
    words if it is taken in part; n_chars follows the text. Documents that are not taken are absent."""

    @F.pandas_udf("string")
    def head(text: pd.Series, n: pd.Series) -> pd.Series:
        import re

        words = re.compile(r"[^\x20\x09-\x0D]+")
        out = []
        for t, k in zip(text, n):
            end = 0
            for i, m in enumerate(words.finditer(t)):
                if i == k:
                    break
                end = m.end()
            out.append(t[:end])
        return pd.Series(out)

    placed = numbered(docs)
    taken = materialise(_mixed(placed).where("taken > 0").select("_row", "size", "taken"), "taken")
    rows = placed.select(F.struct(*docs.columns).alias("doc"), "_row").join(taken, "_row")
    whole = rows.where("taken >= size").select("doc", F.explode(F.sequence(F.lit(1), F.expr("cast(taken div size as int)"))))
    part = rows.where("taken % size > 0").select(F.col("doc").withField("text", head("doc.text", F.expr("taken % size"))).alias("doc"))
    out = whole.select("doc").union(part)
    if "n_chars" in docs.columns:
        out = out.select(F.col("doc").withField("n_chars", F.char_length("doc.text").cast("long")).alias("doc"))
    return out.select("doc.*")


def report(docs: DataFrame) -> DataFrame:
    return mixed(docs).drop("_row")
