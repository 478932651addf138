"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

The terms of a text are its 5-word shingles, weighted by how often they occur; a shorter text is one term. For each of
64 samples a term of weight s gets a value a(s), and the sample of a text is the smallest value of its terms. With
r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1), all fixed by term and sample, consistent weighted sampling has
t = floor(ln s / r + b) and a(s) = c exp(-r (t - b + 1)); two texts then agree on a sample with a probability equal to
their generalised Jaccard similarity.

The same draw, rearranged so that weight 1 costs one hash: r b and r (1 - b) are independent Exp(1) values e1 and e2,
and a(1) = c exp(-e2) is Exp(1). So a(1) = -ln(1 - u) comes first, e2 = ln(1 + E / a(1)) with E ~ Exp(1) follows its
distribution given a(1), r = e1 + e2 is the gamma sample, and a(s) = a(1) exp(-r t) with t = floor((ln s + e1) / r).
Values are compared as 1 - exp(-a) on a 63-bit scale, on which a(1) is u itself; of the smallest value the lowest 16
bits are kept, so that samples of different terms agree by chance once in 65,536.

Rows that agree in doc_id and text are one document: they get the same results, and the next document is the next
different one. A null text is empty; all texts without words agree with each other and with nothing else. Null ids come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from epitide.sources.scratch import materialise

SAMPLES, BLOCK = 64, 8
WORDS = 5
#: Stands for a null id.
NO_ID = -(1 << 63)
#: Bytes of text in one partition, so that the terms of a partition fit in memory.
PARTITION_BYTES = 5 << 20


def successors(docs: DataFrame) -> DataFrame:
    """id, h, n, copies, next_id, next_h for each different (id, h): the next in descending order of id; after the last,
    the first. Ranges of ids are sorted apart; only the first row of each range meets those of the others.
    """
    rows = docs.groupBy("id", "h").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    order = [F.col("id").desc(), F.col("h")]
    rows = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    inner = Window.partitionBy("part").orderBy(*order)
    rows = rows.withColumn("follow", F.lead(F.struct("id", "h")).over(inner))
    heads = rows.groupBy("part").agg(F.max_by(F.struct("id", "h"), F.struct("id", -F.col("h").cast("decimal(20,0)"))).alias("head"))
    ranges = Window.orderBy("part")  # one row for each range
    heads = heads.withColumn("after", F.coalesce(F.lead("head").over(ranges), F.first("head").over(ranges.rowsBetween(Window.unboundedPreceding, 0)))).select("part", "after")
    return rows.join(heads, "part").withColumn("follow", F.coalesce("follow", "after")).select(
        "id", "h", "n", "copies", F.col("follow.id").alias("next_id"), F.col("follow.h").alias("next_h")
    )


def edited_texts(docs: DataFrame, follow: DataFrame, partitions: int) -> DataFrame:
    """The columns of `follow`, text, and edited: the last third of the code points replaced by as many first ones of
    the next document. Texts are shuffled once."""
    placed = docs.select("id", "h", "text").repartition(partitions, "id", "h").dropDuplicates(["id", "h"])
    wanted = follow.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.struct("*").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    heads = placed.join(wanted, ["id", "h"]).select("to.*", "k", F.expr("left(text, k)").alias("head"))
    both = placed.join(heads, ["id", "h"])
    return both.select(*follow.columns, "text", F.concat(F.expr("left(text, char_length(text) - k)"), F.col("head")).alias("edited"))


def _terms(text: str) -> Column:
    return F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")


def _value(weight: Column, log_weight: Column, sample: Column) -> Column:
    """The value of a term on the 63-bit scale; null for weight 0."""
    draw = F.xxhash64("term", sample)
    unit = F.shiftrightunsigned(draw, 1)
    other = F.xxhash64(draw, F.lit(1))
    u = (F.shiftrightunsigned(draw, 11).cast("double") + 0.5) * 2.0**-53
    first = -F.log1p(-u)
    gap = -F.ln((F.shiftrightunsigned(other, 32).cast("double") + 0.5) * 2.0**-32)
    e1 = -F.ln((other.bitwiseAND(0xFFFFFFFF).cast("double") + 0.5) * 2.0**-32)
    r = e1 + F.log1p(gap / first)
    heavy = (-F.expm1(-first * F.exp(-r * F.floor((log_weight + e1) / r))) * 2.0**63).cast("long")
    return F.when(weight == 1, unit).when(weight > 1, heavy)


def signatures(texts: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, and the samples of columns `a` and `b` as arrays of SAMPLES smallints. Rows are already dealt by some keys."""
    sides = F.array(*(F.struct(_terms(c).alias("w"), F.lit(i).alias("side")) for i, c in enumerate((a, b))))
    rows = texts.select(*keys, F.explode(sides).alias("x")).select(*keys, "x.side", "x.w")
    rows = rows.select(*keys, "side", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WORDS, F.lit(0)))).alias("i"))
    term = F.xxhash64(*(F.get("w", F.col("i") + j) for j in range(WORDS)))
    rows = rows.select(*keys, "side", term.alias("term")).groupBy(*keys, "term").agg(F.sum(1 - F.col("side")).alias("wa"), F.sum("side").alias("wb"))
    rows = rows.select(*keys, "term", "wa", "wb", F.when(F.col("wa") > 1, F.ln("wa")).alias("la"), F.when(F.col("wb") > 1, F.ln("wb")).alias("lb"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // BLOCK - 1))).alias("block"))
    samples = [F.col("block") * BLOCK + k for k in range(BLOCK)]
    found = rows.groupBy(*keys, "block").agg(
        *(F.min(_value(F.col(f"w{s}"), F.col(f"l{s}"), samples[k])).alias(f"{s}{k}") for s in "ab" for k in range(BLOCK))
    )
    low = lambda c: (F.col(c).bitwiseAND(0xFFFF) - 0x8000).cast("smallint")
    blocks = found.select(*keys, F.struct("block", *(F.array(*(low(f"{s}{k}") for k in range(BLOCK))).alias(s) for s in "ab")).alias("block"))
    blocks = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list("block")).alias("blocks"))  # SAMPLES / BLOCK rows a key
    return blocks.select(*keys, F.flatten("blocks.a").alias("a"), F.flatten("blocks.b").alias("b"))


def likeness(x: Column, y: Column) -> Column:
    """Share of samples on which two fingerprints agree."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / F.lit(float(SAMPLES))


def as_text(x: Column) -> Column:
    """Samples as hexadecimal, 4 digits each."""
    return F.array_join(F.transform(x, lambda v: F.lpad(F.lower(F.hex(v.cast("int") + 0x8000)), 4, "0")), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of `docs`."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), F.char_length(text).cast("long").alias("n"),
    )
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    follow = materialise(successors(docs.drop("text")), "order")
    texts = edited_texts(docs, follow, partitions)
    samples = signatures(texts, ["id", "h"], "text", "edited")  # few key columns: one row for each term passes here
    found = materialise(samples.join(texts.select(*follow.columns, F.sha2("edited", 256).alias("edited_sha256")), ["id", "h"]), "fingerprints")
    after = found.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("a").alias("c"))
    full = found.join(after, ["next_id", "next_h"])
    return full.select(
        F.when(F.col("id") > NO_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
