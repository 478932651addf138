"""Nearest neighbours by learned partitions.

A bounded sample gets a graph of nearest neighbours. The graph is cut into balanced parts: halved again and again at
the median of the widest direction, then refined by moving nodes to the part that holds most of their neighbours while
no part exceeds its capacity. A small network learns to foretell from a vector the parts of its neighbours. Every row
of the table is then indexed under its most probable part; a query visits the parts that together hold most of its
probability, and all rows there are ranked by the exact measure.

Parts are joined with their queries in blocks of bounded size on both sides, so a part that holds a third of all rows
is many tasks. Nearness is the inner product in double precision, ties go to the smaller vec_id.

Vectors that are null, zero, hold null or non-finite components, or differ in length from the most common length (of
equally common ones the larger) take no part, and null ids neither. Of rows with equal vec_id the smallest vector counts.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from epitide.llm.common import tidy
from epitide.llm.learning import Adam
from epitide.sources.scratch import materialise

#: Vectors that the graph and the network are fitted on.
SAMPLE = 8_000
#: Rows a part should hold, and the fewest sampled vectors that make a part.
PART_ROWS, PART_SAMPLE = 4_000, 40
NEIGHBOURS, SLACK, SWEEPS = 10, 1.15, 8
HIDDEN, ROUNDS, BATCH = 128, 30, 256
#: A query visits the most probable parts until they hold this probability, at least MIN_PARTS of them.
MASS, MIN_PARTS = 0.96, 3
BLOCK_ROWS = 8_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (array<double>) of the vectors that take part, and their length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = top["dim"] if top else 0
    return rows.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")), dim


def neighbour_graph(x: np.ndarray) -> np.ndarray:
    k = min(NEIGHBOURS, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1000):
        s = x[lo : lo + 1000] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1000] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """The part of each node; no part holds more than SLACK times its share."""
    part, sets = np.zeros(len(x), np.int64), [(np.arange(len(x)), parts)]
    done = 0
    while sets:
        nodes, want = sets.pop()
        if want == 1:
            part[nodes], done = done, done + 1
            continue
        centred = x[nodes] - x[nodes].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = nodes[np.argsort(centred @ axis, kind="stable")]
        cut = len(order) * (want // 2) // want
        sets += [(order[:cut], want // 2), (order[cut:], want - want // 2)]
    size, most = np.bincount(part, minlength=parts), int(np.ceil(SLACK * len(x) / parts))
    both = [[] for _ in range(len(x))]
    for i, near in enumerate(graph.tolist()):
        for j in near:
            both[i].append(j)
            both[j].append(i)
    for _ in range(SWEEPS):
        moved = 0
        for i in range(len(x)):
            found = np.bincount(part[both[i]], minlength=parts)
            found[size >= most] = -1
            best = int(found.argmax())
            own = part[i]
            if best != own and found[best] > (part[both[i]] == own).sum():
                part[i] = best
                size[own] -= 1
                size[best] += 1
                moved += 1
        if moved < len(x) // 200:
            break
    return part


def _forward(x: np.ndarray, net: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ net["a"] + net["b"], 0)
    z = hidden @ net["c"] + net["d"]
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    return hidden, p / p.sum(1, keepdims=True)


def fit_network(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int) -> dict[str, np.ndarray]:
    """Weights of one hidden layer; the target of a vector is the share of parts among itself and its neighbours."""
    rng, n = np.random.default_rng(3), len(x)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
    target[np.arange(n), part] += 1
    target /= target.sum(1, keepdims=True)
    scale = np.sqrt((x * x).sum(1).mean() / x.shape[1]) or 1.0
    net = {
        "a": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)) / scale, "b": np.zeros(HIDDEN),
        "c": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), "d": np.zeros(parts),
    }
    adam = Adam(*net.values(), rate=0.003)
    for _ in range(ROUNDS):
        mixed = rng.permutation(n)
        for lo in range(0, n, BATCH):
            rows = mixed[lo : lo + BATCH]
            hidden, p = _forward(x[rows], net)
            g = (p - target[rows]) / len(rows)
            back = (g @ net["c"].T) * (hidden > 0)
            adam.step(x[rows].T @ back, back.sum(0), hidden.T @ g, g.sum(0))
    return net


def fit(rows: DataFrame, dim: int, count: int) -> dict[str, np.ndarray]:
    """The network, fitted in one task on at most SAMPLE rows."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    parts = max(1, min(count // PART_ROWS, min(count, SAMPLE) // PART_SAMPLE))

    def run(batches):
        whole = pa.Table.from_batches(list(batches)).sort_by("vec_id")
        x = _matrix(whole["v"], dim)
        graph = neighbour_graph(x)
        net = fit_network(x, graph, balanced_parts(x, graph, parts), parts)
        out = io.BytesIO()
        np.savez(out, **net)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["net"])

    if parts == 1:
        return {}
    got = sample.repartition(1).mapInArrow(tidy(run), "net binary").first()  # one row of fixed size
    return dict(np.load(io.BytesIO(got["net"])))


def routed(rows: DataFrame, dim: int, net: dict[str, np.ndarray], several: bool) -> DataFrame:
    """vec_id, v and the part of each row; with `several`, a row for each part a query visits."""
    if not net:
        return rows.select("vec_id", "v", F.lit(0).alias("part"))
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = _forward(_matrix(batch.column(1), dim), shared.value)[1]
            if several:
                order = np.argsort(-p, axis=1, kind="stable")
                before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
                use = before < MASS
                use[:, : min(MIN_PARTS, p.shape[1])] = True
                at, which = np.nonzero(use)
                part = order[at, which]
            else:
                at, part = np.arange(len(p)), p.argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(part.astype(np.int32))], names=["vec_id", "v", "part"])

    return rows.select("vec_id", "v").mapInArrow(tidy(run), "vec_id long, v array<double>, part int")


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """Query id, row id and inner product of each query's k nearest rows other than itself, ties to smaller ids."""
    out: tuple[list, list, list] = ([], [], [])
    for q, qid in zip(queries, query_ids.tolist()):
        s = rows @ q
        s[ids == qid] = -np.inf
        at = np.flatnonzero(s > -np.inf)
        if len(at) > k:
            at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((ids[at], -s[at]))[:k]]
        out[0].extend([qid] * len(at)), out[1].extend(ids[at].tolist()), out[2].extend(s[at].tolist())
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found."""
    rows, dim = usable(vectors)
    rows = materialise(rows, "vectors")
    net = fit(rows, dim, rows.count())
    index = materialise(routed(rows, dim, net, False), "index")
    asked = materialise(routed(rows.where(is_query), dim, net, True), "asked")
    blocks = index.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    turns = asked.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("turns"))
    grid = F.broadcast(materialise(blocks.join(turns, "part"), "grid"))  # one row for each part: at most SAMPLE / PART_SAMPLE
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(grid, "part").select("vec_id", "v", "part", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), every("turns").alias("turn"))
    right = asked.join(grid, "part").select("vec_id", "v", "part", every("blocks").alias("block"), F.pmod(F.xxhash64("vec_id"), "turns").cast("int").alias("turn"))

    def rank(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            found: tuple[list, list, list] = ([], [], [])
        else:
            found = best(_matrix(queries["v"], dim), queries["vec_id"].to_numpy(), _matrix(rows["v"], dim), rows["vec_id"].to_numpy(), k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    key = ["part", "block", "turn"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
