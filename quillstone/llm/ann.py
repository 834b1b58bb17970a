"""Nearest neighbours by largest inner product: stable projections in kd-trees, with a chi-square stopping test.

A vector x gets one more component, sqrt(M^2 - |x|^2) for the largest norm M (a query gets 0): the largest inner product is then
the least Euclidean distance. Gaussian projections to a few dimensions are 2-stable: a squared projected distance is the true one
times a chi-square variable. So projected neighbours are taken incrementally, nearest first, and verified by their true
distance, until the k-th distance d found and the projected distance r of what comes next satisfy ``P(chi2 <= r^2 / d^2) >= sure``:
a nearer vector would have been seen with that probability.

The projected space is cut into shards by a kd-tree fitted on ``SAMPLE`` vectors at most; every vector is indexed in the shard
that it falls in, and a shard of many is cut further by a hash (beyond ``SAMPLE / 16`` shards, of 16 sampled vectors each, that is all). A query searches its own shard; with the distance found there,
the test picks the other shards it must visit, from their boxes. Each shard builds the kd-tree of its vectors in its task.

Of equal vectors only those of the least ids can be among the nearest, so ``k + 1`` of each are kept, counted in salted parts;
equal queries are searched once. What is broadcast is the shard tree: 100 bytes for ``SHARD_ROWS`` vectors.

Defined results: vectors that are null or zero, or hold null or non-finite components, take no part; components that a vector is
shorter by than the longest are zeros; of several rows of one id all take part, none is a neighbour of its own id (so fewer than k
may be left of k + 1 found); ties go to the smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .components import cut

PROJECTIONS, SURE = 8, 0.8
#: A bound of what a product of vectors of length one is off by rounding.
ROUNDING = 1e-12
#: Leaves of a tree are verified some at a time, GROWTH times as many each time, for so many queries together.
SAMPLE, SHARD_ROWS, LEAF_ROWS, STEP_LEAVES, GROWTH, QUERIES = 16_384, 8_192, 64, 8, 4, 256


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


class Projection:
    def __init__(self, length: int, norm: float, seed: int = 7):
        self.norm = norm
        self.matrix = np.random.default_rng(seed).standard_normal((length + 1, PROJECTIONS))

    def vectors(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]

    def distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """True distances of extended vectors, from inner products."""
        return np.sqrt(np.maximum(self.norm**2 + (q * q).sum(1) - 2 * score, 1e-12))


def median_tree(points: np.ndarray, leaves: int) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]], list[tuple[int, float]]]:
    """Splits at medians of the widest dimension: rows of each leaf, its box in the whole space, and the splits from the
    root on (node i has children 2i and 2i + 1)."""
    depth = max(0, math.ceil(math.log2(max(1, leaves))))
    width = points.shape[1]
    rows = {1: np.arange(len(points))}
    boxes = {1: (np.full(width, -np.inf), np.full(width, np.inf))}
    splits = [(0, 0.0)] * (1 << depth)
    for node in range(1, 1 << depth):
        own, (low, high) = rows.pop(node), boxes.pop(node)
        x = points[own]
        d = int(np.argmax(x.max(0) - x.min(0))) if len(x) else 0
        at = float(np.median(x[:, d])) if len(x) else 0.0
        left = x[:, d] < at
        splits[node] = (d, at)
        rows[2 * node], rows[2 * node + 1] = own[left], own[~left]
        upper, lower = high.copy(), low.copy()
        upper[d] = lower[d] = at
        boxes[2 * node], boxes[2 * node + 1] = (low, upper), (lower, high)
    leaf = range(1 << depth, 2 << depth)
    return [rows[i] for i in leaf], [boxes[i] for i in leaf], splits


def leaf_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    node = np.ones(len(points), np.int64)
    dims, cuts = np.array([d for d, _ in splits]), np.array([c for _, c in splits])
    line = np.arange(len(points))
    for _ in range(int(math.log2(len(splits)))):
        node = 2 * node + (points[line, dims[node]] >= cuts[node])
    return node - len(splits)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Projected distances of queries from boxes: (queries, boxes)."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        x = q[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0)
        out += gap * gap
    return np.sqrt(out)


class Index:
    """The kd-tree of a shard's vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projection: Projection):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.projection = ids[order], x[order], projection
        points = projection.vectors(self.x)
        self.leaves, _, _ = median_tree(points, -(-len(points) // LEAF_ROWS))
        self.leaves = [a for a in self.leaves if len(a)]
        self.low = np.array([points[a].min(0) for a in self.leaves]).reshape(-1, PROJECTIONS)
        self.high = np.array([points[a].max(0) for a in self.leaves]).reshape(-1, PROJECTIONS)

    def search(self, q: np.ndarray, k: int, known: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k nearest found of each query; known: a k-th score that others have found already."""
        known = np.full(len(q), -np.inf) if known is None else known
        return [x for a in range(0, len(q), QUERIES) for x in self._search(q[a : a + QUERIES], k, known[a : a + QUERIES])]

    def _search(self, q: np.ndarray, k: int, known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        gaps = box_distance(self.projection.queries(q), self.low, self.high)
        rank = np.argsort(np.argsort(gaps, axis=1, kind="stable"), axis=1)  # when a query comes to a leaf
        scores, kth = np.full((len(q), len(self.ids)), -np.inf), known.copy()
        at, step, active = 0, STEP_LEAVES, np.ones(len(q), bool)
        while at < len(self.leaves) and active.any():
            due = (rank >= at) & (rank < at + step) & active[:, None]
            for j in np.flatnonzero(due.any(0)).tolist():
                own, rows = np.flatnonzero(due[:, j]), self.leaves[j]
                scores[own[:, None], rows] = q[own] @ self.x[rows].T
            at, step = at + step, GROWTH * step
            if len(self.ids) >= k:
                own = np.flatnonzero(active)
                kth[own] = np.maximum(kth[own], np.partition(scores[own], -k, axis=1)[:, -k])
            if at < len(self.leaves):
                next_gap = np.where(rank == at, gaps, 0).sum(1)
                distance = np.where(np.isneginf(kth), np.inf, self.projection.distance(q, np.maximum(kth, -1e300)))
                active &= chi_square((next_gap / distance) ** 2, PROJECTIONS) < SURE
        out, length = [], np.sqrt((q * q).sum(1)) * self.projection.norm
        for row, own, least, most in zip(q, scores, kth, length, strict=True):
            # products of blocks differ in their last bits with the block: what may be among the first is scored again, row by row
            near = np.flatnonzero((own >= least - ROUNDING * most) & (own > -np.inf))
            exact = (self.x[near] * row).sum(1)
            best = np.lexsort((self.ids[near], -exact))[:k]
            out.append((self.ids[near[best]], exact[best]))
        return out


def matrix(column, length: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part, as (vec_id, v), v of doubles."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every``, the k rows of other ids found of
    largest inner product (the measure in double precision, on the vectors as given)."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    size = rows.agg(F.max(F.size("v")).alias("length"), F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm")).first()
    length, count = size["length"] or 1, size["n"]
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("v")))).withColumn("digest", F.xxhash64("v"))
    salted = Window.partitionBy("digest", "v", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    equal = Window.partitionBy("digest", "v").orderBy("vec_id")
    few = rows.withColumn("rn", F.row_number().over(salted)).where(F.col("rn") <= k + 1)
    few = few.withColumn("rn", F.row_number().over(equal)).where(F.col("rn") <= k + 1).select("vec_id", "v")
    projection = Projection(length, size["norm"] or 1.0)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    _, boxes, splits = median_tree(projection.vectors(matrix(sample["v"], length)), max(1, min(SAMPLE // 16, -(-count // SHARD_ROWS))))
    tree = spark.sparkContext.broadcast((projection, splits, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])))

    def place(batches):
        projection, splits, _, _ = tree.value
        for b in batches:
            shard = leaf_of(projection.vectors(matrix(b["v"], length)), splits)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b["vec_id"], b["v"]], ["shard", "vec_id", "v"])

    placed = cut(few.mapInArrow(place, "shard int, vec_id long, v array<double>"))
    counts = {r["shard"]: -(-r["count"] // (2 * SHARD_ROWS)) for r in placed.groupBy("shard").count().collect()}  # one row a shard
    lots = spark.sparkContext.broadcast(counts)
    queries = cut(rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("digest", "v").agg(F.min("vec_id").alias("query")))

    def spread(batches):
        for b in batches:
            mixed = B.mix(b["vec_id"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 11).tolist()
            lot = np.array([i % lots.value.get(s, 1) for i, s in zip(mixed, b["shard"].to_pylist(), strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([b["shard"], pa.array(lot), b["vec_id"], b["v"]], ["shard", "lot", "vec_id", "v"])

    def routed(home: bool):
        def run(batches):
            projection, splits, low, high = tree.value
            for b in batches:
                q = matrix(b["v"], length)
                points = projection.queries(q)
                if home:
                    go = np.zeros((len(q), len(low)), bool)
                    gaps = box_distance(points, low, high)
                    gaps[:, [s for s in range(len(low)) if s not in lots.value]] = np.inf
                    go[np.arange(len(q)), gaps.argmin(1)] = True
                else:
                    known = b["kth"].to_numpy(zero_copy_only=False)
                    d = projection.distance(q, np.where(np.isnan(known), -np.inf, known))
                    test = chi_square((box_distance(points, low, high) / d[:, None]) ** 2, PROJECTIONS)
                    go = test < SURE
                    go[np.arange(len(q)), b["home"].to_numpy()] = False
                i, s = np.nonzero(go)
                n = np.array([lots.value.get(int(x), 0) for x in s], np.int64)
                i, s, lot = np.repeat(i, n), np.repeat(s, n), np.concatenate([np.arange(x) for x in n]) if len(n) else n
                taken = b.take(pa.array(i, pa.int64()))
                kth = taken["kth"] if not home else pa.nulls(len(i), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(lot, pa.int32()), taken["query"], taken["v"], kth], ["shard", "lot", "query", "v", "kth"])

        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query", "home", "vec_id", "score")}
        if left.num_rows and right.num_rows:
            index = Index(left["vec_id"].to_numpy(), matrix(left["v"], length), tree.value[0])
            known = right["kth"].to_numpy()
            known = np.where(np.isnan(known), -np.inf, known)
            for query, (ids, scores) in zip(right["query"].to_pylist(), index.search(matrix(right["v"], length), k + 1, known), strict=True):
                out["query"] += [query] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
            out["home"] = [left["shard"][0].as_py()] * len(out["query"])
        return pa.table({"query": pa.array(out["query"], pa.int64()), "home": pa.array(out["home"], pa.int32()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    route = "shard int, lot int, query long, v array<double>, kth double"
    store = placed.mapInArrow(spread, "shard int, lot int, vec_id long, v array<double>").groupBy("shard", "lot")
    asked = lambda df, home: store.cogroup(df.mapInArrow(routed(home), route).groupBy("shard", "lot")).applyInArrow(search, "query long, home int, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = cut(top(asked(queries.select("query", "v"), True)))
    kth = first.groupBy("query").agg(F.min("home").alias("home"), F.when(F.count("*") > k, F.min("score")).alias("kth"))
    second = asked(queries.join(kth, "query").select("query", "v", "home", "kth"), False)
    lists = top(first.drop("rn").unionByName(second)).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("found"))
    found = cut(queries.select("query", "digest", "v").join(lists, "query").select("digest", "v", "found"))
    own = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "digest", "v")
    out = own.join(found, ["digest", "v"]).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return out.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")
