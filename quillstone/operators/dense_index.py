"""An inverted-file index of vectors inside each key, written once and probed often.

A key's vectors lie in lists about centres, which are fitted on a bounded sample of the key by rounds of means; every vector is put in the list of its
nearest centre. A list knows its radius r, the largest distance of its vectors from the centre c, so no inner product of a query q in it
is above ``q.c + |q| r``.

A search with ``probes`` looks into as many lists, those of largest ``q.c``: approximate. Without, it looks into one list, and
then into every list whose bound reaches the k-th best found: exact, by as few lists as the bounds allow.

Keys of any size are dealt out: vectors to blocks of bounded bytes for being put in lists, large lists to blocks again, queries to blocks
for choosing lists. What a task gets beside its block is the key's centres, ``MOST_LISTS`` at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.scratch import scratch
from .postings import top

#: Vectors of a key that centres are fitted on, about; lists of a key at most; bytes of vectors in one block.
SAMPLE, MOST_LISTS, BLOCK_BYTES = 16_384, 4_096, 16 << 20
BUCKET_BYTES = 64 << 20


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centres(x: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Means of nearest vectors, from vectors spread evenly over the sample; a centre that loses all stays."""
    out = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, out)[0]
        n = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


def nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its distance."""
    own, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for a in range(0, len(x), step):
        part = x[a : a + step]
        own[a : a + step] = ((c * c).sum(1)[None] - 2 * part @ c.T).argmin(1)
        far[a : a + step] = np.sqrt(((part - c[own[a : a + step]]) ** 2).sum(1))
    return own, far


class DenseIndex:
    """``folder`` holds ``lists`` (key, list, centre, radius, n, blocks) and ``vectors`` (bucket, key, list, block, id, v)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.lists = spark.read.parquet(f"{self.folder}/lists")
        self.vectors = spark.read.parquet(f"{self.folder}/vectors")
        self.buckets = spark.read.parquet(f"{self.folder}/about").first()["buckets"]

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, key: str, id_col: str, vector_col: str, list_rows: int = 1024) -> DenseIndex:
        """Writes the index. Vectors have one length; those of a null key or null vector take no part."""
        spark, folder = vectors.sparkSession, folder.rstrip("/")
        rows = vectors.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("key IS NOT NULL AND v IS NOT NULL")
        width = rows.agg(F.max(F.size("v"))).first()[0] or 1
        block_rows = max(256, BLOCK_BYTES // (8 * width))
        lists = F.least(F.ceil(F.col("n") / F.lit(list_rows)), F.lit(MOST_LISTS)).cast("int")
        counts = _kept(rows.groupBy("key").agg(F.count("*").alias("n")).select("key", "n", lists.alias("lists"), F.ceil(F.col("n") / F.lit(block_rows)).cast("int").alias("blocks")), "counts")
        kinds = {c: to_arrow_type(rows.schema[c].dataType) for c in ("key", "id")}
        sampled = rows.join(counts, "key").where(F.pmod(F.xxhash64("id", "v"), F.col("n")) < SAMPLE)

        def fit(table: pa.Table) -> pa.Table:
            x = matrix(table.sort_by("id")["v"])
            c = centres(x, table["lists"][0].as_py())
            return pa.table({"key": pa.array([table["key"][0].as_py()] * len(c), kinds["key"]), "list": pa.array(range(len(c)), pa.int32()), "centre": pa.array(list(c), pa.list_(pa.float64()))})

        of_key = T.StructType([rows.schema["key"], *T._parse_datatype_string("list int, centre array<double>")])
        fitted = _kept(sampled.select("key", "id", "v", "lists").groupBy("key").applyInArrow(fit, of_key), "centres")
        dealt = rows.join(counts.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
        sent = fitted.join(counts.select("key", "blocks"), "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def put(own: pa.Table, of: pa.Table) -> pa.Table:
            list_, far = np.zeros(0, np.int64), np.zeros(0)
            if own.num_rows:
                of = of.sort_by("list")
                list_, far = nearest(matrix(own["v"]), matrix(of["centre"]))
                list_ = of["list"].to_numpy()[list_]
            return pa.table({"key": own["key"], "list": pa.array(list_, pa.int32()), "id": own["id"], "v": own["v"], "far": pa.array(far)})

        schema = T.StructType([rows.schema["key"], T.StructField("list", T.IntegerType()), rows.schema["id"], *T._parse_datatype_string("v array<double>, far double")])
        by = lambda df, *columns: df.select("key", "block", *columns).groupBy("key", "block")
        placed = _kept(by(dealt, "id", "v").cogroup(by(sent, "list", "centre")).applyInArrow(put, schema), "placed")
        sizes = placed.groupBy("key", "list").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        known = fitted.join(sizes, ["key", "list"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(block_rows)).cast("int"))
        known.write.parquet(f"{folder}/lists")
        buckets = int(max(16, -(-(counts.agg(F.sum("n")).first()[0] or 0) * 8 * width // BUCKET_BYTES)))
        known = spark.read.parquet(f"{folder}/lists").select("key", "list", "blocks")
        out = placed.join(known, ["key", "list"]).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")).withColumn("bucket", F.pmod(F.xxhash64("key", "list"), F.lit(buckets)).cast("int"))
        out = out.select("bucket", "key", "list", "block", "id", "v").repartition("bucket", "block").sortWithinPartitions("bucket", "key", "list", "block")
        out.write.partitionBy("bucket").parquet(f"{folder}/vectors")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    def search(self, queries: DataFrame, k: int, key: str, query: str, query_vector: str, probes: int | None = None, chunk: str = "id") -> DataFrame:
        """``(query, chunk, score, rank)``: of each query's key the k vectors of largest inner product but its own id, scores rounded to
        nine digits, ties to the smaller id, ranks from 0."""
        asked = queries.select(F.col(key).alias("key"), F.col(query).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("key IS NOT NULL AND v IS NOT NULL")
        order = [F.desc("score"), F.col("id")]
        found = self._scores(self._chosen(asked, probes or 1), k)
        if probes is None:
            found = _kept(found, "found")
            kth = top(found, ["q"], order, k, "id").where(F.col("__rn") == k).select("q", F.col("score").alias("kth"))
            more = self._scores(self._chosen(asked.join(kth, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))), None), k)
            found = found.unionByName(more)
        return top(found, ["q"], order, k, "id").select(F.col("q").alias(query), F.col("id").alias(chunk), "score", (F.col("__rn") - 1).alias("rank"))

    def _chosen(self, asked: DataFrame, first: int | None) -> DataFrame:
        """``(key, list, blocks, q, v)``: lists that queries look into - the ``first`` nearest, or without a number all others whose bound
        reaches ``kth``."""
        sizes = asked.groupBy("key").agg(F.ceil(F.count("*") / F.lit(2048)).cast("int").alias("lots"))
        left = asked.join(sizes, "key").withColumn("lot", F.pmod(F.xxhash64("q"), F.col("lots")).cast("int"))
        right = self.lists.join(sizes, "key").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))

        def choose(own: pa.Table, of: pa.Table) -> pa.Table:
            row = at = np.zeros(0, np.int64)
            if own.num_rows and of.num_rows:
                of = of.sort_by("list")
                q, c = matrix(own["v"]), matrix(of["centre"])
                near = q @ c.T
                rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                if first is not None:
                    row, at = np.nonzero(rank < first)
                else:
                    bound = near + np.sqrt((q * q).sum(1))[:, None] * of["radius"].to_numpy()[None]
                    row, at = np.nonzero((rank > 0) & (bound + 1e-8 * (1 + abs(bound)) >= own["kth"].to_numpy()[:, None]))
            own, of = own.select(["q", "v"]).take(pa.array(row)), of.select(["key", "list", "blocks"]).take(pa.array(at))
            return pa.table({"key": of["key"], "list": of["list"], "blocks": of["blocks"], "q": own["q"], "v": own["v"]})

        schema = T.StructType([self.lists.schema["key"], *T._parse_datatype_string("list int, blocks int"), asked.schema["q"], asked.schema["v"]])
        extra = ["kth"] if first is None else []
        grouped = left.select("key", "lot", "q", "v", *extra).groupBy("key", "lot").cogroup(right.select("key", "lot", "list", "centre", "radius", "blocks").groupBy("key", "lot"))
        return _kept(grouped.applyInArrow(choose, schema), "chosen")

    def _scores(self, chosen: DataFrame, k: int) -> DataFrame:
        """``(q, id, score)``: the best of each block; only buckets of chosen lists are read."""
        bucket = F.pmod(F.xxhash64("key", "list"), F.lit(self.buckets)).cast("int")
        asked = [r[0] for r in chosen.select(bucket).distinct().collect()]  # as many as the index has buckets, at most
        index = self.vectors if len(asked) == self.buckets else self.vectors.where(F.col("bucket").isin(asked))
        lists = chosen.select("key", "list").distinct()
        left = index.join(lists, ["key", "list"], "left_semi").select("key", "list", "block", "id", "v").groupBy("key", "list", "block")
        right = chosen.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "list", "block", "q", "v").groupBy("key", "list", "block")
        kinds = {"q": to_arrow_type(chosen.schema["q"].dataType), "id": to_arrow_type(self.vectors.schema["id"].dataType)}

        def score(own: pa.Table, of: pa.Table) -> pa.Table:
            out: dict[str, list] = {"q": [], "id": [], "score": []}
            if own.num_rows and of.num_rows:
                own = own.sort_by("id")
                ids, x = own["id"].to_pylist(), matrix(own["v"])
                for a in range(0, of.num_rows, 256):
                    part = of.slice(a, 256)
                    for q, scores in zip(part["q"].to_pylist(), np.round(matrix(part["v"]) @ x.T, 9), strict=True):
                        least = np.partition(scores, -min(k + 1, len(ids)))[-min(k + 1, len(ids))]
                        near = np.flatnonzero(scores >= least)
                        best = [i for i in near[np.argsort(-scores[near], kind="stable")].tolist() if ids[i] != q][:k]  # ids stand in order
                        out["q"] += [q] * len(best)
                        out["id"] += [ids[i] for i in best]
                        out["score"] += scores[best].tolist()
            return pa.table({"q": pa.array(out["q"], kinds["q"]), "id": pa.array(out["id"], kinds["id"]), "score": pa.array(out["score"], pa.float64())})

        schema = T.StructType([chosen.schema["q"], self.vectors.schema["id"], T.StructField("score", T.DoubleType())])
        return left.cogroup(right).applyInArrow(score, schema)


def _kept(df: DataFrame, name: str) -> DataFrame:
    df.write.parquet(path := scratch(df.sparkSession, name))
    return df.sparkSession.read.parquet(path)
