"""Lexical and dense ranking of a document's chunks, and their fusion. All joins and windows are within one key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X


def bm25(chunks: DataFrame, queries: DataFrame, key: list[str], chunk: str = "chunk", text: str = "text", query: str = "query", query_text: str = "query_text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(key, query, chunk, score)`` of chunks that share a word with the query; the corpus of a query is its key's chunks; a word
    that a query repeats counts as often."""
    asked = queries.select(*key, query, F.explode(X.words(query_text)).alias("t")).groupBy(*key, query, "t").agg(F.count("*").alias("qf"))
    of_key = asked.groupBy(*key).agg(F.collect_list(F.struct(F.col(query).alias("q"), "t", "qf")).alias("asked"))
    rows = chunks.select(*key, chunk, text).join(of_key, key)  # all that follows stays on this partitioning
    rows = rows.select(*key, chunk, "asked", X.words(text).alias("w"))
    hits = F.transform("asked", lambda a: F.struct(a["q"].alias("q"), a["t"].alias("t"), a["qf"].alias("qf"), (F.size("w") - F.size(F.array_remove("w", a["t"]))).alias("tf")))
    rows = rows.select(*key, chunk, F.size("w").alias("len"), F.filter(hits, lambda h: h["tf"] > 0).alias("hits"))
    whole = Window.partitionBy(*key)
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("avg", F.avg("len").over(whole))
    rows = rows.select(*key, chunk, "len", "n", "avg", F.explode("hits").alias("h")).select(*key, F.col("h.q").alias(query), chunk, "len", "n", "avg", "h.t", "h.qf", "h.tf")
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy(*key, query, "t")))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return rows.groupBy(*key, query, chunk).agg(F.sum(part).alias("score"))


def ranked(scores: DataFrame, key: list[str], chunk: str = "chunk", score: str = "score", k: int | None = None) -> DataFrame:
    """Ranks from 0 by falling score; ties go to the first chunk."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), F.col(chunk))) - 1)
    return out if k is None else out.where(F.col("rank") < k)


def cosine(a: str, b: str):
    """Of vectors of length one: their inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(queries: DataFrame, vectors: DataFrame, key: str, query: str, query_vector: str, chunk: str, vector: str, k: int, block_rows: int = 4096) -> DataFrame:
    """``(query, chunk, score)``: the k chunks of each query's key of largest inner product (in double precision, rounded to nine digits;
    ties to the first chunk), but the query itself. A key's vectors are dealt to blocks of bounded size, its queries go to every
    block, and a block answers with its k nearest: no pairs leave it."""
    counts = vectors.groupBy(key).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("__blocks"))
    numbered = F.broadcast(counts) if counts.limit(100_001).count() <= 100_000 else counts
    block = F.pmod(F.xxhash64(chunk), F.col("__blocks")).cast("int")
    left = vectors.join(numbered, key).select(F.col(key).alias("k"), block.alias("b"), F.col(chunk).alias("c"), F.col(vector).cast("array<double>").alias("v"))
    right = queries.join(numbered, key).select(F.col(key).alias("k"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("b"), F.col(query).alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    kinds = {name: to_arrow_type(df.schema[c].dataType) for name, df, c in (("q", queries, query), ("c", vectors, chunk))}

    def search(of_block: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "c": [], "score": []}
        if of_block.num_rows and asked.num_rows:
            ids, x = of_block["c"].to_pylist(), np.array(of_block["v"].to_pylist())
            for at in range(0, asked.num_rows, 256):
                part = asked.slice(at, 256)
                for q, scores in zip(part["q"].to_pylist(), np.round(np.array(part["v"].to_pylist()) @ x.T, 9), strict=True):
                    near = np.flatnonzero(scores >= np.partition(scores, -min(k + 1, len(ids)))[-min(k + 1, len(ids))]).tolist()
                    best = sorted((-scores[i], ids[i]) for i in near if ids[i] != q)[:k]
                    out["q"] += [q] * len(best)
                    out["c"] += [i for _, i in best]
                    out["score"] += [-s for s, _ in best]
        return pa.table({"q": pa.array(out["q"], kinds["q"]), "c": pa.array(out["c"], kinds["c"]), "score": pa.array(out["score"], pa.float64())})

    schema = T.StructType([T.StructField("q", queries.schema[query].dataType), T.StructField("c", vectors.schema[chunk].dataType), T.StructField("score", T.DoubleType())])
    found = left.groupBy("k", "b").cogroup(right.groupBy("k", "b")).applyInArrow(search, schema)
    return found.select(F.col("q").alias(query), F.col("c").alias(chunk), "score")


def fuse(lists: list[DataFrame], key: list[str], chunk: str = "chunk", constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, ranked anew."""
    every = lists[0].select(*key, chunk, "rank")
    for more in lists[1:]:
        every = every.unionByName(more.select(*key, chunk, "rank"))
    return ranked(every.groupBy(*key, chunk).agg(F.sum(1.0 / (constant + F.col("rank") + 1)).alias("score")), key, chunk)


def rerank(fused: DataFrame, scores: DataFrame | Column, key: list[str], chunk: str = "chunk", head: int = 20) -> DataFrame:
    """The first ``head`` of a ranking by another score: a column of ``scores``, or an expression of the ranking's own rows, which is
    computed for these alone."""
    first = fused.where(F.col("rank") < head).drop("score", "rank")
    return ranked(first.withColumn("score", scores) if isinstance(scores, Column) else first.join(scores, [*key, chunk]), key, chunk)


def recall(ranking: DataFrame, chunks: DataFrame, gold: DataFrame, key: list[str], ks: list[int], chunk: str = "chunk", text: str = "text", spans: str = "gold") -> DataFrame:
    """For each k: of how many queries all, or any, gold spans are within the joined text of the first k chunks."""
    top = ranking.where(F.col("rank") < max(ks)).join(chunks.select(*[c for c in key if c in chunks.columns], chunk, text), [*[c for c in key if c in chunks.columns], chunk])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", X.norm(text).alias("t")))), lambda x: x["t"])  # max(ks) a query
    lists = top.groupBy(*key).agg(texts.alias("texts"))
    rows = gold.join(lists, key).select(*key, F.transform(spans, lambda g: X.norm(g)).alias(spans), "texts").select(*key, spans, "texts", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hay = F.array_join(F.filter(F.slice("texts", F.lit(1), F.col("k")), lambda x: x != ""), " ")  # as the joined text normalised, without doing that for each k
    hits = X.bind(hay, lambda h: F.size(F.filter(F.col(spans), lambda g: X.grounded(g, h))))
    rows = rows.withColumn("hits", hits)
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("hits") == F.size(spans)).alias("all_found"), F.count_if(F.col("hits") > 0).alias("any_found"))
