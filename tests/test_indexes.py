"""The postings index and the vector index against scoring everything."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import dense_index as D
from quillstone.operators import postings as P
from quillstone.operators import retrieval as RT
from quillstone.plans import retrieval_queries as Q


def bm25(chunks, query, k1=1.5, b=0.75):
    words = {c: re.findall("[a-z0-9]+", (t or "").lower()) for c, t in chunks.items()}
    avg, df = sum(map(len, words.values())) / len(words), Counter(t for w in words.values() for t in set(w))
    out = {}
    for c, w in words.items():
        tf, hit = Counter(w), [t for t in re.findall("[a-z0-9]+", query.lower()) if t in w]
        if hit:
            out[c] = round(sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / avg)) for t in hit), 9)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["the"] * 30 + [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40)))
    chunks = {("a", i): text() for i in range(300)} | {("b", 5 * i): text() for i in range(20)} | {("c", 0): "", ("c", 1): None, ("d", 7): "Rare. rare! RARE"}
    queries = [("a", "q1", "the w1 w2 w1"), ("a", "q2", "the"), ("a", "q3", "nowhere"), ("b", "q1", "w3 the w4"), ("c", "q1", "the"), ("d", "q1", "rare thing"), ("x", "q1", "the"), ("a", "q4", None)]
    return chunks, queries


@pytest.mark.parametrize(("span", "buckets"), [(8, 3), (1, None), (1000, 5)])
def test_postings_search(spark, tmp_path, corpus, span, buckets):
    chunks, queries = corpus
    df = spark.createDataFrame([(k, c, t) for (k, c), t in chunks.items()], "k string, chunk long, text string").repartition(3)
    index = P.PostingsIndex.build(df, f"file://{tmp_path}/i", ["k"], span=span, buckets=buckets)
    index = P.PostingsIndex(spark, f"file://{tmp_path}/i")  # as another program opens it
    got = index.search(spark.createDataFrame(queries, "k string, query string, query_text string"), k=5).collect()
    for k, q, text in queries:
        scores = bm25({c: t for (x, c), t in chunks.items() if x == k}, text or "") if any(x == k for x, _ in chunks) else {}
        want = sorted((-s, c) for c, s in scores.items())[:5]
        rows = sorted((r for r in got if (r.k, r["query"]) == (k, q)), key=lambda r: r["rank"])
        assert [r.chunk for r in rows] == [c for _, c in want] and [r["rank"] for r in rows] == list(range(len(want)))
        assert np.allclose([r.score for r in rows], [-s for s, _ in want])


def test_postings_of_many_corpora_are_cut_out_first(spark, tmp_path, corpus, monkeypatch):
    """Only what is asked for is kept for the steps of the search; results are the same."""
    chunks, queries = corpus
    df = spark.createDataFrame([(k, c, t) for (k, c), t in chunks.items()], "k string, chunk long, text string")
    index = P.PostingsIndex.build(df, f"file://{tmp_path}/i", ["k"], span=8, buckets=3)
    asked = spark.createDataFrame(queries, "k string, query string, query_text string")
    want = sorted(map(tuple, index.search(asked, k=5).collect()))
    monkeypatch.setattr(P, "MANY_CORPORA", 2)
    kept, keep = [], index._kept
    monkeypatch.setattr(index, "_kept", lambda x: kept.append(keep(x)) or kept[-1])
    assert sorted(map(tuple, index.search(asked, k=5).collect())) == want
    (cut,) = (x for x in kept if "lens" in x.columns)
    whole = index.postings(kept[0])
    terms = {(k, t) for k, q, text in queries for t in re.findall("[a-z0-9]+", (text or "").lower())}
    of = lambda x: sorted(tuple(r[c] for c in ("bucket", "term", "k", "block", "n", "max_tf", "min_len", "chunks", "tfs", "lens")) for r in x.collect())
    assert of(cut) == [r for r in of(whole) if (r[2], r[1]) in terms]


def test_postings_leave_blocks_out(spark, tmp_path):
    """One block of chunks has the query's words far more often: with its scores known no other is read."""
    rows = [(0, i, ("needle " * 9 if i // 10 == 3 else "needle " if i % 10 == 0 else "") + "straw " * 30) for i in range(400)]
    index = P.PostingsIndex.build(spark.createDataFrame(rows, "k int, chunk long, text string"), f"file://{tmp_path}/i", ["k"], span=10, buckets=4)
    asked = spark.createDataFrame([(0, 1, "needle")], "k int, query int, query_text string")
    _, blocks = index.scored(asked, 3, "query", "query_text", 1.5, 0.75)
    read = {r["block"] for r in blocks.where("read").collect()}
    assert 3 in read and len(read) == 3 and blocks.count() == 40
    assert [r.chunk for r in index.search(asked, 3).orderBy("rank").collect()] == [30, 31, 32]


def test_postings_choose_first_blocks_once(spark, tmp_path, monkeypatch):
    """Bounds of equal blocks differ in their last digits from one evaluation to the next: no chunk is lost or scored twice for that."""
    rows = [(0, i, "needle straw " + "straw " * (i % 3)) for i in range(120)]
    index = P.PostingsIndex.build(spark.createDataFrame(rows, "k int, chunk long, text string"), f"file://{tmp_path}/i", ["k"], span=4, buckets=4)
    top, chance = P.top, F.udf(lambda _: random.SystemRandom().random() * 1e-13, "double").asNondeterministic()

    def unstable(df, by, order, k, spread):
        if spread != "block":
            return top(df, by, order, k, spread)
        return top(df.withColumn("bound", F.round("bound", 3) + chance("block")), by, order, k, spread)

    monkeypatch.setattr(P, "top", unstable)
    asked = spark.createDataFrame([(0, 1, "needle")], "k int, query int, query_text string")
    scores = index.scored(asked, 5, "query", "query_text", 1.5, 0.75)[0].select("chunk").collect()
    assert sorted(r.chunk for r in scores) == list(range(120))  # all bounds reach the fifth score
    assert [r.chunk for r in index.search(asked, 5).orderBy("rank").collect()] == [0, 3, 6, 9, 12]


def test_postings_read_only_what_is_asked(spark, tmp_path):
    index = P.PostingsIndex.build(spark.createDataFrame([(0, i, f"word{i} common") for i in range(200)], "k int, chunk long, text string"), f"file://{tmp_path}/i", ["k"], buckets=32)
    terms = spark.createDataFrame([("word7",)], "term string").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(32)).cast("int"))
    part = index.postings(terms)
    plan = part._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*term,word7", plan)
    assert {r.bucket for r in part.select("bucket").distinct().collect()} == {terms.first()["bucket"]}


def test_counted_terms(spark):
    rows = [("b a b", [("a", 1), ("b", 2)]), ("", []), (None, []), ("x", [("x", 1)]), ("z z z", [("z", 3)])]
    got = spark.createDataFrame(rows, "t string, w array<struct<t:string,tf:int>>").select("w", P.counted_terms(P.X.words("t")).alias("x")).collect()
    assert all(r.x == r.w for r in got)


def neighbours(rows, queries, k):
    out = {}
    for key, q, v in queries:
        scores = sorted((-round(float(np.dot(v, x)), 9), i) for kk, i, x in rows if kk == key and i != q and x is not None)
        out[q] = [i for _, i in scores[:k]]
    return out


def vectors(clustered: bool, n: int = 900, seed: int = 1):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((12, 16)) * 4
    rows = [(int(rng.integers(2)) * int(rng.integers(2)), i, (middle[rng.integers(12)] + rng.standard_normal(16) * 0.3 if clustered else rng.standard_normal(16)).tolist()) for i in range(n)]
    return [*rows, (None, n, [1.0] * 16), (1, n + 1, None), (9, n + 2, [1.0] * 16), *[(0, 10_000 + i, rows[0][2]) for i in range(60)]]


@pytest.mark.parametrize("clustered", [True, False])
def test_dense_index(spark, tmp_path, monkeypatch, clustered):
    monkeypatch.setattr(D, "BLOCK_BYTES", 100 * 8 * 16)  # lists and keys of several blocks
    monkeypatch.setattr(D, "SAMPLE", 500)
    rows = vectors(clustered)
    queries = [r for r in rows if r[1] % 9 == 0 and r[2] is not None and r[0] is not None] + [(77, -1, [1.0] * 16)]
    df = spark.createDataFrame(rows, "label int, id long, v array<double>").repartition(3)
    D.DenseIndex.build(df, f"file://{tmp_path}/i", "label", "id", "v", list_rows=40)
    index = D.DenseIndex(spark, f"file://{tmp_path}/i")
    assert index.vectors.count() == len(rows) - 2 and index.lists.agg(F.sum("n")).first()[0] == len(rows) - 2
    asked = spark.createDataFrame(queries, "label int, query long, v array<double>")
    want = neighbours(rows, queries, 10)

    def found(probes):
        out = {q: [] for q in want}
        for r in sorted(index.search(asked, 10, "label", "query", "v", probes).collect(), key=lambda r: r["rank"]):
            out[r["query"]].append(r["id"])
        return out

    assert found(None) == want
    some = found(4 if clustered else 12)
    recall = sum(len(set(some[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_cut_once(spark):
    """Steps read the pieces from a table; none cuts the texts again."""
    pieces, asked = Q.chunks(spark, "/root/testdata/sf0.001")
    assert not any(x in plan_of(df) for df in (pieces, asked) for x in ("split(", "regexp_replace("))


def test_tokens_and_words(spark):
    rows = [None, "", " ", "a", "A  b\tc\n", " x y　 z\x1c\x85", "e-mail, 3.5%!", "İx Kelvin é é1", "!~\x7f\u0080"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.tokens("t").alias("a"), F.filter(F.split(T.norm("t"), " "), lambda x: x != "").alias("b"), T.words("t").alias("w"), F.lower("t").alias("l")).collect()
    assert all(r.a == r.b and r.w == re.findall("[a-z0-9]+", r.l or "") for r in got)


def test_rerank_by_an_expression(spark):
    ranking = spark.createDataFrame([(1, 0, c, 1.0, c) for c in range(6)], "k int, query int, chunk int, score double, rank int")
    scores = ranking.select("k", "query", "chunk", (F.col("chunk") % 3).alias("score"))
    want = [(2, 0), (1, 1), (0, 2), (3, 3)]
    for by in (scores, F.col("chunk") % 3):
        got = RT.rerank(ranking, by, ["k", "query"], head=4)
        assert [(r.chunk, r["rank"]) for r in got.orderBy("rank").collect()] == want


def test_recall_normalises_a_piece_once(spark):
    """Not for each k: white space and case are made even before the lists are multiplied. Empty pieces leave no gap."""
    chunks = spark.createDataFrame([(1, 0, "One  TWO\n"), (1, 1, " "), (1, 2, "three"), (1, 3, "four")], "doc int, chunk int, text string")
    ranking = spark.createDataFrame([(1, 0, c, c) for c in range(4)], "doc int, query int, chunk int, rank int")
    gold = spark.createDataFrame([(1, 0, ["two three.", "THREE\tfour"])], "doc int, query int, gold array<string>")
    out = RT.recall(ranking, chunks, gold, ["doc", "query"], [1, 3, 4])
    assert sorted(map(tuple, out.collect())) == [(1, 1, 0, 0), (3, 1, 0, 1), (4, 1, 1, 1)]
    assert "regexp_replace(" not in plan_of(out).split("explode(")[0]
