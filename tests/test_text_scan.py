"""Search by reading the texts, against SQL and against scoring everything."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from quillstone.operators import text_scan as S
from quillstone.plans import registry, retrieval_queries  # noqa: F401


def tables(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def same_as_sql(spark, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT item_id, doc_id, piece, rank, score FROM ({registry.SQL['corpus_search']})").fetchall()
    got = registry.QUERIES["corpus_search"](spark, folder).select("item_id", "doc_id", "piece", "rank", "score").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    return want


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = ["the", "The,", "Ix", "a-b", "ñandú", "...", "x y", "p\x1cq"] + [f"w{i}" for i in range(40)]
    text = lambda n: rng.choice([" ", "\n", "\u3000 "]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 400))) for i in range(120)] + [(200, None), (201, ""), (202, "..."), (-5, text(30))]
    items = [(i, text(25)) for i in range(12)] + [(20, ""), (21, None), (22, "nowhere"), (23, "the the w1")]
    return docs, items


@pytest.mark.parametrize(("queries", "cells"), [(4096, 1 << 19), (5, 64)])
def test_scan_equals_sql(spark, tmp_path, corpus, monkeypatch, queries, cells):
    """In one pass, and in passes of few queries with blocks of few pieces."""
    docs, items = corpus
    monkeypatch.setattr(S, "PASS_QUERIES", queries)
    monkeypatch.setattr(S, "CELLS", cells)
    assert len(same_as_sql(spark, tables(spark, tmp_path / "t", docs, items))) == 130


def test_rows_of_one_id_are_one_document(spark, tmp_path, corpus):
    docs, items = corpus
    same_as_sql(spark, tables(spark, tmp_path / "t", docs + docs[:7] + docs[:3], [*items, (23, "w2 w1"), (None, "w3 the")]))


def test_rows_without_id_count_and_are_not_found(spark):
    docs = spark.createDataFrame([(1, "rare straw"), (2, "straw"), (None, "rare rare"), (None, "straw")], "doc_id long, text string")
    got = S.search(docs, spark.createDataFrame([(0, "rare")], "query int, query_text string"), 5).collect()
    want = np.log(1 + (4 - 2 + 0.5) / (2 + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1.5))
    assert [(r.doc, r.piece, r["rank"]) for r in got] == [(1, 0, 0)] and np.isclose(got[0].score, want)


def test_empty_tables(spark):
    docs, asked = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("q", "word")], "query string, query_text string")
    assert S.search(docs, asked, 5).collect() == [] == S.search(docs, asked.where("false"), 5).collect()
    assert S.search(spark.createDataFrame([(1, None)], docs.schema), asked, 5).collect() == []


def test_products_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    x, w = (rng.random(s) * (rng.random(s) < 0.4) for s in ((30, 20), (20, 9)))
    (row, term), (of, query) = np.nonzero(x), np.nonzero(w)
    for products in (1, 7, 1 << 20):
        monkeypatch.setattr(S, "PRODUCTS", products)
        got = S.products(row, term, x[row, term], np.searchsorted(of, np.arange(21)), query, w[of, query], (30, 9))
        assert np.allclose(got, x @ w)


def test_best_of_blocks():
    """Whatever the blocks, ties to the first place: scores that are rounded alike are equal."""
    rng = np.random.default_rng(4)
    scores = np.maximum(rng.integers(-40, 60, (500, 3)) / 10 + rng.random((500, 3)) * 1e-11, 0)
    docs = rng.permutation(500)
    for size in (1, 40, 500):
        best = S.Best(3, 4, 9)
        for at in range(0, 500, size):
            best.add(scores[at : at + size], docs[at : at + size], np.zeros(size, np.int64)[: 500 - at])
        for q in range(3):
            want = sorted((-round(s, 9), d) for s, d in zip(scores[:, q], docs, strict=True) if s > 0)[:4]
            assert [(-s, d) for s, d in zip(best.scores[best.q == q], best.docs[best.q == q], strict=True)] == want


def test_corpus_search_shuffles_no_words(spark, tmp_path):
    """What is shuffled are documents, counts of words that are asked, and each task's best; not a row for each word of each piece, or
    for each query, word and document."""
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    folder = tables(spark, tmp_path / "t", [(i, text(400)) for i in range(300)], [(i, text(30)) for i in range(20)])
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    assert registry.QUERIES["corpus_search"](spark, folder).count() == 200
    assert shuffled() - before < 300 * 400 / 10
