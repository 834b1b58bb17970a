"""Operators of the library against small versions in plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.operators import containment as C
from quillstone.operators import dedup as D
from quillstone.operators import ranks as RK
from quillstone.operators import resample as RS
from quillstone.operators import retrieval as RT
from quillstone.operators import sampling as S


@pytest.mark.parametrize("block", [4_000_000, 7])
def test_containment_brute(spark, block):
    """Needles of every length, in one pass or several; edges forgiven."""
    rng = random.Random(1)
    words = ["a", "be", "cat", "cats", "dog.", "(x)", "é", "concat"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    hays = [(i, some(rng.randrange(0, 30))) for i in range(60)] + [(900, None), (901, "")]
    needles = [(i, rng.choice(["", '"', " "]) + some(rng.randrange(0, 8)) + rng.choice(["", ".", "-"])) for i in range(60)]
    got = C.containment(spark.createDataFrame(needles, "n long, t string"), spark.createDataFrame(hays, "h long, t string"), "n", "t", "h", "t", block_rows=block)
    norm = lambda t: " ".join((t or "").lower().split())
    want = {(h, n) for h, x in hays for n, t in needles if norm(t) in norm(x) or norm(t).strip(".,;:!?’'\"-— ") in norm(x)}
    assert sorted((r.h, r.n) for r in got.collect()) == sorted(want) and len(want) > 100


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab é\U0001f600", max_size=50), max_size=6), st.lists(st.text(alphabet="ab é\U0001f600", min_size=1, max_size=40), min_size=1, max_size=6), st.booleans())
def test_needles_found(texts, needles, small):
    needles = [*needles, *(t[3:39] for t in texts if len(t) > 5)]
    known = np.array([C.known_by(n) for n in set(needles)], dtype=object)
    q, head, length, whole = (known[:, k].astype(np.uint64) for k in range(4))
    before, C.CHUNK = C.CHUNK, 8 if small else C.CHUNK
    try:
        assert C.Needles(q, head, length, whole).found(texts) == [{n for n in needles if n in t} for t in texts]
    finally:
        C.CHUNK = before


def test_a_million_short_needles():
    """In one pass: far more one-word needles than an automaton's memory is for."""
    words = [f"{k:x}z" for k in range(0, 3_000_000, 3)]
    n = len(words)
    known = np.array([C.known_by(w) for w in words[:: n // 20_000]], dtype=object)
    q, head, length, whole = (known[:, k].astype(np.uint64) for k in range(4))
    rng = np.random.default_rng(1)
    filler = rng.integers(0, 1 << 63, 980_000, np.uint64)
    needles = C.Needles(np.concatenate([q, np.full(len(filler), 6, np.uint64)]), np.concatenate([head, filler]), np.concatenate([length, np.full(len(filler), 6, np.uint64)]), np.concatenate([whole, filler]))
    wanted = set(words[:: n // 20_000])
    text = " ".join(words[:: n // 5000]) + " nothing else here"
    assert needles.found([text]) == [{w for w in wanted if w in text}]


def families():
    """Families of variants of a text, copies, and texts with nothing in common."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for size in (70, 9, 2, 1, 1):
        base = [word() for _ in range(60)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(60)] = word()
            out.append(" ".join(t))
    out += [out[0], out[-1], "short", "short", "", "a b"]
    rng.shuffle(out)
    return list(enumerate(out)) + [(999, None)]


@pytest.mark.parametrize("block", [1024, 16])
def test_similar_sets(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "COLUMNS", 50)
    rows = families()
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), i)
    named = sorted((i, s) for s, i in sets.items())
    j = {(a, b): len(x & y) / len(x | y) for k, (a, x) in enumerate(named) for b, y in named[k + 1 :]}
    tokens = D.X.tokens("text")
    want = {p: v for p, v in j.items() if v >= 0.6}
    got = {(r.a, r.b): r.jaccard for r in D.similar_pairs(df, "id", tokens, 5, 0.6).collect()}
    assert got == pytest.approx(want) and len(want) > 400
    near = [p for p, v in j.items() if v >= 0.8]
    links = {r.id: (r.n_links, r.least_link) for r in D.similar_links(df, "id", tokens, 5, 0.8).collect()}
    assert links == {i: (len(own), min(own)) for i in {x for p in near for x in p} for own in [[b if a == i else a for a, b in near if i in (a, b)]]}
    label = lambda c: c % 3
    counts = {(r.level, r.crosses): r.n for r in D.similar_counts(df, "id", tokens, label, [0.9, 0.6]).collect()}
    assert counts == {(t, c): sum(v >= t and (a % 3 != b % 3) == c for (a, b), v in j.items()) for t in (0.9, 0.6) for c in (True, False)}
    assert D.similar_pairs(df.limit(0), "id", tokens).count() == 0


def test_a_family_sends_no_pairs(spark):
    """Of 3,000 variants blocks send a row for each at most, not one for each of four million links."""
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(w if k != i % 60 else f"x{i}" for k, w in enumerate(base))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    out = D.similar_links(df, "id", D.X.tokens("text"), 5, 0.8)
    got = out.agg(F.count("*").alias("n"), F.sum("n_links").alias("links"), F.max("least_link").alias("least")).first()
    assert got.n == 3000 and got.links == 2 * got.links // 2 and got.links >= 3000 * 40 and got.least == 1
    counts = {(r.level, r.crosses): r.n for r in D.similar_counts(df, "id", D.X.tokens("text"), lambda c: c % 2, [0.8]).collect()}
    assert 2 * (counts[0.8, True] + counts[0.8, False]) == got.links


def test_ranked_draws(spark):
    rows = [(i, "abc"[i % 3] if i % 7 else None) for i in range(500)]
    got = S.ranked_draws(spark.createDataFrame(rows, "k long, g string"), "k", "seed", ["g"]).collect()
    draw = lambda k: (hashlib.md5(f"seed|{k}".encode()).hexdigest(), k)
    for g in ("a", "b", "c", None):
        own = sorted((k for k, x in rows if x == g), key=draw)
        assert {r.k: (r["__rank"], r["__n"]) for r in got if r.g == g} == {k: (i, len(own)) for i, k in enumerate(own, 1)}
    assert S.ranked_draws(spark.createDataFrame([], "k long, g string"), "k", "s").count() == 0


def test_median_rows(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["x", "y", None]), rng.randrange(6)) for i in range(101)]
    got = {r.g: r.k for r in S.median_rows(spark.createDataFrame(rows, "k long, g string, s long"), "g", F.col("s"), "k").collect()}
    for g in ("x", "y", None):
        own = sorted((s, k) for k, x, s in rows if x == g)
        assert got[g] == own[len(own) // 2][1]


def brute_macro(rows, pred, classes):
    f = []
    for c in classes:
        tp, fp, fn = (sum(t(r[0] == c, r[pred] == c) for r in rows) for t in (lambda g, p: g and p, lambda g, p: not g and p, lambda g, p: g and not p))
        f.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    return sum(f) / len(f)


def test_bootstrap(spark):
    """The intervals of resampling rows, from resampled counts; draws don't depend on partitions."""
    rng = random.Random(3)
    rows = [(g := rng.choice("abc"), g if rng.random() < 0.8 else rng.choice(["a", None]), g if rng.random() < 0.6 else "b") for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, p string, q string")
    one = RS.bootstrap(df, "g", ["p"], ["a", "b", "c"], draws=1500).first()
    two = RS.bootstrap(df.repartition(7), "g", ["p", "q"], ["a", "b", "c"], draws=1500).first()
    resampled = [[rows[rng.randrange(300)] for _ in rows] for _ in range(600)]
    v = sorted(brute_macro(r, 1, "abc") for r in resampled)
    d = sorted(brute_macro(r, 1, "abc") - brute_macro(r, 2, "abc") for r in resampled)
    for got, want in ((one, v), (two, d)):
        assert np.allclose([got.mean, got.ci_low, got.ci_high], [np.mean(want), want[15], want[585]], atol=0.015)
    assert two.p_positive > 0.95 and one == RS.bootstrap(df.repartition(3), "g", ["p"], ["a", "b", "c"], draws=1500).first()
    assert RS.bootstrap(df.limit(0), "g", ["p"], ["a"]).first()["mean"] is None


def test_bootstrap_by_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice("uvw"), rng.random() < 0.5, rng.random() < 0.7) for _ in range(240)]
    df = spark.createDataFrame([(k, g, g if i % 5 else p, p) for i, (k, g, p) in enumerate(rows)], "k string, g boolean, a boolean, b boolean")
    got = RS.bootstrap(df, "g", ["a", "b"], [True], by="k", draws=1000).first()
    data = [tuple(r) for r in df.collect()]
    score = lambda rs, c: np.mean([brute_macro([(r[1], r[c]) for r in rs if r[0] == k], 1, [True]) for k in "uvw"])
    d = sorted(score(r, 2) - score(r, 3) for r in ([data[rng.randrange(240)] for _ in data] for _ in range(400)))
    assert np.allclose([got.mean, got.ci_low, got.ci_high], [np.mean(d), d[10], d[390]], atol=0.02)


def test_poisson_weights(spark):
    """Mean and variance of the drawn weights, small counts and large."""
    rows = [(c, f"k{c}") for c in (1, 3, 8, 9, 40, 1000)]
    w = RS.weight(F.col("c"), F.concat_ws("|", "k", F.col("i").cast("string")))
    got = spark.createDataFrame(rows, "c long, k string").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3999)))).select("c", w.alias("w")).groupBy("c").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v"), F.min("w").alias("low")).collect()
    for r in got:
        assert abs(r.m - r.c) < 5 * (r.c / 4000) ** 0.5 and 0.88 < r.v / r.c < 1.12 and r.low >= 0


def test_running(spark, monkeypatch):
    """Places over many ranges, a group with most rows among them, nulls as a group of their own."""
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(5)) for i in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "k long, g string, w int").repartition(5)
    got = RK.running(df, ["k"], ["g"], F.col("w")).collect()
    for g in ("hot", "a", None):
        own, upto = sorted(r for r in rows if r[1] == g), 0
        found = {r.k: (r["__upto"], r["__n"]) for r in got if r.g == g}
        for k, _, w in own:
            upto += w
            assert found[k] == (upto, sum(r[2] for r in own))
    capped = {r.k for r in RK.running_cap(df, "g", "k", F.col("w") > 1, 3).where("capped").collect()}
    assert capped == {r[0] for g in ("hot", "a", None) for r in sorted(x for x in rows if x[1] == g and x[2] > 1)[3:]}
    assert RK.running(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_rank_percentiles(spark, by):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b"]), rng.choice([None, 7, rng.randrange(1000)])) for _ in range(300)]
    got = RK.rank_percentiles(spark.createDataFrame(rows, "g string, v int"), "v", {"p1": (0.01, 1), "p50": (0.5, 0), "p100": (1.0, 0)}, by).collect()
    for r in got:
        own = sorted(v for g, v in rows if v is not None and (not by or g == r.g))
        at = lambda q, less: own[max(0, min(int(q * len(own)) - less, len(own) - 1))]  # noqa: B023, E731
        assert (r.n, r.p1, r.p50, r.p100) == (len(own), at(0.01, 1), at(0.5, 0), own[-1])
    assert len(got) == (2 if by else 1)


def test_shots(spark):
    rows = [(i, "xyz"[i % 3], f"t{i}") for i in range(60)]
    out = S.shots(spark.createDataFrame(rows, "k long, c string, t string"), "k", "c", ["x", "q", "y"], 6, F.struct("t"), "s").first().shots
    draw = lambda i, c: min((hashlib.md5(f"s|{i}|{k}".encode()).hexdigest(), t) for k, x, t in rows if x == c)[1]
    assert [e.t for e in out] == [draw(0, "x"), draw(2, "y"), draw(3, "x"), draw(5, "y")]


def test_dense_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 8)), 1)
    rows = [(i, "k" if i % 3 else "l", [float(v) for v in x[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "c long, k string, v array<double>")
    asked = df.where("c % 10 = 0").select(F.col("c").alias("q"), "k", F.col("v").alias("qv"))
    got = RT.ranked(RT.dense(asked, df, "k", "q", "qv", "c", "v", 4, block_rows=16), ["q"], "c", k=4).collect()
    for q in range(0, 300, 10):
        own = [i for i in range(300) if (i % 3 == 0) == (q % 3 == 0) and i != q]
        want = sorted((-round(float(x[i] @ x[q]), 9), i) for i in own)[:4]
        assert [r.c for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])] == [i for _, i in want]


def test_shingles_are_shuffled_once(spark, monkeypatch):
    """They are counted where they meet: the plan that ranks them takes the sets apart once."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, path, *a, **k: (plans.append(w._df._jdf.queryExecution().optimizedPlan().toString()), write(w, path, *a, **k))[1])
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g"), (3, "x y z")], "id long, t string")
    assert [(r.a, r.b, round(r.jaccard, 6)) for r in D.similar_pairs(df, "id", F.split("t", " "), 3, 0.5).collect()] == [(1, 2, 0.6)]
    assert [p.count("Generate explode(s#") for p in plans if "explode(s#" in p] == [1]
