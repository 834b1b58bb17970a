"""The operators against brute force, and on odd inputs."""

from __future__ import annotations

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import ann, bitplanes, decontaminate, exchange, html_density, ngram_join, packing, toxicity, url_filter
from quillstone.llm.components import components
from quillstone.llm.html_density import extract_text, main_text
from quillstone.llm.line_dedup import dedup_lines
from quillstone.llm.ngram_join import ngram_components
from quillstone.llm.substring_dedup import dedup_substrings
from quillstone.llm.url_filter import filter_urls

SCHEMA = "doc_id long, text string, source string, n_lines long, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def corpus(seed, n=60, words=40, vocabulary=300):
    """Texts with copies, near copies, shared passages and lines; nulls, empties, a long text, and a repeated row."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", "É", "."])
    text = lambda k: "".join(word() + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(k))
    passage, line = text(60), "A common line that many have"
    out = []
    for i in range(n):
        kind = rng.randrange(8)
        t = text(rng.randrange(words * 3))
        if kind == 0 and out:
            t = rng.choice(out)[1] or ""
        elif kind == 1 and out:
            w = (rng.choice(out)[1] or "x").split(" ")
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 2:
            t = t + passage + text(5)
        elif kind == 3:
            t = t + "\n" + rng.choice(["  ", ""]) + line + "\t\n" + line.upper() + "\n" + t
        out.append((i * 3 + 1, t))
    out += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one two"), (1004, "ONE two"), (1005, text(4000)), out[3], (7, out[5][1])]
    rng.shuffle(out)
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "s", 5, 1) for i, t in rows], SCHEMA).repartition(parts)


def distinct(rows):
    """For comparisons by id: the first row of each."""
    seen = {}
    for i, t in rows:
        seen.setdefault(i, t)
    return sorted(seen.items())


@pytest.fixture(params=["one hop", "two hops"])
def hops(request, monkeypatch):
    """With few coarse ranges and small blocks, keys of even small inputs take two hops."""
    if request.param == "two hops":
        monkeypatch.setattr(exchange, "COARSE", 5)
        monkeypatch.setattr(exchange, "BLOCK", 7)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, hops, seed):
    rows = distinct(corpus(seed))
    key = lambda s: low(s.strip(" \t\n\v\f\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    want = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 10 and len(held[key(x)]) >= 2 and min(held[key(x)]) != i)]
        want[i] = ("\n".join(keep), len(lines), len(lines) - len(keep))
    got = dedup_lines(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "bucket", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()} == want


def test_lines_threshold_and_repeats(spark):
    rows = [(i, f"a line of some length\nown {i} and only") for i in (3, 1, 2, 2)] + [(None, "a line of some length")]
    got = [(r.doc_id, r.n_dropped) for r in dedup_lines(frame(spark, rows), min_docs=4).collect()]
    assert sorted(got, key=str) == [(1, 0), (2, 1), (2, 1), (3, 1), (None, 1)]
    assert all(r.n_dropped == 0 for r in dedup_lines(frame(spark, rows), min_docs=5).collect())


@pytest.mark.parametrize(("seed", "window"), [(3, 50), (4, 8)])
def test_substrings(spark, hops, seed, window):
    rows = distinct(corpus(seed))
    first, want = {}, {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first.setdefault(tuple(w[a : a + window]), i) < i:
                gone[a : a + window] = [True] * window
        want[i] = (" ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone))
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in dedup_substrings(frame(spark, rows), window=window).collect()}
    assert got == want and sum(x[2] for x in got.values()) > 0


def test_substrings_repeats(spark):
    t = " ".join(map(str, range(70)))
    got = sorted((str(r.doc_id), r.n_removed) for r in dedup_substrings(frame(spark, [(5, t), (5, t), (None, t), (9, t)])).collect())
    assert got == [("5", 0), ("5", 0), ("9", 70), ("None", 70)]


def brute_components(rows, size, percent):
    """For each row; rows of one id are one node."""
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append({tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set())
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(rows[a][0]), find(rows[b][0])
            up[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize(("seed", "chunk", "percent"), [(5, 256, 85), (6, 2, 60), (7, 1, 50)])
def test_ngram_components(spark, hops, monkeypatch, seed, chunk, percent):
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", chunk)
    monkeypatch.setattr(ngram_join, "REST_CLASSES", 2 * chunk)
    rows = corpus(seed, n=90, words=30, vocabulary=60 if percent < 85 else 300)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(frame(spark, rows), size=4, percent=percent).collect()]
    assert sorted(got) == sorted(brute_components(rows, 4, percent))


def test_ngram_repeats(spark):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_components(frame(spark, [(4, "a b c d e"), (4, "a b c d e"), (9, "A b c d e"), (None, "a b c d e")])).collect())
    assert got == [("4", 2, "4"), ("4", 2, "4"), ("9", 2, "4"), ("None", 2, "None")]


def test_ngram_rows_of_one_id(spark):
    rows = [(5, "a b c d e"), (5, "p q r s t"), (3, "p q r s t"), (9, "a b c d e"), (3, "k l m n o"), (12, "k l m n o"), (12, "z"), (14, "Z"), (20, "none of them"), (20, None)]
    got = sorted((r.doc_id, r.component_id) for r in ngram_components(frame(spark, rows)).collect())
    assert got == sorted((i, 20 if i == 20 else 3) for i, _ in rows)


def test_ngram_home_of_many_ngrams(spark, monkeypatch):
    """One long class shares each of its prefix n-grams with a few others: its home is chunked by all of them."""
    monkeypatch.setattr(ngram_join, "CHUNK_CLASSES", 8)
    long_ = [f"w{k}" for k in range(63)]
    rows = [(1, " ".join(long_))] + [(10 + k, " ".join(long_[k : k + 4] + [f"own{k}-{j}" for j in range(k % 3)])) for k in range(0, 60)]
    held = ngram_join.chunked(ngram_join.cut(ngram_join.members(ngram_join.cut(ngram_join.ngram_rows(frame(spark, rows).select("doc_id", "text"), 8, "doc_id", "text", 4, 30)), 30, 4)))
    sizes = [r["count"] for r in held.groupBy("home", "of", "chunk").count().collect()]
    assert max(sizes) <= 8 * 3
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(frame(spark, rows), percent=30).collect()]
    assert sorted(got) == sorted(brute_components(rows, 4, 30))


def test_join_chunk_brute():
    rng = random.Random(8)
    for _ in range(40):
        sets = [sorted(rng.sample(range(30), rng.randrange(1, 15))) for _ in range(rng.randrange(1, 25))]
        percent = rng.choice([30, 60, 85])
        pairs = ngram_join.join_chunk(np.arange(len(sets)) + 10, [len(s) for s in sets], [np.array(s, np.uint64) for s in sets], percent)
        up = list(range(len(sets)))
        find = lambda x: x if up[x] == x else find(up[x])
        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(set(sets[a]) & set(sets[b]))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
        assert sorted(pairs) == sorted((i + 10, find(i) + 10) for i in range(len(sets)) if find(i) != i)


def test_components(spark):
    rng = random.Random(9)
    edges = [(max(a, b), min(a, b)) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(70)) if a != b] + [(200 + i, 199 + i) for i in range(20)]
    up = {x: x for e in edges for x in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "hi long, lo long")).collect()}
    assert got == {x: find(x) for x in up}


def levenshtein_search(p, t):
    prev = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        cur = [i + 1]
        for j, y in enumerate(t):
            cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_best_end():
    rng = random.Random(10)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, m))) for m in (15, 30))
        edits, a, b = decontaminate.nearest(p, t)
        assert edits == levenshtein_search(p, t)
        assert levenshtein_search(p, t[a:b]) == edits


def edited(rng, s, rate):
    out = []
    for c in s:
        r = rng.random()
        out.append("" if r < rate / 3 else rng.choice("xyz") if r < 2 * rate / 3 else c + rng.choice("xyz") if r < rate else c)
    return "".join(out)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(11)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    clean = [t for t in (r.text for r in docs.limit(60).collect()) if not any(decontaminate.normal(x) in decontaminate.normal(t) for _, x in items)]
    planted = [(1000 + k, "Vorspann é " + clean[k % len(clean)][:300] + " " + edited(rng, t, 0.05).replace(" ", "  " if k % 5 == 0 else " ", 1) + " " + clean[-1 - k % 7][:200], i) for k, (i, t) in enumerate(items)]
    rows = [(i, t, 1) for i, t in enumerate(clean)] + [(i, t, 1) for i, t, _ in planted] + [(5000, None, 1), (5001, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, leaks int")
    benchmark = spark.createDataFrame([*items, (900, None), (901, ""), (902, "short")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "TABLE_BYTES", 40_000)  # several blocks, written between
    monkeypatch.setattr(decontaminate, "BLOCKS", 2)
    out = decontaminate.find_leaks(df, benchmark)
    got = {r.doc_id: r.leaks for r in out.collect()}
    assert out.columns == ["doc_id", "text", "leaks"] and len(got) == len(rows)
    assert not any(got[i] for i in range(len(clean))) and not got[5000] and not got[5001]
    assert sum(any(x.item_id == i for x in got[d]) for d, _, i in planted) >= 0.95 * len(planted)
    text = {i: t for i, t, _ in planted}
    for d, _, i in planted:
        for x in got[d]:
            item = decontaminate.normal(dict(items)[x.item_id])
            assert levenshtein_search(item, decontaminate.normal(text[d][x.start : x.start + x.n_chars])) == x.edits <= len(item) // 10


@pytest.mark.parametrize("step", [10, 11, 12])
def test_decontamination_spread_edits(spark, step):
    """Edits spread evenly up to the threshold, between words and in a text without any."""
    items = [(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    bare = [(i + 1000, "".join(chr(0x4E00 + zlib.crc32(f"{i}-{k}".encode()) % 900) for k in range(90))) for i, _ in items]
    spoilt = lambda t: "".join(("", "#", c + "é")[k // step % 3] if k % step == step - 1 else c for k, c in enumerate(t))
    rows = [(i, ("\u5b57" * 70 if i >= 1000 else "Vorspann é ") + spoilt(t) + "\u5b57" * 40) for i, t in [*items, *bare]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([*items, *bare], "item_id long, text string")).collect()
    assert all(r.doc_id in {x.item_id for x in r.leaks} for r in found) and len(found) == 2 * len(items)


def tables_of(items):
    return decontaminate.Tables(items, decontaminate.embed([t for _, t in items]), 10)


def test_decontamination_blocks_are_bounded():
    """Tables of thousands of short items take what a block is counted at."""
    import pickle

    rng = random.Random(3)
    for n, size in ((2000, 12), (500, 100), (20, 5000)):
        items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(size - 1)) + "x") for i in range(n)]
        counted = sum(decontaminate.ITEM_COST + decontaminate.BYTE_COST * size for _ in items)
        spent = len(pickle.dumps(tables_of(items))) - len(tables_of(items).grams) * (1 << decontaminate.FILTER_BITS)
        assert spent <= 1.1 * counted
    assert decontaminate.TABLE_BYTES * decontaminate.BLOCKS <= 256 << 20


def random_edits(rng, t, rate):
    out = list(t)
    for k in rng.sample(range(len(out)), int(len(out) * rate)):
        out[k] = rng.choice([rng.choice("abcdefghij"), "", out[k] + rng.choice("klmnopqrst")])
    return "".join(out)


@pytest.mark.parametrize("spoil", [lambda r, t: random_edits(r, t, 0.05), lambda r, t: random_edits(r, t, 0.08), lambda r, t: random_edits(r, t, 0.095)] + [lambda r, t, n=n: "".join((c + "x" if k % (3 * n) == 0 else "q" if k % n == 0 else c) if k % n == 0 else c for k, c in enumerate(t, 1)) for n in (10, 11, 12)])
def test_decontamination_recall(spoil):
    """What a brute force would find of random and of evenly spread edits up to the threshold."""
    rng = random.Random(21)
    items = [(i, " ".join("".join(rng.choice("aeionrstl") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(12, 40)))) for i in range(60)]
    tables = tables_of(items)
    noise = "some other text that stands around it and means nothing "
    spoilt = [noise + spoil(rng, decontaminate.normal(t)) + " " + noise for _, t in items]
    near = [levenshtein_search(t, s) <= len(t) // 10 for (_, t), s in zip(items, spoilt, strict=True)]
    found = [any(x[0] == i for x in row) for (i, _), row in zip(items, tables.leaks(pa.array(spoilt)), strict=True)]
    assert sum(near) > 30 and sum(f for f, n in zip(found, near, strict=True) if n) >= 0.97 * sum(near)
    assert not any(f and not n for f, n in zip(found, near, strict=True))


def test_decontamination_odd_tables(spark):
    """Repeated rows and items, ties, a long text, empty tables."""
    item = "the quick brown fox jumps over the lazy dog and then goes home"
    docs = spark.createDataFrame([(1, item), (1, item), (2, f"{item} {item}"), (3, "x " * 200_000 + item.upper())], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    got = sorted((r.doc_id, [tuple(x) for x in r.leaks]) for r in decontaminate.find_leaks(docs, items).collect())
    one = lambda at: [(7, at, len(item), 0), (8, at, len(item), 0)]
    assert got == [(1, one(0)), (1, one(0)), (2, one(0)), (3, one(400_000))]
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    assert [r.leaks for r in decontaminate.find_leaks(docs, items.limit(0)).collect()] == [[]] * 4


def test_decontamination_short_items(spark):
    """Items under 32 bytes: exactly or by as many edits as their length allows; ``min_chars`` leaves short ones out."""
    items = spark.createDataFrame([(1, "tiny"), (2, "quartz lamp"), (3, "nineteen letters ok")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a Tiny one"), (2, "the quarz lamp"), (3, "the qarz lamp"), (4, "字字ninetXen letters ok字"), (5, "tinny")], "doc_id long, text string")
    got = {r.doc_id: [(x.item_id, x.start, x.edits) for x in r.leaks] for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {1: [(1, 2, 0)], 2: [(2, 4, 1)], 3: [], 4: [(3, 2, 1)], 5: []}
    assert {x.item_id for r in decontaminate.find_leaks(docs, items, min_chars=12).collect() for x in r.leaks} == {3}


def test_urls(spark):
    captures = [(1, "http://a.b.com/x/y", 5), (2, "https://b.com/", 15), (3, "HTTP://U:p@A.B.com:80/x", 25), (4, None, 5), (5, "nonsense", 5), (6, "http://a.b.com/x", None), (7, "http://c.com/x/yy", 12), (8, "http://a.b.com/", 20)]
    day = lambda df, c: df.withColumn(c, F.date_add(F.lit("2024-01-01").cast("date"), F.col(c)))
    changes = [("bad", False, "domain", "b.com", "add", 10), ("bad", False, "domain", "b.com", "remove", 20), ("bad", False, "domain", "b.com", "add", 20), ("bad", False, "domain", "b.com", "add", 22),
               ("bad", False, "host", "a.b.com", "add", 0), ("bad", False, "host", "a.b.com", "remove", 10), ("good", True, "path", "a.b.com/x", "add", 20), ("sect", False, "path", "c.com/x/y", "add", 0), (None, False, "host", "c.com", "add", 0)]
    clash = ("allowed", "listed", "pattern", "salt", "list", "__x.y", "__id", "__lists")
    c = day(spark.createDataFrame([(*x, "old", *clash) for x in captures], "page_id long, url string, fetched int, lists string, " + ", ".join(f"`{k}` string" for k in clash)), "fetched")
    e = day(spark.createDataFrame(changes, "list string, allows boolean, kind string, pattern string, action string, at int"), "at")
    assert [r[k] for k in clash for r in filter_urls(c, e).collect()] == [k for k in clash for _ in captures]
    got = {r.page_id: (r.lists, r.blocked) for r in filter_urls(c, e).collect()}
    assert got == {1: (["bad"], True), 2: (["bad"], True), 3: (["bad", "good"], False), 4: ([], False), 5: ([], False), 6: ([], False), 7: ([], False), 8: (["bad"], True)}
    assert filter_urls(c, e.limit(0)).where("blocked").count() == 0 and filter_urls(c.limit(0), e).count() == 0


@pytest.mark.parametrize("period", [86_400 * 3, 86_400 * 360])
def test_urls_brute(spark, monkeypatch, period):
    """Foreign patterns, hot ones and repeated rows against a loop over all captures and changes."""
    monkeypatch.setattr(url_filter, "HOT_ROWS", 5)
    monkeypatch.setattr(url_filter, "PERIOD_S", period)
    rng = random.Random(23)
    hosts = ["a.com", "b.a.com", "c.org", "[::1]", "x.y.z.net"]
    captures = [(i, f"http://{rng.choice(hosts[:1] * 6 + hosts)}{rng.choice(['', ':80'])}/" + "/".join(rng.choice("pqR") for _ in range(rng.randrange(4))), rng.randrange(40)) for i in range(150)]
    captures += captures[:20]
    captures += [(i, *captures[k][1:]) for k, i in zip(range(40, 80), [None] * 20 + [7] * 20, strict=True)]  # rows of no id and of one
    target = lambda: rng.choice([("host", rng.choice(hosts)), ("domain", rng.choice(["a.com", "com", "net", "z.net", "other.de"])), ("path", rng.choice(["a.com/p", "a.com/p/q", "c.org/R", "[::1]/p"]))])
    changes = [(rng.choice(["l1", "l2"]), *target(), rng.choice(["add", "add", "remove"]), rng.randrange(40)) for _ in range(60)]
    day = lambda df, c: df.withColumn(c, F.date_add(F.lit("2024-01-01").cast("date"), F.col(c)))
    e = day(spark.createDataFrame([(name, name == "l2", *x) for name, *x in changes], "list string, allows boolean, kind string, pattern string, action string, at int"), "at")
    want = []
    for i, url, t in captures:
        _, _, rest = url.partition("://")
        host, _, path = rest.partition("/")
        host = host if host.startswith("[") and not host.endswith(":80") else host.removesuffix(":80")
        parts = [x for x in path.split("/") if x]
        fits = lambda kind, p: p == host if kind == "host" else (p == host or host.endswith("." + p)) and "." in p if kind == "domain" else p in [host + "/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)]  # noqa: B023, E731
        found = set()
        for name in ("l1", "l2"):
            for kind, p in {(k, p) for n, k, p, _, _ in changes if n == name and fits(k, p)}:
                past = [(at, action == "add") for n, k, q, action, at in changes if (n, k, q) == (name, kind, p) and at <= t]
                if past and max(past)[1]:
                    found.add(name)
        want.append((i, sorted(found), "l1" in found and "l2" not in found))
    c = day(spark.createDataFrame(captures, "page_id long, url string, fetched int"), "fetched")
    in_order = lambda rows: sorted(rows, key=str)
    assert in_order((r.page_id, r.lists, r.blocked) for r in filter_urls(c, e).collect()) == in_order(want)


def test_urls_case(spark):
    """Hosts in any case, paths in their own."""
    captures = spark.createDataFrame([(1, "http://EXAMPLE.com/Docs/a"), (2, "http://example.com/docs/a"), (3, "http://example.com/Docs/A"), (4, "http://b.Example.com/")], "page_id long, url string").withColumn("fetched", F.lit("2024-01-05"))
    changes = [("docs", False, "path", "Example.com/Docs", "add"), ("deep", True, "path", "example.com/Docs/A", "add"), ("host", False, "host", "B.example.com", "add")]
    entries = spark.createDataFrame(changes, "list string, allows boolean, kind string, pattern string, action string").withColumn("at", F.lit("2024-01-01"))
    got = {r.page_id: (r.lists, r.blocked) for r in filter_urls(captures, entries).collect()}
    assert got == {1: (["docs"], True), 2: ([], False), 3: (["deep", "docs"], False), 4: (["host"], True)}


def test_toxicity(spark):
    rng = random.Random(12)
    names = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = [rng.choice(names) for _ in range(rng.randrange(5, 80))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty!", "Horrid" + rng.choice(names)]))
        rows.append((i, " ".join(w), 0.5))
        labels.append((i, int(toxic)))
    rows += [(2000, None, 0.5), (2001, "", 0.5), (2002, "x" * 100_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (1, None), (5000, 1), (0, 0)], "doc_id long, toxic int")
    fold = F.when(F.col("id") % 7 == 2, None).otherwise((F.col("id") % 7 == 3).cast("int"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.train(docs, marks, fold)).collect()}
    held = [(got[i].predicted, t) for i, t in labels if i % 7 == 2]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[2000].predicted and not got[2001].predicted and got[2000].score == got[2001].score
    none = toxicity.score_toxicity(docs, toxicity.train(docs, marks.where("toxic = 0"), fold))
    assert none.columns == ["doc_id", "text", "score", "predicted"] and none.agg(F.max("score")).first()[0] == 0


def brute_kneser_ney(rows, word):
    """Log of toxic over ordinary likelihood of a word, from (text, toxic) rows: sets of texts, no hashes, no packing."""
    head, seen = (lambda w: w.encode()[: toxicity.HEAD]), ({}, {})
    for text, toxic in rows:
        for w in set(text.lower().split()):
            seen[toxic][w] = seen[toxic].get(w, 0) + 1
    every, p = set(seen[0]) | set(seen[1]), []
    h, d = head(word), toxicity.DISCOUNT
    pooled = {w: seen[0].get(w, 0) + seen[1].get(w, 0) for w in every}
    of_head = sum(n for w, n in pooled.items() if head(w) == h)
    for own in seen:
        heads = {}
        for w, n in own.items():
            heads[head(w)] = heads.get(head(w), 0) + n
        total, freed = sum(heads.values()), sum(min(n, d) for n in heads.values())
        continuation = sum(head(w) == h for w in every) / len(every)
        p_head = (max(heads.get(h, 0) - d, 0) + freed * continuation) / total if of_head else freed / total
        shared = pooled.get(word, 0) / of_head if pooled.get(word) else 1.0  # an unknown word: the class's share for rare words
        kept = sum(min(n, d) for w, n in own.items() if head(w) == h)
        p_rest = (max(own.get(word, 0) - d, 0) + kept * shared) / heads[h] if heads.get(h) else shared
        p.append(p_head * p_rest)
    return np.log(p[1]) - np.log(p[0])


def toxic_rows(seed, n=400):
    rng = random.Random(seed)
    names = [rng.choice(["stem", "other", "ab", "longer", "x"]) + rng.choice("abcde") * rng.randrange(4) + rng.choice(["", "", "ing", "Ed"]) for _ in range(150)]
    text = lambda t: " ".join(rng.choice(names[:120] if t else names[30:]) for _ in range(rng.randrange(3, 25)))
    return [(text(i % 4 == 0), int(i % 4 == 0)) for i in range(n)]


def test_toxicity_is_kneser_ney(spark):
    rows = toxic_rows(18)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, (F.col("id") % 5 == 3).cast("int")).shared.value
    words = sorted({w for t, _ in rows for w in t.lower().split()}) + ["stemzzz", "never", "ab", "abq"]
    keys = [toxicity._word_key(h, r)[0] for _, h, r in (next(toxicity.units(pa.array([w]))) for w in words)]
    for of, some in ((0, [r for i, r in enumerate(rows) if i % 5 != 3]), (1, rows)):
        assert np.allclose(model.gains(np.array(keys), of), [brute_kneser_ney(some, w) for w in words], atol=1e-4)


def test_toxicity_judged(spark):
    rng = random.Random(19)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (0, 1, 7, 8, 9, 40)] + [None]
    value = lambda key: (key % np.uint64(97)).astype(np.float32) - 40
    got = list(zip(*toxicity.judged(pa.array(texts), value), strict=True))
    for t, (total, n, word, span) in zip(texts, got, strict=True):
        g = [float(value(toxicity._word_key(h, r))[0]) for w in (t or "").split() for _, h, r in toxicity.units(pa.array([w]))]
        best = max((sum(g[k : k + 8]) / 8 for k in range(max(1, len(g) - 7))), default=0)
        assert (n, word) == (len(g), max(g, default=0)) and np.allclose([total, span], [sum(g), best])


@pytest.mark.parametrize("hops", [False, True])
def test_toxicity_tables_that_are_not_broadcast(spark, monkeypatch, hops):
    """Beyond MODEL_BYTES the tables stay distributed, beyond COARSE ranges there are two hops: the same scores; repeated rows, empty tables,
    clashing names."""
    rows = toxic_rows(20)
    docs = spark.createDataFrame([*[(i, t, "x", 1) for i, (t, _) in enumerate(rows)], (3, rows[3][0], "x", 1), (900, None, "y", 2), (901, "", "y", 2), (None, "ab stem", "z", 3)], "doc_id long, text string, predicted string, bucket int").withColumn("__bucket", F.lit("kept"))
    marks = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, toxic int")
    fold = (F.col("id") % 5 == 3).cast("int")
    score = lambda: sorted((str(r.doc_id), r.bucket, r.predicted, r.score) for r in toxicity.score_toxicity(docs, toxicity.train(docs, marks, fold)).collect())
    small = score()
    monkeypatch.setattr(toxicity, "MODEL_BYTES", 0)
    if hops:
        monkeypatch.setattr(exchange, "COARSE", 2)
        monkeypatch.setattr(exchange, "BLOCK", 5)
    large = score()
    assert [x[:3] for x in small] == [x[:3] for x in large] and np.allclose([x[3] for x in small], [x[3] for x in large], atol=1e-9)
    trained = toxicity.train(docs, marks, fold)
    assert trained.shared is None and toxicity.score_toxicity(docs.limit(0), trained).count() == 0
    assert toxicity.train(docs.limit(0), marks, fold) is None and toxicity.train(docs, marks.limit(0), fold) is None


def test_toxicity_keeps_every_head(spark):
    """Far more heads than chance would keep apart in 2^20 slots: each toxic one has its own counts."""
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(5))
    heads = [name(k * 137) for k in range(60_000)]
    rows = [(10 * g + n, " ".join(heads[2000 * g : 2000 * g + 2000]), int(g % 10 == 0)) for g in range(30) for n in range(8)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, F.when(F.col("id") % 10 == 7, 1).otherwise(0)).shared.value
    for of in (0, 1):
        total = toxicity.judged(pa.array(heads), lambda key: model.gains(key, of))[0]  # noqa: B023
        assert ((total > 0) == (np.arange(60_000) // 2000 % 10 == 0)).all()


def test_toxicity_rows_do_not_grow_with_ranges(monkeypatch):
    """A task sends as many rows as there are coarse ranges at most, whatever the number of ranges."""
    monkeypatch.setattr(toxicity, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))}))
    words = " ".join(f"{k * 7919:x}q" for k in range(40_000))
    batch = pa.RecordBatch.from_pydict({"fold": pa.array([0], pa.int32()), "toxic": pa.array([0], pa.int32()), "text": [words]})
    assert [sum(b.num_rows for b in toxicity._counter(parts)([batch])) for parts in (8, 4096, 1 << 18)] == [8, 4096, 4096]


def test_toxicity_counts_beyond_16_bits():
    batch = pa.RecordBatch.from_pydict({"fold": pa.array([0] * 70_000 + [1] * 2, pa.int32()), "toxic": pa.array([0] * 70_000 + [1] * 2, pa.int32()), "text": ["hello"] * 70_002})
    keys, *counts = toxicity._pack_counts([batch])
    row = toxicity._tables(exchange.send(0, keys, 1, *counts)).to_pylist()[0]
    assert row["totals"] == [70_000, 0, 3, 0, 1, 70_000, 2, 3, 2, 1]


PAGES = [
    ("<body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>T &amp; U</h1><p>One  two<br>three</p><p>Four</article><footer>&copy; x</footer>", "T & U\n\nOne two three\n\nFour"),
    ("<div id=main><div class=sidebar><p>Side</p></div><div class='post-body'><p>" + "A long text here, " * 10 + "</p><p>Second part.</p></div><div class=comments><p>Nice!</p></div></div>", ("A long text here, " * 10).strip() + "\n\nSecond part."),
    ("<script>var a='</p><article>';</script><style>p{}</style><main><p>Body</p><form><input>Send</form></main>", "Body"),
    ("<article><p>cut off &amp here<p>and the en", "cut off & here\n\nand the en"), ("<article><p>text<a hr", "text"), ("just text", "just text"), ("", ""), (None, ""), ("<<<>>>&#x41;", "<<<>>>A"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert main_text(html) == text


LONG = "A long text here, with much to say, " * 6


WHOLE = [
    (f"<p don't><p>{LONG}</p><p>{LONG}</p>", 2), (f'<p title="5" tall">{LONG}</p><p>{LONG}</p>', 2), (f"<p a='x>y' b = \"<p>\" c=d\"e><a href=x?y=\"z>{LONG}</a></p><p>{LONG}</p>", 2),
    (f'<html><body><form id="aspnetForm"><nav>Home</nav><p>{LONG}</p><p>{LONG}</p></form></body></html>', 2), (f"<form>{LONG}</form>", 1), (f"<form><p>{LONG}</p></form>", 1),
    (f'<div class="login"><p>{LONG}</p><p>{LONG}</p></div><div><p>short</p></div>', 2), (f'<div class="related-content"><p>{LONG}</p><p>{LONG}</p></div><div><p>tiny</p></div>', 2),
]


@pytest.mark.parametrize(("html", "n"), WHOLE)
def test_no_page_is_lost(html, n):
    """Stray quotes, forms about a whole page, and names of chrome about all there is."""
    assert main_text(html).split("\n\n") == [LONG.strip()] * n


@pytest.mark.parametrize(
    "html",
    [
        f"<div class='layout has-sidebar'><div><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar><p>Side</p></div></div>",
        f"<div id='no-comments'><p>{LONG}</p><p>{LONG}</p></div><div class=comments><p>Nice!</p></div>",
        f"<div class='sidebar-layout'><div><p>{LONG}</p><p>{LONG}</p></div></div><p>Imprint</p>",
        f"<div class='widget'><article><p>{LONG}</p><p class='related-work'>{LONG}</p><div class=related><p>More</p></div></article></div><div class=comments><article>Nice!</article></div>",
        f"<div><p>{LONG}</p><p>{LONG}</p></div><div class='comment-list'><p>{'Nice! ' * 90}</p><p>{'Good! ' * 90}</p></div>",
    ],
)
def test_names_are_no_proof(html):
    assert [t for t in main_text(html).split("\n\n") if t != "Imprint"] == [LONG.strip()] * 2


@pytest.mark.parametrize("name", ["id='cookies'", "class='ad-hoc-analysis'", "class='promo-code-history'"])
def test_names_within_articles(name):
    """Sections of an article that are named as what it is about; adverts and comments within it go."""
    html = f"<nav><a href=x>Home</a></nav><article><h1>On them</h1><p>{LONG}</p><section {name}><h2>Part</h2><p>{LONG}</p><p>{LONG}</p></section><div class='ad-slot'>Buy!</div><p>{LONG}</p><section class=comments><p>{LONG}</p></section></article>"
    assert main_text(html).split("\n\n") == ["On them", LONG.strip(), "Part", *[LONG.strip()] * 3]


def test_density_is_what_it_says():
    """Composite densities and their sums, the core and the threshold, against the definition node by node."""
    rng = random.Random(22)
    for _ in range(60):
        tags = ["div", "section", "ul", "p", "span"]

        def some(depth):
            inner = "".join(some(depth - 1) for _ in range(rng.randrange(4))) if depth else ""
            words = " ".join("word" * rng.randrange(1, 4) for _ in range(rng.randrange(12)))
            link = f"<a href=x>{'link ' * rng.randrange(4)}</a>" if rng.random() < 0.4 else ""  # noqa: S311
            tag = rng.choice(tags[:3] if inner else tags)
            return f"<{tag}>{words}{link}{inner}</{tag}>"

        root = html_density.parse("".join(some(4) for _ in range(3)))

        def counts(x):
            c = np.array([x.own[0], x.own[1], x.own[2], x.own[3]], float)
            return c + sum((counts(k) + [0, 0, 1, 0] for k in x.kids), np.zeros(4))

        html_density.measure(root)
        nodes = html_density._every(root)
        chars, link_chars = counts(root)[:2]
        for x in nodes:
            c, lc, t, lt = counts(x)
            t, lt = max(t, 1), max(lt, 1)
            base = 1 + np.log(c / max(1, c - lc) * lc + link_chars / max(1, chars) * c + np.e)
            want = 0 if not c else c / t * np.log(max(1, c / max(1, lc) * t / lt)) / np.log(base)
            assert np.isclose(x.density, want)
        for x in nodes:
            assert np.isclose(x.sum, sum(k.density for k in x.kids))
        core = html_density._core(root)
        assert core.sum == max(x.sum for x in nodes)
        path = html_density._path(core)
        got, held = html_density.chosen(root), {id(x) for x in path}
        least = min(x.density for x in path)
        dense = [x for x in nodes if id(x) not in held and x.density >= least > 0 and x.up and id(x.up) in held and x.up is not core]
        assert core in got and {id(html_density._core(x)) for x in dense} <= {id(x) for x in got}


def test_deep_and_repeated_pages(spark):
    import time

    for deep in ("<div>" * 20_000 + "x", "<div><li>a</li>" * 20_000, "<div></b></section>" * 20_000, "<li><ul><div>" * 10_000 + "<li>b"):
        began = time.perf_counter()
        main_text(deep)
        assert time.perf_counter() - began < 10
    page = f"<article><p>{LONG}</p></article>"
    got = extract_text(spark.createDataFrame([(1, page, "a"), (1, page, "a"), (None, page, None)], "page_id long, html string, text string"))
    assert [r.text for r in got.collect()] == [LONG.strip()] * 3
    assert main_text("<p>" + "long text " * 300_000) == ("long text " * 300_000).strip()


def test_extract(spark):
    df = spark.createDataFrame([(i, h, "old") for i, (h, _) in enumerate(PAGES)], "page_id int, html string, text string")
    assert [r.text for r in extract_text(df).orderBy("page_id").collect()] == [t for _, t in PAGES]
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("kind", [np.uint16, np.uint32])
def test_planes(bits, kind):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, np.iinfo(kind).max, n).astype(kind)
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, bits), n, ids.itemsize, bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, tmp_path, monkeypatch, bits):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = distinct(corpus(13)) + [(3000, "<|ENDOFTEXT|> <|endoftext|> İst x́y ofﬁce's can't ΣΑΣ 12.5 日本。ok,,")]
    monkeypatch.setattr(bitplanes, "CHUNK_IDS", 1000)
    files = bitplanes.write_token_files(frame(spark, rows), path, 2, f"file://{tmp_path}", bits=bits)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitplanes.read_token_files(files).collect()}
    start, want = 0, {}
    for (i, _), e in zip(sorted(rows), Tokenizer.from_file(path).encode_batch([t or "" for _, t in sorted(rows)], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    monkeypatch.setattr(bitplanes, "RUN_FILES", 3)
    again = bitplanes.read_token_files(bitplanes.write_token_files(frame(spark, rows), path, 2, f"file://{tmp_path}", bits=bits))
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in again.collect()} == want
    odd = bitplanes.read_token_files(bitplanes.write_token_files(frame(spark, [(None, "b"), (4, "a b"), (4, None), (4, "a")]), path, 2, f"file://{tmp_path}", bits=bits)).collect()
    assert sorted((r.start, r.n_tokens, str(r.doc_id)) for r in odd) == [(0, 1, "4"), (1, 2, "4"), (3, 3, "4"), (6, 2, "None")]
    assert bitplanes.read_token_files(bitplanes.write_token_files(frame(spark, rows).limit(0), path, 2, f"file://{tmp_path}")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(monkeypatch, name):
    import public_tokenizers

    encoder = bitplanes.Encoder(open(public_tokenizers.path(name)).read())
    texts = [t or "" for _, t in corpus(14)] + ["naïve!!! (x). Étude, ÉTUDE", "a b x…, ''s don't.", "", "(É)É! É́x Ñ™ ™ <|endoftext|> <|ENDOFTEXT|>. #tag##, [Straße] ×a÷ ÿ-ß e-mail@x.y ''"]
    for size in (1, 1 << 20):
        monkeypatch.setattr(bitplanes, "PART_BYTES", size)
        monkeypatch.setattr(bitplanes, "REMEMBERED", 50 * size)
        ids, at = encoder(pa.array(texts), 7)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [[*e.ids, 7] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_best_fit():
    rng = random.Random(15)
    for _ in range(60):
        n, capacity = rng.choice([0, 1, 5, 60, 200]), rng.choice([16, 64])
        docs = [(i, rng.choice([None, "a", "a", "a", "b", "c"]), int(rng.expovariate(1 / 20)), rng.randrange(max(1, n // 2)) if rng.random() < 0.5 else 10**6 + i) for i in range(n)]
        copies = {c: sum(d[3] == c for d in docs) for _, _, _, c in docs}
        bins: dict[int, list] = {}
        for row, _, _, length, b, place in packing.pack_shard(docs, capacity):
            _, source, words, cluster = docs[row]
            fits = lambda held: (
                sum(x[1] for x in held) + length <= capacity
                and (source is None or all(docs[x[0]][1] != source for x in held))
                and all(x[0] != row and (copies[cluster] < 2 or docs[x[0]][3] != cluster) for x in held)
            )  # noqa: E731, B023
            open_ = {k: capacity - sum(x[1] for x in held) for k, held in bins.items() if fits(held)}
            assert place == sum(x[1] for x in bins.get(b, []))
            assert (b in open_ and open_[b] == min(open_.values())) if open_ else b not in bins
            bins.setdefault(b, []).append((row, length))
        assert sum(x[1] for held in bins.values() for x in held) == sum(d[2] + 1 for d in docs)


def test_pack(spark):
    rows = corpus(16)
    out = packing.pack(frame(spark, rows), capacity=50).collect()
    total = sum(len((t or "").split()) + 1 for _, t in rows)
    assert sum(r.n_places for r in out) == total and all(r.place + r.n_places <= 50 for r in out)
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(17)
    centers = rng.standard_normal((5, 16))
    x = (centers[rng.integers(0, 5, 700)] + 0.5 * rng.standard_normal((700, 16))).astype(np.float32)
    x[100:160] = x[100]  # many equal vectors
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)] + [(2000, None), (2020, [0.0] * 16), (2040, [1.0] * 15 + [None]), (2060, [float("nan")] * 16), (2080, [1.0]), (2100, [float("inf")] + [0.0] * 15)]
    ids, x = np.array([*range(700), 2080]), np.vstack([x, [[1.0] + [0.0] * 15]]).astype(float)  # a short vector has zeros behind
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [*range(0, 700, 20), 2080]
    hits = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        want = [int(ids[k]) for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert np.allclose([c for _, _, c in found], [s[ids == v][0] for _, v, _ in found])
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len(set(want) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    ragged = spark.createDataFrame([(0, [1.0]), (1, [2.0, 5.0]), (2, [0.5, 1.0, 9.0]), (2, [3.0]), (40, [])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(ragged).collect()) == [(0, 1, 2, 3.0), (0, 2, 1, 2.0), (0, 3, 2, 0.5)]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few).collect()] == [(0, 1)]
    assert ann.nearest(few.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [40, 300, 2000])
def test_equal_vectors_in_order_of_id(rows):
    """Hundreds of equal vectors among others: ids and scores exactly as a row-by-row product orders them, whatever the blocks."""
    rng = np.random.default_rng(rows)
    x = np.repeat(rng.standard_normal((rows // 20, 24)), 20, axis=0)[rng.permutation(rows)]
    ids, q = rng.permutation(rows) * 3, np.vstack([x[:50], rng.standard_normal((50, 24))])
    for v, (got, scores) in zip(q, ann.Index(ids, x, ann.Projection(24, np.linalg.norm(x, axis=1).max())).search(q, 33), strict=True):
        exact = (x * v).sum(1)
        score = dict(zip(ids.tolist(), exact.tolist(), strict=True))
        assert scores.tolist() == [score[i] for i in got.tolist()]
        assert got.tolist() == sorted(got.tolist(), key=lambda i: (-score[i], i))
        for value in set(scores[:-1].tolist()) - {scores[-1]}:  # of those equal to one found all are found
            assert {i for i in got.tolist() if score[i] == value} == set(ids[exact == value].tolist())
        last = sorted(ids[exact == scores[-1]].tolist())  # and of those equal to the last the least
        assert [i for i in got.tolist() if score[i] == scores[-1]] == last[: int((scores == scores[-1]).sum())]


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "norms", "equal"])
def test_index_recall(kind):
    rng = np.random.default_rng(24)
    x = rng.standard_normal((6000, 32))
    if kind == "clustered":
        x = rng.standard_normal((40, 32))[rng.integers(0, 40, 6000)] + 0.3 * x
    elif kind == "norms":
        x *= rng.exponential(1, 6000)[:, None]
    elif kind == "equal":
        x[:3000] = x[0]
    ids, q = rng.permutation(6000), x[::100]
    found = ann.Index(ids, x, ann.Projection(32, np.linalg.norm(x, axis=1).max())).search(q, 21)
    hits = 0
    for v, (got, scores) in zip(q, found, strict=True):
        s = x @ v
        best = np.lexsort((ids, -s))[:21]
        hits += len(set(ids[best].tolist()) & set(got.tolist()))
        assert np.allclose(scores, [s[ids == i][0] for i in got]) and (np.diff(scores) <= 1e-12).all() and len(got) == 21
    assert hits >= 0.97 * 21 * len(q)


@pytest.mark.parametrize("operator", [dedup_lines, dedup_substrings])
def test_clashing_names(spark, operator):
    rows = [(i, "a line that two have\n" + "w " * 60, i, "x", "y", 9, 9) for i in (1, 2)]
    names = ["__bucket", "___bucket", "n x", "n_words", "n_lines"]
    got = operator(spark.createDataFrame(rows, "doc_id long, text string, `__bucket` int, `___bucket` string, `n x` string, n_words int, n_lines int")).collect()
    new = {"n_lines", "n_dropped"} if operator is dedup_lines else {"n_words", "n_removed"}
    assert all([r[c] for c in names if c not in new] == [x for c, x in zip(names, row[2:], strict=True) if c not in new] for r, row in zip(sorted(got), rows, strict=True))


@pytest.mark.parametrize("operator", [dedup_lines, dedup_substrings, ngram_components, packing.pack])
def test_empty(spark, operator):
    assert operator(frame(spark, []).limit(0)).count() == 0


