from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import conversation_trie, quality_rules, queries, vector_codes

# ---------------------------------------------------------------- vector codes


def lloyd(rows, parts, entries, rounds, scale=256):
    """Whole assignments each round, in Python's integers."""
    kept = [(i, l, [math.floor(scale * x) for x in v]) for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, None
    width = max(1, -(-max(len(v) for *_, v in kept) // parts))
    kept = [(i, l, v + [0] * (width * parts - len(v)), v) for i, l, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for *_, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for *_, v, _ in kept]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (*_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by = defaultdict(int)
    for (_, l, *_), e in zip(kept, errors, strict=True):
        by[l] += e
    out = Counter((i, "".join(f"{k:02x}" for _, k in f), e, by[l]) for (i, l, *_), f, e in zip(kept, found, errors, strict=True))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


VECTORS = "vec_id long, label int, embedding array<double>, codes string, part int"


def check_codes(spark, rows, parts=4, entries=8, rounds=2):
    df = spark.createDataFrame([(i, l, v, "x", 1) for i, l, v in rows], VECTORS).repartition(3)
    out, books = vector_codes.encode_vectors(df, parts=parts, entries=entries, rounds=rounds)
    want, sha = lloyd(rows, parts, entries, rounds)
    assert Counter(map(tuple, out.select("vec_id", "code", "error", "label_error").collect())) == Counter(want)
    if want:
        assert books.sha256() == sha
    return out, books


def test_codes_equal_whole_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), rng.normal(0, 0.3, 8).tolist()) for i in range(200)]
    out, books = check_codes(spark, rows)
    r = out.where("vec_id = 11").first()
    x = np.floor(256 * np.array(rows[11][2])).astype(int)
    assert ((books.decode(r["code"]) - x) ** 2).sum() == r["error"]
    check_codes(spark, rows, rounds=0)
    check_codes(spark, rows, rounds=4)


def test_codes_of_odd_rows(spark):
    a = [0.5, -0.25, 1.0, 0.0]
    rows = [(1, 1, a), (1, 1, a), (1, None, [0.25, 0.0, 0.0, 1.0]), (2, None, None), (3, 1, [0.1, None, 0.2, 0.3]), (4, 1, [float("nan"), 0.0, 0.0, 0.0]), (5, 2, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, 1, [0.0, -0.0, 0.001, -0.001]), (7, 1, [0.5]), (8, 2, []), (-9, 2, [1e9, -1e9, 3e8, 0.0]), (6, None, a)]
    check_codes(spark, rows, entries=4)
    check_codes(spark, rows, entries=256)
    check_codes(spark, [], entries=4)
    check_codes(spark, [(1, 1, None)])


def test_codes_with_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, [0.5, 0.5, 0.5, 0.5] if i % 2 else rng.normal(0, 1, 4).tolist()) for i in range(400)]
    check_codes(spark, rows, parts=2, entries=16, rounds=3)


def test_a_round_sends_what_changed(spark):
    """Parts that keep their entry send nothing."""
    changes = vector_codes.Changes((1, 4, 2))
    x = np.array([[1, 2], [3, 4], [5, 6]])
    changes.add(0, np.array([1, 1, 2], np.uint8), x, 1)
    changes.add(0, np.array([1, 1, 3], np.uint8), x, -1)
    rows = changes.rows()
    assert rows["entry"] == [2, 3] and rows["n"] == [1, -1] and [list(map(int, s)) for s in rows["sums"]] == [[5, 6], [-5, -6]]


def test_distances_are_exact_at_any_size():
    x, book = np.array([[1 << 60, 0]]), np.array([[(1 << 60) - 1, 0], [1 << 60, 1]])
    code, far = vector_codes.nearest_entries(x, book)
    assert code.tolist() == [0] and far.tolist() == [1]


# ---------------------------------------------------------------- conversation trie


def trie(conversations: dict) -> set:
    """conversations: id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    if not members:
        return set()
    out = set()
    for node, own in members.items():
        below = [m for m in members if m[: len(node)] == node]
        child = lambda m: [x for x in members if len(x) == len(m) + 1 and x[: len(m)] == m]
        ends = sorted(c for c in own if len(conversations[c]) == len(node))
        out.add((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(child(node)), sum(not child(m) for m in below),
            sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


SHOWN = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(spark, conversations, shuffles=4):
    rows = [(c, k, role, text) for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    turns = conversation_trie.turns_of(df, by=queries.F.col("conv_id")).select("conv_id", "turns")
    bare = [c for c, turns in conversations.items() if not turns]
    if bare:
        turns = turns.unionByName(spark.createDataFrame([(c,) for c in bare], "conv_id long").select("conv_id", queries.F.array().cast(turns.schema["turns"].dataType).alias("turns")))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        out = conversation_trie.prefix_trie(conversation_trie.paths_of(turns)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r["pos"] for r in out) == list(range(len(out)))
    spans = {r["pos"]: r for r in out}
    for r in out:  # intervals nest, and hold exactly what is deeper until the next node that isn't
        assert all(spans[p]["depth"] > r["depth"] for p in range(r["pos"] + 1, r["end"] + 1))
        assert r["end"] + 1 not in spans or spans[r["end"] + 1]["depth"] <= r["depth"]
    return {tuple(r[c] for c in SHOWN) for r in out}


@pytest.mark.parametrize("shuffles", [1, 3, 17])
def test_trie_over_ranges(spark, shuffles):
    rng = np.random.default_rng(5)
    convs = {c: [("user", "abc"[rng.integers(3)] * int(rng.integers(1, 4))) for _ in range(rng.integers(0, 6))] for c in range(60)}
    convs |= {100 + c: [("user", "hot"), ("assistant", "same"), ("user", "end")] for c in range(70)}  # over several ranges
    convs |= {200 + c: [("user", "hot"), ("assistant", "same")] for c in range(30)}
    assert found_trie(spark, convs, shuffles) == trie(convs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=5), min_size=1, max_size=14), st.lists(st.integers(0, 13), max_size=4))
def test_ranges_add_up(paths, cuts):
    """The merging of ranges, without Spark: shares of a node make the whole, whatever the cuts."""
    digest = lambda x: hashlib.md5(x.encode()).digest()
    rows = sorted((b"".join(map(digest, p)), c, [len(x) for x in p]) for c, p in enumerate(paths))
    edges = sorted({0, len(rows), *(c for c in cuts if c < len(rows))})
    parts = [rows[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    n, offset = Counter(), 0
    for k, part in enumerate(parts):
        own = conversation_trie.Range(k, parts[k - 1][-1][0] if k else None, parts[k + 1][0][0] if k + 1 < len(parts) else None, offset)
        own.read((c, p, lengths) for p, c, lengths in part)
        for batch in own.rows():
            for r in batch.to_pylist():
                if r["kind"] == conversation_trie.NODE:
                    n["closed"] += 1
                    n["members"] += r["n_convs"]
                elif r["kind"] == conversation_trie.SHARE:
                    n["members"] += r["n_convs"]
                    n["edge"] += r["pos"] is not None
        offset += len(own.depth) - own.base
    distinct = {tuple(p[:d]) for p in paths for d in range(len(p) + 1)}
    assert n["closed"] + n["edge"] == offset == len(distinct)
    assert n["members"] == sum(len(p) + 1 for p in paths)


def rebuild(rows):
    """From (conv_id, turn, role, text), as the contract of the query says."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, path string, turns int"


def check_op12(spark, rows, folder):
    spark.createDataFrame([(*r, "p", 1) for r in rows], CONVERSATIONS).write.parquet(f"{folder}/conversations.parquet")
    out = queries.op12_conversation_trie(spark, str(folder)).collect()
    assert Counter(tuple(r[c] for c in SHOWN) for r in out) == Counter(trie(rebuild(rows)))


def test_op12(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(c), int(t), "user" if t % 2 == 0 else "assistant", "xy"[rng.integers(2)] * int(rng.integers(0, 5))) for c in range(80, 330, 3) for t in range(rng.integers(1, 8))]
    rows += [(100, t, "user", f"é{t}") for t in range(7)]  # the head of a hundred
    rows += [(401, None, None, "first"), (401, 0, "user", None), (401, 1, None, None), (402, 0, "user", ""), (402, 0, "user", ""), (None, 0, "user", "nobody"), (500, 3, "a", "b"), (500, 3, "ab", ""), (777, 0, "user", "z" * 100_000)]
    rows += [(c, 0, "user", "same") for c in range(600, 660)]
    check_op12(spark, rows, tmp_path / "some")
    check_op12(spark, [], tmp_path / "none")
    check_op12(spark, [(None, 1, "user", "x")], tmp_path / "null")


# ---------------------------------------------------------------- quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k in range(len(w) - 2) if runs[(w[k], w[k + 1], w[k + 2])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "a", "a b", "a b c a b c", "a a a a", "x\ny\nx\n\n\nx", "x\r\ny\r\nx", " x\nx", "é ü z # | <>", "퟿ \U0001f600   q", "one\ntwo\n", "\n\n", "##", "a b c\na b c\nA b c",
]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #|\n\t\ré !.", max_size=60), st.text(max_size=20)), max_size=8))
def test_measures(texts):
    texts = [None if t is None else t.encode("utf-8", "replace").decode() for t in [*texts, *TEXTS]]
    found = quality_rules.measures(pa.array(texts, pa.string()))
    assert [tuple(int(found[k][i]) for k in quality_rules.MEASURES[:5]) for i in range(len(texts))] == [base(t) for t in texts]


def test_measures_over_chunks(monkeypatch):
    monkeypatch.setattr(quality_rules.B, "CHUNK", 64)
    monkeypatch.setattr(quality_rules.B.chunks, "__defaults__", (64,))
    texts = [*TEXTS, "word " * 200, *TEXTS, "a b c d e f g. " * 20]
    found = quality_rules.measures(pa.array(texts))
    assert [tuple(int(found[k][i]) for k in quality_rules.MEASURES[:5]) for i in range(len(texts))] == [base(t) for t in texts]


def test_expectation_maximisation_finds_the_rules_worth():
    """Votes drawn from known rates: the fit recovers them and the classes, and a rule that is wrong on purpose is muted."""
    rng = np.random.default_rng(8)
    n, rules = 20_000, 7
    good = rng.random(n) < 0.8
    rates = np.array([[[0.6, 0.3, 0.1]] * 5 + [[0.34, 0.33, 0.33], [0.1, 0.3, 0.6]], [[0.03, 0.2, 0.77]] * 5 + [[0.34, 0.33, 0.33], [0.6, 0.3, 0.1]]])
    v = np.array([[rng.choice(3, p=rates[int(g), r]) - 1 for r in range(rules)] for g in good], np.int8)
    distinct, inverse, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    model = quality_rules.fit(distinct, counts.astype(float))
    assert abs(model.share - 0.8) < 0.03
    assert np.abs(model.rates[:, :5] - rates[:, :5]).max() < 0.05
    assert np.allclose(model.rates[0, 6], model.rates[1, 6])
    assert ((model.posterior(distinct)[inverse.ravel()] >= 0.5) == good).mean() > 0.97


def judged_by_hand(texts):
    """Votes, classes and verdicts of all texts, one at a time in plain Python."""
    found = quality_rules.measures(pa.array(texts, pa.string()))
    rows = []
    for i in range(len(texts)):
        m = {k: int(found[k][i]) for k in quality_rules.MEASURES}
        vote = []
        for r in quality_rules.RULES:
            rate = m[r.top] / m[r.bottom] if m[r.bottom] else 0
            vote.append(0 if m[r.bottom] < r.enough else 1 if r.good[0] <= rate <= r.good[1] else 0 if r.fair[0] <= rate <= r.fair[1] else -1)
        rows.append(vote)
    p = [[0.95, 0.3, 0.1, 0.05][min(3, v.count(-1))] for v in rows]
    rules = range(len(quality_rules.RULES))
    for _ in range(500):
        rates = {}
        for r in rules:
            count = {(c, x): 0.5 + sum((q if c else 1 - q) for v, q in zip(rows, p, strict=True) if v[r] == x) for c in (0, 1) for x in (-1, 0, 1)}
            total = {c: sum(count[c, x] for x in (-1, 0, 1)) for c in (0, 1)}
            rates[r] = {k: n / total[k[0]] for k, n in count.items()}
            if rates[r][0, -1] < rates[r][1, -1] or rates[r][0, 1] > rates[r][1, 1]:
                rates[r] = {(c, x): (count[0, x] + count[1, x]) / (total[0] + total[1]) for c, x in count}
        share = (sum(p) + 1) / (len(rows) + 2)
        new = []
        for v in rows:
            odds = math.log((1 - share) / share) + sum(math.log(rates[r][0, v[r]] / rates[r][1, v[r]]) for r in rules)
            new.append(1 / (1 + math.exp(odds)))
        done = max(abs(a - b) for a, b in zip(p, new, strict=True)) < 1e-12
        p = new
        if done:
            break
    return p


def prose(rng, n, mark=""):
    letters = "etaoinshrdlu"
    words = ["".join(letters[k] for k in rng.integers(0, 12, rng.integers(3, 8))) + mark for _ in range(n)]
    return "\n".join(" ".join(words[k : k + 12]) + "." for k in range(0, n, 12))


def test_op13(spark, tmp_path):
    rng = np.random.default_rng(9)
    clean = [prose(rng, int(rng.integers(60, 300))) for _ in range(120)]
    junk = [prose(rng, 100, mark="$$$") for _ in range(10)] + [prose(rng, 100, mark="!!").upper() for _ in range(10)] + [" | ".join(prose(rng, 100).split()) for _ in range(10)] + [(prose(rng, 24) + "\n") * 8 for _ in range(10)]
    texts = clean + junk + ["short text", None, "", "word " * 30_000, clean[0]]
    ids = [*range(len(texts) - 1), 0]  # the first id twice
    ids[-3] = None
    rows = [(i, t, "x", 1, 2) for i, t in zip(ids, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, pattern string, kept int, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_quality_rules(spark, str(tmp_path)).collect()
    p = judged_by_hand(texts)
    want = Counter()
    for i, t, q in zip(ids, texts, p, strict=True):
        m = base(t)
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        want[(i, *m, failed, not failed and q >= 0.5)] += 1
    assert Counter(map(tuple, out)) == want
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[i] for i in range(120)) and not any(kept[i] for i in range(120, 160))


def test_quality_of_an_empty_table(spark):
    out, _ = quality_rules.judge_quality(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and "votes" in out.columns
