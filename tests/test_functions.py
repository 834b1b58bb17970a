"""Scalar functions against small versions in plain Python."""

from __future__ import annotations

import array
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillstone.functions import parsing as P
from quillstone.functions import playbook as PB
from quillstone.functions import spans as SP
from quillstone.functions import text as X
from quillstone.functions import windows as WN
from quillstone.operators import reviews as R
from quillstone.sources import files as S


def norm(s):
    return " ".join((s or "").lower().split())


def column(spark, values, kind, use):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + kind)
    return [r[1] for r in df.select("i", use.alias("x")).orderBy("i").collect()]


ODD = ["", None, "a b", "x\x1cy", "a\x85b", "　 A  B ", "İx", "tab\there\n\nthere", " q"]


def test_norm(spark):
    assert column(spark, [(s,) for s in ODD], "s string", X.norm("s")) == [norm(s) for s in ODD]


def test_n_tokens(spark):
    """As many as the tokens, whatever the white space, and without the pattern that makes them."""
    white = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    draw = random.Random(7)
    texts = [None, "", " ", "\n \u3000", "a", " a", "a\tb ", "\u200bx \ufeffy", "İ\u0130 É\x1fz", *["".join(draw.choices([*white, "a", "É", "\u200b", "💡"], k=40)) for _ in range(200)], *[f"a{w}b{w}{w}c" for w in white]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.n_tokens("t").alias("n"), F.size(X.tokens("t")).alias("made"), F.col("t").isNull().alias("none")).collect()
    assert [r.n for r in got] == [r.made for r in got] and {r.n for r in got if r.none} == {0} and len(got) == len(texts)


def test_grounded(spark):
    rows = [("a clause.", "here is a clause of it"), ("", "x"), ("...", "x"), ("missing", "x"), ("“no", "no")]
    assert column(spark, rows, "a string, b string", X.grounded(F.col("a"), F.col("b"))) == [True, True, True, False, False]


WORDS = ["a", "b", "c", "d", "e"]


def texts(rng, n=3, m=6):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(m))) for _ in range(rng.randrange(n))]


def python_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def python_greedy(gold, pred):
    j = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())) if a.split() and b.split() else 0.0
    used_g, used_p = set(), set()
    for s, g, p in sorted(((-j(a, b), g, p) for g, a in enumerate(gold) for p, b in enumerate(pred))):
        if s <= -0.5 and g not in used_g and p not in used_p:
            used_g.add(g), used_p.add(p)
    return len(used_g)


def test_evidence_functions(spark):
    rng = random.Random(5)
    rows = [(texts(rng), texts(rng)) for _ in range(150)]
    g, p = X.tokens(F.array_join("g", " ")), X.tokens(F.array_join("p", " "))
    kind = "g array<string>, p array<string>"
    token = lambda xs: " ".join(xs).split()
    assert column(spark, rows, kind, X.lcs(g, p)) == [python_lcs(token(a), token(b)) for a, b in rows]
    assert column(spark, rows, kind, X.greedy_matches(F.col("g"), F.col("p"))) == [python_greedy(a, b) for a, b in rows]
    assert column(spark, rows, kind, X.multiset_overlap(g, p)) == [sum((Counter(token(a)) & Counter(token(b))).values()) for a, b in rows]


@pytest.mark.parametrize(
    ("gold", "pred", "case"),
    [(["a b"], ["x a b y"], "TP"), (["a b"], ["a", "b"], "TP"), (["a b", "c"], ["a b"], "FN"), (["a"], [], "FN"), ([], ["a"], "FP"), ([], [], "TN"), ([" "], ["a"], "FN")],
)
def test_evidence_case(spark, gold, pred, case):
    assert column(spark, [(gold, pred)], "g array<string>, p array<string>", X.evidence_case(F.col("g"), F.col("p"))) == [case]


@pytest.mark.parametrize(
    ("raw", "verdict", "state", "mode"),
    [
        ('{"verdict": "Entailment", "evidence": []}', "Entailment", "json", "strict_json"),
        ('```json\n{"verdict": "not mentioned", "evidence": ["x"]}\n```', "NotMentioned", "json", "strict_json"),
        ("<think>Entailment</think> Contradiction", "Contradiction", "not_json", "bare_label"),
        ("unclosed thought</think>{\"verdict\": \"entailment\", \"evidence\": \"q\"}", "Entailment", "json", "strict_json"),
        ('{"label": "Contradiction"}', "Contradiction", "json_wrong_schema", "json_wrong_schema"),
        ('{"verdict": "maybe", "evidence": []}', None, "json_wrong_schema", "unparseable"),
        ('} {"verdict": "Entailment", "evidence": []}', "Entailment", "not_json", "bare_label"),
        ("", None, "not_json", "empty"), (None, None, "not_json", "empty"), ("no idea", None, "not_json", "unparseable"),
    ],
)
def test_verdict_reply(spark, raw, verdict, state, mode):
    got = column(spark, [(raw,)], "s string", P.parse_verdict_reply(F.col("s")))[0]
    assert (got.verdict, got.json_state, got.parse_mode) == (verdict, state, mode)


@pytest.mark.parametrize(
    ("raw", "verdict", "valid"),
    [('{"verdict": "Entailment"}', "Entailment", True), ('ok {"verdict": "neutral"} done', "NotMentioned", True), ("It contradicts: contradiction", "Contradiction", False), ('{"relation": "Entailment"}', "Entailment", False), ("", None, False), ("?", None, False)],
)
def test_clause_reply(raw, verdict, valid):
    assert P.clause_reply(raw)[:2] == (verdict, valid)


def test_presence():
    assert P.presence_scored('{"present": "false"}') == (True, [])
    assert P.presence_served('{"present": "false"}') == (None, [])
    assert P.presence_served('x {"present": true, "evidence": "q"}') == (True, ["q"])
    assert P.presence_scored('{"present": 0, "evidence": ["a", 1]}') == (False, ["a", "1"])


def test_find_object():
    assert P.find_object('x {"a": 1} {"b": 2}') == {"a": 1}
    assert P.find_object('{"a": "}"}') == {"a": "}"}
    assert P.find_object('no {"a": "{"} end') is None  # braces within strings count
    assert P.find_object('} {"a": 1}') is None


def test_asserted():
    assert P.last_asserted("the position is contradicted, though it does not entail it") == "Contradiction"
    assert P.last_asserted("it is not mentioned") == "NotMentioned"
    assert P.last_asserted("") is None


def test_locate_round_trip(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + ["İ stanbul  A", "a b\x85c"]
    rng = random.Random(2)
    for doc in docs:
        found = SP.Located(doc)
        if not found.shifted:
            assert found.norm == norm(doc)
        for _ in range(5):
            a = rng.randrange(len(doc))
            quote = doc[a : a + rng.randrange(1, 80)]
            if norm(quote) and not found.shifted:
                start, end = found.find(quote)
                assert norm(doc[start:end]) == norm(quote)


def test_marks(spark):
    marks = [(5, 9), (0, 4), (0, 6), (6, 7), (8, 12)]
    got = column(spark, [([{"start": a, "end": b} for a, b in marks],)], "m array<struct<start:int,end:int>>", SP.disjoint_marks(F.col("m")))[0]
    assert [(x.start, x.end) for x in got] == [(0, 6), (6, 7), (8, 12)]


def test_chunks_cover():
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join("w" * rng.randrange(1, 40) for _ in range(rng.randrange(0, 200)))
        got = list(WN.space_chunks(text, 90, 20))
        assert not text and not got or got[0][0] == 0 and got[-1][1] == len(text)
        assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(got, got[1:], strict=False))


def test_serving_windows_cover():
    rng = random.Random(4)
    for _ in range(40):
        text = "".join(rng.choice(["word ", "x ", "line\n", "\n"]) for _ in range(rng.randrange(0, 300)))
        got = list(WN.line_windows(text, WN.whitespace_starts(text), 30, 5, 40))
        assert got[0][0] == 0 or len(got) > 1
        assert got[-1][1] == len(text)
        assert all(b[0] <= a[1] for a, b in zip(got, got[1:], strict=False))


def test_windows_by_a_tokenizer(spark):
    """Windows over the tokens of a public vocabulary: within the bound, overlapping, and the text whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = lambda t: [a for a, _ in Tokenizer.from_file(path).encode(t, add_special_tokens=False).offsets]
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice(["contract ", "Übertragung ", "x\n", "<|endoftext|> ", "42, "]) for _ in range(rng.randrange(0, 400)))) for i in range(12)] + [(98, ""), (99, None)]
    rows = WN.serving_windows(spark.createDataFrame(docs, "id int, text string").repartition(3), 60, 10, starts=WN.file_starts(path)).orderBy("id", "window").collect()
    for i, t in docs:
        got, starts = [(r.start, r.end) for r in rows if r.id == i], encode(t or "")
        assert [r.window for r in rows if r.id == i] == list(range(len(got))) and got[-1][1] == len(t or "")
        assert len(got) > 1 or len(starts) <= 60
        assert all(sum(a <= s < b for s in starts) <= 60 for a, b in got)
        assert all(b[0] < a[1] for a, b in zip(got, got[1:], strict=False))


def test_find_object():
    cases = {'x {"a": 1} {"b": 2}': {"a": 1}, '{"a": {"b": 2}}': {"a": {"b": 2}}, 'x {bad} {"b": 2}': {"b": 2}, '} {"a": 1}': None, '} { {"a": 1} }': {"a": 1}, '{"a": "}"} {"b": 1}': None, "{": None, "": None, "[1]": None, '{} {"a": 1}': {}, '}{ {"a": 1}': {"a": 1}}
    assert {t: P.find_object(t) for t in cases} == cases


@pytest.mark.parametrize(("n", "windows"), [(0, 1), (399, 1), (400, 1), (401, 2), (700, 2), (701, 3)])
def test_token_windows(spark, n, windows):
    got = column(spark, [(n,)], "n int", WN.token_windows(F.col("n"), 400, 300))[0]
    assert len(got) == windows and got[-1].tok_end == n


def test_unwrap():
    assert S.unwrapped("the parties\nagree to\nthis.\n1. Next\nline") == "the parties agree to this.\n1. Next line"
    assert S.unwrapped("HEADING\nText goes\n, on") == "HEADING\nText goes, on"


def test_playbook(spark):
    text = "1. We may disclose information to our affiliates. HIGH\n2. The term must not exceed three years.\nMEDIUM\n(c) The recipient shall return all materials. LOW"
    modal = "Rationale: because it must be so.\nThe supplier shall deliver goods on time\nTHE SUPPLIER SHALL DELIVER\n- the supplier shall deliver goods, on time!\nSection 4 must be read with care by all"
    long_ = "PAYMENT TERMS We shall pay. " + "x" * 300 + " LIABILITY — The cap is twice the fees paid in the year HIGH\nAn item that is two things. HIGH Another item that is low. LOW\nwww must be https://x.example"
    got = column(spark, [(text,), (modal,), (long_,), (None,), ("",)], "t string", PB.positions(F.col("t")))
    assert got[0] == ["We may disclose information to our affiliates.", "The term must not exceed three years.", "The recipient shall return all materials."]
    assert got[1] == ["The supplier shall deliver goods on time."]
    assert got[2] == ["The cap is twice the fees paid in the year.", "An item that is two things.", "Another item that is low."]
    assert got[3:] == [[], []]


def test_json_shape():
    shapes = {'{"verdict": "x"}': (True, True, "verdict"), '{"a": 1, "b": "t"}': (True, False, "b"), 'so: {"verdict": 1} ok': (True, True, "verdict"), "```json\n{}\n```": (True, False, None), "[1]": (False, False, None), "{": (False, False, None), "": (False, False, None), '<think>{"verdict": 1}</think>no': (False, False, None)}
    assert {t: P.json_shape(t) for t in shapes} == shapes and P.json_shape(None) == (False, False, None)


def test_text_files():
    assert S.file_text("a.txt", b"x\r\ny\r\n\r\n\r\n\r\nz") == ("x\ny\n\nz", None)
    assert S.file_text("a.txt", b" ")[0] is None
    assert S.file_text("a.exe", b"x")[1].startswith("Unsupported")


def test_blocks(spark):
    text = "TITLE HERE\n\n  some text.\n1. Section\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "é one")], "k int, t string")
    got = R.text_blocks(docs, "k", "t").orderBy("k", "block").collect()
    assert [(b.block, b.kind, text[b.start : b.end]) for b in got if b.k == 1] == [(0, "heading", "TITLE HERE"), (1, "para", "some text."), (2, "heading", "1. Section")]
    assert [(b.k, b.start, b.end) for b in got if b.k > 1] == [(4, 0, 5)]


def test_first_of_and_yes_no(spark):
    assert column(spark, [("Well: No, yes",), ("",)], "s string", X.first_of("s", ["Yes", "No"])) == ["No", None]
    assert column(spark, [("a: YES ok",), ("A no",), (None,)], "s string", X.yes_no("s", "A")) == [True, None, None]


def test_quotes(spark):
    s = "he \"said all this\" and 'that also is' but \"short\""
    assert column(spark, [(s,)], "s string", X.quoted("s")) == [["said all this", "that also is"]]
    assert re.findall(r'"([^"]{8,})"', s) == ["said all this"] and json.dumps(s)


def test_rows_go_to_python_in_small_batches(spark):
    """A worker isn't handed ten thousand texts at once, whatever their lengths are."""
    from quillstone import plans
    from quillstone.functions import windows as W

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for query in ("unwrap_lines", "estimated_windows"):
        spark.conf.set(name, "64m")
        plans.load()[0][query](spark, "/root/testdata/sf0.001")
        texts = spark.range(200).selectExpr("repeat('x', 100000) AS t").coalesce(1)
        most = texts.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
        assert most <= 2 * W.BATCH_BYTES


def test_starts_of_a_tokenizer_file():
    """Looked up one by one, they are those of the encoding's offsets."""
    import public_tokenizers
    from quillstone.functions import windows as W

    path = public_tokenizers.path("byte_bpe_50k.json")
    for text in ("", "a", "Grüße, 東京 <|endoftext|>\n\n x " * 30):
        starts = W.file_starts(path)(text)
        assert not isinstance(starts, array.array) and list(starts) == [a for a, _ in W._tokenizer(path).encode(text, add_special_tokens=False).offsets]
