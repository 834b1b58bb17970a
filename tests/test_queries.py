"""Every query of the library against its SQL."""

from __future__ import annotations

import pytest
from compare import TABLES, both

from quillstone import plans
from quillstone.plans.base import answers

QUERIES, SQL = plans.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], SQL[name], SF)
    assert ours == theirs


def test_others_are_brute_forced():
    """Queries without SQL: a longest common subsequence and a tokenizer."""
    assert set(QUERIES) - set(SQL) == {"soft_evidence", "tokenizer_windows"}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_soft_evidence(spark):
    f = lambda p, r: 2 * p * r / (p + r) if p + r else 0.0
    want: dict = {}
    for r in answers(spark, SF).where("size(gold) > 0").select("lang", "gold", "pred").collect():
        g, p = (" ".join(x).lower().split() for x in (r.gold, r.pred))
        both, shared = lcs(g, p), len(set(g) & set(p))
        ratio = lambda a, b: a / b if b else 0.0
        one = [ratio(both, len(p)), ratio(both, len(g)), ratio(shared, len(set(p))), ratio(shared, len(set(g)))]
        want.setdefault(r.lang, []).append([*one[:2], f(*one[:2]), *one[2:], f(*one[2:])])
    for r in QUERIES["soft_evidence"](spark, SF).collect():
        mean = [sum(x) / len(x) for x in zip(*want[r.lang], strict=True)]
        assert r.n == len(want[r.lang]) and [r[f"{a}_{k}"] for a in ("rouge_l", "overlap") for k in "prf"] == pytest.approx(mean)


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_bootstrap", "paired_bootstrap_by_category"])
def test_bootstraps(spark, name):
    """About the point estimates, and alike in every run."""
    got = QUERIES[name](spark, SF).first()
    assert got.ci_low <= got["mean"] <= got.ci_high and got == QUERIES[name](spark, SF).first()
    if name == "bootstrap_ci":
        point = QUERIES["verdict_report"](spark, SF).agg({"f1": "avg"}).first()[0]
        assert abs(got["mean"] - point) < 0.02 and got.ci_low < point < got.ci_high


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "item_id"]


def test_notes_are_counted_as_in_sql(spark, tmp_path):
    """In the report every end counts, that of an abbreviation or in a number too; white space beyond ASCII is part of a word."""
    texts = ["No", "Made by Acme Inc. in 1999", "One. two. Rest", "One! Two", "1.5   x", ""] * 60
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents")
    (part,) = tmp_path.glob("documents/*.parquet")
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(part if t == "documents" else f"{SF}/{t}.parquet")
    for name in ("note_report", "note_reasons"):
        ours, theirs = both(spark, QUERIES[name], SQL[name], str(tmp_path))
        assert ours == theirs
