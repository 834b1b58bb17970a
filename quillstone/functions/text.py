"""Scalar text functions as Columns: all stays in the JVM but longest common subsequences and overlaps of multisets, which no built-in
has in linear time, and ``n_tokens``."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of text normalisation, edge punctuation of quotes, and the two token patterns.
WHITE = "[\\u0009-\\u000D\\u001C-\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
#: Runs that aren't one space already: the others needn't be touched.
UNEVEN = "(?:[\\u0009-\\u000D\\u001C-\\u001F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]" + WHITE[:-1] + "*| " + WHITE + ")"
#: Runs of white space, as ``WHITE``: that a character isn't visible ASCII is asked first, one comparison for most.
GAPS = "[[^!-~]&&" + WHITE[:-1] + "]++"
EDGE = ".,;:!?’'\"-— "
NO_WORD = "[^a-z0-9]++"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def norm(c: Column | str) -> Column:
    """Lower case, runs of white space as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), UNEVEN, " "))


def edge_strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(EDGE))


def contains_norm(needle: Column, hay: Column) -> Column:
    """Plain containment of normalised text."""
    return F.contains(hay, needle)


def grounded(needle: Column, hay: Column) -> Column:
    """Containment that forgives punctuation at the needle's ends; an empty needle is contained in all."""
    return F.contains(hay, needle) | F.contains(hay, edge_strip(needle))


def tokens(c: Column | str) -> Column:
    """White-space tokens of the normalised text."""
    return F.array_remove(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), GAPS), "")


def n_tokens(c: Column | str) -> Column:
    """How many ``tokens`` there are, without making them: Python's white space is ``WHITE``, and it splits far faster than a pattern.
    For long texts see ``windows.small_batches``."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(t.split()) if t else 0).astype("int32")

    return run(_col(c))


def words(c: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), NO_WORD), "")  # cheaper than to extract all words


def shingles(tokens_: Column, k: int) -> Column:
    """Distinct runs of k tokens; one short run where there are fewer."""
    return bind(tokens_, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, F.lit(k)), " "))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_measure(p: Column, r: Column, beta2: float = 1.0) -> Column:
    return ratio((1 + beta2) * p * r, beta2 * p + r)


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct tokens of two arrays; 0 where either is empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def set_prf(gold: Column, pred: Column) -> Column:
    """Precision, recall and F1 of distinct tokens; zeros where either is empty."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    both = F.size(F.array_intersect(g, p))
    prec, rec = ratio(both, F.size(p)), ratio(both, F.size(g))
    return F.struct(prec.alias("p"), rec.alias("r"), f_measure(prec, rec).alias("f"))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets. Counting is linear; built-ins would compare all with all."""

    @F.pandas_udf("int")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([(Counter(x) & Counter(y)).total() for x, y in zip(left, right, strict=True)], dtype="int32")

    return run(a, b)


def multiset_prf(gold: Column, pred: Column) -> Column:
    both = multiset_overlap(gold, pred)
    prec, rec = ratio(both, F.size(pred)), ratio(both, F.size(gold))
    return F.struct(prec.alias("p"), rec.alias("r"), f_measure(prec, rec).alias("f"))


def longest_common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    masks: dict = {}
    for k, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << k
    full = row = (1 << len(b)) - 1
    for x in a:
        if hit := row & masks.get(x, 0):
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: no built-in has it, and a fold would copy a row of the table for each
    cell."""

    @F.pandas_udf("int")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([longest_common(list(x), list(y)) for x, y in zip(left, right, strict=True)], dtype="int32")

    return run(a, b)


def rouge_l(gold: Column, pred: Column) -> Column:
    both = lcs(pred, gold)
    prec, rec = ratio(both, F.size(pred)), ratio(both, F.size(gold))
    return F.struct(prec.alias("p"), rec.alias("r"), f_measure(prec, rec).alias("f"))


def greedy_matches(gold: Column, pred: Column, least: float = 0.5) -> Column:
    """How many gold spans find a partner of their own: pairs by falling Jaccard, then gold and predicted position."""
    pairs = F.flatten(
        F.transform(gold, lambda g, i: F.transform(pred, lambda p, j: F.struct((-jaccard(tokens(g), tokens(p))).alias("d"), i.alias("i"), j.alias("j"))))
    )
    start = F.struct(F.array().cast("array<int>").alias("g"), F.array().cast("array<int>").alias("p"))
    taken = F.aggregate(
        F.array_sort(F.filter(pairs, lambda x: x["d"] <= -least)),
        start,
        lambda acc, x: F.when(F.array_contains(acc["g"], x["i"]) | F.array_contains(acc["p"], x["j"]), acc).otherwise(
            F.struct(F.array_append(acc["g"], x["i"]).alias("g"), F.array_append(acc["p"], x["j"]).alias("p"))
        ),
    )
    return F.size(taken["g"])


def covered(gold: Column, pred: Column) -> Column:
    """For each gold span: is its normalised text, not empty, within the joined prediction?"""
    return bind(norm(F.array_join(pred, " ")), lambda hay: F.transform(gold, lambda g: (norm(g) != "") & F.contains(hay, norm(g))))


def evidence_case(gold: Column, pred: Column) -> Column:
    """TP or FN with gold spans, FP or TN without."""
    return F.when(F.size(gold) > 0, F.when(F.forall(covered(gold, pred), lambda x: x), "TP").otherwise("FN")).otherwise(F.when(F.size(pred) > 0, "FP").otherwise("TN"))


def covered_share(gold: Column, pred: Column) -> Column:
    return F.when(F.size(gold) > 0, ratio(F.size(F.filter(covered(gold, pred), lambda x: x)), F.size(gold))).otherwise(1.0)


def drop_trivial(gold: Column, chars: int = 4) -> Column:
    """Spans of more than ``chars`` normalised characters."""
    return F.filter(gold, lambda g: F.length(norm(g)) > chars)


def evidence_mode(gold: Column, pred: Column, slack: int = 5) -> Column:
    """How predicted evidence relates to gold: ok, spurious, abstain, exact, superset, partial or disjoint."""
    hay = norm(F.array_join(pred, " "))
    flags = F.transform(F.filter(gold, lambda g: norm(g) != ""), lambda g: F.contains(hay, norm(g)))
    extra = F.size(F.array_except(tokens(F.array_join(pred, " ")), tokens(F.array_join(gold, " "))))
    return (
        F.when((F.size(gold) == 0) & (F.size(pred) == 0), "ok").when(F.size(gold) == 0, "spurious").when(F.size(pred) == 0, "abstain")
        .when(F.forall(flags, lambda x: x), F.when(extra <= slack, "exact").otherwise("superset"))
        .when(F.exists(flags, lambda x: x), "partial").otherwise("disjoint")
    )


def quoted(c: Column | str, least: int = 8) -> Column:
    """Texts of ``least`` characters or more within double or single quotes, stripped, in order."""
    pairs = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(f"\"[^\"]{{{least},}}\"|'[^']{{{least},}}'"), F.lit(0))
    return F.filter(F.transform(pairs, lambda q: F.trim(F.substring(q, F.lit(2), F.length(q) - 2))), lambda q: q != "")


def sentence_count(c: Column | str) -> Column:
    """Sentence ends, less those of abbreviations and decimals."""
    # The abbreviations.
    text = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\b(?:e\.g|i\.e|etc|vs|Inc|Ltd|Corp|Co|No|Art|Sec)\.", "X")
    text = F.regexp_replace(text, r"\d\.\d", "XX")
    return F.regexp_count(F.trim(text), F.lit(r"[.!?](?:\s|$)"))


def opening(c: Column | str, n: int = 5) -> Column:
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def first_of(c: Column | str, space: list[str]) -> Column:
    """The answer of a closed set that occurs first as a whole word, ignoring case; the lesser of equals."""
    at = [F.struct(F.regexp_instr(_col(c), F.lit(rf"(?i)\b\Q{a}\E\b")).alias("at"), F.lit(a).alias("answer")) for a in space]
    return F.array_min(F.filter(F.array(*at), lambda x: x["at"] > 0))["answer"]


def yes_no(c: Column | str, key: str) -> Column:
    """true or false of a line ``key: yes`` or ``key: no``; null without one."""
    found = F.lower(F.regexp_extract(F.coalesce(_col(c), F.lit("")), rf"(?im)^\s*{key}\s*[:：]\s*(yes|no)\b", 1))
    return F.when(found == "yes", True).when(found == "no", False)


def strip_wrappers(c: Column | str) -> Column:
    """A model's reply without its thinking, channel marks and code fences."""
    t = F.coalesce(_col(c), F.lit(""))
    # The wrappers.
    t = F.regexp_replace(t, r"(?s)<\|channel>thought.*?<channel\|>", " ")
    t = F.regexp_replace(t, r"(?is)<think>.*?</think>", " ")
    t = F.regexp_replace(t, r"(?is)\A.*?</think>", " ")
    t = F.regexp_replace(t, r"<\|channel>\w+\s*|<channel\|>|<\|turn>\w*\s*|<turn\|>", " ")
    t = F.regexp_replace(t, r"(?i)```(?:json)?|```", " ")
    return F.regexp_replace(t, "^" + WHITE + "|" + WHITE + "$", "")


def bucket(n: Column, edges: list[tuple[int, str]], beyond: str) -> Column:
    """The label of the first upper bound that n is under."""
    out = None
    for bound, label in edges:
        out = F.when(n < bound, label) if out is None else out.when(n < bound, label)
    return out.otherwise(beyond)


def pick(key: Column, seed: str) -> Column:
    """A number below 2^24 that a seed draws for a key; any engine computes the same."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 6), 16, 10).cast("int")


def excerpt(text: Column, needle: Column, around: int = 80) -> Column:
    """The text about the first occurrence of ``needle``."""
    at = F.instr(text, needle)
    return F.when(at > 0, F.substring(text, F.greatest(at - around, F.lit(1)), F.length(needle) + 2 * around))
