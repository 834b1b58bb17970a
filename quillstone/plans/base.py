"""Inputs that the tables don't hold, made of them alike in Spark and in SQL.

``answers``: what a model might have said of each document. Its sentences, whole, stand for spans; gold and
predicted evidence, verdicts and an answer's length are drawn by hashes of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.parsing import CLASSES
from .registry import texts

WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def draw(key: Column, seed: str, n: int) -> Column:
    return X.pick(key, seed) % n


def s_draw(key: str, seed: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 6) AS INTEGER) % {n})"


def s_norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{WS}', ' ', 'g'))"


def s_tokens(x: str) -> str:
    return f"list_filter(string_split({s_norm(x)}, ' '), lambda t: t <> '')"


def s_edge(x: str) -> str:
    return f"trim({x}, '.,;:!?’''\"-— ')"


def s_ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


def s_f(p: str, r: str) -> str:
    return f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0)"


#: Where each word of a text begins (from 0), after a CTE ``texts`` of ``doc_id`` and ``text``.
STARTS = f"""
pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '{WS[:-1]}*{WS[:1]}^{WS[1:-1]}+')) AS piece, generate_subscripts(regexp_extract_all(text, '{WS[:-1]}*{WS[:1]}^{WS[1:-1]}+'), 1) AS k FROM texts),
offsets AS (SELECT doc_id, list(a ORDER BY k) AS starts FROM (SELECT doc_id, k, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(regexp_extract(piece, '{WS[:1]}^{WS[1:-1]}+$')) AS BIGINT) AS a FROM pieces) GROUP BY doc_id)"""

ABC = "abcdefghijklmnopqrstuvwxyz"


def loud(c: Column) -> Column:
    """a-z in capitals; engines differ on others."""
    return F.translate(c, ABC, ABC.upper())


def s_loud(x: str) -> str:
    return f"translate({x}, '{ABC}', '{ABC.upper()}')"


def spans(text: Column) -> Column:
    return F.split(text, r"\. ")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    k = F.col("doc_id")
    s, g, p = F.col("s"), draw(k, "gold", 4), draw(k, "pred", 7)
    none = F.array().cast("array<string>")
    verdict = lambda d: F.array(*map(F.lit, CLASSES))[d]
    rows = docs.withColumn("s", F.split(F.coalesce("text", F.lit("")), r"\. ", 4))  # three sentences are used, the fourth is all the rest
    pred = F.when(p == 0, none).when(p == 1, F.slice(s, 1, 2)).when(p == 2, F.slice(s, 1, 1)).when(p == 3, F.slice(s, 3, 1)).when(p == 4, F.slice(s, 1, 3))
    rows = rows.withColumn("gold", F.when(g == 0, none).otherwise(F.slice(s, 1, 2))).withColumn("pred", pred.when(p == 5, F.transform(F.slice(s, 1, 2), lambda x: F.concat(loud(x), F.lit(".")))).otherwise(F.array(F.lit("not in any text"))))
    rows = rows.withColumn("gold_verdict", verdict(draw(k, "verdict", 3)))
    wrong = F.when(draw(k, "miss", 5) == 0, None).otherwise(verdict(draw(k, "other", 3)))
    rows = rows.withColumn("pred_verdict", F.when(draw(k, "hit", 10) < 7, F.col("gold_verdict")).otherwise(wrong))
    return rows.withColumn("n_tokens", (draw(k, "tokens", 500) + 5).cast("int")).withColumn("hypothesis", F.concat(F.lit("h"), draw(k, "hypothesis", 17))).drop("s")


_list = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"
ANSWERS = f"""
raw_answers AS (SELECT *, string_split(coalesce(text, ''), '. ') AS s,
    {s_draw('doc_id', 'gold', 4)} AS g, {s_draw('doc_id', 'pred', 7)} AS p FROM documents),
answers AS (SELECT doc_id, text, lang, source, n_chars,
    CASE WHEN g = 0 THEN CAST([] AS VARCHAR[]) ELSE s[1:2] END AS gold,
    CASE p WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN s[1:2] WHEN 2 THEN s[1:1] WHEN 3 THEN s[3:3] WHEN 4 THEN s[1:3]
           WHEN 5 THEN list_transform(s[1:2], lambda x: {s_loud('x')} || '.') ELSE ['not in any text'] END AS pred,
    {_list}[{s_draw('doc_id', 'verdict', 3)} + 1] AS gold_verdict,
    CASE WHEN {s_draw('doc_id', 'hit', 10)} < 7 THEN {_list}[{s_draw('doc_id', 'verdict', 3)} + 1]
         WHEN {s_draw('doc_id', 'miss', 5)} = 0 THEN NULL ELSE {_list}[{s_draw('doc_id', 'other', 3)} + 1] END AS pred_verdict,
    {s_draw('doc_id', 'tokens', 500)} + 5 AS n_tokens, 'h' || {s_draw('doc_id', 'hypothesis', 17)} AS hypothesis
  FROM raw_answers)"""

_hay, _gj, _pj = s_norm("array_to_string(pred, ' ')"), "array_to_string(gold, ' ')", "array_to_string(pred, ' ')"
#: Row features of evidence, after ANSWERS.
FEATURES = f"""
tokened AS (SELECT *, {_hay} AS hay, {s_tokens(_gj)} AS gt, {s_tokens(_pj)} AS pt FROM answers),
flagged AS (SELECT *, list_transform(gold, lambda q: {s_norm('q')} <> '' AND contains(hay, {s_norm('q')})) AS flags,
    len(list_intersect(gt, pt)) AS shared, len(list_distinct(list_concat(gt, pt))) AS either,
    coalesce(list_sum(list_transform(list_intersect(gt, pt), lambda t: least(len(list_filter(gt, lambda x: x = t)), len(list_filter(pt, lambda x: x = t))))), 0) AS multi
  FROM tokened),
features AS (SELECT *,
    CASE WHEN len(gold) > 0 THEN CASE WHEN len(list_filter(flags, lambda x: NOT x)) = 0 THEN 'TP' ELSE 'FN' END WHEN len(pred) > 0 THEN 'FP' ELSE 'TN' END AS kase,
    CASE WHEN len(gold) > 0 THEN len(list_filter(flags, lambda x: x)) / CAST(len(gold) AS DOUBLE) ELSE 1.0 END AS share,
    CASE WHEN either > 0 THEN shared / CAST(either AS DOUBLE) END AS jac,
    {s_ratio('multi', 'len(pt)')} AS mp, {s_ratio('multi', 'len(gt)')} AS mr, {s_ratio('shared', 'len(list_distinct(pt))')} AS sp, {s_ratio('shared', 'len(list_distinct(gt))')} AS sr
  FROM flagged)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
