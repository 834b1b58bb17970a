"""Scores of verdicts, presence and evidence over ``answers``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.parsing import CLASSES
from ..operators import datasets as DS
from ..operators import metrics as M
from ..operators import ranks as RK
from ..operators import resample as RS
from ..sources.scratch import scratch
from .base import ANSWERS, FEATURES, answers, draw, rounded, s_draw, s_edge, s_f, s_norm, s_ratio, s_tokens
from .registry import query, table

_CLASSES = "(VALUES ('Entailment'), ('Contradiction'), ('NotMentioned')) c(class)"
_COUNTS = """count(*) FILTER (gold_verdict = class AND pred_verdict IS NOT DISTINCT FROM class) AS tp,
count(*) FILTER (gold_verdict <> class AND pred_verdict IS NOT DISTINCT FROM class) AS fp, count(*) FILTER (gold_verdict = class AND pred_verdict IS DISTINCT FROM class) AS fn"""
_P, _R = s_ratio("tp", "tp + fp"), s_ratio("tp", "tp + fn")
_PRF = f"{_P} AS precision, {_R} AS recall, {s_f(_P, _R)} AS f1"


@query("verdict_report", f"WITH {ANSWERS}, k AS (SELECT class, {_COUNTS} FROM answers, {_CLASSES} GROUP BY class) SELECT *, {_PRF}, tp + fn AS support FROM k")
def _(spark, sf):
    return M.class_report(answers(spark, sf), "gold_verdict", "pred_verdict", CLASSES)


@query("verdict_macro_by_lang", f"""WITH {ANSWERS}, k AS (SELECT lang, class, {_COUNTS} FROM answers, {_CLASSES} GROUP BY 1, 2), f AS (SELECT *, {_PRF} FROM k)
SELECT lang, round(avg(f1), 6) AS macro_f1, any_value(n) AS n, round(any_value(accuracy), 6) AS accuracy FROM f JOIN
(SELECT lang, count(*) AS n, avg(CAST(gold_verdict IS NOT DISTINCT FROM pred_verdict AS INTEGER)) AS accuracy FROM answers GROUP BY 1) USING (lang) GROUP BY lang""")
def _(spark, sf):
    return rounded(M.macro_report(answers(spark, sf), "gold_verdict", "pred_verdict", CLASSES, ["lang"]))


@query("verdict_confusion", f"""WITH {ANSWERS} SELECT gold_verdict, count(*) FILTER (pred_verdict = 'Entailment') AS "Entailment", count(*) FILTER (pred_verdict = 'Contradiction') AS "Contradiction",
count(*) FILTER (pred_verdict = 'NotMentioned') AS "NotMentioned", count(*) FILTER (pred_verdict IS NULL) AS "__unparsed__" FROM answers GROUP BY 1""")
def _(spark, sf):
    return M.confusion(answers(spark, sf), "gold_verdict", "pred_verdict", CLASSES)


@query("failure_flow", f"""WITH {ANSWERS} SELECT gold_verdict, coalesce(pred_verdict, '__unparsed__') AS went_to, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY gold_verdict), 6) AS share
FROM answers WHERE gold_verdict IS DISTINCT FROM pred_verdict GROUP BY 1, 2""")
def _(spark, sf):
    wrong = answers(spark, sf).where(~F.col("gold_verdict").eqNullSafe(F.col("pred_verdict")))
    n = wrong.groupBy("gold_verdict", F.coalesce("pred_verdict", F.lit(M.UNPARSED)).alias("went_to")).agg(F.count("*").alias("n"))
    return rounded(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gold_verdict"))))


@query("label_report", """WITH r AS (SELECT toxic AS gold, CAST(n_chars > 2000 AS INTEGER) AS pred FROM labels JOIN documents USING (doc_id))
SELECT count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 1) AS fp, count(*) FILTER (gold = 1 AND pred = 0) AS fn, count(*) FILTER (gold = 0 AND pred = 0) AS tn FROM r""")
def _(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("g")).join(table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("p")), "doc_id")
    g, p = F.col("g"), F.col("p")
    return rows.agg(*[M.count_if(c).alias(n) for n, c in (("tp", g & p), ("fp", ~g & p), ("fn", g & ~p), ("tn", ~g & ~p))])


_ALWAYS = s_ratio("fp + tn", "tp + fp + fn + tn")


@query("presence_report", f"""WITH r AS (SELECT source, {s_draw('doc_id', 'gold', 4)} <> 0 AS g, {s_draw('doc_id', 'pred', 7)} <> 0 AS p FROM documents),
k AS (SELECT source, GROUPING(source) AS pooled, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM r GROUP BY GROUPING SETS ((source), ()))
SELECT source, CAST(pooled AS INTEGER) AS pooled, tp, fp, fn, tn, {_PRF}, {_ALWAYS} AS always_absent_accuracy FROM k""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("source", (draw(F.col("doc_id"), "gold", 4) != 0).alias("g"), (draw(F.col("doc_id"), "pred", 7) != 0).alias("p"))
    return M.presence_report(docs, "g", "p", "source")


_EV = f"""count(*) FILTER (kase = 'TP') AS tp, count(*) FILTER (kase = 'FN') AS fn, count(*) FILTER (kase = 'FP') AS fp, count(*) FILTER (kase = 'TN') AS tn,
coalesce(avg(share) FILTER (len(gold) > 0), 0) AS partial_credit, coalesce(avg(jac), 0) AS jaccard, count(*) FILTER (len(gold) > 0 AND len(pred) = 0) AS abstained,
coalesce(avg(mp) FILTER (len(gold) > 0), 0) AS token_p, coalesce(avg(mr) FILTER (len(gold) > 0), 0) AS token_r, coalesce(avg({s_f('mp', 'mr')}) FILTER (len(gold) > 0), 0) AS token_f, coalesce(avg({s_f('sp', 'sr')}) FILTER (len(gold) > 0), 0) AS token_f_sets"""
_EV_OUT = f"""tp, fn, fp, tn, round({_P}, 6) AS precision, round({_R}, 6) AS recall, round({s_f(_P, _R)}, 6) AS f1, round({s_ratio('5 * tp', '5 * tp + 4 * fn + fp')}, 6) AS f2, round(partial_credit, 6) AS partial_credit, round(jaccard, 6) AS jaccard,
round(token_p, 6) AS token_p, round(token_r, 6) AS token_r, round(token_f, 6) AS token_f, round(token_f_sets, 6) AS token_f_sets, round({s_ratio('abstained', 'tp + fn')}, 6) AS false_abstention"""


@query("evidence_report", f"WITH {ANSWERS}, {FEATURES}, k AS (SELECT {_EV} FROM features) SELECT {_EV_OUT} FROM k")
def _(spark, sf):
    return rounded(M.evidence_report(M.evidence_features(answers(spark, sf))))


@query("evidence_report_groups", f"""WITH {ANSWERS}, {FEATURES}, b AS (SELECT *, CASE WHEN n_chars < 2000 THEN '<2K' WHEN n_chars < 4000 THEN '2-4K' WHEN n_chars < 8000 THEN '4-8K' ELSE '>8K' END AS length FROM features),
k AS (SELECT lang, length, {_EV} FROM b GROUP BY 1, 2) SELECT lang, length, {_EV_OUT} FROM k""")
def _(spark, sf):
    rows = M.evidence_features(answers(spark, sf)).withColumn("length", X.bucket(F.col("n_chars"), [(2_000, "<2K"), (4_000, "2-4K"), (8_000, "4-8K")], ">8K"))
    return rounded(M.evidence_report(rows, ["lang", "length"]))


_ANSWERS_NT = ANSWERS.replace("answers AS (", "answers0 AS (", 1) if ANSWERS.startswith("answers AS") else ANSWERS.replace("\nanswers AS (", "\nanswers0 AS (")
_NT = f"{_ANSWERS_NT}, answers AS (SELECT * REPLACE (list_filter(gold, lambda q: length({s_norm('q')}) > 4) AS gold) FROM answers0 WHERE len(gold) = 0 OR len(list_filter(gold, lambda q: length({s_norm('q')}) > 4)) > 0)"


@query("evidence_report_nontrivial", f"WITH {_NT}, {FEATURES}, k AS (SELECT {_EV} FROM features) SELECT {_EV_OUT} FROM k")
def _(spark, sf):
    rows = answers(spark, sf).withColumn("kept", X.drop_trivial(F.col("gold"))).where((F.size("gold") == 0) | (F.size("kept") > 0)).withColumn("gold", F.col("kept")).drop("kept")
    return rounded(M.evidence_report(M.evidence_features(rows)))


@query("evidence_present_only", f"WITH {ANSWERS}, {FEATURES}, k AS (SELECT {_EV} FROM features WHERE len(gold) > 0) SELECT {_EV_OUT} FROM k")
def _(spark, sf):
    return rounded(M.evidence_report(M.evidence_features(answers(spark, sf).where(F.size("gold") > 0))))


@query("joint_report", f"""WITH {ANSWERS}, {FEATURES} SELECT lang, round(avg(CAST(coalesce(gold_verdict = pred_verdict, false) AND share = 1 AS INTEGER)), 6) AS joint_lenient,
round(avg(CAST(coalesce(gold_verdict = pred_verdict, false) AND share = 1 AND kase <> 'FP' AS INTEGER)), 6) AS joint_strict FROM features GROUP BY lang""")
def _(spark, sf):
    return rounded(M.joint_report(M.evidence_features(answers(spark, sf)), "gold_verdict", "pred_verdict", ["lang"]))


@query("cell_report", f"""WITH {ANSWERS}, {FEATURES}, k AS (SELECT source, {_EV}, count(*) AS n, avg(n_tokens) AS mean_tokens, avg(CAST(gold_verdict IS NOT DISTINCT FROM pred_verdict AS INTEGER)) AS accuracy,
list_sort(list(n_tokens))[CAST(least(floor(0.99 * count(*)), count(*) - 1) AS INTEGER) + 1] AS p99_tokens FROM features GROUP BY source)
SELECT source, n, round(mean_tokens, 6) AS mean_tokens, CAST(p99_tokens AS INTEGER) AS p99_tokens, round(accuracy, 6) AS accuracy, {_EV_OUT} FROM k""")
def _(spark, sf):
    M.evidence_features(answers(spark, sf)).drop("text", "gold", "pred").write.parquet(path := scratch(spark, "features"))  # narrow; three reports read it
    rows = spark.read.parquet(path)
    other = rows.groupBy("source").agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean_tokens"), F.avg(F.col("gold_verdict").eqNullSafe(F.col("pred_verdict")).cast("int")).alias("accuracy"))
    p99 = RK.rank_percentiles(rows, "n_tokens", {"p99_tokens": (0.99, 0)}, ["source"]).drop("n")
    return rounded(other.join(p99, "source").join(M.evidence_report(rows, ["source"]), "source"))


@query("hallucination_report", f"""WITH {ANSWERS}, r AS (SELECT len(pred) AS n, len(list_filter(pred, lambda q: {s_norm('q')} <> '' AND NOT contains({s_norm('text')}, {s_norm('q')}) AND NOT contains({s_norm('text')}, {s_edge(s_norm('q'))}))) AS bad FROM answers WHERE len(pred) > 0)
SELECT CAST(sum(n) AS BIGINT) AS n_spans, CAST(sum(bad) AS BIGINT) AS n_hallucinated, count(*) AS n_examples, {s_ratio('sum(bad)', 'sum(n)')} AS span_rate, {s_ratio('count(*) FILTER (bad > 0)', 'count(*)')} AS example_rate FROM r""")
def _(spark, sf):
    return M.hallucination_report(answers(spark, sf), "text", "pred")


@query("evidence_modes", f"""WITH {ANSWERS}, {FEATURES}, m AS (SELECT CASE WHEN len(gold) = 0 AND len(pred) = 0 THEN 'ok' WHEN len(gold) = 0 THEN 'spurious' WHEN len(pred) = 0 THEN 'abstain'
WHEN len(list_filter(list_filter(gold, lambda q: {s_norm('q')} <> ''), lambda q: NOT contains(hay, {s_norm('q')}))) = 0 THEN CASE WHEN len(list_filter(list_distinct(pt), lambda t: NOT list_contains(gt, t))) <= 5 THEN 'exact' ELSE 'superset' END
WHEN len(list_filter(gold, lambda q: {s_norm('q')} <> '' AND contains(hay, {s_norm('q')}))) > 0 THEN 'partial' ELSE 'disjoint' END AS mode FROM features)
SELECT mode, count(*) AS n FROM m GROUP BY 1""")
def _(spark, sf):
    return answers(spark, sf).groupBy(X.evidence_mode(F.col("gold"), F.col("pred")).alias("mode")).agg(F.count("*").alias("n"))


@query("soft_evidence")
def _(spark, sf):
    rows = answers(spark, sf).where(F.size("gold") > 0).select("lang", X.tokens(F.array_join("gold", " ")).alias("g"), X.tokens(F.array_join("pred", " ")).alias("p"))
    rows = rows.select("lang", X.rouge_l(F.col("g"), F.col("p")).alias("r"), X.set_prf(F.col("g"), F.col("p")).alias("t"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *[F.avg(f"r.{k}").alias(f"rouge_l_{k}") for k in "prf"], *[F.avg(f"t.{k}").alias(f"overlap_{k}") for k in "prf"])


_J = f"coalesce(len(list_intersect({s_tokens('g')}, {s_tokens('p')})) / CAST(nullif(len(list_distinct(list_concat({s_tokens('g')}, {s_tokens('p')}))), 0) AS DOUBLE), 0.0)"


@query("span_recall", f"""WITH {ANSWERS}, {FEATURES}, gs AS (SELECT doc_id, unnest(gold) AS g, generate_subscripts(gold, 1) AS i FROM features), ps AS (SELECT doc_id, unnest(pred) AS p, generate_subscripts(pred, 1) AS j FROM features),
x AS (SELECT doc_id, i, j, {_J} AS s FROM gs JOIN ps USING (doc_id)),
l AS (SELECT doc_id, list(struct_pack(i := i, j := j, g := CAST([] AS BIGINT[]), p := CAST([] AS BIGINT[])) ORDER BY s DESC, i, j) FILTER (s >= 0.5) AS pairs FROM x GROUP BY 1),
f AS (SELECT doc_id, len(list_reduce(list_concat([struct_pack(i := CAST(-1 AS BIGINT), j := CAST(-1 AS BIGINT), g := CAST([] AS BIGINT[]), p := CAST([] AS BIGINT[]))], pairs),
  lambda acc, y: CASE WHEN list_contains(acc.g, y.i) OR list_contains(acc.p, y.j) THEN acc ELSE struct_pack(i := y.i, j := y.j, g := list_append(acc.g, y.i), p := list_append(acc.p, y.j)) END).g) AS found FROM l WHERE pairs IS NOT NULL),
k AS (SELECT len(gold) AS spans, coalesce(found, 0) AS found, kase FROM features LEFT JOIN f USING (doc_id) WHERE len(gold) > 0)
SELECT CASE WHEN kase <> 'FN' THEN 'covered' WHEN found = spans THEN 'boundary_only' WHEN found > 0 THEN 'partial' ELSE 'not_found' END AS kind, count(*) AS n, CAST(sum(spans) AS BIGINT) AS spans, CAST(sum(found) AS BIGINT) AS located FROM k GROUP BY 1""")
def _(spark, sf):
    rows = answers(spark, sf).where(F.size("gold") > 0)
    rows = rows.select(F.size("gold").alias("g"), X.greedy_matches(F.col("gold"), F.col("pred")).alias("found"), X.evidence_case(F.col("gold"), F.col("pred")).alias("case"))
    kind = F.when(F.col("found") == F.col("g"), "boundary_only").when(F.col("found") > 0, "partial").otherwise("not_found")
    return rows.groupBy(F.when(F.col("case") == "FN", kind).otherwise("covered").alias("kind")).agg(F.count("*").alias("n"), F.sum("g").alias("spans"), F.sum("found").alias("located"))


_PCT = lambda q, less=0: f"list_sort(list(n_tokens))[CAST(greatest(least(floor({q} * count(*)) - {less}, count(*) - 1), 0) AS INTEGER) + 1]"


@query("token_percentiles", f"WITH {ANSWERS} SELECT lang, count(*) AS n, {_PCT(0.5)} AS p50, {_PCT(0.9)} AS p90, {_PCT(0.95, 1)} AS p95, {_PCT(0.99)} AS p99 FROM answers GROUP BY lang")
def _(spark, sf):
    return RK.rank_percentiles(answers(spark, sf), "n_tokens", {"p50": (0.5, 0), "p90": (0.9, 0), "p95": (0.95, 1), "p99": (0.99, 0)}, ["lang"])


@query("length_bounds", f"WITH {ANSWERS} SELECT greatest({_PCT(0.01, 1)}, 20) AS low, {_PCT(0.99)} AS high FROM answers")
def _(spark, sf):
    return RK.rank_percentiles(answers(spark, sf), "n_tokens", {"p1": (0.01, 1), "high": (0.99, 0)}).select(F.greatest("p1", F.lit(20)).alias("low"), "high")


@query("length_exceedance", """SELECT lang, count(*) AS docs, count(*) FILTER (n_chars > 4000) AS over_4k, count(*) FILTER (n_chars > 16000) AS over_16k, round(avg(n_chars / greatest(len(string_split(trim(text), ' ')), 1)), 4) AS chars_per_word FROM documents GROUP BY lang""")
def _(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(n > 4000).alias("over_4k"), F.count_if(n > 16000).alias("over_16k"), F.round(F.avg(n / F.greatest(F.size(F.split(F.trim("text"), " ")), F.lit(1))), 4).alias("chars_per_word"))


@query("trivial_baselines", f"""WITH {ANSWERS}, k AS (SELECT gold_verdict, count(*) AS c FROM answers GROUP BY 1), n AS (SELECT sum(c) AS n FROM k)
SELECT gold_verdict AS constant, c / CAST(n AS DOUBLE) AS accuracy, (2 * (c / CAST(n AS DOUBLE)) / (1 + c / CAST(n AS DOUBLE))) / 3 AS macro_f1, row_number() OVER (ORDER BY c DESC, gold_verdict) = 1 AS majority FROM k, n""")
def _(spark, sf):
    counts = answers(spark, sf).groupBy(F.col("gold_verdict").alias("constant")).agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy())  # a row a class
    rows = counts.select("constant", share.alias("accuracy"), (F.row_number().over(Window.orderBy(F.desc("c"), "constant")) == 1).alias("majority"))
    return rows.withColumn("macro_f1", 2 * F.col("accuracy") / (1 + F.col("accuracy")) / 3)


@query("per_hypothesis", f"""WITH {ANSWERS} SELECT hypothesis, count(*) AS n, count(*) FILTER (gold_verdict IS NOT DISTINCT FROM pred_verdict) AS n_right,
count(*) FILTER (len(gold) > 0 AND instr(text, gold[1]) <= length(text) / 2) AS first_half FROM answers GROUP BY 1""")
def _(spark, sf):
    early = F.coalesce((F.size("gold") > 0) & (F.instr("text", F.get("gold", F.lit(0))) <= F.length("text") / 2), F.lit(False))
    return answers(spark, sf).groupBy("hypothesis").agg(F.count("*").alias("n"), F.count_if(F.col("gold_verdict").eqNullSafe(F.col("pred_verdict"))).alias("n_right"), F.count_if(early).alias("first_half"))


@query("failure_taxonomy", f"""WITH {ANSWERS}, {FEATURES}, t AS (SELECT CASE WHEN pred_verdict IS NULL THEN 'a_unparsed' WHEN gold_verdict = pred_verdict AND kase IN ('TP', 'TN') THEN 'ok' WHEN gold_verdict <> pred_verdict AND gold_verdict <> 'NotMentioned' AND pred_verdict <> 'NotMentioned' THEN 'b_polarity'
WHEN gold_verdict <> pred_verdict AND pred_verdict = 'NotMentioned' THEN 'c_missed' WHEN gold_verdict <> pred_verdict THEN 'd_invented' ELSE 'e_evidence' END AS kind FROM features) SELECT kind, count(*) AS n FROM t GROUP BY 1""")
def _(spark, sf):
    rows = M.evidence_features(answers(spark, sf))
    g, p = F.col("gold_verdict"), F.col("pred_verdict")
    kind = (
        F.when(p.isNull(), "a_unparsed").when((g == p) & F.col("case").isin("TP", "TN"), "ok").when((g != p) & (g != "NotMentioned") & (p != "NotMentioned"), "b_polarity")
        .when((g != p) & (p == "NotMentioned"), "c_missed").when(g != p, "d_invented").otherwise("e_evidence")
    )
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("worst_quartile", f"""WITH {ANSWERS}, h AS (SELECT hypothesis, count(*) AS n, count(*) FILTER (gold_verdict IS DISTINCT FROM pred_verdict) AS bad FROM answers GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY bad / CAST(n AS DOUBLE) DESC, hypothesis) AS rn, count(*) OVER () AS k FROM h)
SELECT sum(bad) FILTER (rn <= k // 4) / CAST(sum(bad) AS DOUBLE) AS share, CASE WHEN sum(bad) FILTER (rn <= k // 4) / CAST(sum(bad) AS DOUBLE) >= 0.5 THEN 'concentrated' ELSE 'spread' END AS branch FROM r""")
def _(spark, sf):
    h = answers(spark, sf).groupBy("hypothesis").agg(F.count("*").alias("n"), F.count_if(~F.col("gold_verdict").eqNullSafe(F.col("pred_verdict"))).alias("bad"))
    ranked = h.withColumn("rn", F.row_number().over(Window.orderBy(F.desc(F.col("bad") / F.col("n")), "hypothesis"))).withColumn("k", F.count("*").over(Window.partitionBy()))  # a row a hypothesis
    share = F.sum(F.when(F.col("rn") <= F.floor(F.col("k") / 4), F.col("bad"))) / F.sum("bad").cast("double")
    return ranked.agg(share.alias("share")).withColumn("branch", F.when(F.col("share") >= 0.5, "concentrated").otherwise("spread"))


@query("carve_out_lift", f"""WITH {ANSWERS}, w AS (SELECT gold_verdict IS DISTINCT FROM pred_verdict AS wrong, regexp_matches(substr(text, greatest(instr(text, gold[1]) - 300, 1), length(gold[1]) + 600), '(?i) (not|except|unless|pour|der|que) ') AS carve FROM answers WHERE len(gold) > 0)
SELECT carve, count(*) AS n, round(avg(CAST(wrong AS INTEGER)), 6) AS error_rate FROM w GROUP BY 1""")
def _(spark, sf):
    rows = answers(spark, sf).where(F.size("gold") > 0).withColumn("g", F.col("gold")[0])
    around = F.substring(F.col("text"), F.greatest(F.instr("text", F.col("g")) - 300, F.lit(1)), F.length("g") + 600)
    wrong = (~F.col("gold_verdict").eqNullSafe(F.col("pred_verdict"))).cast("int")
    return rounded(rows.groupBy(around.rlike("(?i) (not|except|unless|pour|der|que) ").alias("carve")).agg(F.count("*").alias("n"), F.avg(wrong).alias("error_rate")))


@query("fn_overlap", f"""WITH {ANSWERS}, {FEATURES}, o AS (SELECT CAST(round({s_ratio('shared', 'len(list_distinct(gt))')} * 1000) AS INTEGER) AS o FROM features WHERE kase = 'FN')
SELECT count(*) AS n, list_sort(list(o))[CAST(least(floor(0.5 * count(*)), count(*) - 1) AS INTEGER) + 1] AS p50, list_sort(list(o))[CAST(least(floor(0.9 * count(*)), count(*) - 1) AS INTEGER) + 1] AS p90 FROM o""")
def _(spark, sf):
    rows = M.evidence_features(answers(spark, sf)).where("case = 'FN'").select(F.round(F.col("as_set.r") * 1000).cast("int").alias("o"))
    return RK.rank_percentiles(rows, "o", {"p50": (0.5, 0), "p90": (0.9, 0)})


@query("error_concentration", f"""WITH {ANSWERS}, h AS (SELECT hypothesis, count(*) AS n FROM answers WHERE pred_verdict = 'Contradiction' AND gold_verdict <> 'Contradiction' GROUP BY 1)
SELECT hypothesis, n, round(sum(n) OVER (ORDER BY n DESC, hypothesis) / CAST(sum(n) OVER () AS DOUBLE), 6) AS running_share FROM h""")
def _(spark, sf):
    rows = answers(spark, sf).where((F.col("pred_verdict") == "Contradiction") & (F.col("gold_verdict") != "Contradiction")).groupBy("hypothesis").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy(F.desc("n"), "hypothesis").rowsBetween(Window.unboundedPreceding, 0))  # a row a hypothesis
    return rounded(rows.select("hypothesis", "n", (running / F.sum("n").over(Window.partitionBy()).cast("double")).alias("running_share")))


@query("micro_macro", f"""WITH {ANSWERS}, t AS (SELECT source, count(*) AS n, count(*) FILTER (gold_verdict IS NOT DISTINCT FROM pred_verdict) AS r, count(*) FILTER (pred_verdict IS NULL) AS u FROM answers GROUP BY 1)
SELECT round(sum(r) / CAST(sum(n) AS DOUBLE), 6) AS micro, round(avg(r / CAST(n AS DOUBLE)), 6) AS macro, CAST(sum(u) AS BIGINT) AS unparseable FROM t""")
def _(spark, sf):
    t = answers(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("gold_verdict").eqNullSafe(F.col("pred_verdict"))).alias("r"), F.count_if(F.col("pred_verdict").isNull()).alias("u"))
    return rounded(t.agg((F.sum("r") / F.sum("n")).alias("micro"), F.avg(F.col("r") / F.col("n")).alias("macro"), F.sum("u").alias("unparseable")))


@query("exemplar_sensitivity", f"""WITH {ANSWERS}, v AS (SELECT source, {s_draw('doc_id', 'variant', 3)} AS variant, avg(CAST(gold_verdict IS NOT DISTINCT FROM pred_verdict AS INTEGER)) AS a FROM answers GROUP BY 1, 2)
SELECT source, round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6) AS sd, round(max(a) - min(a), 6) AS range FROM v GROUP BY source""")
def _(spark, sf):
    rows = answers(spark, sf).groupBy("source", draw(F.col("doc_id"), "variant", 3).alias("variant")).agg(F.avg(F.col("gold_verdict").eqNullSafe(F.col("pred_verdict")).cast("int")).alias("a"))
    return rounded(rows.groupBy("source").agg(F.avg("a").alias("mean"), F.coalesce(F.stddev_samp("a"), F.lit(0.0)).alias("sd"), (F.max("a") - F.min("a")).alias("range")))


@query("rank_stability", f"""WITH {ANSWERS}, v AS (SELECT lang, {s_draw('doc_id', 'variant', 3)} AS variant, avg(CAST(gold_verdict IS NOT DISTINCT FROM pred_verdict AS INTEGER)) AS a FROM answers GROUP BY 1, 2),
o AS (SELECT variant, string_agg(lang, '>' ORDER BY a DESC, lang) AS o FROM v GROUP BY variant) SELECT count(*) AS variants, count(DISTINCT o) AS orders FROM o""")
def _(spark, sf):
    v = answers(spark, sf).groupBy("lang", draw(F.col("doc_id"), "variant", 3).alias("variant")).agg(F.avg(F.col("gold_verdict").eqNullSafe(F.col("pred_verdict")).cast("int")).alias("a"))
    o = v.groupBy("variant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("a")).alias("a"), "lang"))), lambda x: x["lang"]), ">").alias("o"))
    return o.agg(F.count("*").alias("variants"), F.count_distinct("o").alias("orders"))


@query("drift_agreement", f"""WITH {ANSWERS} SELECT count(*) AS n, count(*) FILTER (gold_verdict IS NOT DISTINCT FROM pred_verdict) AS same_verdict, count(*) FILTER (len(gold) > 0 AND len(pred) > 0) AS both_cite,
count(*) FILTER (gold = pred) AS same_evidence FROM answers""")
def _(spark, sf):
    a = answers(spark, sf)
    return a.agg(F.count("*").alias("n"), F.count_if(F.col("gold_verdict").eqNullSafe(F.col("pred_verdict"))).alias("same_verdict"), F.count_if((F.size("gold") > 0) & (F.size("pred") > 0)).alias("both_cite"), F.count_if(F.col("gold") == F.col("pred")).alias("same_evidence"))


@query("strata_accuracy", f"""WITH {ANSWERS} SELECT CASE WHEN n_chars < 2000 THEN '<2K' WHEN n_chars < 4000 THEN '2-4K' WHEN n_chars < 8000 THEN '4-8K' ELSE '>8K' END AS length, count(*) AS n, round(avg(CAST(gold_verdict IS NOT DISTINCT FROM pred_verdict AS INTEGER)), 6) AS accuracy FROM answers GROUP BY 1""")
def _(spark, sf):
    length = X.bucket(F.col("n_chars"), [(2_000, "<2K"), (4_000, "2-4K"), (8_000, "4-8K")], ">8K")
    return rounded(answers(spark, sf).groupBy(length.alias("length")).agg(F.count("*").alias("n"), F.avg(F.col("gold_verdict").eqNullSafe(F.col("pred_verdict")).cast("int")).alias("accuracy")))


def _bootstrap_sql(rows: str, named: list[str], gold: str, preds: list[str], classes: list[str], by: str | None = None, draws: int = 2000) -> str:
    """Hashed Poisson weights of counted combinations; macro F1 of each draw."""
    key = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in named)
    one = " + ".join(f"CAST(x >= {step} AS INTEGER)" for step in RS.STEPS)
    is_ = lambda c, x: f"coalesce({c} = {x}, false)"
    sums = ", ".join(f"sum(w) FILTER ({is_(gold, c)} AND {is_(p, c)}) AS tp{k}_{j}, sum(w) FILTER ({is_(gold, c)} <> {is_(p, c)}) AS off{k}_{j}" for k, p in enumerate(preds) for j, c in enumerate(classes))
    f1 = lambda k, j: f"CASE WHEN tp{k}_{j} > 0 THEN 2 * tp{k}_{j} / CAST(2 * tp{k}_{j} + coalesce(off{k}_{j}, 0) AS DOUBLE) ELSE 0 END"
    macro = ", ".join(f"avg(({' + '.join(f1(k, j) for j in range(len(classes)))}) / {len(classes)}) AS m{k}" for k in range(len(preds)))
    group = f", {by}" if by else ""
    return f"""WITH {ANSWERS}, rows AS ({rows}), cells AS (SELECT {', '.join(named)}, count(*) AS c FROM rows GROUP BY ALL),
d AS (SELECT *, md5('0|' || {key} || '|' || draw) AS h FROM cells, unnest(range({draws})) t(draw)),
u AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(i * 4 + 1 AS BIGINT), 4) AS INTEGER)) AS u FROM d),
w AS (SELECT *, CASE WHEN c <= {RS.SINGLE} THEN list_sum(list_transform(u[1:c], lambda x: {one})) ELSE greatest(0, floor(c + sqrt(c) * ((list_sum(u) / 65536.0 - 4 + 8 / 131072.0) * sqrt(1.5)) + 0.5)) END AS w FROM u),
s AS (SELECT draw{group}, {sums} FROM w GROUP BY draw{group}), m AS (SELECT draw, {macro} FROM s GROUP BY draw),
v AS (SELECT round({'m0 - m1' if len(preds) == 2 else 'm0'}, 9) AS v FROM m)
SELECT round(avg(v), 6) AS mean, round(list_sort(list(v))[{int(0.025 * draws) + 1}], 6) AS ci_low, round(list_sort(list(v))[{int(0.975 * draws) + 1}], 6) AS ci_high, round(avg(CAST(v > 0 AS INTEGER)), 6) AS p_positive FROM v"""


_CLASSES = [f"'{c}'" for c in CLASSES]
_OTHER = f"CASE WHEN {s_draw('doc_id', 'hit2', 10)} < 6 THEN gold_verdict ELSE 'NotMentioned' END AS other"


@query("bootstrap_ci", _bootstrap_sql("SELECT * FROM answers", ["gold_verdict", "pred_verdict"], "gold_verdict", ["pred_verdict"], _CLASSES))
def _(spark, sf):
    return rounded(RS.bootstrap(answers(spark, sf), "gold_verdict", ["pred_verdict"], CLASSES))


def two_systems(spark, sf):
    """Answers with those of another system beside them."""
    return answers(spark, sf).withColumn("other", F.when(draw(F.col("doc_id"), "hit2", 10) < 6, F.col("gold_verdict")).otherwise("NotMentioned"))


@query("paired_bootstrap", _bootstrap_sql(f"SELECT *, {_OTHER} FROM answers", ["gold_verdict", "pred_verdict", "other"], "gold_verdict", ["pred_verdict", "other"], _CLASSES))
def _(spark, sf):
    return rounded(RS.bootstrap(two_systems(spark, sf), "gold_verdict", ["pred_verdict", "other"], CLASSES))


@query("paired_bootstrap_by_category", _bootstrap_sql(f"SELECT source, len(gold) > 0 AS g, len(pred) > 0 AS a, {s_draw('doc_id', 'present2', 5)} > 0 AS b FROM answers", ["source", "g", "a", "b"], "g", ["a", "b"], ["true"], by="source"))
def _(spark, sf):
    """Presence of evidence: the mean over sources of the F1 of the present ones, of two systems."""
    rows = answers(spark, sf).select("source", (F.size("gold") > 0).alias("g"), (F.size("pred") > 0).alias("a"), (draw(F.col("doc_id"), "present2", 5) > 0).alias("b"))
    return rounded(RS.bootstrap(rows, "g", ["a", "b"], [True], by="source"))


@query("training_curve", """WITH d AS (SELECT date_trunc('hour', ts) AS step, avg(value) AS loss FROM events GROUP BY 1),
w AS (SELECT step, loss, row_number() OVER (ORDER BY step) AS x, count(*) OVER () AS n, avg(loss) OVER (ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smooth FROM d),
q AS (SELECT *, x - 1 < greatest(1, n // 4) AS head, x - 1 >= greatest(1, n * 3 // 4) AS tail, x - 1 >= greatest(1, n * 9 // 10) AS late FROM w)
SELECT count(*) AS steps, round(regr_slope(loss, x), 4) AS slope, round((avg(loss) FILTER (tail) - avg(loss) FILTER (head)) / abs(avg(loss) FILTER (head)), 6) AS change, round((arg_max(loss, x) FILTER (late) - arg_min(loss, x) FILTER (late)) / abs(arg_min(loss, x) FILTER (late)), 6) AS drift,
round(stddev_pop(loss) FILTER (tail) / avg(loss) FILTER (tail), 6) AS tail_cv, round(stddev_samp(loss) / avg(loss), 4) AS cv, count(*) FILTER (loss > 1.02 * smooth) AS spikes FROM q""")
def _(spark, sf):
    """The hourly mean of logged values: slope, change from the first to the last quarter, drift over the last tenth, variation and spikes."""
    d = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("step")).agg(F.avg("value").alias("loss"))
    w = Window.orderBy("step")  # a row an hour
    rows = d.select("loss", F.row_number().over(w).alias("x"), F.count("*").over(Window.partitionBy()).alias("n"), F.avg("loss").over(w.rowsBetween(-4, 0)).alias("smooth"))
    return M.curve(rows)


@query("cost_table", f"""WITH t AS (SELECT conv_id, 'model-' || conv_id % 3 AS model, role, len({s_tokens('text')}) AS n FROM conversations)
SELECT model, count(DISTINCT conv_id) AS conversations, CAST(coalesce(sum(n) FILTER (role <> 'assistant'), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS reply_tokens,
round(sum(n) / CAST(count(DISTINCT conv_id) AS DOUBLE), 4) AS per_conversation, round(3 * coalesce(sum(n) FILTER (role <> 'assistant'), 0) / 1e6 + 15 * coalesce(sum(n) FILTER (role = 'assistant'), 0) / 1e6, 6) AS cost FROM t GROUP BY 1""")
def _(spark, sf):
    """Tokens read and written by each of three models over their conversations, and what they cost at prices for a million."""
    t = table(spark, sf, "conversations").select("conv_id", F.concat(F.lit("model-"), F.col("conv_id") % 3).alias("model"), (F.col("role") == "assistant").alias("reply"), F.size(X.tokens("text")).alias("n"))
    each = t.groupBy("model", "conv_id").agg(F.coalesce(F.sum(F.when(~F.col("reply"), F.col("n"))), F.lit(0)).alias("read"), F.coalesce(F.sum(F.when(F.col("reply"), F.col("n"))), F.lit(0)).alias("written"))
    sums = each.groupBy("model").agg(F.count("*").alias("conversations"), F.sum("read").alias("prompt_tokens"), F.sum("written").alias("reply_tokens"))
    total, cost = F.col("prompt_tokens") + F.col("reply_tokens"), 3 * F.col("prompt_tokens") / 1e6 + 15 * F.col("reply_tokens") / 1e6
    return sums.select("*", F.round(total / F.col("conversations"), 4).alias("per_conversation"), F.round(cost, 6).alias("cost"))


_VOTES = f"""n AS (SELECT doc_id, text, {s_tokens('text')} AS w, gold FROM answers),
win AS (SELECT doc_id, gold, w, unnest(CASE WHEN len(w) <= 400 THEN [0] ELSE range(0, CAST(ceil((len(w) - 400) / 300.0) AS INTEGER) + 1) END) AS k FROM n),
votes AS (SELECT doc_id, CAST(k AS INTEGER) AS k, gold, {s_draw("doc_id || '-' || k", 'present', 3)} = 0 AS present, ['Contradiction', 'Entailment', 'NotMentioned'][{s_draw("doc_id || '-' || k", 'vote', 3)} + 1] AS verdict,
  list_filter(gold, lambda q: {s_norm('q')} <> '' AND contains(array_to_string(w[k * 300 + 1:k * 300 + 400], ' '), {s_norm('q')})) AS evidence FROM win)"""


def votes(spark, sf):
    """A vote for each window of each document."""
    rows = answers(spark, sf).withColumn("w", X.tokens("text"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.size("w") - 400) / F.lit(300)), F.lit(0)).cast("int"))))
    part = F.array_join(F.slice("w", F.col("k") * 300 + 1, F.lit(400)), " ")
    seen = X.bind(part, lambda hay: F.filter(F.col("gold"), lambda q: (X.norm(q) != "") & F.contains(hay, X.norm(q))))
    key = F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("k").cast("string"))
    verdict = F.array(F.lit("Contradiction"), F.lit("Entailment"), F.lit("NotMentioned"))[draw(key, "vote", 3)]
    return rows.select("doc_id", F.col("k").alias("window"), "gold", (draw(key, "present", 3) == 0).alias("present"), verdict.alias("verdict"), seen.alias("evidence")).withColumn("n_grounded", F.size("evidence")).withColumn("n_located", F.size("evidence"))


@query("or_over_windows", f"""WITH {ANSWERS}, {_VOTES} SELECT doc_id, bool_or(present) AS present, count(*) FILTER (present) AS n_votes, count(*) AS n_windows,
coalesce(array_to_string(flatten(list(evidence ORDER BY k) FILTER (present)), '|'), '') AS evidence FROM votes GROUP BY 1""")
def _(spark, sf):
    return DS.or_over_windows(votes(spark, sf), ["doc_id"]).withColumn("evidence", F.array_join("evidence", "|"))


@query("or_over_windows_grounded", f"WITH {ANSWERS}, {_VOTES} SELECT doc_id, bool_or(present AND len(evidence) > 0) AS present, count(*) FILTER (present AND len(evidence) > 0) AS n_votes FROM votes GROUP BY 1")
def _(spark, sf):
    return DS.or_over_windows(votes(spark, sf), ["doc_id"], "grounded").select("doc_id", "present", "n_votes")


@query("strongest_verdict", f"""WITH {ANSWERS}, {_VOTES}, r AS (SELECT *, CASE verdict WHEN 'Contradiction' THEN 1 WHEN 'Entailment' THEN 2 ELSE 3 END AS r, min(CASE verdict WHEN 'Contradiction' THEN 1 WHEN 'Entailment' THEN 2 ELSE 3 END) OVER (PARTITION BY doc_id) AS b FROM votes)
SELECT doc_id, ['Contradiction', 'Entailment', 'NotMentioned'][any_value(b)] AS verdict, coalesce(array_to_string(flatten(list(evidence ORDER BY k) FILTER (r = b)), '|'), '') AS evidence FROM r GROUP BY 1""")
def _(spark, sf):
    return DS.strongest_verdict(votes(spark, sf), ["doc_id"], ["Contradiction", "Entailment", "NotMentioned"]).withColumn("evidence", F.array_join("evidence", "|"))


@query("windowed_yield", f"""WITH {ANSWERS}, {_VOTES} SELECT count(*) AS n_windows, count(*) FILTER (len(evidence) > 0) AS positive, count(DISTINCT doc_id) FILTER (len(gold) > 0) AS docs_with_gold, count(DISTINCT doc_id) FILTER (len(evidence) > 0) AS docs_reached FROM votes""")
def _(spark, sf):
    v = votes(spark, sf)
    seen = F.size("evidence") > 0
    return v.agg(F.count("*").alias("n_windows"), F.count_if(seen).alias("positive"), F.count_distinct(F.when(F.size("gold") > 0, F.col("doc_id"))).alias("docs_with_gold"), F.count_distinct(F.when(seen, F.col("doc_id"))).alias("docs_reached"))


@query("error_classes", f"""WITH {ANSWERS}, {_VOTES}, d AS (SELECT doc_id, len(any_value(gold)) > 0 AS g, bool_or(len(evidence) > 0) AS covered, bool_or(present) AS answered, bool_or(present AND len(evidence) > 0) AS grounded FROM votes GROUP BY 1)
SELECT CASE WHEN NOT g AND NOT answered OR g AND grounded THEN 'right' WHEN g AND NOT covered THEN 'coverage' WHEN g AND NOT answered THEN 'accuracy' WHEN g THEN 'grounding' ELSE 'aggregation' END AS kind, count(*) AS n FROM d GROUP BY 1""")
def _(spark, sf):
    seen = F.size("evidence") > 0
    d = votes(spark, sf).groupBy("doc_id").agg(F.bool_or(F.size("gold") > 0).alias("g"), F.bool_or(seen).alias("covered"), F.bool_or("present").alias("answered"), F.bool_or(F.col("present") & seen).alias("grounded"))
    kind = F.when((~F.col("g") & ~F.col("answered")) | (F.col("g") & F.col("grounded")), "right").when(F.col("g") & ~F.col("covered"), "coverage").when(F.col("g") & ~F.col("answered"), "accuracy").when(F.col("g"), "grounding").otherwise("aggregation")
    return d.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("visibility", f"""WITH {ANSWERS}, v AS (SELECT lang, gold, list_filter(gold, lambda q: contains({s_norm('substr(text, greatest(length(text) - 2000, 0) + 1)')}, {s_norm('q')})) AS seen FROM answers WHERE len(gold) > 0)
SELECT lang, CAST(sum(len(gold)) AS BIGINT) AS spans, CAST(sum(len(seen)) AS BIGINT) AS spans_seen, count(*) AS n_rows, count(*) FILTER (len(seen) = len(gold)) AS rows_whole FROM v GROUP BY lang""")
def _(spark, sf):
    rows = answers(spark, sf).where(F.size("gold") > 0)
    rows = rows.select("lang", "gold", DS.visible(F.col("gold"), F.col("text"), F.greatest(F.length("text") - 2000, F.lit(0)), "plain").alias("seen"))
    return rows.groupBy("lang").agg(F.sum(F.size("gold")).alias("spans"), F.sum(F.size("seen")).alias("spans_seen"), F.count("*").alias("n_rows"), F.count_if(F.size("seen") == F.size("gold")).alias("rows_whole"))


@query("truncation_safety", f"""WITH {ANSWERS}, e AS (SELECT doc_id, list_max(list_transform(gold, lambda q: instr(text, q) + length(q) - 1)) AS last_char FROM answers WHERE len(gold) > 0)
SELECT count(*) AS pairs, count(*) FILTER (last_char > 150) AS lost FROM e""")
def _(spark, sf):
    rows = answers(spark, sf).where(F.size("gold") > 0)
    last = F.array_max(F.transform("gold", lambda q: F.instr(F.col("text"), q) + F.length(q) - 1))
    return rows.agg(F.count("*").alias("pairs"), F.count_if(last > 150).alias("lost"))
