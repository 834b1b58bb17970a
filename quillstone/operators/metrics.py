"""Scores of predicted classes and evidence, as aggregations: one shuffle on the group keys, partial sums before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

UNPARSED = "__unparsed__"


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = X.ratio(tp, tp + fp), X.ratio(tp, tp + fn)
    return p, r, X.f_measure(p, r)


def class_counts(df: DataFrame, gold: str, pred: str, classes: list[str], by: list[str] = ()) -> DataFrame:
    """tp, fp, fn of each class (and group). A null prediction is no class."""
    rows = df.withColumn("class", F.explode(F.array(*map(F.lit, classes))))
    is_gold, is_pred = F.col(gold).eqNullSafe(F.col("class")), F.col(pred).eqNullSafe(F.col("class"))
    return rows.groupBy(*by, "class").agg(count_if(is_gold & is_pred).alias("tp"), count_if(~is_gold & is_pred).alias("fp"), count_if(is_gold & ~is_pred).alias("fn"))


def class_report(df: DataFrame, gold: str, pred: str, classes: list[str], by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    counted = class_counts(df, gold, pred, classes, by)
    return counted.select(*by, "class", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def macro_report(df: DataFrame, gold: str, pred: str, classes: list[str], by: list[str] = ()) -> DataFrame:
    """Macro F1 and accuracy: both from class counts, so one pass."""
    report = class_report(df, gold, pred, classes, by)
    total = df.groupBy(*by).agg(F.count("*").alias("n"), count_if(F.col(gold).eqNullSafe(F.col(pred))).alias("right"))
    macro = report.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
    joined = macro.join(total, list(by)) if by else macro.crossJoin(F.broadcast(total))  # one row each
    return joined.select(*by, "n", "macro_f1", X.ratio(F.col("right"), F.col("n")).alias("accuracy"))


def confusion(df: DataFrame, gold: str, pred: str, classes: list[str]) -> DataFrame:
    """A row for each gold class, a column for each prediction; null predictions are UNPARSED."""
    shown = df.withColumn("__p", F.coalesce(F.col(pred), F.lit(UNPARSED)))
    return shown.groupBy(gold).pivot("__p", [*classes, UNPARSED]).count().na.fill(0)


def presence_report(df: DataFrame, gold: str, pred: str, by: str) -> DataFrame:
    """F1 of presence for each category and, where the category is null, pooled over all."""
    g, p = F.col(gold), F.coalesce(F.col(pred), F.lit(False))
    counted = df.groupingSets([[F.col(by)], []], by).agg(
        count_if(g & p).alias("tp"), count_if(~g & p).alias("fp"), count_if(g & ~p).alias("fn"), count_if(~g & ~p).alias("tn"), F.grouping(by).cast("int").alias("pooled")
    )
    prec, rec, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counted.select(by, "pooled", "tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall"), f.alias("f1"), X.ratio(F.col("fp") + F.col("tn"), n).alias("always_absent_accuracy"))


def evidence_features(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Row features that all evidence scores are made of; computed once, narrow."""
    g, p = F.col(gold), F.col(pred)
    df = df.withColumns({"__gt": X.tokens(F.array_join(g, " ")), "__pt": X.tokens(F.array_join(p, " "))})
    gt, pt = F.col("__gt"), F.col("__pt")
    both = F.size(F.array_union(gt, pt))
    return df.withColumns({
        "case": X.evidence_case(g, p), "share": X.covered_share(g, p), "gold_bearing": F.size(g) > 0, "abstained": (F.size(g) > 0) & (F.size(p) == 0),
        "jaccard": F.when(both > 0, X.jaccard(gt, pt)), "multiset": X.multiset_prf(gt, pt), "as_set": X.set_prf(gt, pt),
    }).drop("__gt", "__pt")


def evidence_report(features: DataFrame, by: list[str] = ()) -> DataFrame:
    """Strict F1 and F2, partial credit, Jaccard, false abstention, token F1 as multisets and sets."""
    c = F.col("case")
    counted = features.groupBy(*by).agg(
        *[count_if(c == k).alias(k.lower()) for k in ("TP", "FN", "FP", "TN")],
        F.avg(F.when(F.col("gold_bearing"), F.col("share"))).alias("partial_credit"), F.avg("jaccard").alias("jaccard"), count_if(F.col("abstained")).alias("abstained"),
        *[F.avg(F.when(F.col("gold_bearing"), F.col(f"multiset.{k}"))).alias(f"token_{k}") for k in "prf"], F.avg(F.when(F.col("gold_bearing"), F.col("as_set.f"))).alias("token_f_sets"),
    )
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    f2 = X.ratio(5 * F.col("tp"), 5 * F.col("tp") + 4 * F.col("fn") + F.col("fp"))
    zero = [F.coalesce(k, F.lit(0.0)).alias(k) for k in ("partial_credit", "jaccard", "token_p", "token_r", "token_f", "token_f_sets")]
    return counted.select(*by, "tp", "fn", "fp", "tn", p.alias("precision"), r.alias("recall"), f.alias("f1"), f2.alias("f2"), *zero, X.ratio(F.col("abstained"), F.col("tp") + F.col("fn")).alias("false_abstention"))


def joint_report(df: DataFrame, gold: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Class right and all gold evidence covered; strictly, without evidence where there is none."""
    right = F.col(gold).eqNullSafe(F.col(pred)) & (F.col("share") == 1.0)
    return df.groupBy(*by).agg(F.avg(right.cast("int")).alias("joint_lenient"), F.avg((right & (F.col("case") != "FP")).cast("int")).alias("joint_strict"))


def hallucination_report(df: DataFrame, text: str, pred: str) -> DataFrame:
    """Predicted spans that the text doesn't hold, forgiving punctuation at their ends; the text is normalised once a row."""
    bad = X.bind(X.norm(text), lambda hay: F.size(F.filter(F.col(pred), lambda s: (X.norm(s) != "") & ~X.grounded(X.norm(s), hay))))
    rows = df.where(F.size(pred) > 0).select(F.size(pred).alias("spans"), bad.alias("bad"))
    total = rows.agg(F.sum("spans").cast("long").alias("n_spans"), F.sum("bad").cast("long").alias("n_hallucinated"), F.count("*").alias("n_examples"), count_if(F.col("bad") > 0).alias("n_bad"))
    return total.select("n_spans", "n_hallucinated", "n_examples", X.ratio(F.col("n_hallucinated"), F.col("n_spans")).alias("span_rate"), X.ratio(F.col("n_bad"), F.col("n_examples")).alias("example_rate"))


def curve(rows: DataFrame) -> DataFrame:
    """A training curve (loss, x from 1, n, smooth: the mean of the last five) in numbers: slope, change of the mean from the first to the
    last quarter, drift over the last tenth, variation in the last quarter and in all, and how many steps are 2 % above the mean."""
    loss, x, n = F.col("loss"), F.col("x"), F.col("n")
    start = lambda tenths: F.greatest(F.lit(1), F.floor(n * tenths / 20))
    head, tail, late = x - 1 < F.greatest(F.lit(1), F.floor(n / 4)), x - 1 >= start(15), x - 1 >= start(18)
    of = lambda f, c: f(F.when(c, loss))
    first, last = F.min_by(F.when(late, loss), F.when(late, x)), F.max_by(F.when(late, loss), F.when(late, x))
    return rows.agg(
        F.count("*").alias("steps"), F.round(F.regr_slope("loss", x.cast("double")), 4).alias("slope"), F.round((of(F.avg, tail) - of(F.avg, head)) / F.abs(of(F.avg, head)), 6).alias("change"), F.round((last - first) / F.abs(first), 6).alias("drift"),
        F.round(of(F.stddev_pop, tail) / of(F.avg, tail), 6).alias("tail_cv"), F.round(F.stddev_samp("loss") / F.avg("loss"), 4).alias("cv"), F.count_if(loss > 1.02 * F.col("smooth")).alias("spikes"),
    )
