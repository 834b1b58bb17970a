"""Bootstraps by hashed weights.

A resample draws each row a number of times; with weights drawn for each row by itself (Poisson, mean one) resamples need no
knowledge of one another's rows, and all that a metric needs are weighted sums. Rows that look alike to the metric are counted
first: c of them together have a Poisson weight of mean c. Weights come from a hash of the combination and the draw, so that any
engine, any partitioning and any retry draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 65,536 times the probabilities that a Poisson variable of mean one is at most 0, 1, 2, ...
STEPS = [24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535]
#: Counts up to this are sums of single draws; larger ones are drawn as a normal variable of the same mean and variance.
SINGLE = 8


def weight(count: Column, key: Column) -> Column:
    """A Poisson draw of this mean, by the hash of a key: eight uniform numbers of 16 bits."""
    u = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(F.md5(key), i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    one = lambda x: sum(((x >= step).cast("int") for step in STEPS), F.lit(0))
    few = F.aggregate(F.slice(u, F.lit(1), F.least(count, F.lit(SINGLE)).cast("int")), F.lit(0), lambda s, x: s + one(x)).cast("long")
    normal = (F.aggregate(u, F.lit(0), lambda s, x: s + x) / 65536.0 - 4 + 8 / 131072.0) * (12 / 8) ** 0.5
    return F.when(count <= SINGLE, few).otherwise(F.greatest(F.lit(0), F.floor(count + F.sqrt(count) * normal + 0.5))).cast("long")


def bootstrap(df: DataFrame, gold: str, preds: list[str], classes: list, by: str | None = None, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Percentile interval of macro F1 over ``draws`` resamples (and, of two predictions, of the difference and how often the first is
    better). Macro F1 is the mean over classes; with ``by``, over its values, of the F1 of the one class given."""
    named = [*([by] if by else []), gold, *preds]
    cells = df.groupBy(*named).agg(F.count("*").alias("__c"))
    cells = cells.withColumn("__key", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in named]))
    drawn = cells.withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.withColumn("__w", weight(F.col("__c"), F.concat_ws("|", F.lit(str(seed)), "__key", F.col("__draw").cast("string"))))
    is_ = lambda column, c: F.coalesce(F.col(column) == F.lit(c), F.lit(False))
    total = lambda c: F.sum(F.when(c, F.col("__w")).otherwise(0))
    sums = [x for k, p in enumerate(preds) for j, c in enumerate(classes) for x in (total(is_(gold, c) & is_(p, c)).alias(f"__tp{k}_{j}"), total(is_(gold, c) != is_(p, c)).alias(f"__off{k}_{j}"))]
    # a row for each draw, or each draw and value of ``by``
    rows = drawn.groupBy("__draw", *([by] if by else [])).agg(*sums)
    f1 = lambda k, j: F.when(F.col(f"__tp{k}_{j}") > 0, 2 * F.col(f"__tp{k}_{j}") / (2 * F.col(f"__tp{k}_{j}") + F.col(f"__off{k}_{j}"))).otherwise(0.0)
    macro = [sum((f1(k, j) for j in range(len(classes))), F.lit(0.0)) / len(classes) for k in range(len(preds))]
    each = rows.groupBy("__draw").agg(*[F.avg(m).alias(f"m{k}") for k, m in enumerate(macro)])
    v = F.round(F.col("m0") - F.col("m1") if len(preds) == 2 else F.col("m0"), 9)
    in_order = F.sort_array(F.collect_list("v"))  # ``draws`` values
    at = lambda q: F.get(in_order, F.lit(int(q * draws)))
    return each.select(v.alias("v")).agg(F.avg("v").alias("mean"), at(0.025).alias("ci_low"), at(0.975).alias("ci_high"), F.avg((F.col("v") > 0).cast("int")).alias("p_positive"))
