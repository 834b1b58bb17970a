"""Places in an order over rows of any number: running sums by counted ranges.

Rows are cut into ranges of the order, a running sum is taken within each range and group, and what lies in the ranges before is added from a
table of sums, a row for each range and group. So no task orders a group, however many rows it has.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def running(df: DataFrame, order: list[str], by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """``df`` with ``__upto``, the sum of weights (of ones) up to and with each row in its group, and ``__n``, the group's sum. Rows of one
    place in the order lie in one range; their own order is arbitrary unless ``order`` tells all rows apart."""
    names = df.columns
    weighed = df.withColumn("__weight", F.lit(1) if weight is None else weight)
    ranged = weighed.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged.write.parquet(path := scratch(df.sparkSession, "ranges"))  # read twice: a range must be the same rows both times
    ranged = df.sparkSession.read.parquet(path)
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__weight").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.sum("__sum").over(Window.partitionBy(*by)).alias("__n"))
    within = F.sum("__weight").over(Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = functools.reduce(operator.and_, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"s.`{c}`")) for c in [*by, "__range"]])
    joined = ranged.withColumn("__own", within).alias("r").join(sums.alias("s"), same)
    return joined.select(*[F.col(f"r.`{c}`") for c in names], (F.col("__before") + F.col("__own")).alias("__upto"), "__n")


def rank_percentiles(df: DataFrame, value: str, qs: dict[str, tuple[float, int]], by: list[str] = ()) -> DataFrame:
    """Values at ranks ``min(int(q n) - less, n - 1)``, from counts of distinct values and running sums of these. qs: name -> (q, less)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    ranked = running(counts, [value], by, F.col("__c"))
    at = lambda q, less: F.greatest(F.least(F.floor(F.lit(q) * F.col("__n")).cast("long") - less, F.col("__n") - 1), F.lit(0))
    return ranked.groupBy(*by).agg(F.max("__n").alias("n"), *[F.min(F.when(F.col("__upto") > at(q, less), F.col(value))).alias(name) for name, (q, less) in qs.items()])


def running_cap(df: DataFrame, group: str, order: str, passes: Column, cap: int) -> DataFrame:
    """Adds ``capped``: among rows that pass, those after the first ``cap`` of their group in row order."""
    rows = df.withColumn("__ok", F.coalesce(passes, F.lit(False)))
    out = running(rows, [order], [group, "__ok"])
    return out.withColumn("capped", F.col("__ok") & (F.col("__upto") > cap)).drop("__ok", "__upto", "__n")
