"""Splits and samples. Seeded draws are ranks by a hash of seed and key, which any engine reproduces; ranks are within groups."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def draw(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of least draw: a top-n, not a sort of all rows."""
    return df.orderBy(draw(F.col(key), seed), key).limit(n)


def ranked_draws(df: DataFrame, key: str, seed: str, by: list[str] = ()) -> DataFrame:
    """``df`` with ``__rank``, each row's place (from 1) by draw, and ``__n``, how many there are, within groups or over all. The order is
    a range sort: ranges of the hash are counted, and rows ranked within theirs, so that no task sorts a group."""
    rows = df.withColumn("__d", draw(F.col(key), seed)).withColumn("__p", F.substring("__d", 1, 3))  # 4096 ranges
    counts = rows.groupBy(*by, "__p").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # of counts: 4096 a group
    counts = counts.select(*by, "__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy(*by)).alias("__n"))
    within = F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__d", key))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "__p"]]
    joined = rows.withColumn("__rn", within).alias("r").join(counts.alias("c"), functools.reduce(operator.and_, same))
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("__before") + F.col("__rn")).alias("__rank"), "__n")


def stratified_sample(df: DataFrame, key: str, label: str, share: float, seed: str) -> DataFrame:
    """This share of each label's rows (half to even), one at least."""
    ranked = ranked_draws(df, key, seed, [label])
    return ranked.where(F.col("__rank") <= F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(share)))).drop("__rank", "__n")


def round_robin(df: DataFrame, key: str, label: str, category: str, n: int, seed: str) -> DataFrame:
    """n rows of each label, taken from its categories in turn."""
    inner = Window.partitionBy(label, category).orderBy(draw(F.col(key), seed), key)
    turns = Window.partitionBy(label).orderBy("__turn", category)
    out = df.withColumn("__turn", F.row_number().over(inner)).where(F.col("__turn") <= n)
    return out.withColumn("__rn", F.row_number().over(turns)).where(F.col("__rn") <= n).drop("__turn", "__rn")


def oversample(df: DataFrame, key: str, label: str, seed: str) -> DataFrame:
    """Each label's rows repeated to the size of the largest label: whole copies, then the rows of least draw; ``copy`` from 0."""
    most = df.groupBy(label).agg(F.count("*").alias("__c")).agg(F.max("__c").alias("__m"))
    out = ranked_draws(df, key, seed, [label]).crossJoin(F.broadcast(most))  # one row
    times = F.floor(F.col("__m") / F.col("__n")) + (F.col("__rank") <= F.col("__m") % F.col("__n")).cast("int")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), (times - 1).cast("int")))).drop("__rank", "__n", "__m")


def group_split(df: DataFrame, group: str, shares: list[tuple[str, float]], rest: str, seed: str) -> DataFrame:
    """``(group, split)``: whole groups, in the order of their draws, to splits of these shares (half to even)."""
    out, done, split = ranked_draws(df.select(group).distinct(), group, seed), F.lit(0), None
    for name, share in shares:
        done = done + F.bround(F.col("__n") * F.lit(share)).cast("long")
        split = F.when(F.col("__rank") <= done, name) if split is None else split.when(F.col("__rank") <= done, name)
    return out.select(group, split.otherwise(rest).alias("split"))


def mixture_cap(df: DataFrame, key: str, task: str, capped: str, share: float, seed: str) -> DataFrame:
    """Rows of the capped task are at most this share of the result: those of least draw stay."""
    is_capped = F.coalesce(F.col(task) == capped, F.lit(False))
    want = df.agg(F.floor(F.lit(share / (1 - share)) * F.count_if(~is_capped)).alias("__want"))  # one row
    some = ranked_draws(df.where(is_capped), key, seed).crossJoin(F.broadcast(want)).where("__rank <= __want")
    return df.where(~is_capped).unionByName(some.drop("__rank", "__n", "__want"))


def median_rows(df: DataFrame, label: str, size: Column, key: str) -> DataFrame:
    """The row of each label at the middle of its sizes (the upper one of two). Sizes are counted first; only rows of the middle size
    are put in order."""
    rows = df.withColumn("__s", size)
    counts = rows.groupBy(label, "__s").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(label).orderBy("__s"))
    counts = counts.withColumn("__upto", upto).withColumn("__at", F.floor(F.sum("__c").over(Window.partitionBy(label)) / 2) + 1)
    middle = counts.where((F.col("__upto") >= F.col("__at")) & (F.col("__upto") - F.col("__c") < F.col("__at")))
    middle = middle.select(F.col(label).alias("__l"), F.col("__s").alias("__m"), (F.col("__at") - F.col("__upto") + F.col("__c")).alias("__place"))  # a row a label
    same = rows.join(F.broadcast(middle) if middle.limit(100_001).count() <= 100_000 else middle, F.col(label).eqNullSafe(F.col("__l")) & F.col("__s").eqNullSafe(F.col("__m")))
    return same.withColumn("__rn", F.row_number().over(Window.partitionBy(label).orderBy(key))).where("__rn = __place").drop("__s", "__l", "__m", "__place", "__rn")


def shard(df: DataFrame, key: str, of: int, k: int) -> DataFrame:
    return df.where(F.pmod(F.col(key), F.lit(of)) == k)


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def shots(train: DataFrame, key: str, label: str, classes: list, k: int, example: Column, seed: str) -> DataFrame:
    """One row with ``shots``, an array of k examples drawn with replacement from the classes in turn; a class without rows gives none. A draw
    is the row of least hash of seed, draw and key, so all k are found in one pass of partial minima."""
    of = lambda i: F.when(F.col(label) == F.lit(classes[i % len(classes)]), draw(F.col(key), f"{seed}|{i}"))
    least = [F.min_by(example, of(i)).alias(f"s{i}") for i in range(k)]
    held = [F.when(F.min(of(i)).isNotNull(), F.lit(True)).alias(f"h{i}") for i in range(k)]
    found = train.agg(*least, *held)
    return found.select(F.filter(F.array(*[F.when(F.col(f"h{i}"), F.col(f"s{i}")) for i in range(k)]), lambda x: x.isNotNull()).alias("shots"))
