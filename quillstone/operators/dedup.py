"""Equal and similar texts within and across splits of a dataset."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.scratch import scratch


def duplicate_rows(df: DataFrame, key: Column) -> DataFrame:
    """Rows, distinct keys, and rows beyond the first of each key."""
    counts = df.select(F.sha2(key, 256).alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct")).withColumn("n_duplicate", F.col("n") - F.col("n_distinct"))


def equal_groups(df: DataFrame, id_col: str, text: Column, split: str | None = None) -> DataFrame:
    """Groups of two texts or more that normalise alike: hash, size, least id, and whether they cross splits."""
    spans = F.min(split) != F.max(split) if split else F.lit(False)
    grouped = df.select(id_col, *([split] if split else []), F.sha2(X.norm(text), 256).alias("h")).groupBy("h")
    return grouped.agg(F.count("*").alias("size"), F.min(id_col).alias("first_id"), spans.alias("crosses")).where("size > 1")


def split_overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """For each two splits, how many keys are in both."""
    keys = df.select(key, split).distinct()
    pairs = keys.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    a = pairs.select(F.explode("s").alias("a"), "s")
    return a.select("a", F.explode("s").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


#: Sets that are compared with one another, or with as many others, in one task; columns of shingles that are multiplied at once.
BLOCK, COLUMNS = 1024, 4096


def _compared(df: DataFrame, id_col: str, tokens: Column, k: int, least: float, label: Column | None, emit: Callable, schema: T.StructType) -> DataFrame:
    """What ``emit`` makes of the similar sets of each block; each two similar sets are seen in one block only.

    Two sets as similar share a shingle of their prefixes in the order of rarity. A set goes to a home for each shingle of its
    prefix, named by the least set that has it there; so sets of one family, which share many, meet once and not once a shingle.
    Sets that meet in several homes count in the least of these. Homes are compared in blocks of bounded size, by products of
    incidence matrices: a family of m sets costs m^2 comparisons, but nothing is shuffled or written for a pair unless ``emit`` does."""
    spark = df.sparkSession
    classes = shingle_classes(df, id_col, tokens, k)
    sets = classes.groupBy("digest").agg(F.min("id").alias("id"), F.first("s").alias("s")).where(F.size("s") > 0).select("id", "s")
    sets.write.parquet(path := scratch(spark, "shingle-sets"))  # read three times below
    sets = spark.read.parquet(path)
    sizes = sets.withColumn("n", F.size("s"))
    # shingles are shuffled once: counted where they meet, not counted apart and joined
    ranked = sizes.select("id", "n", F.explode("s").alias("x")).withColumn("df", F.count("*").over(Window.partitionBy("x"))).where("df > 1")
    ordered = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
    # shingles of one set alone come first in the order and match nothing: the prefix is what they leave of it
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int") + 1
    left = F.greatest(prefix - (F.col("n") - F.size("o")), F.lit(0))
    heads = ordered.select("id", F.explode(F.slice("o", F.lit(1), left)).alias("o")).select("id", F.col("o.x").alias("x"))
    heads.write.parquet(path := scratch(spark, "prefixes"))
    heads = spark.read.parquet(path)
    named = heads.groupBy("x").agg(F.min("id").alias("home"), F.count("*").alias("c")).where("c > 1").drop("c")
    homes = heads.join(named, "x").groupBy("id").agg(F.array_sort(F.collect_set("home")).alias("homes"))
    homes.write.parquet(path := scratch(spark, "homes"))
    homes = spark.read.parquet(path)
    blocks = homes.select(F.explode("homes").alias("home")).groupBy("home").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = sets.join(homes, "id").withColumn("label", F.lit(0) if label is None else label).withColumn("home", F.explode("homes")).join(blocks, "home")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("home", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "label", "s", "homes")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, chunk, home, lo, hi = table["id"].to_numpy(), table["own"].to_numpy(), table["home"][0].as_py(), table["lo"][0].as_py(), table["hi"][0].as_py()
        n = pc.list_value_length(table["s"]).to_numpy()
        wanted = np.triu(np.ones((len(ids), len(ids)), bool), 1)
        if lo != hi:
            wanted &= chunk[:, None] != chunk[None]
        both = _shared(table["s"])
        at, to = np.nonzero(wanted & (both > 0))
        j = both[at, to] / (n[at] + n[to] - both[at, to])
        near = j >= least
        at, to, j = at[near], to[near], j[near]
        if len(at):
            before = pc.list_value_length(table["homes"]).to_numpy()
            flat, of = table["homes"].combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(ids)), before)
            earlier = flat < home
            also = _incidence(flat[earlier], of[earlier], len(ids))
            first = np.ones(len(at), bool)
            for part in also:
                first &= ~((part @ part.T)[at, to] > 0)
            at, to, j = at[first], to[first], j[first]
        return emit(ids, table["label"].to_numpy(), at, to, j)

    return met.groupBy("home", "lo", "hi").applyInArrow(run, schema)


def _incidence(values: np.ndarray, of: np.ndarray, rows: int) -> list[np.ndarray]:
    """Which rows have which values, those of two rows or more; some columns at a time."""
    distinct, at, n = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    at, of, out = number[at[keep]], of[keep], []
    for a in range(0, int((n > 1).sum()), COLUMNS):
        own = (at >= a) & (at < a + COLUMNS)
        part = np.zeros((rows, COLUMNS), np.float32)
        part[of[own], at[own] - a] = 1
        out.append(part)
    return out


def _shared(sets: pa.ChunkedArray) -> np.ndarray:
    """How many elements each two rows of sets have in common."""
    n = pc.list_value_length(sets).to_numpy()
    out = np.zeros((len(n), len(n)), np.float32)  # whole numbers up to 2^24
    for part in _incidence(sets.combine_chunks().flatten().to_numpy(), np.repeat(np.arange(len(n)), n), len(n)):
        out += part @ part.T
    return out.astype(np.int64)


def similar_pairs(df: DataFrame, id_col: str, tokens: Column, k: int = 5, least: float = 0.6) -> DataFrame:
    """``(a, b, jaccard)`` of classes whose shingle sets have at least this similarity, a < b; a class is all texts of one
    set and named by its least id (``shingle_classes`` has the members)."""

    def emit(ids, _, at, to, j):  # noqa: ANN001, ANN202
        return pa.table({"a": ids[at], "b": ids[to], "jaccard": j.astype(float)})

    kind = T.StructField("a", df.schema[id_col].dataType)
    return _compared(df, id_col, tokens, k, least, None, emit, T.StructType([kind, T.StructField("b", kind.dataType), T.StructField("jaccard", T.DoubleType())]))


def similar_links(df: DataFrame, id_col: str, tokens: Column, k: int = 5, least: float = 0.8) -> DataFrame:
    """``(id, n_links, least_link)`` of each class that is similar to another: to how many, and to which first. A row a class, whatever
    the size of its family."""

    def emit(ids, _, at, to, j):  # noqa: ANN001, ANN202
        n = np.bincount(np.concatenate([at, to]), minlength=len(ids))
        first = np.full(len(ids), len(ids))
        np.minimum.at(first, np.concatenate([at, to]), np.concatenate([to, at]))  # rows stand in order of id
        own = np.flatnonzero(n)
        return pa.table({"id": ids[own], "n_links": n[own].astype(np.int64), "least_link": ids[first[own]]})

    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("n_links", T.LongType()), T.StructField("least_link", kind)])
    return _compared(df, id_col, tokens, k, least, None, emit, out).groupBy("id").agg(F.sum("n_links").alias("n_links"), F.min("least_link").alias("least_link"))


def similar_counts(df: DataFrame, id_col: str, tokens: Column, label: Callable[[Column], Column], levels: list[float], k: int = 5) -> DataFrame:
    """``(level, crosses, n)``: how many pairs of classes are similar to each level at least, of different labels and of one; the label
    (a number) is a function of the class's id. Blocks send counts, never pairs."""

    def emit(_, labels, at, to, j):  # noqa: ANN001, ANN202
        crosses = labels[at] != labels[to]
        rows = [(t, c, int(((j >= t) & (crosses == c)).sum())) for t in levels for c in (True, False)]
        return pa.table({"level": [r[0] for r in rows], "crosses": [r[1] for r in rows], "n": [r[2] for r in rows]})

    schema = T._parse_datatype_string("level double, crosses boolean, n long")
    return _compared(df, id_col, tokens, k, min(levels), label(F.col("id")).cast("int"), emit, schema).groupBy("level", "crosses").agg(F.sum("n").alias("n"))


def shingle_classes(df: DataFrame, id_col: str, tokens: Column, k: int = 5) -> DataFrame:
    """Each text's shingle set as sorted 64-bit hashes, with a digest that names its class."""
    hashes = X.bind(tokens, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])))
    rows = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(hashes)).alias("s"))
    return rows.withColumn("digest", F.concat_ws("-", F.xxhash64("s"), F.xxhash64(F.lit(1), "s"), F.size("s")))
