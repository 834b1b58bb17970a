"""Connected components of a graph given as pairs, and the shared folder that lineage is cut in."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one if all run on this
    machine (tests), which goes with the program; on a cluster that is an error."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: driver and executors need a folder that all of them see")
        own = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    """A folder that is not needed any more, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """The same rows from a table written at a ``new_path``; a column ``kind`` parts its files, so that readers of one kind read no other."""
    (df.write.partitionBy("kind") if "kind" in df.columns else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of the pairs ``(hi, lo)``, hi > lo; component: the least node reachable.

    Each round points every node at its least neighbour and hands its other neighbours on to that one, until every
    node has one smaller neighbour; then the pointers of this forest are doubled until they reach the roots. Nodes are
    grouped by the larger end, which has few partners; joins are on plain tables, which adaptive execution can split.
    """
    edges = cut(edges.select("hi", "lo").distinct())
    while True:
        least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        least = cut(least)
        if not least.where("n > 1").limit(1).count():
            break
        more = edges.join(least.where("n > 1"), "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(least.select("hi", F.col("m").alias("lo")).unionByName(more).distinct())
    forest = least.select(F.col("hi").alias("node"), F.col("m").alias("component"))
    while True:
        up = forest.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = cut(forest.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved")))
        forest = jumped.select("node", "component")
        if not jumped.where("moved").limit(1).count():
            break
    roots = forest.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return forest.unionByName(roots)
