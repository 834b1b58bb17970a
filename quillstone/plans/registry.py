"""The registered queries: name, plan and, where SQL can express it, the same relation as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under ``name``."""

    def register(plan: Plan) -> Plan:
        assert name not in QUERIES, name
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What Parquet writers usually make a row group of, the least that a task can read.
ROW_GROUP_BYTES = 128 << 20


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for work that is heavy for its bytes. A table of fewer row groups than cores would keep most of these idle, so its
    rows are dealt out first; a larger one is read as it is, without a shuffle."""
    df, path = table(spark, sf_dir, "documents"), spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * ROW_GROUP_BYTES else df
