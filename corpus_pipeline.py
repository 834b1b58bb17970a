"""A training corpus from ``documents``: toxic texts go, repeated lines go, one of each group of near duplicates stays, texts that
hold benchmark passages go, and the rest is packed into bins.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that the stage before it kept; all but the last return the
columns of ``documents``, with ``n_chars`` as the text is then.

Defined results: null and empty texts aren't toxic, hold one empty line, are linked with nothing, hold no passage and take one
place in a bin; rows of one id are scored, compared and searched each, and count as one document for line deduplication; rows of a
null id stay unless they are near duplicates; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.components import cut, delete, shared_folder
from quillstone.llm.decontaminate import find_leaks
from quillstone.llm.line_dedup import dedup_lines
from quillstone.llm.ngram_join import ngram_components
from quillstone.llm.packing import pack
from quillstone.llm.queries import toxicity_model
from quillstone.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model(spark, docs.select("doc_id", "text"), sf_dir)
    return score_toxicity(docs, model, threshold=0.3).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs, min_docs=2, min_chars=10)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word n-grams, similarity 0.8 or more; of each group the row of least id stays, of equal ids the first."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        docs = _numbered(docs)
    else:
        docs = docs.withColumn("row", F.col("doc_id"))
    found = ngram_components(docs.select(F.col("row").alias("doc_id"), "text"), size=5, percent=80)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("row"))
    return docs.join(gone.hint("merge"), "row", "left_anti").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, another number for each row: the id in its first row, numbers beyond all ids in others."""
    docs = cut(docs.withColumn("at", F.monotonically_increasing_id()))
    first = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("at").alias("at"), F.lit(True).alias("is_first"))
    most = F.lit(max(docs.agg(F.max("doc_id")).first()[0] or 0, 0))
    return docs.join(first, ["doc_id", "at"], "left").withColumn("row", F.when(F.col("is_first"), F.col("doc_id")).otherwise(most + 1 + F.col("at"))).drop("at", "is_first")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, benchmark, percent=10).where(F.size("leaks") == 0).select(*COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, capacity=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack_bins),
]

#: No SQL: the classifier, the edit distances and the packing are beyond it. ``tests/llm/test_pipeline.py`` has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again; what the next has read is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
