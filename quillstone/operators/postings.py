"""A postings index: for each term and corpus, blocks of chunks that hold the term, written once and asked often.

A corpus is all chunks of one key. Chunks of neighbouring numbers make a block, the same blocks for every term, and a row of the index
is what one block has of one term: chunks, counts and lengths, and, apart from these, what bounds any score in the block - the
largest count and the least length. Files lie in buckets by a hash of the term, each sorted by term.

A search reads the bounds of its terms first: buckets that hold none of them are left out by their folders, other terms by the
files' statistics. The k most promising blocks of a query are scored, the k-th best score found is its threshold, and of the other
blocks only those whose bound reaches it are read. No block left out can hold one of the k best, so results are those of scoring
all chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import scratch

#: Words for one bucket; tasks that write one bucket, so that a frequent term's blocks are dealt out.
BUCKET_WORDS, WRITERS = 8 << 20, 8
#: Terms up to which files' statistics are asked for each of them. What lies beyond a bound by rounding.
FEW_TERMS, SLACK = 1_000, 1e-9
#: Corpora beyond which a search first cuts out the postings of its words.
MANY_CORPORA = 1_000


def counted_terms(words: Column) -> Column:
    """Distinct words with their counts, as (t, tf): neighbours in sorted order, so that a long chunk costs no square."""
    begins = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i - 1) != F.get(w, i)))
    each = lambda w, b: F.transform(b, lambda i, k: F.struct(F.get(w, i).alias("t"), (F.coalesce(F.get(b, k + 1), F.size(w)) - i).alias("tf")))
    some = X.bind(F.array_sort(words), lambda w: X.bind(begins(w), lambda b: each(w, b)))
    return F.when(F.size(words) > 0, some).otherwise(F.array().cast("array<struct<t:string,tf:int>>"))


def top(df: DataFrame, by: list[str], order: list, k: int, spread: str) -> DataFrame:
    """The first k rows of each group; of a large group each of 64 parts is cut to k first."""
    first = Window.partitionBy(*by, F.pmod(F.xxhash64(spread), F.lit(64))).orderBy(*order)
    cut = df.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= k)
    return cut.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= k)


class PostingsIndex:
    """``folder`` holds ``postings`` (bucket, term, key, block, n, max_tf, min_len, chunks, tfs, lens), ``corpora`` (key, n, total) and
    ``about`` (buckets, span)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        about = spark.read.parquet(f"{self.folder}/about").first()
        self.buckets, self.span = about["buckets"], about["span"]
        self.corpora = spark.read.parquet(f"{self.folder}/corpora")
        self.key = [c for c in self.corpora.columns if c not in ("n", "total")]

    @classmethod
    def build(cls, chunks: DataFrame, folder: str, key: list[str], chunk: str = "chunk", text: str = "text", span: int = 128, buckets: int | None = None) -> PostingsIndex:
        """Writes the index of ``chunks``, numbered within their key; ``span`` neighbouring numbers make a block. Words are shuffled once,
        as (term, chunk, count)."""
        spark, folder = chunks.sparkSession, folder.rstrip("/")
        rows = chunks.select(*key, F.col(chunk).cast("long").alias("chunk"), X.words(text).alias("w"))
        rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.size("w")).alias("total")).write.parquet(f"{folder}/corpora")
        if buckets is None:
            size = spark.read.parquet(f"{folder}/corpora").agg(F.sum("total")).first()[0] or 0
            buckets = max(4, -(-int(size) // BUCKET_WORDS))
        of = F.floor(F.col("chunk") / F.lit(span)).cast("long")
        terms = rows.select(*key, "chunk", of.alias("block"), F.size("w").alias("len"), F.explode(counted_terms(F.col("w"))).alias("x"))
        terms = terms.select(*key, "chunk", "block", "len", F.col("x.t").alias("term"), F.col("x.tf").alias("tf"))
        terms = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).withColumn("writer", F.pmod(F.xxhash64(*key, "block"), F.lit(WRITERS)).cast("int"))
        held = F.sort_array(F.collect_list(F.struct("chunk", "tf", "len")))
        blocks = terms.repartition("bucket", "writer").groupBy("bucket", "writer", "term", *key, "block").agg(F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), held.alias("x"))
        blocks = blocks.select("bucket", "term", *key, "block", F.size("x").alias("n"), "max_tf", "min_len", F.col("x.chunk").alias("chunks"), F.col("x.tf").alias("tfs"), F.col("x.len").alias("lens"))
        blocks.sortWithinPartitions("bucket", "term", *key, "block").write.partitionBy("bucket").parquet(f"{folder}/postings")
        spark.createDataFrame([(buckets, span)], "buckets int, span long").coalesce(1).write.parquet(f"{folder}/about")
        return cls(spark, folder)

    def postings(self, terms: DataFrame) -> DataFrame:
        """The part of the index that can hold these terms (column ``term``); folders of other buckets aren't listed in the plan."""
        out = self.spark.read.parquet(f"{self.folder}/postings")
        some = terms.select("term").distinct().limit(FEW_TERMS + 1).collect()
        if len(some) <= FEW_TERMS:
            out = out.where(F.col("term").isin([r["term"] for r in some]))
        asked = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # as many as the index has buckets, at most
        return out if len(asked) == self.buckets else out.where(F.col("bucket").isin(asked))

    def _cut_out(self, index: DataFrame, asked: DataFrame) -> DataFrame:
        """The postings of what is asked for. A row is shuffled as its names and one array of whole numbers."""
        offsets = F.transform("chunks", lambda c: (c - F.col("block") * F.lit(self.span)).cast("int"))
        rows = index.select("term", *self.key, "block", F.concat(offsets, "tfs", "lens").alias("x"))
        rows = rows.join(asked.select("term", *self.key).distinct(), ["term", *self.key], "left_semi").withColumn("n", (F.size("x") / 3).cast("int"))
        part = lambda k: F.slice("x", F.col("n") * k + 1, F.col("n"))
        rows = rows.select("term", *self.key, "block", "n", F.transform(part(0), lambda c: c + F.col("block") * F.lit(self.span)).alias("chunks"), part(1).alias("tfs"), part(2).alias("lens"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        return rows.select(bucket.alias("bucket"), "term", *self.key, "block", "n", F.array_max("tfs").alias("max_tf"), F.array_min("lens").alias("min_len"), "chunks", "tfs", "lens")

    def _kept(self, df: DataFrame) -> DataFrame:
        """What several steps read, from a table in the shared folder."""
        df.write.parquet(path := scratch(self.spark, "postings-search"))
        return self.spark.read.parquet(path)

    def search(self, queries: DataFrame, k: int, query: str = "query", query_text: str = "query_text", k1: float = 1.5, b: float = 0.75, digits: int = 9) -> DataFrame:
        """``(key, query, chunk, score, rank)``: of each query its k best chunks among those of its key that share a word with it, ranks
        from 0; BM25, rounded to so many digits, ties to the first chunk. A word that a query repeats counts as often."""
        scores = self.scored(queries, k, query, query_text, k1, b)[0].withColumn("score", F.round("score", digits))
        order = [F.desc("score"), F.col("chunk")]
        return top(scores, [*self.key, query], order, k, "chunk").select(*self.key, query, "chunk", "score", (F.col("__rn") - 1).alias("rank"))

    def scored(self, queries: DataFrame, k: int, query: str, query_text: str, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
        """Exact scores of all chunks of the blocks that were read; and the blocks, with their bounds and whether they were read."""
        by, block = [*self.key, query], [*self.key, query, "block"]
        asked = queries.select(*by, F.explode(X.words(query_text)).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("qf"))
        asked = self._kept(asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")))
        index = self.postings(asked)
        if self.corpora.limit(MANY_CORPORA + 1).count() > MANY_CORPORA:
            # of many corpora few words each are asked for: what they have of these is cut out in one pass, and all below reads that
            index = self._kept(self._cut_out(index, asked))
        bounds = index.select("bucket", "term", *self.key, "block", "n", "max_tf", "min_len").join(asked, ["bucket", "term", *self.key])
        df = bounds.groupBy(*by, "term").agg(F.sum("n").alias("df"))
        size = self.corpora.select(*self.key, F.col("n").alias("of"), (F.col("total") / F.col("n")).alias("avg"))
        idf = F.ln(1 + (F.col("of") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        worth = df.join(size, self.key).select(*by, "term", idf.alias("idf"), "avg")
        part = lambda tf, length: F.col("qf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avg")))
        bounds = self._kept(bounds.join(worth, [*by, "term"]))  # small beside the index: a row for each term and block asked
        blocks = bounds.groupBy(*block).agg(F.sum(part(F.col("max_tf"), F.col("min_len"))).alias("bound"))
        # k rows a query; kept, since bounds are sums in no fixed order: evaluated anew, blocks of equal bounds could change places
        first = self._kept(top(blocks, by, [F.desc("bound"), F.col("block")], k, "block").select(*block))

        def scores(of: DataFrame) -> DataFrame:
            wanted = bounds.join(of, block).select("bucket", "term", *block, "qf", "idf", "avg")
            held = index.select("bucket", "term", *self.key, "block", F.arrays_zip("chunks", "tfs", "lens").alias("x")).join(wanted, ["bucket", "term", *self.key, "block"])
            each = held.select(*block, "qf", "idf", "avg", F.explode("x").alias("x"))
            return each.groupBy(*block, F.col("x.chunks").alias("chunk")).agg(F.sum(part(F.col("x.tfs"), F.col("x.lens"))).alias("score"))

        found = self._kept(scores(first))
        kth = top(found, by, [F.desc("score"), F.col("chunk")], k, "chunk").where(F.col("__rn") == k).select(*by, F.col("score").alias("kth"))
        more = blocks.join(first, block, "left_anti").join(kth, by, "left").where(F.col("kth").isNull() | (F.col("bound") * (1 + SLACK) + SLACK >= F.col("kth")))
        read = first.unionByName(more.select(*block)).withColumn("read", F.lit(True))
        return found.unionByName(scores(more.select(*block))), blocks.join(read, block, "left").withColumn("read", F.coalesce("read", F.lit(False)))
