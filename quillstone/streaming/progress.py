"""Reviews as they run: a queue of requests, and the latest progress of each, kept apart from the record."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import scratch

PROGRESS = "review_id long, stage string, done double, at timestamp"


def latest(events: DataFrame, key: str = "review_id", at: str = "at", order: str | None = None) -> DataFrame:
    """The last event of each key; ``order`` breaks ties in time. For batches and, in update mode, streams."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max(F.struct(at, *([order] if order else []), *[c for c in rest if c not in (at, order)])).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def live(events: DataFrame, finished: str = "stage = 'done'", ttl_s: int = 600, now: str | None = None, order: str | None = None) -> DataFrame:
    """Latest progress of reviews that aren't finished and were heard of within ``ttl_s`` (now: an SQL expression)."""
    moment = F.expr(now) if now else F.current_timestamp()
    return latest(events, order=order).where(~F.expr(finished)).where(moment.cast("double") - F.col("at").cast("timestamp").cast("double") <= ttl_s)


class Progress(StatefulProcessor):
    """State of one review: its last event, which stays as a tombstone once the review is finished. Only a later event changes it, so
    an older one that comes late is silent even then. A timer of event time drops it ``ttl_s`` after its last event; events older
    than that are beyond the watermark by then."""

    def __init__(self, ttl_s: int):
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, stage string, done double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803, ANN201
        before = self.last.get()[0] if self.last.exists() else None
        last = None
        for b in rows:
            b = b[b["at"] > before] if before is not None else b
            if len(b):
                x = b.sort_values(["at", "stage", "done"]).iloc[-1]
                if last is None or x["at"] > last["at"]:
                    last = x
        if last is None:
            return
        at = last["at"].to_pydatetime()
        self.last.update((at, last["stage"], float(last["done"])))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(max(int(pd.Timestamp(at, tz="UTC").timestamp() * 1000) + self.ttl_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"review_id": [key[0]], "stage": [last["stage"]], "done": [float(last["done"])], "at": [at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803, ANN201
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, ttl_s: int = 600) -> DataFrame:
    """A stream of each review's latest progress, as it changes: state is one row a review, kept ``ttl_s`` of event time after its last
    event. Events no later than the last one, of a finished review too, change nothing. State of this kind needs the RocksDB store,
    which is set for queries started after this call."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    grouped = events.select("review_id", "stage", "done", "at").withWatermark("at", f"{ttl_s} seconds").groupBy("review_id")
    return grouped.transformWithStateInPandas(Progress(ttl_s), PROGRESS, "Update", "EventTime")


STATUS = "review_id string, status string, error string, batch long, step int"


def serve_queue(spark: SparkSession, incoming: str, schema: str, review: Callable[[DataFrame], DataFrame], store, checkpoint: str, log: str, check: Callable[[DataFrame], None] | None = None):
    """One consumer of files of requests, in the order they came. Each request's status is appended to ``log`` as it changes: queued,
    running, then done or, where its batch's review failed, error with the reason; the store gets what was done. A failed batch doesn't
    hold up those behind it. Restarts go on after the last whole batch. Returns the query.

    Of a batch its ids are kept, not its texts. What ``review`` returns is kept too where there is a ``check``, which raises if the batch
    must not be stored: it looks at what was found without finding it again."""

    def handle(batch: DataFrame, number: int) -> None:
        ids = batch.select("review_id").distinct().coalesce(spark.sparkContext.defaultParallelism).persist()

        def say(first: int, *changes: str, error: str | None = None) -> None:
            steps = F.array(*[F.struct(F.lit(status).alias("status"), F.lit(first + k).alias("step")) for k, status in enumerate(changes)])
            rows = ids.select("review_id", F.explode(steps).alias("x")).select("review_id", "x.status", F.lit(error).cast("string").alias("error"), F.lit(number).cast("long").alias("batch"), "x.step")
            rows.write.mode("append").parquet(log)

        try:
            if not ids.count():
                return
            say(0, "queued", "running")  # a batch is taken up when its turn comes, and run at once
            found = None
            try:
                found = review(batch)
                if check:
                    check(found.persist())
                store.upsert(found.withColumn("status", F.lit("done")))
            except Exception as e:  # whatever a review raises is its requests' status
                say(2, "error", error=str(e).splitlines()[0][:500] if str(e) else type(e).__name__)
            else:
                say(2, "done")
            finally:
                if check and found is not None:
                    found.unpersist()
        finally:
            ids.unpersist()

    requests = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(incoming)
    return requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(spark: SparkSession, log: str) -> DataFrame:
    """``(review_id, status, error)``: the last status of each request."""
    rows = spark.read.schema(STATUS).parquet(log)
    return rows.groupBy("review_id").agg(F.max(F.struct("batch", "step", "status", "error")).alias("x")).select("review_id", "x.status", "x.error")


def bounded(df: DataFrame, limit: int) -> tuple[DataFrame, ResourceProfile | None]:
    """``df`` and a resource profile under which at most ``limit`` of its tasks run at once: tasks that ask for so many cores that no more
    fit. Where one task an executor is more than that already, or all runs in one process, parts are walked through by ``limit`` tasks
    instead."""
    context = df.sparkSession.sparkContext
    cores, executor = context.defaultParallelism, int(context.getConf().get("spark.executor.cores", "0"))
    if context.master.startswith("local-cluster["):
        cores, executor = (int(x) for x in context.master[len("local-cluster[") :].split(",")[:2])
        cores *= executor
    executors = -(-cores // executor) if executor else 0
    if context.master == "local" or context.master.startswith("local[") or not 0 < executors <= limit:
        return df.coalesce(limit), None
    each = min(executor, limit // executors)  # tasks an executor runs: executor // cpus
    return df, ResourceProfileBuilder().require(TaskResourceRequests().cpus(executor // each if executor % each == 0 else executor // each + 1)).build


#: Bytes of a task of ordered work: parts are far smaller, and a task of its own for each costs more than its work.
TASK_BYTES = 8 << 20


def in_order(df: DataFrame, order: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, limit: int, part_bytes: int = 32 << 20, place: str = "place") -> DataFrame:
    """``work`` over all rows with at most ``limit`` parts in flight, and ``place``, each result's number from 1 in the order of ``order``, a
    column that ``work`` keeps in its rows' order. Parts are ranges of the order of about ``part_bytes``; a task walks through those of
    ``TASK_BYTES``, so tasks are as many as the table needs, and losing an executor costs those that it had in hand. Results are
    written once, then numbered by the tasks before."""
    spark = df.sparkSession
    size = lambda f: F.octet_length(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8)
    size = functools.reduce(lambda a, b: a + b, [F.coalesce(size(f), F.lit(0)) for f in df.schema.fields])
    total = df.agg(F.sum(size)).first()[0] or 0
    parts = df.repartitionByRange(max(limit, -(-int(total) // max(part_bytes, TASK_BYTES))), order)
    parts = parts.sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()).withColumn("__bytes", size.cast("long"))
    parts, profile = bounded(parts, limit)
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches):
        part, at = None, 0
        for b in batches:
            for (p, _), rows in b.groupby(["__part", b["__bytes"].cumsum() // part_bytes], sort=False):  # a task may walk through several
                part, at = p, at if p == part else 0
                out = work(rows.drop(columns=["__part", "__bytes"]))[names]
                yield out.assign(__part=p, __at=range(at + 1, at + len(out) + 1))
                at += len(out)

    done = parts.mapInPandas(run, f"{schema}, __part int, __at long", profile=profile)
    done.write.parquet(path := scratch(spark, "in-order"))
    done = spark.read.parquet(path)
    sizes = done.groupBy("__part").agg(F.count("*").alias("n"))  # a row a part
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return done.join(F.broadcast(before) if sizes.limit(100_001).count() <= 100_000 else before, "__part").select(*names, (F.col("__before") + F.col("__at")).alias(place))


def interrupted(reviews: DataFrame) -> DataFrame:
    """At a restart: what was queued or running can't be any more."""
    return reviews.withColumn("status", F.when(F.col("status").isin("queued", "running"), "error").otherwise(F.col("status")))
