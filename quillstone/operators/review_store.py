"""The store of reviews: a log of numbered versions over files in buckets of the review's id.

An update writes its rows, as files of the buckets that they fall in, and then publishes the next version: a small file that names all
files that count. Publishing is one step that fails where the number is taken; the writer then reads what was published and
tries the number after. So there is no lock to leave behind: what a dead writer wrote without publishing counts for nobody and is
swept away later. Readers see one version, whole. Buckets with many updates are written anew by ``compact``.
"""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterable
from urllib.parse import urlparse
from urllib.request import url2pathname

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reviews import valid_decision, valid_id

BUCKET, GONE = "store_bucket", "store_deleted"
#: Versions of the log that stay when older ones are swept.
KEPT_VERSIONS = 10


class ReviewStore:
    """Rows by ``review_id``, one each. An upsert replaces whole rows; of several rows of one id in one upsert one stays. Ids and, where there
    is a column ``decision``, decisions are checked as they are written."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, compact_after: int = 12):
        self.spark, self.folder, self.buckets, self.compact_after = spark, folder.rstrip("/"), buckets, compact_after
        jvm = spark._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self.fs = self.path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ the log

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """Names in a folder with the time each was changed, in seconds."""
        if not self.fs.exists(self.path(folder)):
            return []
        return [(s.getPath().getName(), s.getModificationTime() // 1000) for s in self.fs.listStatus(self.path(folder))]

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in self._names("log") if n.removesuffix(".json").isdigit())

    def state(self) -> dict:
        """The last version: which folder a bucket's rows lie in, and which updates came after, in order."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "buckets": self.buckets, "base": {}, "updates": []}
        stream = self.fs.open(self.path(f"log/{versions[-1]:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, state: dict) -> bool:
        """One step that either makes this the version of its number or finds the number taken."""
        final, draft = self.path(f"log/{state['version']:012d}.json"), self.path(f"log/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # a local rename would replace; a second link can't
                local = lambda p: url2pathname(urlparse(p.toUri().getPath()).path)
                os.link(local(draft), local(final))
                return True
            options = self.spark._jvm.org.apache.hadoop.fs.Options
            none = self.spark._sc._gateway.new_array(getattr(options, "Rename"), 1)
            none[0] = getattr(options, "Rename").NONE
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
            context.rename(draft, final, none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.fs.delete(draft, False)

    def _commit(self, change: Callable[[dict], dict]) -> int:
        """Publishes what ``change`` makes of the last version; where another writer was faster, of that one's."""
        while True:
            state = self.state()
            new = change(state)
            if self._publish(new | {"version": state["version"] + 1}):
                return state["version"] + 1

    # ------------------------------------------------------------ rows

    def bucket(self, review_id: str, state: dict) -> int:
        return zlib.crc32(review_id.encode()) % state["buckets"]

    def _written(self, rows: DataFrame, buckets: int) -> tuple[str, list[int]]:
        """Writes rows as files of their buckets; the folder and which buckets it has."""
        folder = uuid.uuid4().hex
        dealt = rows.withColumn(BUCKET, F.crc32(F.col("review_id").cast("binary")) % buckets)
        dealt.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{folder}")
        return folder, sorted(int(n.partition("=")[2]) for n, _ in self._names(f"data/{folder}") if n.startswith(f"{BUCKET}="))

    def _files(self, parts: Iterable[tuple[str, int]]) -> DataFrame | None:
        paths = [f"{self.folder}/data/{folder}/{BUCKET}={b}" for folder, b in parts]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def _rows(self, state: dict, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """Rows as of a version: those of each bucket that no update has, and the last of those that some have. Updates are small beside
        what they update, whose rows are not shuffled where their ids can be broadcast."""
        some = set(range(state["buckets"]) if buckets is None else buckets)
        base = self._files((folder, int(b)) for b, folder in state["base"].items() if int(b) in some)
        updates = [(u, b) for u in state["updates"] for b in u["buckets"] if b in some]
        changed = self._files((u["folder"], b) for u, b in updates)
        if changed is None:
            return base
        order = F.create_map(*[F.lit(x) for u in {u["folder"]: u for u, _ in updates}.values() for x in (u["folder"], u["version"])])
        names = changed.columns
        row = F.struct(*names)
        version = order[F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1)]
        last = changed.select(*names, version.alias("__version")).groupBy("review_id").agg(F.max_by(row, F.struct("__version", F.xxhash64(F.to_json(row)))).alias("x")).select("x.*")
        live = last.where(~F.col(GONE)).drop(GONE)
        return live if base is None else base.join(last.select("review_id"), "review_id", "left_anti").unionByName(live, allowMissingColumns=True)

    def read(self) -> DataFrame | None:
        return self._rows(self.state())

    def get(self, review_id: str) -> DataFrame | None:
        """One review, from the files of its bucket."""
        state = self.state()
        rows = self._rows(state, [self.bucket(review_id, state)])
        return None if rows is None else rows.where(F.col("review_id") == review_id)

    # ------------------------------------------------------------ updates

    def _added(self, state: dict, written: tuple[str, list[int]]) -> dict:
        folder, buckets = written
        return state | {"updates": [*state["updates"], {"version": state["version"] + 1, "folder": folder, "buckets": buckets}]}

    def _checked(self, rows: DataFrame) -> DataFrame:
        bad = lambda what, c: F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
        rows = rows.withColumn("review_id", F.when(valid_id(F.col("review_id")), F.col("review_id")).otherwise(bad("review id", "review_id")))
        if "decision" in rows.columns:
            rows = rows.withColumn("decision", F.when(valid_decision(F.col("decision")), F.col("decision")).otherwise(bad("decision", "decision")))
        return rows.withColumn(GONE, F.lit(False))

    def _tidied(self) -> None:
        updates = [b for u in self.state()["updates"] for b in u["buckets"]]
        if updates and max(map(updates.count, set(updates))) > self.compact_after:
            self.compact()

    def upsert(self, rows: DataFrame) -> None:
        written = self._written(self._checked(rows), self.state()["buckets"])
        self._commit(lambda state: self._added(state, written))
        self._tidied()

    def delete(self, ids: DataFrame) -> None:
        written = self._written(ids.select("review_id").distinct().withColumn(GONE, F.lit(True)), self.state()["buckets"])
        self._commit(lambda state: self._added(state, written))
        self._tidied()

    def seed(self, rows: DataFrame) -> None:
        """Adds the rows whose id isn't there yet, as of the version that it follows."""

        def change(state: dict) -> dict:
            old = self._rows(state)
            new = self._checked(rows if old is None else rows.join(old.select("review_id"), "review_id", "left_anti"))
            return self._added(state, self._written(new, state["buckets"]))

        self._commit(change)
        self._tidied()

    def update(self, review_id: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """Reads one review and writes what ``change`` makes of it: one bucket is read and written. Where another writer published meanwhile
        it is read again, so that no change is lost."""

        def step(state: dict) -> dict:
            rows = self._rows(state, [self.bucket(review_id, state)])
            if rows is None:
                raise KeyError(review_id)
            return self._added(state, self._written(self._checked(change(rows.where(F.col("review_id") == review_id))), state["buckets"]))

        self._commit(step)
        self._tidied()

    # ------------------------------------------------------------ housekeeping

    def compact(self) -> None:
        """Writes buckets that have updates anew. Updates published meanwhile stay after them; a bucket that another compaction took
        meanwhile keeps what that one wrote."""
        seen = self.state()
        busy = sorted({b for u in seen["updates"] for b in u["buckets"]})
        if not busy:
            return
        folder, full = self._written(self._rows(seen, busy), seen["buckets"])

        def change(state: dict) -> dict:
            done = {b for b in busy if state["base"].get(str(b)) == seen["base"].get(str(b))}
            base = {b: f for b, f in state["base"].items() if int(b) not in done} | {str(b): folder for b in full if b in done}
            left = [u | {"buckets": [b for b in u["buckets"] if b not in done or u["version"] > seen["version"]]} for u in state["updates"]]
            return state | {"base": base, "updates": [u for u in left if u["buckets"]]}

        self._commit(change)

    def sweep(self, older_s: float = 86_400) -> int:
        """Deletes folders that no version of the last few names and that are older than any read or unpublished write takes; how many."""
        versions = self._versions()
        keep: set[str] = set()
        for v in versions[-KEPT_VERSIONS:]:
            stream = self.fs.open(self.path(f"log/{v:012d}.json"))
            state = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            stream.close()
            keep |= {*state["base"].values(), *(u["folder"] for u in state["updates"])}
        old = [(f"data/{n}", at) for n, at in self._names("data") if n not in keep] + [(f"log/{n}", at) for n, at in self._names("log") if n.startswith(".draft") or int(n.removesuffix(".json")) < (versions or [0])[-KEPT_VERSIONS:][0]]
        gone = [name for name, at in old if time.time() - at > older_s]
        for name in gone:
            self.fs.delete(self.path(name), True)
        return len(gone)

    def newest(self) -> DataFrame | None:
        df = self.read()
        return None if df is None else df.orderBy(F.desc("created"), "review_id")
