"""Files in and out, the review store, and streams."""

from __future__ import annotations

import datetime as dt
import io
import json
import os
import random
import subprocess
import sys
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.operators import datasets as DS
from quillstone.operators.review_store import ReviewStore
from quillstone.sources import files as S
from quillstone.sources.scratch import write_files
from quillstone.streaming import progress as PR


def test_jsonl_and_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": null}\n')
    df = S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string")
    assert df.count() == 2 and S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string", 1).count() == 1
    S.write_splits(df.withColumn("split", F.when(F.col("id") == 1, "a").otherwise("b")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).groupBy("split").count().count() == 2
    S.write_table(df, str(tmp_path / "table"))
    assert S.read_csv(spark, str(tmp_path / "table/csv"), "id int, t string").count() == 2
    assert "| 1 | x |" in S.markdown_table(df.orderBy("id"))
    with pytest.raises(ValueError):
        S.merge_chunks([df, df], 3)


def test_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.jsonl", '{"a": 1}\n\n{"a": 2}\n')
        z.writestr("readme", "no")
    got = S.read_zipped_jsonl(spark, str(tmp_path / "*.zip"), "a int")
    assert sorted(r.a for r in got.collect()) == [1, 2]


def test_cells_and_tasks(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"model": "a", "n": 1}\n{"model": "b", "n": 1}\n')
    with pytest.raises(ValueError):
        S.read_cells(spark, str(tmp_path / "*.jsonl"), "model string, n int", ["model"])
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1/test.tsv").write_text("index\ttext\tanswer\tdocument_name\n0\thello\tYes\td\n")
    tasks = spark.createDataFrame([("t1", "Q: {{text}}?")], "task string, instruction string")
    assert S.read_tasks(spark, str(tmp_path / "*/test.tsv"), tasks).first()["prompt"] == "Q: hello?"


def test_files(spark, tmp_path):
    data = io.BytesIO()
    ns = S.WORD_NS[1:-1]
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.txt").write_bytes("é\r\nx".encode())
    (tmp_path / "c.bin").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in S.extract_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("One\ttwo\nThree", None) and got["b.txt"] == ("é\nx", None) and got["c.bin"][0] is None


def test_nested(spark, tmp_path):
    text = "The parties agree. Second clause here."
    raw = {"documents": [{"id": "d", "file_name": "f", "text": text, "spans": [[0, 18], [18, 19], [19, 38]], "annotation_sets": [{"annotations": {"h1": {"choice": "Entailment", "spans": [0, 1, 9]}, "h2": {"choice": "NotMentioned", "spans": []}}}]}], "labels": {"h1": {"hypothesis": "H one"}}}
    (tmp_path / "n.json").write_text(json.dumps(raw, indent=1))
    rows = {r.hypothesis_id: r for r in DS.flatten_inference(S.read_nested(spark, str(tmp_path / "n.json"), S.INFERENCE_SCHEMA)).collect()}
    assert rows["h1"].evidence == ["The parties agree."] and rows["h1"].n_dropped == 2 and rows["h1"].hypothesis == "H one" and rows["h2"].evidence == []
    raw = {"version": "1", "data": [{"title": "c", "paragraphs": [{"context": text, "qas": [{"id": "c__Term", "answers": [{"text": "second  clause"}, {"text": "nope"}]}, {"id": "c__Law", "answers": [{"text": "nope"}]}, {"id": "c__Fee", "answers": []}]}]}]}
    (tmp_path / "q.json").write_text(json.dumps(raw))
    got = {r.category: (r.present, r.evidence) for r in DS.flatten_questions(S.read_nested(spark, str(tmp_path / "q.json"), S.QUESTION_SCHEMA)).collect()}
    assert got == {"Term": (True, ["second  clause"]), "Fee": (False, [])}


def test_store(spark, tmp_path):
    store = ReviewStore(spark, f"file://{tmp_path}/store")
    rows = lambda *x: spark.createDataFrame(list(x), "review_id string, status string, created double")
    assert store.read() is None and store.newest() is None
    store.seed(rows(("a", "queued", 1.0), ("b", "queued", 2.0)))
    store.upsert(rows(("a", "done", 1.0)))
    store.seed(rows(("a", "queued", 1.0), ("c", "queued", 3.0)))
    assert {r.review_id: r.status for r in store.read().collect()} == {"a": "done", "b": "queued", "c": "queued"}
    store.delete(rows(("b", "", 0.0)))
    assert [r.review_id for r in store.newest().collect()] == ["c", "a"] and store.get("a").count() == 1
    assert {r.status for r in PR.interrupted(store.read()).collect()} == {"done", "error"}


def test_queue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"review_id": "x", "created": 1.0}\n')
    store = ReviewStore(spark, f"file://{tmp_path}/store")
    (tmp_path / "in/2.json").write_text('{"review_id": "y", "created": 2.0}\n')
    (tmp_path / "in/3.json").write_text('{"review_id": "x", "created": 3.0}\n')
    for k in (1, 2, 3):
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + 10 * k,) * 2)  # the order they came in

    def review(df):
        if df.where("review_id = 'y'").count():
            raise RuntimeError("no text\nat all")
        return df.withColumn("found", F.lit(3))

    for _ in range(2):  # a restart finds nothing left to do
        PR.serve_queue(spark, str(tmp_path / "in"), "review_id string, created double", review, store, str(tmp_path / "ckpt"), str(tmp_path / "log")).awaitTermination(60)
    assert [(r.review_id, r.status, r.found, r.created) for r in store.read().collect()] == [("x", "done", 3, 3.0)]
    assert sorted((r.review_id, r.status, r.error) for r in PR.statuses(spark, str(tmp_path / "log")).collect()) == [("x", "done", None), ("y", "error", "no text")]
    log = spark.read.parquet(str(tmp_path / "log")).orderBy("batch", "step").collect()
    assert [r.status for r in log] == ["queued", "running", "done", "queued", "running", "error", "queued", "running", "done"]


def test_queue_keeps_no_texts(spark, tmp_path):
    """A batch's texts are read by its review alone: kept are ids and, for the check, what was found, which is found once."""
    rows = [(f"r{k}", "".join(random.Random(k).choices("abcdefgh ", k=50_000))) for k in range(40)]
    spark.createDataFrame(rows, "review_id string, text string").coalesce(1).write.json(str(tmp_path / "in"))
    store, held, seen = ReviewStore(spark, f"file://{tmp_path}/store"), [], str(tmp_path / "seen")
    size = lambda: sum(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo())
    before = size()

    def count(batches):
        for b in batches:
            with open(seen, "a") as out:
                out.writelines(f"{x}\n" for x in b["review_id"])
            yield b.assign(found=b["text"].str.len())[["review_id", "found"]]

    def review(df):
        held.append(size() - before)
        return df.mapInPandas(count, "review_id string, found long")

    def check(found):
        assert found.count() == 40 and found.where("found <> 50000").isEmpty()

    PR.serve_queue(spark, str(tmp_path / "in"), "review_id string, text string", review, store, str(tmp_path / "ckpt"), str(tmp_path / "log"), check).awaitTermination(90)
    assert {(r.status, r.found) for r in store.read().collect()} == {("done", 50_000)} and store.read().count() == 40
    assert held[0] < 100_000
    assert sorted(open(seen).read().split()) == sorted(r[0] for r in rows)
    assert size() <= before


def test_queue_stores_nothing_that_its_check_refuses(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"review_id": "x", "created": 0.0}\n{"review_id": "x", "created": 1.0}\n')
    store = ReviewStore(spark, f"file://{tmp_path}/store")

    def check(found):
        raise ValueError("no")

    PR.serve_queue(spark, str(tmp_path / "in"), "review_id string, created double", lambda df: df, store, str(tmp_path / "ckpt"), str(tmp_path / "log"), check).awaitTermination(60)
    assert store.read() is None
    log = spark.read.parquet(str(tmp_path / "log")).orderBy("batch", "step").collect()
    assert [(r.review_id, r.status, r.error) for r in log] == [("x", "queued", None), ("x", "running", None), ("x", "error", "no")]


@pytest.mark.parametrize("part_bytes", [200, 1 << 20])
def test_in_order(spark, part_bytes):
    rows = [(i * 7 % 101, "x" * i) for i in range(101)]
    out = PR.in_order(spark.createDataFrame(rows, "k long, t string").repartition(9), "k", lambda b: b.assign(n=b["t"].str.len())[["k", "n"]], "k long, n long", 3, part_bytes)
    assert sorted((r.place, r.k, r.n) for r in out.collect()) == [(i, k, len(t)) for i, (k, t) in enumerate(sorted(rows), 1)]
    empty = PR.in_order(spark.createDataFrame([], "k long, t string"), "k", lambda b: b[["k"]], "k long", 3)
    assert empty.count() == 0 and empty.columns == ["k", "place"]


def test_in_order_tasks_are_fewer_than_parts(spark, monkeypatch, tmp_path):
    """A task for each part would cost more than its work; the work still gets a part at a time."""
    tasks, bounded = [], PR.bounded
    monkeypatch.setattr(PR, "bounded", lambda df, limit: tasks.append(df.rdd.getNumPartitions()) or bounded(df, limit))
    rows = [(k, "x" * 100) for k in range(1000)]
    out = PR.in_order(spark.createDataFrame(rows, "k long, t string"), "k", lambda b: b.assign(n=len(b))[["k", "n"]], "k long, n long", 3, part_bytes=1000)
    got = sorted((r.place, r.k, r.n) for r in out.collect())
    assert [x[:2] for x in got] == [(i, i - 1) for i in range(1, 1001)] and max(x[2] for x in got) <= 11
    assert tasks == [3]


BOUNDED = """
import sys, time, os, glob
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1])
folder = sys.argv[2]
spark = SparkSession.builder.master("local-cluster[2,4,1024]").config("spark.executor.memory", "700m").config("spark.checkpoint.dir", f"file://{folder}/ckpt").config("spark.ui.enabled", "false").config("spark.executorEnv.PYTHONPATH", sys.argv[1]).getOrCreate()
from quillstone.streaming import progress as PR
df, profile = PR.bounded(spark.range(0, 24, 1, 24), 4)

def run(batches):
    for b in batches:
        began = time.time()
        time.sleep(0.4)
        open(f"{folder}/{int(b.id.iloc[0])}.run", "w").write(f"{began} {time.time()}")
        yield b

assert df.mapInPandas(run, "id long", profile=profile).count() == 24
times = [tuple(map(float, open(x).read().split())) for x in glob.glob(f"{folder}/*.run")]
print("TASKS", len(times), "MOST", max(sum(a <= t < b for a, b in times) for t, _ in times))
"""


def test_bounded_on_a_cluster(tmp_path):
    """Two executors of four cores: parts are as many as before, and at most four of them run at once."""
    (tmp_path / "run.py").write_text(BOUNDED)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, str(tmp_path / "run.py"), root, str(tmp_path)], capture_output=True, text=True, timeout=240, check=False)
    assert "TASKS 24 MOST" in out.stdout, out.stderr[-3000:]
    assert 2 <= int(out.stdout.split("MOST")[1]) <= 4


def store_rows(spark, *x):
    return spark.createDataFrame(list(x), "review_id string, status string, created double")


def held(store):
    return {r.review_id: r.status for r in store.read().collect()}


def test_store_point_update(spark, tmp_path):
    """One update writes files of one bucket, and a lookup reads those of one."""
    store = ReviewStore(spark, f"file://{tmp_path}/store", buckets=8)
    store.upsert(store_rows(spark, *[(f"r{i}", "queued", float(i)) for i in range(100)]))
    before = set(os.listdir(tmp_path / "store/data"))
    store.update("r7", lambda df: df.withColumn("status", F.lit("done")))
    (new,) = set(os.listdir(tmp_path / "store/data")) - before
    assert len([n for n in os.listdir(tmp_path / f"store/data/{new}") if n.startswith("store_bucket=")]) == 1
    assert store.get("r7").first().status == "done" and len({f.rpartition("/")[0].rpartition("=")[2] for f in store.get("r7").inputFiles()}) == 1
    store.compact()
    assert store.state()["updates"] == [] and held(store) == {f"r{i}": "done" if i == 7 else "queued" for i in range(100)}
    store.delete(store_rows(spark, ("r7", "", 0.0)))
    assert store.get("r7").count() == 0 and store.read().count() == 99


def test_store_checks_what_is_written(spark, tmp_path):
    store = ReviewStore(spark, f"file://{tmp_path}/store")
    for bad in ("a/b", None, ""):
        with pytest.raises(Exception, match="not a review id"):
            store.upsert(store_rows(spark, (bad, "queued", 1.0)))
    decided = lambda d: spark.createDataFrame([("a", d)], "review_id string, decision string")
    with pytest.raises(Exception, match="not a decision: maybe"):
        store.upsert(decided("maybe"))
    assert store.read() is None  # nothing was published
    store.upsert(decided("flag"))
    store.upsert(decided(None))
    assert [r.decision for r in store.read().collect()] == [None]


def test_store_two_writers(spark, tmp_path):
    """Writers publish one after another; none waits for one that died half way."""
    folder = f"file://{tmp_path}/store"
    dead = ReviewStore(spark, folder)
    dead._written(dead._checked(store_rows(spark, ("ghost", "queued", 0.0))), 16)  # killed before it published
    os.makedirs(tmp_path / "store/log")
    (tmp_path / "store/log/.draft-dead").write_text("{")

    def work(name):
        store = ReviewStore(spark, folder, compact_after=3)
        for i in range(4):
            store.upsert(store_rows(spark, (f"{name}{i}", "queued", float(i)), ("both", name, 0.0)))
        store.seed(store_rows(spark, ("seeded", name, 0.0)))
        store.update("both", lambda df: df.withColumn("created", F.col("created") + 1))

    threads = [threading.Thread(target=work, args=(name,)) for name in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join(200)
    store = ReviewStore(spark, folder)
    got = held(store)
    assert set(got) == {*(f"{n}{i}" for n in "ab" for i in range(4)), "both", "seeded"} and got["both"] in "ab"
    assert store.sweep(older_s=3600) == 0 and store.sweep(older_s=-1) > 0
    assert held(store) == got and ReviewStore(spark, folder).get("both").count() == 1
    assert not os.path.exists(tmp_path / "store/log/.draft-dead")


def test_store_loses_no_change(spark, tmp_path):
    """A change that was read before another writer published is made again on what that one wrote."""
    store = ReviewStore(spark, f"file://{tmp_path}/store")
    store.upsert(store_rows(spark, ("a", "queued", 1.0)))
    seen = []

    def change(df):
        seen.append(df.first().created)
        if len(seen) == 1:
            ReviewStore(spark, f"file://{tmp_path}/store").upsert(store_rows(spark, ("a", "running", 10.0)))
        return df.withColumn("created", F.col("created") + 1)

    store.update("a", change)
    assert seen == [1.0, 10.0] and [(r.status, r.created) for r in store.read().collect()] == [("running", 11.0)]


def test_progress_stream(spark, tmp_path):
    schema = "review_id long, stage string, done double, at timestamp"
    t = dt.datetime(2024, 1, 1)
    folder = str(tmp_path / "events")
    late = dt.timedelta(seconds=8)
    steps = [[(1, "a", 0.1, t), (2, "a", 0.2, t)], [(1, "b", 0.5, t + dt.timedelta(seconds=5)), (1, "old", 0.0, t - dt.timedelta(seconds=5))], [(2, "done", 1.0, t + dt.timedelta(seconds=9))], [(2, "running", 0.9, t + late)], [(2, "done", 1.0, t + dt.timedelta(seconds=9)), (3, "a", 0.0, t)]]
    steps += [[(9, "a", 0.0, t + dt.timedelta(hours=hours))] for hours in (1, 2, 3)]  # the watermark passes all that was before
    seen = []
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = PR.progress_stream(spark.readStream.schema(schema).parquet(folder))
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append({r.review_id: r.stage for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination(90)
    last = {}
    for s in seen:
        last.update(s)
    assert last == {1: "b", 2: "done", 3: "a", 9: "a"}
    assert sum(2 in s for s in seen) == 2  # what comes late after the end, or again, is silent


def test_live(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "a", t), (1, "b", t + dt.timedelta(seconds=5)), (2, "done", t), (3, "a", t - dt.timedelta(hours=1))], "review_id long, stage string, at timestamp")
    assert [(r.review_id, r.stage) for r in PR.live(rows, now="timestamp'2024-01-01 00:01:00'").collect()] == [(1, "b")]


def test_files_in_folders(spark, tmp_path):
    """Files are found in folders, hidden ones left out, and read by as many tasks as there are cores for, not by one for some files."""
    names = [f"{k % 7}/f {k}%.txt" for k in range(300)]
    assert write_files(spark.createDataFrame([(n, n.encode()) for n in names], "name string, content binary"), f"file://{tmp_path}/x") == 300
    (tmp_path / "x" / "3" / "_half.txt").write_text("no")
    found = S.extract_files(spark, f"file://{tmp_path}/x")
    assert sorted(r.text for r in found.collect()) == sorted(names) and not found.where("error IS NOT NULL").count()
    assert found.rdd.getNumPartitions() == S.DEALS * spark.sparkContext.defaultParallelism
    assert S.extract_files(spark, f"{tmp_path}/x/[12]").count() == len([n for n in names if n[0] in "12"])


@pytest.mark.parametrize("name", ["question_scan", "inference_scan"])
def test_nested_files_are_written_by_spark(spark, name, monkeypatch):
    """Files of some megabytes go through no Python worker, which would hold a batch of them."""
    from quillstone import plans
    from quillstone.plans import source_queries

    monkeypatch.setattr(source_queries, "write_files", None)
    rows = plans.load()[0][name](spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and all(f.endswith(".txt") for f in rows.inputFiles())
