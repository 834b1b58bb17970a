"""Round trips: the tables written in each format that datasets come in, and read again."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import datasets as DS
from ..operators.review_store import ReviewStore
from ..sources import files as S
from ..sources.scratch import scratch, write_files, write_named_texts
from .base import draw, s_draw, s_norm
from .registry import query, table, texts
from .text_queries import S_SPLIT, split_of

_DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@query("jsonl_scan", "SELECT doc_id, md5(text) AS md5, lang, source, n_chars FROM documents")
def _(spark, sf):
    """Lines of JSON, blank ones among them."""
    docs, folder = table(spark, sf, "documents"), scratch(spark, "jsonl")
    lines = docs.select(F.explode(F.array(F.to_json(F.struct(*docs.columns)), F.when(F.col("doc_id") % 3 == 0, ""))).alias("value"))
    lines.where("value IS NOT NULL").write.text(folder)
    return S.read_jsonl(spark, folder, _DOCUMENTS).select("doc_id", F.md5("text").alias("md5"), "lang", "source", "n_chars")


@query("csv_scan", "SELECT doc_id, md5(text) AS md5, CAST(n_chars AS INTEGER) AS n_chars, lang FROM documents WHERE text IS NOT NULL AND text <> ''")
def _(spark, sf):
    """Quotes, commas and line ends within fields; numbers are read as such."""
    folder = scratch(spark, "csv")
    table(spark, sf, "documents").where("text <> ''").select("doc_id", F.concat(F.lit('"'), "text", F.lit('",')).alias("text"), "n_chars", "lang").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(folder)
    rows = S.read_csv(spark, folder, "doc_id long, text string, n_chars int, lang string")
    return rows.select("doc_id", F.md5(F.substring("text", F.lit(2), F.length("text") - 3)).alias("md5"), "n_chars", "lang")


@query("task_scan", f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('tsv|' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, lang AS task, 'Task ' || lang || ': doc ' || doc_id || '?' AS prompt, CASE WHEN {s_draw('doc_id', 'answer', 2)} = 0 THEN 'Yes' ELSE 'No' END AS answer FROM r WHERE rn <= 40""")
def _(spark, sf):
    """A folder of tab-separated rows for each task, with the task's instruction; a seeded sample of each."""
    folder = scratch(spark, "tasks")
    rows = table(spark, sf, "documents").select("lang", F.col("doc_id").cast("int").alias("index"), F.concat(F.lit("doc "), "doc_id").alias("text"), F.when(draw(F.col("doc_id"), "answer", 2) == 0, "Yes").otherwise("No").alias("answer"))
    rows.write.partitionBy("lang").option("header", True).option("sep", "\t").csv(folder)
    tasks = table(spark, sf, "documents").select(F.concat(F.lit("lang="), "lang").alias("task"), F.col("lang").alias("name"), F.concat(F.lit("Task "), "lang", F.lit(": {{text}}?")).alias("instruction")).distinct()
    read = S.read_tasks(spark, f"{folder}/lang=*", tasks, "index int, text string, answer string", sample=("index", 40, "tsv"))
    return read.select(F.col("index").cast("long").alias("doc_id"), F.col("name").alias("task"), "prompt", "answer")


@query("cells_scan", f"SELECT lang AS model, {s_draw('doc_id', 'condition', 2)} = 1 AS windowed, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2")
def _(spark, sf):
    """A file for each cell of an experiment; which cell a file is, its rows say."""
    folder = scratch(spark, "cells")
    rows = table(spark, sf, "documents").select(F.col("lang").alias("model"), (draw(F.col("doc_id"), "condition", 2) == 1).alias("windowed"), "n_chars")
    rows.select("*", F.concat("model", "windowed").alias("cell")).repartition("cell").write.partitionBy("cell").json(folder)
    cells = S.read_cells(spark, f"{folder}/cell=*/*.json", "model string, windowed boolean, n_chars long", ["model", "windowed"])
    return cells.groupBy("model", "windowed").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("zip_scan", "SELECT doc_id, md5(text) AS md5, lang FROM documents")
def _(spark, sf):
    """Archives of some hundred rows, with a member that holds no rows."""
    folder = scratch(spark, "zip")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("README.txt", "not rows")
            z.writestr("data/rows.jsonl", "\n\n".join(part["line"]) + "\n")
        return pd.DataFrame({"name": [f"{part['lot'].iloc[0]}.zip"], "content": [data.getvalue()]})

    docs = table(spark, sf, "documents")
    lines = docs.select(F.floor(F.col("doc_id") / 200).alias("lot"), F.to_json(F.struct("doc_id", "text", "lang")).alias("line"))
    write_files(lines.groupBy("lot").applyInPandas(pack, "name string, content binary"), folder)
    return S.read_zipped_jsonl(spark, f"{folder}/*.zip", "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("md5"), "lang")


@query("split_sink", f"SELECT {S_SPLIT} AS split, count(*) AS n, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1")
def _(spark, sf):
    folder = scratch(spark, "splits")
    S.write_splits(table(spark, sf, "documents").select("doc_id", split_of(F.col("doc_id")).alias("split")), folder)
    return spark.read.schema("doc_id long, split string").json(folder).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("table_sink", "SELECT f AS kind, lang, count(*) AS n, CAST(max(n_chars) AS BIGINT) AS longest FROM documents, (VALUES ('csv'), ('json')) v(f) GROUP BY 1, 2")
def _(spark, sf):
    """A table of results as CSV and as JSON, each read back."""
    folder, schema = scratch(spark, "table"), "lang string, n long, longest long"
    S.write_table(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")), folder)
    read = S.read_csv(spark, f"{folder}/csv", schema).withColumn("kind", F.lit("csv"))
    return read.unionByName(spark.read.schema(schema).json(f"{folder}/json").withColumn("kind", F.lit("json")))


@query("report_sink", """WITH t AS (SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS a FROM documents GROUP BY 1), s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
l AS (SELECT 0 AS part, 0 AS k, '' AS o, '# Corpus' AS line UNION ALL SELECT 0, 1, '', '' UNION ALL SELECT 1, 0, '', '## By language' UNION ALL SELECT 1, 1, '', '' UNION ALL SELECT 1, 2, '', '| lang | n | mean_chars |' UNION ALL SELECT 1, 3, '', '|---|---|---|'
UNION ALL SELECT 1, 4, lang, '| ' || lang || ' | ' || n || ' | ' || printf('%.4f', a) || ' |' FROM t UNION ALL SELECT 1, 5, '', '' UNION ALL SELECT 2, 0, '', '## By source' UNION ALL SELECT 2, 1, '', '' UNION ALL SELECT 2, 2, '', '| source | n |' UNION ALL SELECT 2, 3, '', '|---|---|'
UNION ALL SELECT 2, 4, source, '| ' || source || ' | ' || n || ' |' FROM s UNION ALL SELECT 3, 0, '', '## Empty' UNION ALL SELECT 3, 1, '', '' UNION ALL SELECT 3, 2, '', 'No rows.')
SELECT CAST(row_number() OVER (ORDER BY part, k, o) - 1 AS INTEGER) AS pos, line FROM (SELECT * FROM l UNION ALL SELECT 2, 5, '', '')""")
def _(spark, sf):
    """A report of several sections, written and read as lines."""
    docs, folder = table(spark, sf, "documents"), scratch(spark, "report")
    by_lang = docs.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars")).orderBy("lang")
    sections = [("By language", by_lang), ("By source", docs.groupBy("source").agg(F.count("*").alias("n")).orderBy("source")), ("Empty", by_lang.limit(0))]
    S.write_report(spark, "Corpus", sections, folder)
    read = spark.read.text(folder, wholetext=True)
    return read.select(F.posexplode(F.split(F.regexp_replace("value", "\n+$", ""), "\n")).alias("pos", "line"))


_FLAT = r"trim(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"


@query("file_text", f"""SELECT 'd' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.docx' WHEN doc_id % 5 = 1 THEN '.exe' ELSE '.txt' END AS name, CASE WHEN doc_id % 5 <> 1 AND {_FLAT} <> '' THEN md5({_FLAT}) END AS md5,
CASE WHEN doc_id % 5 = 1 THEN 'Unsupported file type; use PDF, DOCX or TXT' WHEN {_FLAT} = '' THEN 'No text found in the file' END AS error FROM documents""")
def _(spark, sf):
    """Text of uploaded files, some thousand a folder: Word documents, plain text with other line ends, and kinds that aren't read."""
    folder = scratch(spark, "uploads")
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def make(batches):
        from xml.sax.saxutils import escape

        for b in batches:
            names, contents = [], []
            for i, text in zip(b["doc_id"], b["text"], strict=True):
                if i % 5 == 0:
                    data, body = io.BytesIO(), "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in text.split("\n"))
                    with zipfile.ZipFile(data, "w") as z:
                        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>')
                    names.append(f"{i // 4096}/d{i}.docx"), contents.append(data.getvalue())
                else:
                    names.append(f"{i // 4096}/d{i}.{'exe' if i % 5 == 1 else 'txt'}"), contents.append(text.replace("\n", "\r\n").encode())
            yield pd.DataFrame({"name": names, "content": contents})

    write_files(texts(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(make, "name string, content binary"), folder)
    return S.extract_files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("text").alias("md5"), "error")


@query("inference_scan", f"""WITH s AS (SELECT doc_id, text, {S_SPLIT} AS split, [trim(substr(text, 1, 40), ' '), '', trim(substr(text, 31, 60), ' ')] AS spans FROM documents WHERE text IS NOT NULL AND length(text) >= 100)
SELECT split, 'd' || doc_id AS doc_id, h AS hypothesis_id, 'Hypothesis ' || h AS hypothesis, CASE WHEN h = 'h1' THEN 'Entailment' ELSE 'NotMentioned' END AS verdict,
CASE WHEN h = 'h2' THEN 0 ELSE len(list_filter([spans[1], spans[3]], lambda x: x <> '')) END AS n_evidence, CASE WHEN h = 'h2' THEN '' ELSE array_to_string(list_filter([spans[1], spans[3]], lambda x: x <> ''), '|') END AS evidence,
CAST(CASE WHEN h = 'h2' THEN 0 ELSE 4 - len(list_filter([spans[1], spans[3]], lambda x: x <> '')) END AS INTEGER) AS n_dropped FROM s, (VALUES ('h1'), ('h2')) v(h)""")
def _(spark, sf):
    """Nested files of three splits: spans by offset, annotations by index, some out of bounds, one blank."""
    folder = scratch(spark, "inference")
    docs = table(spark, sf, "documents").where(F.length("text") >= 100).withColumn("split", split_of(F.col("doc_id")))
    offsets = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((0, 40), (40, 40), (30, 90))])
    note = lambda choice, at: F.struct(F.lit(choice).alias("choice"), F.array(*map(F.lit, at)).cast("array<int>").alias("spans"))
    notes = F.create_map(F.lit("h1"), note("Entailment", [0, 1, 2, 7]), F.lit("h2"), note("NotMentioned", []))
    one = F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("x").alias("file_name"), "text", offsets.alias("spans"), F.array(F.struct(notes.alias("annotations"))).alias("annotation_sets"))
    labels = F.create_map(*[x for h in ("h1", "h2") for x in (F.lit(h), F.struct(F.lit(f"Hypothesis {h}").alias("hypothesis")))])
    files = docs.select("split", F.floor(F.col("doc_id") / 500).alias("lot"), one.alias("d")).groupBy("split", "lot").agg(F.collect_list("d").alias("documents"))
    write_named_texts(files.select("split", "lot", F.to_json(F.struct("documents", labels.alias("labels"))).alias("content")), folder, ["split", "lot"])
    out = None
    for split in ("train", "dev", "test"):
        rows = S.read_nested(spark, f"{folder}/split={split}/lot=*", S.INFERENCE_SCHEMA) if spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/split={split}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/split={split}")) else None
        if rows is not None:
            rows = DS.flatten_inference(rows).withColumn("split", F.lit(split))
            out = rows if out is None else out.unionByName(rows)
    return out.select("split", "doc_id", "hypothesis_id", "hypothesis", "verdict", F.size("evidence").cast("long").alias("n_evidence"), F.array_join("evidence", "|").alias("evidence"), "n_dropped")


_GIVEN = "CASE doc_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [substr(text, 5, 30), 'not in any text'] WHEN 2 THEN ['nowhere at all'] ELSE [substr(text, 1, 20), substr(text, 1, 20), '  '] END"


@query("question_scan", f"""WITH g AS (SELECT doc_id, text, {_GIVEN} AS given FROM documents WHERE length(text) >= 50), e AS (SELECT doc_id, given, list_distinct(list_filter(given, lambda a: {s_norm('a')} <> '' AND contains({s_norm('text')}, {s_norm('a')}))) AS evidence FROM g)
SELECT 'Contract ' || doc_id AS contract, 'Category A' AS category, len(evidence) > 0 AS present, CAST(len(evidence) AS INTEGER) AS n_evidence FROM e WHERE len(given) = 0 OR len(evidence) > 0""")
def _(spark, sf):
    """Contracts with questions; answers that the text doesn't hold, and questions left without one, are dropped; so are categories
    that aren't asked for."""
    folder = scratch(spark, "questions")
    k = F.col("doc_id") % 4
    part = lambda a, n: F.substring("text", a, n)
    given = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(part(5, 30), F.lit("not in any text"))).when(k == 2, F.array(F.lit("nowhere at all"))).otherwise(F.array(part(1, 20), part(1, 20), F.lit("  ")))
    ask = lambda name: F.struct(F.concat(F.lit("c"), "doc_id", F.lit(f"__{name}")).alias("id"), F.transform(given, lambda a: F.struct(a.alias("text"))).alias("answers"))
    paragraph = F.struct(F.col("text").alias("context"), F.array(ask("Category A"), ask("Other")).alias("qas"))
    one = F.struct(F.concat(F.lit("Contract "), "doc_id").alias("title"), F.array(paragraph).alias("paragraphs"))
    files = table(spark, sf, "documents").where(F.length("text") >= 50).select(F.floor(F.col("doc_id") / 500).alias("lot"), one.alias("d")).groupBy("lot").agg(F.collect_list("d").alias("data"))
    write_named_texts(files.select("lot", F.to_json(F.struct(F.lit("v1").alias("version"), "data")).alias("content")), folder, ["lot"])
    rows = DS.flatten_questions(S.read_nested(spark, f"{folder}/lot=*", S.QUESTION_SCHEMA), ["Category A"])
    return rows.select("contract", "category", "present", F.size("evidence").alias("n_evidence"))


@query("review_store", f"""SELECT 'r' || doc_id AS review_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents WHERE doc_id % 6 = 0 AND doc_id % 7 <> 0) THEN 'reopened' WHEN doc_id % 3 = 0 THEN 'done' WHEN doc_id % 5 = 0 THEN 'sample' ELSE 'queued' END AS status,
CASE WHEN doc_id % 3 = 0 THEN {s_draw('doc_id', 'decision', 3)} END AS flags FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0)""")
def _(spark, sf):
    """Seeds, an update of some with a new column, samples that are there already, buckets written anew, a removal, and a change of one."""
    store = ReviewStore(spark, scratch(spark, "reviews"), buckets=8)
    ids = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("r"), "doc_id").alias("review_id"))
    store.upsert(ids.where("doc_id % 2 = 0 AND doc_id % 5 <> 0").select("review_id", F.lit("queued").alias("status")))
    store.seed(ids.where("doc_id % 5 = 0").select("review_id", F.lit("sample").alias("status")))
    store.seed(ids.where("doc_id % 5 = 0").select("review_id", F.lit("twice").alias("status")))
    store.compact()
    store.upsert(ids.where("doc_id % 3 = 0").select("review_id", F.lit("done").alias("status"), draw(F.col("doc_id"), "decision", 3).alias("flags")))
    store.delete(ids.where("doc_id % 7 = 0"))
    one = ids.where("doc_id % 6 = 0 AND doc_id % 7 <> 0").agg(F.min("doc_id")).first()[0]
    store.update(f"r{one}", lambda df: df.withColumn("status", F.lit("reopened")))
    return store.read().select("review_id", "status", "flags")


@query("row_zip", f"SELECT doc_id AS \"row\", {s_draw('doc_id', 'gold', 4)} AS gold, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {s_draw('doc_id', 'pred', 7)} END AS pred FROM documents")
def _(spark, sf):
    """Gold and predictions, kept apart, put side by side by the number of their row."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row"))
    gold, pred = docs.withColumn("gold", draw(F.col("row"), "gold", 4)), docs.withColumn("pred", F.when(F.col("row") % 10 != 0, draw(F.col("row"), "pred", 7)))
    return DS.zip_rows(gold, pred.repartition(5, F.col("pred")), "row").select("row", "gold", "pred")
