"""Text, duplicates and containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as SP
from ..functions import text as X
from ..functions import windows as WN
from ..operators import dedup as D
from ..operators import reviews as R
from ..operators.containment import containment
from .base import ANSWERS, STARTS, answers, draw, loud, rounded, s_draw, s_edge, s_loud, s_norm, s_tokens, spans
from .registry import query, table, texts


SPLITS = ["test", "dev", "train"]


def split_of(key):
    d = draw(key, "split", 10)
    return F.when(d < 2, "test").when(d < 4, "dev").otherwise("train")


S_SPLIT = f"CASE WHEN {s_draw('doc_id', 'split', 10)} < 2 THEN 'test' WHEN {s_draw('doc_id', 'split', 10)} < 4 THEN 'dev' ELSE 'train' END"


@query("benchmark_containment", f"""
WITH d AS (SELECT doc_id, {s_norm('text')} AS h FROM documents), b AS (SELECT item_id, {s_norm('text')} AS n FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(h, n) OR contains(h, {s_edge('n')})""")
def _(spark, sf):
    return containment(table(spark, sf, "benchmark"), texts(spark, sf), "item_id", "text", "doc_id", "text")


@query("norm_hash", f"SELECT doc_id, sha256({s_norm('text')}) AS norm_sha256, substr(sha1(coalesce(text, '')), 1, 12) AS chunk_id FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(X.norm("text"), 256).alias("norm_sha256"), F.substring(F.sha1(F.coalesce("text", F.lit(""))), 1, 12).alias("chunk_id"))


@query("word_counts", f"SELECT doc_id, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS INTEGER) AS n_words, CAST(len({s_tokens('text')}) AS INTEGER) AS n_tokens FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.words("text")).alias("n_words"), F.size(X.tokens("text")).alias("n_tokens"))


_SHINGLES = f"""toks AS (SELECT doc_id, {s_tokens('text')} AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM toks)"""


@query("shingle_counts", f"WITH {_SHINGLES} SELECT doc_id, CAST(len(s) AS INTEGER) AS n_shingles FROM sh")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.shingles(X.tokens("text"), 5)).alias("n_shingles"))


@query("exact_dup_groups", f"""SELECT sha256({s_norm('text')}) AS h, count(*) AS size, min(doc_id) AS first_id, count(DISTINCT {S_SPLIT}) > 1 AS crosses
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    return D.equal_groups(table(spark, sf, "documents").withColumn("split", split_of(F.col("doc_id"))), "doc_id", F.col("text"), "split")


@query("duplicate_rows", f"SELECT count(*) AS n, count(DISTINCT {s_norm('text')}) AS n_distinct, count(*) - count(DISTINCT {s_norm('text')}) AS n_duplicate FROM documents")
def _(spark, sf):
    return D.duplicate_rows(table(spark, sf, "documents"), X.norm("text"))


@query("split_counts", f"""SELECT {S_SPLIT} AS split, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang <> 'en') AS other, count(DISTINCT source) AS sources FROM documents GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumn("split", split_of(F.col("doc_id")))
    return docs.groupBy("split").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"), F.count_distinct("source").alias("sources"))


@query("split_overlap", f"""WITH k AS (SELECT DISTINCT {s_norm('text')} AS t, {S_SPLIT} AS split FROM documents)
SELECT x.split AS a, y.split AS b, count(*) AS shared FROM k x JOIN k y ON x.t = y.t AND x.split < y.split GROUP BY 1, 2""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(X.norm("text").alias("t"), split_of(F.col("doc_id")).alias("split"))
    return D.split_overlap(docs, "t", "split")


_PAIRS = f"""{_SHINGLES},
class AS (SELECT min(doc_id) AS id, any_value(s) AS s FROM (SELECT doc_id, list_sort(s) AS s FROM sh) GROUP BY md5(array_to_string(s, '|'))),
flat AS (SELECT id, len(s) AS n, unnest(s) AS x FROM class),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM flat a JOIN flat b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
near AS (SELECT a, b, c / CAST(na + nb - c AS DOUBLE) AS jaccard FROM pairs)"""


@query("near_dup_pairs", f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM near WHERE jaccard >= 0.8")
def _(spark, sf):
    return rounded(D.similar_pairs(texts(spark, sf), "doc_id", X.tokens("text"), 5, 0.8))


@query("near_dup_classes", f"""WITH {_SHINGLES}, k AS (SELECT doc_id, md5(array_to_string(list_sort(s), '|')) AS h FROM sh)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM k""")
def _(spark, sf):
    members = D.shingle_classes(texts(spark, sf), "doc_id", X.tokens("text"), 5)
    names = members.groupBy("digest").agg(F.min("id").alias("class_id"))
    return members.join(names, "digest").select(F.col("id").alias("doc_id"), "class_id")


@query("near_dup_threshold_counts", f"""WITH {_PAIRS}, sp AS (SELECT doc_id, {S_SPLIT} AS split FROM documents),
t AS (SELECT jaccard, x.split <> y.split AS crosses FROM near JOIN sp x ON x.doc_id = a JOIN sp y ON y.doc_id = b)
SELECT count(*) FILTER (crosses AND jaccard >= 0.95) AS cross_95, count(*) FILTER (crosses AND jaccard >= 0.8) AS cross_80,
count(*) FILTER (crosses AND jaccard >= 0.6) AS cross_60, count(*) FILTER (NOT crosses AND jaccard >= 0.8) AS within_80 FROM t""")
def _(spark, sf):
    number = lambda c: F.array_position(F.array(*map(F.lit, SPLITS)), split_of(c))
    n = D.similar_counts(texts(spark, sf), "doc_id", X.tokens("text"), number, [0.95, 0.8, 0.6])
    of = lambda crosses, level: F.coalesce(F.sum(F.when((F.col("crosses") == crosses) & (F.col("level") == level), F.col("n"))), F.lit(0))
    return n.agg(*[of(True, t).alias(f"cross_{round(100 * t)}") for t in (0.95, 0.8, 0.6)], of(False, 0.8).alias("within_80"))


@query("near_dup_families", f"""WITH {_PAIRS}, l AS (SELECT a AS id, b AS other FROM near WHERE jaccard >= 0.8 UNION ALL SELECT b, a FROM near WHERE jaccard >= 0.8)
SELECT id AS doc_id, count(*) AS n_links, min(other) AS least_link FROM l GROUP BY 1""")
def _(spark, sf):
    """Of each class of texts that has near copies: how many classes it is linked with, and the first of these."""
    return D.similar_links(texts(spark, sf), "doc_id", X.tokens("text"), 5, 0.8).withColumnRenamed("id", "doc_id")


@query("length_buckets", """SELECT CASE WHEN n_chars < 1000 THEN '<1K' WHEN n_chars < 4000 THEN '1-4K' WHEN n_chars < 16000 THEN '4-16K' ELSE '>16K' END AS bucket, count(*) AS n FROM documents GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy(X.bucket(F.col("n_chars"), [(1_000, "<1K"), (4_000, "1-4K"), (16_000, "4-16K")], ">16K").alias("bucket")).agg(F.count("*").alias("n"))


_NTOK = f"CAST(len({s_tokens('text')}) AS INTEGER)"
_WINDOWS = f"""n AS (SELECT doc_id, {_NTOK} AS n FROM documents),
win AS (SELECT doc_id, n, unnest(CASE WHEN n <= 400 THEN [0] ELSE range(0, CAST(ceil((n - 400) / 300.0) AS INTEGER) + 1) END) AS w FROM n)"""


@query("token_windows", f"WITH {_WINDOWS} SELECT doc_id, CAST(w AS INTEGER) AS \"window\", CAST(w * 300 AS INTEGER) AS tok_start, CAST(least(w * 300 + 400, n) AS INTEGER) AS tok_end, n > 400 AS windowed FROM win")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.size(X.tokens("text")).alias("n"))
    return docs.select("doc_id", F.explode(WN.token_windows(F.col("n"), 400, 300)).alias("w")).select("doc_id", "w.*")


@query("token_windows_budget", f"""WITH n AS (SELECT doc_id, {_NTOK} AS n FROM documents),
win AS (SELECT doc_id, n, unnest(CASE WHEN n + 50 <= 600 THEN [0] WHEN n <= 400 THEN [0] ELSE range(0, CAST(ceil((n - 400) / 300.0) AS INTEGER) + 1) END) AS w FROM n)
SELECT doc_id, count(*) AS n_windows FROM win GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.size(X.tokens("text")).alias("n"))
    return docs.select("doc_id", F.size(WN.token_windows(F.col("n"), 400, 300, budget=600, overhead=50)).cast("long").alias("n_windows"))


@query("window_histogram", f"""WITH {_WINDOWS}, k AS (SELECT doc_id, count(*) AS k FROM win GROUP BY 1)
SELECT k AS n_windows, count(*) AS docs, count(*) * k * 18 AS calls FROM k GROUP BY k""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.size(WN.token_windows(F.size(X.tokens("text")), 400, 300)).cast("long").alias("n_windows"))
    return docs.groupBy("n_windows").agg(F.count("*").alias("docs")).withColumn("calls", F.col("docs") * F.col("n_windows") * 18)


def _chunked(size: int, overlap: int, last: str) -> str:
    """Chunks by recursion: each begins ``overlap`` before the end of the one before, which is the last space of its second half."""
    half = size // 2

    def end(a: str) -> str:
        rest = f"substr(text, CAST({a} + {half} + 1 AS BIGINT), {size - half})"
        return f"CAST(CASE WHEN {a} + {size} < n AND contains({rest}, ' ') THEN {a} + {half} + length(regexp_extract({rest}, '(?s)^(.*) [^ ]*$', 1)) ELSE least({a} + {size}, n) END AS BIGINT)"

    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, n, 0 AS chunk, CAST(0 AS BIGINT) AS a, {end('0')} AS e FROM d UNION ALL SELECT doc_id, text, n, chunk + 1, a2, {end('a2')} FROM (SELECT *, greatest(a + 1, e - {overlap}) AS a2 FROM c WHERE e < n) x)
{last}"""


@query("char_chunks", _chunked(900, 200, 'SELECT doc_id, chunk, CAST(a AS INTEGER) AS start, CAST(e AS INTEGER) AS "end", md5(substr(text, a + 1, e - a)) AS md5 FROM c'))
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return WN.char_chunks(docs.select("doc_id", "text"), size=900, overlap=200).select("doc_id", "chunk", "start", "end", F.md5("chunk_text").alias("md5"))


@query("parent_chunks", _chunked(300, 80, "SELECT doc_id, chunk, CAST(a AS INTEGER) AS start, CAST(e - a AS INTEGER) AS child_chars, CAST(length(substr(text, greatest((a + e) // 2 - 600, 0) + 1, 1200)) AS INTEGER) AS parent_chars FROM c"))
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return WN.parent_chunks(docs.select("doc_id", "text")).select("doc_id", "chunk", "start", F.length("child").alias("child_chars"), F.length("parent").alias("parent_chars"))


def _last_line(at: str, width: int = 400) -> str:
    """Place of the last line break in the ``width`` characters before a place; -1 without one."""
    rest = f"substr(text, CAST(greatest({at} - {width}, 0) + 1 AS BIGINT), CAST({at} - greatest({at} - {width}, 0) AS BIGINT))"
    return f"CASE WHEN contains({rest}, chr(10)) THEN greatest({at} - {width}, 0) + length(regexp_extract({rest}, '(?s)^(.*)\\n[^\\n]*$', 1)) ELSE -1 END"


def _cut_at(first: str) -> str:
    """Columns a, e and again of the window from a token on: where it begins and ends, and the token that the next is to begin at."""
    return f"""SELECT *, CASE WHEN e >= n OR last THEN NULL ELSE greatest(f + 1, CASE WHEN l2 > a THEN len(list_filter(starts, lambda s: s < l2 + 1)) ELSE again END) END AS next FROM (SELECT *, CASE WHEN last THEN -1 ELSE {_last_line('starts[again + 1]')} END AS l2
FROM (SELECT *, CASE WHEN last THEN 0 ELSE len(list_filter(starts, lambda s: s < e)) - 60 END AS again FROM (SELECT *, CASE WHEN last THEN n WHEN l1 > a THEN l1 + 1 ELSE e0 END AS e FROM (SELECT *, CASE WHEN last THEN -1 ELSE {_last_line('e0')} END AS l1
FROM (SELECT doc_id, text, n, m, starts, w, {first} AS f, {first} + 400 >= m AS last, CASE WHEN m <= 400 THEN 0 ELSE starts[{first} + 1] END AS a, starts[{first} + 401] AS e0 FROM src)))))"""


@query("serving_windows", f"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {STARTS},
d AS (SELECT doc_id, text, length(text) AS n, coalesce(len(starts), 0) AS m, coalesce(starts, []) AS starts FROM texts LEFT JOIN offsets USING (doc_id)),
c AS (SELECT doc_id, text, n, m, starts, w, CAST(f AS BIGINT) AS f, CAST(a AS BIGINT) AS a, CAST(e AS BIGINT) AS e, last, CAST(next AS BIGINT) AS next FROM ({_cut_at('0').replace('FROM src', 'FROM (SELECT *, 0 AS w FROM d)')})
  UNION ALL SELECT doc_id, text, n, m, starts, w, CAST(f AS BIGINT), CAST(a AS BIGINT), CAST(e AS BIGINT), last, CAST(next AS BIGINT) FROM ({_cut_at('g').replace('FROM src', 'FROM (SELECT doc_id, text, n, m, starts, w + 1 AS w, next AS g FROM c WHERE NOT last)')}))
SELECT doc_id, w AS "window", CAST(a AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM c""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return WN.serving_windows(docs.select("doc_id", "text"), 400, 60).select("doc_id", "window", "start", "end")


@query("tokenizer_windows")
def _(spark, sf):
    """The same by the tokens of a public vocabulary, which SQL doesn't have: windows and characters of each document."""
    import public_tokenizers

    docs = texts(spark, sf).select("doc_id", "text")
    found = WN.serving_windows(docs, 400, 60, starts=WN.file_starts(public_tokenizers.path("byte_bpe_50k.json")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.max("end").alias("chars"), F.sum(F.col("end") - F.col("start")).alias("window_chars"))


def _line_end(a: str) -> str:
    """1440 characters on, or behind the last line break of their last 400."""
    rest = f"substr(text, CAST({a} + 1041 AS BIGINT), 400)"
    return f"CAST(CASE WHEN {a} + 1440 < n AND contains({rest}, chr(10)) THEN {a} + 1041 + length(regexp_extract({rest}, '(?s)^(.*)\\n[^\\n]*$', 1)) ELSE least({a} + 1440, n) END AS BIGINT)"


@query("estimated_windows", f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, text, n, 0 AS w, CAST(0 AS BIGINT) AS a, {_line_end('0')} AS e FROM d UNION ALL SELECT doc_id, text, n, w + 1, a2, {_line_end('a2')} FROM (SELECT *, greatest(a + 1, e - 216) AS a2 FROM c WHERE e < n) x)
SELECT doc_id, w AS "window", CAST(a AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM c""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return WN.estimated_windows(docs.select("doc_id", "text"), 400, 60).select("doc_id", "window", "start", "end")


@query("size_estimate", """SELECT doc_id, CAST(round_even(length(text) / 3.6, 0) AS INTEGER) AS tokens,
CAST(CASE WHEN round_even(length(text) / 3.6, 0) <= 1400 THEN 1 ELSE ceil((round_even(length(text) / 3.6, 0) - 1400) / 1200.0) + 1 END AS INTEGER) AS windows,
CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", WN.size_estimate(F.col("text"), tokens=1400, stride=1200).alias("e")).select("doc_id", "e.*")


@query("locate_spans", f"""WITH {ANSWERS}, texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {STARTS},
q AS (SELECT doc_id, text, unnest(list_concat(gold, pred)) AS q, generate_subscripts(list_concat(gold, pred), 1) AS k FROM answers),
r AS (SELECT doc_id, {s_norm('text')} AS h, q, {s_norm('q')} AS nq, row_number() OVER (PARTITION BY doc_id, {s_norm('q')} ORDER BY k) AS rn FROM q),
s AS (SELECT doc_id, q, h, CASE WHEN contains(h, nq) THEN nq ELSE {s_edge('nq')} END AS needle FROM r WHERE rn = 1 AND nq <> ''),
p AS (SELECT doc_id, q, h, instr(h, needle) AS a, instr(h, needle) + length(needle) - 1 AS b FROM s WHERE needle <> '' AND contains(h, needle)),
w AS (SELECT doc_id, q, length(regexp_replace(substr(h, 1, a), '[^ ]', '', 'g')) AS wa, a - length(regexp_extract(substr(h, 1, a), '^(.* )?', 0)) - 1 AS oa, length(regexp_replace(substr(h, 1, b), '[^ ]', '', 'g')) AS wb, b - length(regexp_extract(substr(h, 1, b), '^(.* )?', 0)) - 1 AS ob FROM p)
SELECT doc_id, CAST(starts[wa + 1] + oa AS INTEGER) AS start, CAST(starts[wb + 1] + ob + 1 AS INTEGER) AS "end", md5(q) AS md5 FROM w JOIN offsets USING (doc_id)""")
def _(spark, sf):
    rows = answers(spark, sf).withColumn("quotes", SP.distinct_quotes(F.concat("gold", "pred"), X.norm))
    return rows.select("doc_id", F.explode(SP.locate(F.col("text"), F.col("quotes"))).alias("s")).select("doc_id", "s.start", "s.end", F.md5("s.text").alias("md5"))


@query("disjoint_marks", f"""WITH {ANSWERS}, q AS (SELECT doc_id, text, q FROM (SELECT doc_id, text, unnest(list_concat(gold, pred, list_transform(gold, lambda g: substr(g, 5, 40)))) AS q FROM answers)),
m AS (SELECT doc_id, instr(text, q) - 1 AS s, instr(text, q) - 1 + length(q) AS e FROM q WHERE length(q) > 0 AND instr(text, q) > 0),
l AS (SELECT doc_id, list_transform(list(struct_pack(s := s, e := e) ORDER BY s, e DESC), lambda x: [x.s, x.e]) AS l FROM m GROUP BY doc_id),
k AS (SELECT doc_id, list_reduce(list_concat([[0, 0, 0]], list_transform(l, lambda x: [x[1], x[2], 0])), lambda acc, x: CASE WHEN x[1] >= acc[1] THEN [x[2], acc[2] + 1, acc[3] + x[2] - x[1]] ELSE acc END) AS k FROM l)
SELECT doc_id, CAST(coalesce(k[2], 0) AS INTEGER) AS kept, CAST(coalesce(k[3], 0) AS INTEGER) AS marked FROM documents LEFT JOIN k USING (doc_id)""")
def _(spark, sf):
    """Marks where a document's quotes stand in its text, gold and predicted, and parts of them: how many are shown, over how many characters."""
    a = answers(spark, sf).withColumn("q", F.concat("gold", "pred", F.transform("gold", lambda g: F.substring(g, 5, 40))))
    at = lambda q: F.call_function("instr", F.col("text"), q)
    marks = F.transform(F.filter("q", lambda q: (F.length(q) > 0) & (at(q) > 0)), lambda q: F.struct((at(q) - 1).cast("int").alias("start"), (at(q) - 1 + F.length(q)).cast("int").alias("end")))
    kept = a.select("doc_id", SP.disjoint_marks(marks).alias("m"))
    return kept.select("doc_id", F.size("m").alias("kept"), F.aggregate("m", F.lit(0), lambda n, x: n + x["end"] - x["start"]).alias("marked"))


@query("heading_lines", """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents),
h AS (SELECT *, regexp_replace(t, '[^A-Za-z]', '', 'g') AS letters FROM l WHERE t <> '')
SELECT doc_id, count(*) FILTER (length(t) <= 80 AND (length(letters) >= 4 AND letters = upper(letters) OR (regexp_matches(t, '^(\\d+(\\.\\d+)*\\.?|§\\s*\\d+|[A-Z]\\.|ARTICLE\\s+[IVXLC\\d]+|Section\\s+\\d+)\\s') AND length(t) < 60 AND NOT regexp_matches(t, '[.;:!?]["''”’)]*$')))) AS headings, count(*) AS lines FROM h GROUP BY 1""")
def _(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).where(F.trim("t") != "")
    return lines.groupBy("doc_id").agg(F.count_if(R.is_heading(F.col("t"))).alias("headings"), F.count("*").alias("lines"))


_HEADING = """length(t) <= 80 AND (length(letters) >= 4 AND letters = upper(letters) OR (regexp_matches(t, '^(\\d+(\\.\\d+)*\\.?|§\\s*\\d+|[A-Z]\\.|ARTICLE\\s+[IVXLC\\d]+|Section\\s+\\d+)\\s') AND length(t) < 60 AND NOT regexp_matches(t, '[.;:!?]["''”’)]*$')))"""


@query("text_blocks", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
o AS (SELECT *, trim(s) AS t, regexp_replace(trim(s), '[^A-Za-z]', '', 'g') AS letters, coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS block, CASE WHEN {_HEADING} THEN 'heading' ELSE 'para' END AS kind,
CAST(at_ + length(s) - length(ltrim(s)) AS INTEGER) AS start, CAST(at_ + length(s) AS INTEGER) AS "end" FROM o WHERE t <> ''""")
def _(spark, sf):
    return R.text_blocks(table(spark, sf, "documents"), "doc_id", "text")


@query("contract_markdown", """WITH l AS (SELECT doc_id, t, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
x AS (SELECT doc_id, pos, trim(t) AS t, regexp_replace(trim(t), '[^A-Za-z]', '', 'g') AS letters FROM l WHERE trim(t) <> ''),
h AS (SELECT doc_id, pos, CASE WHEN length(t) <= 80 AND (length(letters) >= 4 AND letters = upper(letters) OR (regexp_matches(t, '^(\\d+(\\.\\d+)*\\.?|§\\s*\\d+|[A-Z]\\.|ARTICLE\\s+[IVXLC\\d]+|Section\\s+\\d+)\\s') AND length(t) < 60 AND NOT regexp_matches(t, '[.;:!?]["''”’)]*$'))) THEN '## ' ELSE '' END || t || chr(10) AS m FROM x)
SELECT doc_id, md5('# Contract ' || doc_id || chr(10) || chr(10) || string_agg(m, chr(10) ORDER BY pos)) AS markdown_md5 FROM h GROUP BY doc_id""")
def _(spark, sf):
    docs = table(spark, sf, "documents").where(F.trim("text") != "")
    return docs.select("doc_id", F.md5(R.contract_markdown(F.concat(F.lit("Contract "), "doc_id"), F.col("text"))).alias("markdown_md5"))


_CLEAN = "regexp_replace(gold[1], '[\"'']', '', 'g')"
QUOTES = "'\"[^\"]{8,}\"|''[^'']{8,}'''"


@query("quoted_spans", f"""WITH {ANSWERS}, said AS (SELECT doc_id, 'He said "' || {_CLEAN} || '" and ''' || {s_loud(_CLEAN)} || '''.' AS t FROM answers WHERE len(gold) > 0)
SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(t, {QUOTES}), lambda q: trim(substr(q, 2, length(q) - 2))), lambda q: q <> ''), '|') AS quotes FROM said""")
def _(spark, sf):
    clean = F.regexp_replace(F.col("gold")[0], "[\"']", "")
    rows = answers(spark, sf).where(F.size("gold") > 0).select("doc_id", F.concat(F.lit('He said "'), clean, F.lit("\" and '"), loud(clean), F.lit("'.")).alias("t"))
    return rows.select("doc_id", F.array_join(X.quoted("t"), "|").alias("quotes"))


@query("sentence_counts", r"""SELECT doc_id, CAST(len(regexp_extract_all(trim(regexp_replace(regexp_replace(text, '\b(?:e\.g|i\.e|etc|vs|Inc|Ltd|Corp|Co|No|Art|Sec)\.', 'X', 'g'), '\d\.\d', 'XX', 'g')), '[.!?](?:\s|$)')) AS INTEGER) AS sentences FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sentence_count("text").cast("int").alias("sentences"))


@query("excerpts", f"""WITH {ANSWERS} SELECT doc_id, CASE WHEN instr(text, gold[1]) > 0 THEN substr(text, greatest(instr(text, gold[1]) - 80, 1), length(gold[1]) + 160) END AS excerpt FROM answers WHERE len(gold) > 0 AND length(gold[1]) > 0""")
def _(spark, sf):
    rows = answers(spark, sf).where((F.size("gold") > 0) & (F.length(F.get("gold", F.lit(0))) > 0))
    return rows.select("doc_id", X.excerpt(F.col("text"), F.col("gold")[0]).alias("excerpt"))


@query("nda_route", r"""SELECT doc_id, regexp_matches(substr(text, 1, 6000), '(?i)non-?\s?disclosure|confidentiality agreement|\bNDA\b') AS nda FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.nda(F.col("text")).alias("nda"))


_LAST = "regexp_extract(acc, '[^\\n]*$')"
_SECTION = "'^(\\d+(\\.\\d+)*\\.?|§\\s*\\d+|[A-Z]\\.|\\([a-z0-9]{1,4}\\))\\s'"


@query("unwrap_lines", f"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, concat(' ', chr(9), chr(11), chr(12), chr(13), chr(133), chr(160)))) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(list_reduce(lines, lambda acc, x: CASE WHEN {_LAST} <> '' AND x <> '' AND (regexp_matches(x, '^[,;:)a-z]') OR NOT (length({_LAST}) < 60 AND (upper({_LAST}) = {_LAST} AND lower({_LAST}) <> {_LAST} OR regexp_matches({_LAST}, {_SECTION}))
  OR regexp_matches({_LAST}, '[.;:!?][”’"'')]*$') OR regexp_matches(x, {_SECTION}))) THEN acc || CASE WHEN regexp_matches(x, '^[,;:)]') THEN '' ELSE ' ' END || x ELSE acc || chr(10) || x END)) AS md5 FROM l""")
def _(spark, sf):
    from ..sources.files import unwrap

    WN.small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", F.md5(unwrap(F.col("text"))).alias("md5"))


@query("span_lengths", f"""WITH {ANSWERS} SELECT doc_id, CAST(len(list_filter(gold, lambda g: length({s_norm('g')}) > 4)) AS INTEGER) AS kept, CAST(len(gold) AS INTEGER) AS given FROM answers""")
def _(spark, sf):
    return answers(spark, sf).select("doc_id", F.size(X.drop_trivial(F.col("gold"))).alias("kept"), F.size("gold").alias("given"))


@query("distinct_spans", """SELECT count(DISTINCT x) AS n FROM (SELECT unnest(string_split(coalesce(text, ''), '. ')) AS x FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select(F.explode(spans(F.coalesce("text", F.lit("")))).alias("x")).agg(F.count_distinct("x").alias("n"))
