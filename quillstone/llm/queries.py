"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ann import nearest
from .bitplanes import read_token_files, write_token_files
from .components import cut
from .conversation_trie import paths_of, prefix_trie, turns_of
from .decontaminate import find_leaks
from .html_density import extract_text
from .line_dedup import dedup_lines
from .ngram_join import ngram_components
from .packing import pack
from .quality_rules import judge_quality
from .substring_dedup import dedup_substrings
from .toxicity import score_toxicity, train
from .url_filter import filter_urls, host_of
from .vector_codes import encode_vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"), min_docs=2, min_chars=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The white space that keys are stripped of, and a lower case of A-Z alone.
_STRIP = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op6_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_STRIP})")} AS k FROM lines),
held AS (SELECT k, min(doc_id) AS holder FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT keyed.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


def _remainder(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Trained on the labelled rows of ``docs`` whose remainder isn't 2; remainder 3 fits the weights."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    fold = F.when(_remainder("id") == 2, None).when(_remainder("id") == 3, 1).otherwise(0)
    return train(docs, labels, fold)


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, toxicity_model(spark, docs, sf_dir), threshold=0.3)
    return scored.select("doc_id", F.coalesce(_remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@_query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), percent=10)
    found = docs.where(F.size("leaks") > 0).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.start", "leak.n_chars", "leak.edits")


@_query
def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


@_query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), capacity=2048)


@_query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def _number(text, at: int):
    """A number from 0 to 65535 that depends on a text; DuckDB computes the same."""
    return F.conv(F.substring(F.md5(text), at, 4), 16, 10).cast("int")


def url_list_changes(pages: DataFrame) -> DataFrame:
    """Dated changes of four lists about the hosts of ``pages``: the tables hold no lists, so these stand in for them."""
    seen = cut(pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", "^[^:/?#]+://[^/?#]+/([^/?#]+)", 1).alias("section")).where("host IS NOT NULL").distinct())
    hosts = seen.select("host").distinct()
    sections = seen.where("section <> ''").select(F.concat("host", F.lit("/"), "section").alias("p"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    change = lambda df, name, allows, kind, pattern, action, n: df.select(F.lit(name).alias("list"), F.lit(allows).alias("allows"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("at"))
    h, p = F.col("host"), F.col("p")
    domain = F.substring_index(h, ".", -2)
    a = _number(h, 1) % 500
    some = hosts.where(_number(h, 5) % 3 < 2)
    b = _number(p, 1) % 300
    out = [
        change(some, "malware", False, "host", h, "add", a),
        change(some, "malware", False, "host", h, "remove", a + 30 + _number(h, 9) % 200),
        change(hosts, "spam", False, "domain", domain, "add", _number(domain, 1) % 700),
        change(sections, "sections", False, "path", p, "add", b),
        change(sections, "sections", False, "path", p, "remove", b + 60),
        change(sections, "sections", False, "path", p, "add", b + 200),
        change(hosts.where(_number(h, 13) % 5 == 0), "trusted", True, "host", h, "add", _number(h, 17) % 730),
    ]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@_query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 730).cast("int")).alias("fetched"))
    out = filter_urls(captures, url_list_changes(pages))
    return out.select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), F.array_join("lists", ",").alias("lists"), "blocked")


def _n(text: str, at: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {at}, 4) AS INTEGER)"


_HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^/?#:@\\[\\]]+)', 1)), '')"
_DOMAIN = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
SQL["op2_url_filters"] = f"""
WITH captures AS (SELECT page_id, url, {_HOST} AS host, DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER) AS fetched,
    regexp_extract(url, '^[^:/?#]+://[^/?#]+/([^/?#]+)', 1) AS section FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host IS NOT NULL),
sections AS (SELECT DISTINCT host || '/' || section AS p FROM captures WHERE host IS NOT NULL AND section <> ''),
spells AS (
  SELECT 'malware' AS list, false AS allows, 'host' AS kind, host AS pattern, {_n('host', 1)} % 500 AS a,
         {_n('host', 1)} % 500 + 30 + {_n('host', 9)} % 200 AS b FROM hosts WHERE {_n('host', 5)} % 3 < 2
  UNION ALL SELECT DISTINCT 'spam', false, 'domain', {_DOMAIN}, {_n(_DOMAIN, 1)} % 700, 1000000 FROM hosts
  UNION ALL SELECT 'sections', false, 'path', p, {_n('p', 1)} % 300, {_n('p', 1)} % 300 + 60 FROM sections
  UNION ALL SELECT 'sections', false, 'path', p, {_n('p', 1)} % 300 + 200, 1000000 FROM sections
  UNION ALL SELECT 'trusted', true, 'host', host, {_n('host', 17)} % 730, 1000000 FROM hosts WHERE {_n('host', 13)} % 5 = 0),
active AS (
  SELECT DISTINCT page_id, list, allows FROM captures JOIN spells ON
    (kind = 'host' AND pattern = host OR kind = 'domain' AND (host = pattern OR ends_with(host, '.' || pattern)) AND contains(pattern, '.')
     OR kind = 'path' AND pattern = host || '/' || section)
    AND fetched >= DATE '2024-01-01' + CAST(a AS INTEGER) AND fetched < DATE '2024-01-01' + CAST(b AS INTEGER))
SELECT page_id, url, strftime(fetched, '%Y-%m-%d') AS fetched, coalesce(string_agg(list, ',' ORDER BY list), '') AS lists,
       coalesce(bool_or(NOT allows) AND NOT bool_or(allows), false) AS blocked
FROM captures LEFT JOIN active USING (page_id) GROUP BY page_id, url, fetched"""


@_query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = encode_vectors(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _lloyd_sql(rounds: int) -> str:
    """The rounds written out one after another, from whole assignments each."""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, label, part, any_value(x) AS x, min(struct_pack(d := {far}, k := k)) AS best FROM p JOIN c{r} USING (part) GROUP BY vec_id, label, part)")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT part, k, list(m ORDER BY i) AS c FROM (SELECT part, best.k AS k, i, CAST((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
              FROM a{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY part, best.k, i) GROUP BY part, k),
            c{r + 1} AS (SELECT part, k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (part, k))""")
    return ",\n".join(steps)


SQL["op11_vector_codes"] = f"""
WITH v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(x * 256) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, e[part * len(e) // 16 + 1:(part + 1) * len(e) // 16] AS x FROM v, unnest(range(16)) t(part)),
c0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS k, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
{_lloyd_sql(2)},
s AS (SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY part, k, i)) AS codebooks_sha256 FROM c2, unnest(range(1, len(c) + 1)) t(i)),
r AS (SELECT vec_id, label, string_agg(lower(format('{{:02x}}', best.k)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, s"""


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: a conversation's first h turns are those of the first of its hundred, h from 0 to 5 by its id's hash. A hundred lie
    in one partition, so turns are shuffled once."""
    c = F.col("conv_id")
    hundred = lambda i: i.cast("long") - i.cast("long") % 100
    own = turns_of(conversations, by=hundred(c))
    h = (F.crc32(c.cast("string").cast("binary")) % 6).cast("int")
    head = F.max(F.when(c == F.col("by"), F.slice("turns", 1, 5))).over(Window.partitionBy("by"))
    rows = own.select("conv_id", "turns", h.alias("h"), head.alias("head"))
    begun = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(begun, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


@_query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(paths_of(rebuilt(_table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL["op12_conversation_trie"] = """
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
d AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS p FROM d),
r AS (SELECT h.conv_id, 0 AS own, p, d, n FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100 AND p <= h
  UNION ALL SELECT conv_id, 1, p, d, n FROM h JOIN o USING (conv_id) WHERE p > h),
c AS (SELECT conv_id, coalesce(list(struct_pack(d := d, n := n) ORDER BY own, p) FILTER (d IS NOT NULL), []) AS l FROM h LEFT JOIN r USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, k AS depth, md5(array_to_string(list_transform(l[1:k], lambda x: x.d), '')) AS node, CASE WHEN k > 0 THEN md5(array_to_string(list_transform(l[1:k - 1], lambda x: x.d), '')) END AS parent,
    CASE WHEN k > 0 THEN l[k].n ELSE 0 END AS n, k = len(l) AS ends FROM c, unnest(range(0, len(l) + 1)) t(k)),
g AS (SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node, depth, parent),
k AS (SELECT g.node, count(b.node) AS n_children FROM g LEFT JOIN g b ON b.parent = g.node GROUP BY g.node),
below AS (SELECT DISTINCT a.node AS top, b.node FROM m a JOIN m b USING (conv_id) WHERE a.depth <= b.depth),
s AS (SELECT top AS node, CAST(count(*) FILTER (n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * n) AS BIGINT) AS saved_tokens FROM below JOIN g USING (node) JOIN k USING (node) GROUP BY top)
SELECT g.conv_id, g.depth, p.conv_id AS parent_conv_id, g.n_convs, n_children, n_leaves, saved_tokens, g.ends_sha256 FROM g JOIN k USING (node) JOIN s USING (node) LEFT JOIN g p ON p.node = g.parent"""


@_query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
