"""Every query of the subpackage and every stage of the pipeline, through the entry, against brute force or SQL."""

from __future__ import annotations

import collections
import hashlib
import html
import itertools
import os
import random
import re
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import both

import __spark_entry__
import corpus_pipeline
from quillstone.llm import decontaminate, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The tables of sf0.001 with rows that are odd."""
    out = tmp_path_factory.mktemp("tables")
    for name in os.listdir(SF):
        shutil.copy(f"{SF}/{name}", out)
        os.chmod(out / name, 0o644)
    table = pq.read_table(f"{SF}/documents.parquet")
    rows = table.to_pylist()
    rng = random.Random(1)
    benchmark = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    add = lambda i, text: rows.append({"doc_id": i, "text": text, "lang": "en", "source": rng.choice(["web", None]), "n_chars": len(text or "")})
    base = [r["text"] for r in rows if r["text"] and 100 < len(r["text"].split()) < 400]
    add(9000, None), add(9001, ""), add(None, " ".join(f"alone{k}" for k in range(50))), add(9002, " \n\t "), add(9003, " ".join(f"w{rng.randrange(900)}" for _ in range(30_000)))
    for k in range(6):
        words = base[k].split(" ")
        words[len(words) // 2] = "changed"
        add(9010 + k, " ".join(words)), add(9020 + k, base[k]), add(9030 + k, "Before it. " + benchmark[k]["text"][: 30 + 60 * k] + benchmark[k]["text"][30 + 60 * k :].replace("e", "", k // 2) + " After it.")
        line = [f"u{rng.randrange(5000)}" for _ in range(200)]
        add(9050 + 2 * k, " ".join(line)), add(9051 + 2 * k, " ".join([*line[: 20 * k], "other", *line[20 * k :]]))
    add(9040, base[7]), add(9041, base[8] + " tail"), add(9041, "\n".join(f"line {k} of one id's second row" for k in range(40)))
    pq.write_table(pa.Table.from_pylist(rows, table.schema), out / "documents.parquet", row_group_size=100)
    labels = pq.read_table(f"{SF}/labels.parquet")
    more = pa.Table.from_pylist([{"doc_id": i, "quality": 1, "toxic": None} for i in (9000, None)], labels.schema)
    pq.write_table(pa.concat_tables([labels, more]), out / "labels.parquet")
    return str(out)


def rows_of(folder, name):
    return pq.read_table(f"{folder}/{name}.parquet").to_pylist()


def result(spark, folder, name):
    return __spark_entry__.queries()[name](spark, folder).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


class Scorer:
    """Scores by two Kneser-Ney models of plain dictionaries, from (doc_id, text) and labels."""

    def __init__(self, docs, labels):
        self.labels = {r["doc_id"]: r["toxic"] for r in labels if r["toxic"] is not None and r["doc_id"] is not None}
        fold = lambda i: zlib.crc32(str(i).encode()) % 4
        rows = [(i, t, self.labels[i]) for i, t in docs if i in self.labels and fold(i) != 2]
        self.w = None
        if len({t for *_, t in rows}) == 2:
            part = self.model([r for r in rows if fold(r[0]) != 3])
            last = [r for r in rows if fold(r[0]) == 3]
            x = np.stack([self.features(part, t) for _, t, _ in last])
            self.w, self.all = toxicity.fit(x, np.array([float(y) for *_, y in last])), self.model(rows)

    @staticmethod
    def words(text):
        return [w for w in "".join(" " if ord(c) < 128 and toxicity.SEPARATES[ord(c)] else c for c in (text or "").translate(LOWER)).encode().split(b" ") if w]

    def model(self, rows):
        n = [collections.Counter(), collections.Counter()]
        for _, text, toxic in rows:
            n[toxic].update(set(self.words(text)))
        head, d = (lambda w: w[: toxicity.HEAD]), toxicity.DISCOUNT
        heads = [collections.Counter(), collections.Counter()]
        kept = [collections.Counter(), collections.Counter()]
        for c in (0, 1):
            for w, k in n[c].items():
                heads[c][head(w)] += k
                kept[c][head(w)] += min(k, d)
        different = collections.Counter(head(w) for w in n[0] | n[1])
        total, freed = [h.total() for h in heads], [sum(min(k, d) for k in h.values()) for h in heads]

        def gain(w):
            h, p = head(w), []
            for c in (0, 1):
                known = heads[0][h] + heads[1][h]
                a = (max(heads[c][h] - d, 0) + freed[c] * different[h] / different.total()) / total[c] if known else freed[c] / total[c]
                pooled = n[0][w] + n[1][w]
                share = pooled / known if pooled else 1.0
                b = (max(n[c][w] - d, 0) + kept[c][h] * share) / heads[c][h] if heads[c][h] else share
                p.append(a * b)
            return np.log(p[1]) - np.log(p[0])

        return gain

    def features(self, gain, text):
        g = [gain(w) for w in self.words(text)]
        span = max((sum(g[k : k + 8]) / 8 for k in range(max(1, len(g) - 7))), default=0)
        return toxicity.features(*(np.array([x]) for x in (sum(g), len(g), max(g, default=0), span)))[0]

    def score(self, text):
        return 0.0 if self.w is None else float(1 / (1 + np.exp(-np.clip(self.features(self.all, text) @ self.w, -30, 30))))


def held_lines(rows):
    """(text kept, lines, lines dropped) of each (doc_id, text)."""
    key = lambda s: s.strip(" \t\n\v\f\r").translate(LOWER)
    order, held = (lambda i: (i is None, i or 0)), {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)], key=order) == i]
        out.append(("\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def groups(texts, size, percent):
    """A group number for each text: the first of those it is linked with."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    at = {}
    for i, s in enumerate(sets):
        for other in {j for g in s for j in at.get(g, ())}:
            if 100 * len(s & sets[other]) >= percent * len(s | sets[other]):
                a, b = find(i), find(other)
                up[max(a, b)] = min(a, b)
        for g in s:
            at.setdefault(g, []).append(i)
    return sets, [find(i) for i in range(len(texts))]


def leaked(text, items):
    t = decontaminate.normal(text or "")
    return {i for i, x in items if decontaminate.best_end(x, t)[0] <= len(x) // 10}


def items_of(folder):
    return [(r["item_id"], decontaminate.normal(r["text"])) for r in rows_of(folder, "benchmark")]


def test_all_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{k}" for k in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "decontamination", "best_fit_packing"]


def test_pipeline(spark, folder):
    """Stage after stage: what each keeps of what it is given."""
    shared = spark.read.parquet(f"{folder}/documents.parquet")
    given = [(r["doc_id"], r["text"]) for r in rows_of(folder, "documents")]
    kept = {}
    docs = shared
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == shared.columns
        kept[name] = out.collect()
        docs = spark.createDataFrame(kept[name], out.schema)
    text = lambda name: [(r.doc_id, r.text) for r in kept[name]]
    same = lambda got, want: sorted(got, key=repr) == sorted(want, key=repr)

    scorer = Scorer(given, rows_of(folder, "labels"))
    assert same(text("toxicity"), [(i, t) for i, t in given if scorer.score(t) < 0.3])
    lines = held_lines(text("toxicity"))
    assert same(text("line_dedup"), [(i, t) for (i, _), (t, _, _) in zip(text("toxicity"), lines, strict=True)])
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])

    rows = sorted(text("line_dedup"), key=lambda r: (r[0] is None, r[0] or 0))
    _, group = groups([t for _, t in rows], 5, 80)
    assert same([i for i, _ in text("ngram_jaccard_join")], [rows[k][0] for k, g in enumerate(group) if g == k])
    assert len(rows) > len(kept["ngram_jaccard_join"]) and set(text("ngram_jaccard_join")) <= set(rows)

    items = items_of(folder)
    assert same(text("decontamination"), [(i, t) for i, t in text("ngram_jaccard_join") if not leaked(t, items)])
    packed, words = collections.Counter(), {}
    for r in kept["best_fit_packing"]:
        packed[r.doc_id] += r.n_places
    for i, t in text("decontamination"):
        words[i] = words.get(i, 0) + len((t or "").split()) + 1
    assert packed == words
    assert len(result(spark, folder, "pipeline")) == len(kept["best_fit_packing"])


def test_pipeline_rows_of_one_id(spark, folder):
    """Of equal rows one stays; a row that is like no other stays though one of its id goes; null ids take part."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (None, c), (None, c), (7, None), (7, ""), (8, b + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_near_duplicates(spark, docs, folder).collect()), key=repr)
    assert got in [sorted([(3, a), x, (None, c), (7, None), (7, "")], key=repr) for x in [(5, b), (8, b + " more")]]


@pytest.mark.parametrize("k", range(5))
def test_pipeline_empty(spark, folder, k):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[k][1](spark, docs, folder).count() == 0


def test_op1(spark, folder):
    items = items_of(folder)
    got = collections.Counter((r.doc_id, r.item_id) for r in result(spark, folder, "op1_decontamination"))
    want = collections.Counter((r["doc_id"], i) for r in rows_of(folder, "documents") for i in leaked(r["text"], items))
    assert not got - want and (want - got).total() <= 0.02 * want.total() and want.total() >= 6


@pytest.mark.parametrize("name", ["op2_url_filters", "op6_line_dedup"])
def test_against_sql(spark, name):
    ours, theirs = both(spark, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], SF)
    assert ours == theirs


def test_op3(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(folder, "documents")]
    scorer = Scorer(docs, rows_of(folder, "labels"))
    got = sorted((str(r.doc_id), r.score, r.predicted, r.held_out) for r in result(spark, folder, "op3_toxicity"))
    want = sorted((str(i), s := scorer.score(t), int(s >= 0.3), i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, t in docs)
    assert [(i, p, h) for i, _, p, h in got] == [(i, p, h) for i, _, p, h in want]
    assert np.allclose([s for _, s, *_ in got], [s for _, s, *_ in want], atol=1e-4)


def test_op4(spark, folder):
    """These pages hold their text in an article of headings and paragraphs."""
    for r, page in zip(sorted(result(spark, folder, "op4_html_extraction"), key=lambda r: r.page_id), sorted(rows_of(folder, "pages"), key=lambda r: r["page_id"]), strict=True):
        body = re.search(r"<article>(.*?)(?:</article>|$)", page["html"], re.S)[1]
        body = re.sub(r"<(script|style|form|aside|nav|footer)\b.*?</\1>|<!--.*?-->", " ", body, flags=re.S)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|section|blockquote|table|tr|td|pre)\b[^>]*>", body))
        assert (r.text, r.n_chars) == (t := "\n\n".join(x for x in blocks if x), len(t))


def test_op5(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(folder, "documents")]
    sets, group = groups([t for _, t in rows], 4, 85)
    member = collections.defaultdict(set)
    for (i, _), g in zip(rows, group, strict=True):
        member[g].add(i)
    joined: dict = {}
    for ids in member.values():  # rows of one id are one node
        ids = set().union(*[joined.get(i, {i}) for i in ids - {None}], ids - {None})
        for i in ids:
            joined[i] = ids
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in result(spark, folder, "op5_ngram_jaccard_join")), key=repr)
    assert got == sorted(((i, len(s), None if i is None else min(joined[i])) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def test_op6(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(folder, "documents")]
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in result(spark, folder, "op6_line_dedup")), key=repr)
    assert got == sorted(((i, n, gone, sha(t)) for (i, _), (t, n, gone) in zip(rows, held_lines(rows), strict=True)), key=repr)


def test_op7(spark, folder):
    rows = sorted(((r["doc_id"], WORD.findall(r["text"] or "")) for r in rows_of(folder, "documents")), key=lambda r: (r[0] is None, r[0] or 0))
    first: dict = {}
    for i, w in rows:
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    want = []
    for i, w in rows:
        gone = set()
        for a in range(len(w) - 49):
            if first[tuple(w[a : a + 50])] != i:
                gone.update(range(a, a + 50))
        want.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in result(spark, folder, "op7_substring_dedup")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_op8(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, start, want = [], 0, []
    for r in rows_of(folder, "documents"):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        rows.append(((r["doc_id"] is None, r["doc_id"] or 0, np.array(ids, "<u2").tobytes()), ids))
    for (null, i, _), ids in sorted(rows):
        want.append((None if null else i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in result(spark, folder, "op8_token_planes")]
    assert sorted(got, key=lambda r: r[1]) == want


def test_op9(spark, folder):
    """Every piece is placed once, no bin is over-full, none holds a source or equal texts twice."""
    docs = [(r["doc_id"], r["source"], (r["text"] or "").encode().lower().split()) for r in rows_of(folder, "documents")]
    got = result(spark, folder, "op9_best_fit_packing")
    need = collections.Counter()
    for i, _, w in docs:
        need[i] += len(w) + 1
    have, bins = collections.Counter(), collections.defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_places
        bins[r.shard, r.bin].append(r)
    assert have == need
    once = {i: (s, tuple(w)) for i, s, w in docs if sum(i == j for j, *_ in docs) == 1}
    for held in bins.values():
        held.sort(key=lambda r: r.place)
        assert all(a.place + a.n_places == b.place for a, b in itertools.pairwise(held)) and held[-1].place + held[-1].n_places <= 2048
        known = [once[r.doc_id] for r in held if r.doc_id in once]
        sources = [s for s, _ in known if s is not None]
        assert len(sources) == len(set(sources)) and len({w for _, w in known}) == len(known)


def test_op10(spark, folder):
    rows = rows_of(folder, "embeddings")
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = collections.defaultdict(list)
    for r in result(spark, folder, "op10_nearest_neighbours"):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        best = [int(ids[k]) for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21)) and all(np.isclose(s, score[ids == v][0]) for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best))
    assert hits >= 0.9 * 20 * len(got)
