"""Toxicity by class-conditional Kneser-Ney models.

A word is two units, its first ``HEAD`` bytes and the rest, so that a rare word is judged by the words it begins like. Each class c
has a model of them by absolute discounts, from numbers n of texts (a text counts a word once), and what the discounts free
goes to counts that both classes share:

    P_c(head)        = (max(n_c(head) - D, 0) + freed_c * S(head)) / n_c
    P_c(rest | head) = (max(n_c(word) - D, 0) + freed_c(head) * S(rest | head)) / n_c(head)

S(head) is Kneser-Ney's continuation count, the share of all different words that begin so, and S(rest | head) the share of the word
among both classes' counts of its head. A word of at most D texts in either class thus has the share of its head that the class
keeps for rare words, whichever word it is, so that such words need not be stored; a head that no training text holds has what the
class keeps for these. Every word of a text has a likelihood in both classes. A text's score is a logistic function of the
difference of its two log-likelihoods, normalised by length, over all of it, over its worst expression of ``SPAN`` words and over its worst
word; the weights are fitted on texts that the counts they are fitted with were not taken from.

Counts cover every labelled training text. They are merged in a shuffle of packed distinct words (see ``exchange``); the tables of
key ranges stay distributed. A task sends ``exchange.COARSE`` rows at most; beyond so many ranges counts and questions take a second
hop, merged by blocks of tasks. Up to ``MODEL_BYTES`` of them are broadcast; beyond, the texts' distinct words are sent to the
tables and the answers back, with the same scores. Keys are hashes, 32 bits of the head and 32 of the rest.

Defined results: null and empty texts have no words and get the score of that; rows without a label don't train; of several
labels for one id the largest counts; without training rows of both classes every score is 0; other columns pass through,
except that ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks as B
from . import exchange as X
from .components import cut

#: Bytes of a head; texts that a count is discounted by; words of an expression.
HEAD, DISCOUNT, SPAN = 5, 3, 8
#: Labelled texts that the logistic weights are fitted on, at most (those of least hash), and bytes of tables that are broadcast at most.
FIT_ROWS, MODEL_BYTES = 20_000, 128 << 20
SEPARATES = B.IS_SPACE.copy()
SEPARATES[[ord(c) for c in ".,;:!?()[]{}<>\"'|/\\*_"]] = True
EMPTY_REST = np.uint64(0x5851F42D4C957F2D)


def units(table_column):
    """Batches of (first_word of each row, hash of each word's head, hash of its rest)."""
    raw, offsets = B.text_bytes(table_column)
    for i, j in B.chunks(offsets):
        part = B.LOWER[raw[offsets[i] : offsets[j]]]
        part = np.where(SEPARATES[part], np.uint8(32), part)
        starts, ends, first = B.word_spans(part, offsets[i : j + 1] - offsets[i])
        split = np.minimum(starts + HEAD, ends)
        rest = np.full(len(starts), EMPTY_REST)
        long_ = np.flatnonzero(split < ends)
        rest[long_] = B.span_hashes(part, split[long_], ends[long_])
        yield first, B.span_hashes(part, starts, split), rest


def _word_key(head: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (head >> np.uint64(32) << np.uint64(32)) | (rest >> np.uint64(32))


def _pack_counts(batches):
    """(ascending word keys, counts of fold 0, counts of fold 1): ordinary in the low 32 bits, toxic in the high ones."""
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
    for batch in batches:
        kind = (2 * batch["fold"].to_numpy(zero_copy_only=False) + batch["toxic"].to_numpy(zero_copy_only=False)).astype(np.int64)
        own, at = [keys], 0
        new = [counts]
        for first, head, rest in units(batch["text"]):
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            key = _word_key(head, rest)
            with np.errstate(over="ignore"):  # a text counts each word once, or repetition within it would pass for evidence
                once = np.unique(B.mix(key + B.mix(doc.astype(np.uint64), 2)), return_index=True)[1]
            k = kind[at : at + len(n)][doc[once]]
            at += len(n)
            key, group = np.unique(key[once], return_inverse=True)
            own.append(key), new.append(np.bincount(group * 4 + k, minlength=4 * len(key)).reshape(-1, 4))
        keys, group = np.unique(np.concatenate(own), return_inverse=True)
        total = np.zeros((len(keys), 4), np.int64)
        np.add.at(total, group, np.concatenate(new))
        counts = total
    ordinary, toxic = counts[:, ::2].astype(np.uint64), counts[:, 1::2].astype(np.uint64)
    both = ordinary | toxic << np.uint64(32)
    return keys, both[:, 0], both[:, 1]


def _counter(parts: int):
    coarse = X.coarse(parts)

    def run(batches):
        keys, *counts = _pack_counts(batches)
        yield from X.send(TaskContext.get().partitionId(), keys, coarse, *counts).to_batches()

    return run


def _blocks(sent: DataFrame) -> DataFrame:
    return sent.withColumn("block", F.floor(F.col("bucket") / X.BLOCK).cast("int"))


def _onward(sent: DataFrame, parts: int) -> DataFrame:
    """What buckets sent to coarse ranges, to the ranges themselves: a block of buckets is merged, its counts added up (keys alone: each
    once), so that a block sends what a bucket would. ``bucket`` is the block then."""
    if parts <= X.COARSE:
        return sent

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        keys, group = np.unique(np.concatenate([B.unpack_sorted(d, n) for d, n in zip(rows["keys"], rows["n"], strict=True)]), return_inverse=True)
        counts = []
        for c in ("more", "extra"):
            if rows[c][0] is None:
                counts.append(None)
                continue
            packed = np.concatenate([B.unpack_ints(d, n) for d, n in zip(rows[c], rows["n"], strict=True)])
            total = np.zeros(len(keys), np.uint64)
            np.add.at(total, group, packed)  # both halves at once: neither passes 32 bits
            counts.append(total)
        return X.send(rows["block"][0], keys, parts, *counts)

    return _blocks(sent).groupBy("part", "block").applyInArrow(run, X.SENT)


def _homeward(asked: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Answers to blocks of buckets, to each bucket what it asked."""
    if parts <= X.COARSE:
        return answers

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        keys, bits, _ = X.answered(told)
        rows = {k: [] for k, _ in X.ANSWER_TYPES}
        for r in own.to_pylist():
            mine = B.unpack_sorted(r["keys"], r["n"])
            for k, x in zip(rows, (r["bucket"], r["part"], r["n"], r["keys"], B.pack_ints(bits[np.searchsorted(keys, mine)]), None), strict=True):
                rows[k].append(x)
        return X.batch(rows, X.ANSWER_TYPES)

    coarse = answers.withColumn("coarse", F.floor(F.col("part") * X.coarse(parts) / parts).cast("int"))
    return _blocks(asked).groupBy("part", "block").cogroup(coarse.groupBy("coarse", "bucket")).applyInArrow(run, X.ANSWER)


#: One row for each key range. heads, words: packed ascending keys; of_heads, of_words: float32 tables, see ``_tables``; totals: of
#: fold 0, then of all texts, ordinary and toxic: counts of heads, what discounts free of them; and different words.
TABLES = "part int, n_heads int, heads binary, of_heads binary, n_words int, words binary, of_words binary, totals array<double>"
TABLES_ARROW = pa.schema([("part", pa.int32()), ("n_heads", pa.int32()), ("heads", pa.binary()), ("of_heads", pa.binary()), ("n_words", pa.int32()), ("words", pa.binary()), ("of_words", pa.binary()), ("totals", pa.list_(pa.float64()))])


def _kept(n: np.ndarray) -> np.ndarray:
    return np.maximum(n - DISCOUNT, 0)


def _tables(table: pa.Table) -> pa.Table:
    """The counts of one key range, that is of all words of its heads. For fold 0, then for all texts - of a head: ordinary and toxic
    count, different words, log ratio of what it keeps for rare words; of a word that has more than the discount in a class: log
    ratio of its share of the head."""
    rows = table.to_pydict()
    keys = np.concatenate([B.unpack_sorted(d, n) for d, n in zip(rows["keys"], rows["n"], strict=True)])
    packed = [np.concatenate([B.unpack_ints(d, n) for d, n in zip(rows[k], rows["n"], strict=True)]) for k in ("more", "extra")]
    four = np.stack([x >> np.uint64(32 * k) & np.uint64(0xFFFFFFFF) for x in packed for k in range(2)], 1).astype(np.int64)
    keys, group = np.unique(keys, return_inverse=True)
    c = np.stack([np.bincount(group, four[:, k], len(keys)) for k in range(4)], 1)
    heads, head = np.unique(keys >> np.uint64(32), return_inverse=True)
    of_heads, of_words, totals, stored = [], [], [], np.zeros(len(keys), bool)
    for own in (c[:, :2], c[:, :2] + c[:, 2:]):
        of_head, free = (np.stack([np.bincount(head, x[:, k], len(heads)) for k in range(2)], 1) for x in (own, own - _kept(own)))
        words = np.bincount(head, own.sum(1) > 0, len(heads))
        share = np.where(of_head > 0, free / np.maximum(of_head, 1), 1.0)
        rare = np.log(share[:, 1]) - np.log(share[:, 0])
        both = (own.sum(1) / np.maximum(of_head.sum(1)[head], 1))[:, None]
        p = np.where(of_head[head] > 0, (_kept(own) + free[head] * both) / np.maximum(of_head[head], 1), both)
        rich = (own > DISCOUNT).any(1)
        of_heads += [*of_head.T, words, rare]
        of_words.append(np.where(rich, np.log(np.maximum(p[:, 1], 1e-300)) - np.log(np.maximum(p[:, 0], 1e-300)), rare[head]))
        stored |= rich
        totals += [*of_head.sum(0), *(of_head - _kept(of_head)).sum(0), words.sum()]
    at = np.flatnonzero(stored)
    pack = lambda columns: np.stack(columns, 1).astype(np.float32).tobytes()
    row = [rows["part"][0], len(heads), B.pack_sorted(heads), pack(of_heads), len(at), B.pack_sorted(keys[at]), pack([x[at] for x in of_words]), totals]
    return pa.table([pa.array([x], f.type) for x, f in zip(row, TABLES_ARROW, strict=True)], schema=TABLES_ARROW)


class Model:
    """The log of the toxic over the ordinary likelihood of words, from tables of key ranges in order and the totals of all ranges;
    ``of``: by the counts of fold 0 alone (0) or of all training texts (1)."""

    def __init__(self, ranges: list[dict], totals: np.ndarray):
        join = lambda arrays, kind: np.concatenate([np.zeros(0, kind), *arrays])
        self.heads = join([B.unpack_sorted(r["heads"], r["n_heads"]) for r in ranges], np.uint64)
        self.words = join([B.unpack_sorted(r["words"], r["n_words"]) for r in ranges], np.uint64)
        v = join([np.frombuffer(r["of_heads"], np.float32) for r in ranges], np.float32).reshape(-1, 8).astype(float)
        of_words = join([np.frombuffer(r["of_words"], np.float32) for r in ranges], np.float32).reshape(-1, 2).astype(float)
        self.of_heads, self.of_words, self.new = np.zeros((len(v), 2)), np.zeros(of_words.shape), np.zeros(2)
        of = np.searchsorted(self.heads, self.words >> np.uint64(32))
        for i in (0, 1):
            n, free, words = (np.asarray(x) for x in (totals[5 * i : 5 * i + 2], totals[5 * i + 2 : 5 * i + 4], totals[5 * i + 4]))
            own, shared, rare = v[:, 4 * i : 4 * i + 2], v[:, 4 * i + 2] / max(words, 1), v[:, 4 * i + 3]
            if n.min() > 0:
                self.new[i] = np.log(free[1] / n[1]) - np.log(free[0] / n[0])
                p = (_kept(own) + free * shared[:, None]) / n
                ratio = np.where(own.sum(1) > 0, np.log(np.maximum(p[:, 1], 1e-300)) - np.log(np.maximum(p[:, 0], 1e-300)), self.new[i])
                self.of_heads[:, i] = ratio + rare
                self.of_words[:, i] = ratio[of] + of_words[:, i]

    def gains(self, key: np.ndarray, of: int) -> np.ndarray:
        """For each word key, in float32."""
        out = np.full(len(key), self.new[of], np.float32)
        at = X.find(self.words, key)
        held = at >= 0
        out[held] = self.of_words[at[held], of]
        rest = np.flatnonzero(~held)
        at = X.find(self.heads, key[rest] >> np.uint64(32))
        out[rest[at >= 0]] = self.of_heads[at[at >= 0], of]
        return out


def judged(column, gains) -> tuple[np.ndarray, ...]:
    """For each text: sum of the gains of its words, number of words, the largest gain of a word and the largest mean gain of ``SPAN``
    words in a row (of all, in a shorter text)."""
    out: list[list[np.ndarray]] = [[np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
    for first, head, rest in units(column):
        gain = gains(_word_key(head, rest)).astype(float)
        total, n = np.concatenate(([0.0], np.cumsum(gain))), np.diff(first)
        has, sums = np.flatnonzero(n), total[first[1:]] - total[first[:-1]]
        word, span = np.zeros(len(n)), sums / SPAN
        if len(has):
            word[has] = np.maximum.reduceat(gain, first[has])
            means = np.full(len(gain), -np.inf)
            means[: max(0, len(gain) - SPAN + 1)] = (total[SPAN:] - total[:-SPAN]) / SPAN
            means[: max(0, len(gain) - SPAN + 1)][~B.inside_one(first, SPAN)] = -np.inf
            long_ = has[n[has] >= SPAN]
            span[long_] = np.maximum.reduceat(means, first[has])[n[has] >= SPAN]
        for x, y in zip(out, (sums, n, word, span), strict=True):
            x.append(y)
    return tuple(map(np.concatenate, out))


def features(total: np.ndarray, n: np.ndarray, word: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Constant; the difference of log-likelihoods normalised by the length, by its root, in the worst expression and the worst
    word; log length."""
    m = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), total / m, total / np.sqrt(m) / 10, span, word / 4, np.log1p(n) / 10], 1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Trained:
    """Tables of key ranges, a broadcast model of them where they are small (or None), weights."""

    def __init__(self, tables: DataFrame, totals: np.ndarray, parts: int, shared, weights: np.ndarray):
        self.tables, self.totals, self.parts, self.shared, self.weights = tables, totals, parts, shared, weights


def train(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Trained | None:
    """A model of the labelled texts and the weights of its score, or None without texts of both classes. fold: 0 and 1 part the
    training texts for fitting the weights; where it is null a row trains nothing."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    marks = marks.withColumn("fold", fold).where("fold IS NOT NULL AND toxic IN (0, 1)")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.withColumn("fold_", fold).where("fold_ IS NOT NULL").drop("fold_").join(marks.hint("merge"), "id")  # one plan at every size
    parts = 1 << max(3, (X.bucket_count(docs, text_col) // 4 - 1).bit_length())  # a power of two: no range ends within a head
    sent = rows.select("fold", "toxic", "text").mapInArrow(_counter(parts), X.SENT)
    tables = cut(_onward(sent, parts).groupBy("part").applyInArrow(_tables, TABLES))
    size = lambda c: F.sum(F.octet_length(c))
    got = tables.select(*[F.sum(F.col("totals")[k]).alias(f"t{k}") for k in range(10)], (size("heads") + size("words") + size("of_heads") + size("of_words")).alias("size")).first()
    totals = np.array([got[f"t{k}"] or 0.0 for k in range(10)])
    if min(totals[0], totals[1]) <= 0:
        return None
    shared = None
    if got["size"] <= MODEL_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast(Model(sorted(tables.toArrow().to_pylist(), key=lambda r: r["part"]), totals))
    trained = Trained(tables, totals, parts, shared, None)
    some = marks.where("fold = 1").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("id", "toxic")
    fitted = texts.join(F.broadcast(some), "id")  # FIT_ROWS rows at most
    out = "__sum double, __n long, __word double, __span double"
    got = _scored(fitted, trained, "text", "id", 0, lambda *x: x, out).select("toxic", "__sum", "__n", "__word", "__span")
    got = got.orderBy(F.xxhash64("__sum", "__n"), "__sum", "__n", "__word", "__span", "toxic").limit(FIT_ROWS).toArrow()
    y = got["toxic"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    trained.weights = fit(features(*(got[c].to_numpy() for c in ("__sum", "__n", "__word", "__span"))), y)
    return trained


def _scored(docs: DataFrame, trained: Trained, text_col: str, id_col: str, of: int, finish, new: str) -> DataFrame:
    """``docs`` with new columns: ``finish`` of what is judged of each text."""
    fields = T._parse_datatype_string(new).fields
    keep = [c for c in docs.columns if c not in [f.name for f in fields]]
    schema = T.StructType([*[docs.schema[c] for c in keep], *fields])
    columns = [F.col(f"`{c}`") for c in keep]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    shared, totals, parts, coarse = trained.shared, trained.totals, trained.parts, X.coarse(trained.parts)

    def with_new(b, gains):
        found = finish(*judged(b[text_col], gains))
        return [*[b[c] for c in keep], *[pa.array(x, k) for x, k in zip(found, kinds, strict=True)]], [*keep, *[f.name for f in fields]]

    if shared is not None:

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays(*with_new(b, lambda key: shared.value.gains(key, of)))

        return docs.select(*columns).mapInArrow(run, schema)

    def ask(table: pa.Table) -> pa.Table:
        keys = [np.unique(_word_key(head, rest)) for _, head, rest in units(table[text_col])]
        return X.send(table[own][0].as_py(), np.unique(np.concatenate([np.zeros(0, np.uint64), *keys])), coarse)

    def answer(stored: pa.Table, asked: pa.Table) -> pa.Table:
        model, rows = Model(stored.to_pylist(), totals), {k: [] for k, _ in X.ANSWER_TYPES}
        for r in asked.to_pylist():
            gain = model.gains(B.unpack_sorted(r["keys"], r["n"]), of)
            for k, x in zip(rows, (r["bucket"], r["part"], r["n"], r["keys"], B.pack_ints(gain.view(np.uint32).astype(np.uint64)), None), strict=True):
                rows[k].append(x)
        return X.batch(rows, X.ANSWER_TYPES)

    def back(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, bits, _ = X.answered(answers)
        gain = bits.astype(np.uint32).view(np.float32)
        arrays, names = with_new(table, lambda key: gain[np.searchsorted(keys, key)])
        return pa.table(dict(zip(names, arrays, strict=True)))

    own = X.free(docs.columns, "__bucket")
    dealt = X.dealt(docs, X.bucket_count(docs, text_col), *columns, id_col=id_col, text_col=text_col, name=own)
    asked = dealt.groupBy(own).applyInArrow(ask, X.SENT)
    if parts > X.COARSE:
        asked = cut(asked)  # read twice, on the way there and back
    answers = trained.tables.groupBy("part").cogroup(_onward(asked, parts).groupBy("part")).applyInArrow(answer, X.ANSWER)
    return dealt.groupBy(own).cogroup(_homeward(asked, answers, parts).groupBy("bucket")).applyInArrow(back, schema)


def score_toxicity(docs: DataFrame, trained: Trained | None, text_col: str = "text", threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    if trained is None:
        return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")], F.lit(0.0).alias("score"), F.lit(int(threshold <= 0)).alias("predicted"))

    weights = trained.weights

    def finish(*found):
        score = 1 / (1 + np.exp(-np.clip(features(*found) @ weights, -30, 30)))
        return score, (score >= threshold).astype(np.int32)

    return _scored(docs, trained, text_col, id_col, 1, finish, "score double, predicted int")
