"""Substring deduplication by fixed-block anchors.

Every document is cut into non-overlapping blocks of ``window // 2`` words: the index. Any run of ``window`` words holds a
whole block of the document it was indexed from, so every repeat is hit when each rolling window of block size probes the
index. A hit is then extended: around it, runs of ``window`` words are compared by 96-bit fingerprints with those around
the hits in all other documents, run by run, so that what is removed is the union of these runs - the maximal exact repeats.

Three passes over bucketed texts, two key exchanges (see ``exchange``); the texts are shuffled once.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; repeats within one
document stay; rows of one id don't take words from each other; a null id comes after all others; an empty table gives an
empty table; other columns pass through, except that ``n_words`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import exchange as X


def _scan(table: pa.Table, text_col: str, id_col: str):
    """Row ranges of bounded size, with words and their hashes: (rows, raw, first_word, starts, ends, hashes, ids)."""
    raw, offsets = B.text_bytes(table[text_col])
    ids = B.ordered_ids(table[id_col])
    for i, j in B.chunks(offsets):
        part = raw[offsets[i] : offsets[j]]
        starts, ends, first_word = B.word_spans(part, offsets[i : j + 1] - offsets[i])
        yield (i, j), part, first_word, starts, ends, B.span_hashes(part, starts, ends), ids[i:j]


def _owners(first_word: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ids[np.searchsorted(first_word, at, "right") - 1]


def _covering(first_word: np.ndarray, hits: np.ndarray, block: int, window: int) -> np.ndarray:
    """Starts of runs of ``window`` words within one document that hold a whole hit block."""
    total = int(first_word[-1])
    if total < window or not len(hits):
        return np.zeros(0, np.int64)
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, np.maximum(hits - (window - block), 0), 1)
    np.add.at(step, hits + 1, -1)
    covered = np.cumsum(step[: total - window + 1]) > 0
    return np.flatnonzero(covered & B.inside_one(first_word, window))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``docs`` with the words covered by a run of ``window`` words that also starts in a document of smaller id removed;
    the words kept are joined by one space. Adds ``n_words`` (before) and ``n_removed``."""
    block = window // 2
    buckets = X.bucket_count(docs, text_col)
    parts = max(1, buckets // 2)
    coarse = X.coarse(parts)
    bits = min(64, 33 + max(1, (parts - 1).bit_length()))  # of a probe: false hits cost time, not results
    keep = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    own = X.free(docs.columns, "__bucket")
    dealt = X.dealt(docs, buckets, *[F.col(f"`{c}`") for c in keep], id_col=id_col, text_col=text_col, name=own)

    def probes(table: pa.Table) -> pa.Table:
        keys, marks = [], []  # per distinct rolling window: indexed somewhere, in several documents
        lo = []
        for _, _, first_word, _, _, h, ids in _scan(table, text_col, id_col):
            fine = np.flatnonzero(B.inside_one(first_word, block))
            doc = np.searchsorted(first_word, fine, "right") - 1
            keys.append(B.windows(h, block)[fine]), marks.append((fine - first_word[doc]) % block == 0)
            lo.append(ids[doc])
        none = np.zeros(0, np.uint64)
        keys, marks, ids = (np.concatenate([none.astype(bool) if x is marks else none, *x]) for x in (keys, marks, lo))
        order = np.argsort(keys)
        keys, marks, ids = keys[order], marks[order], ids[order]
        if not len(keys):
            return X.send(0, keys, coarse)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        flags = np.logical_or.reduceat(marks, first) + 2 * several.astype(np.uint64)
        return X.send(table[own][0].as_py(), keys[first], coarse, flags, bits=bits)

    def shared(keys: np.ndarray, owner: np.ndarray, flags: np.ndarray, _):
        group, n = X.groups(keys)
        indexed, several, one, other = (np.zeros(n, bool) for _ in range(4))
        indexed[group[(flags & np.uint64(1)) > 0]] = True
        several[group[flags >= 2]] = True
        last = np.full(n, -1)
        last[group] = owner
        other[group[last[group] != owner]] = True
        return (indexed & (several | other))[group], None, None

    def runs(table: pa.Table, back: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint64)
        keys, check, docs_ = [none], [none], [none]
        found = X.answered(back)[0]
        if len(found) and table.num_rows:
            for _, _, first_word, _, _, h, ids in _scan(table, text_col, id_col):
                cut = B.windows(h, block) >> np.uint64(64 - bits)
                at = _covering(first_word, np.flatnonzero((X.find(found, cut) >= 0) & B.inside_one(first_word, block)), block, window)
                if len(at):
                    keys.append(B.windows(h, window)[at]), docs_.append(_owners(first_word, ids, at))
                    check.append(B.windows(B.mix(h, 1), window, B.WORD_MUL2)[at] >> np.uint64(32))
        keys, check, ids = np.concatenate(keys), np.concatenate(check), np.concatenate(docs_)
        order = np.argsort(keys)
        keys, check, ids = keys[order], check[order], ids[order]
        if not len(keys):
            return X.send(0, keys, coarse)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        least, most = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
        return X.send(table[own][0].as_py(), keys[first], coarse, least, check[first] << np.uint64(1) | (least != most).astype(np.uint64))

    def owned(keys: np.ndarray, owner: np.ndarray, least: np.ndarray, extra: np.ndarray):
        check = extra >> np.uint64(1)
        order = np.lexsort((check, keys))
        k, c = keys[order], check[order]
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))
        holder = np.empty_like(least)
        holder[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(k))))
        return (holder < least) | (extra & np.uint64(1) > 0), holder, None

    fields = [docs.schema[c] if c != text_col else T.StructField(c, T.StringType()) for c in keep]
    out = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], pa.string() if f.name == text_col else table.schema.field(f.name).type if f.name in keep else pa.int64()) for f in out})
        found, holder, _ = X.answered(back)
        texts, n_words, n_removed = [], [], []
        for (i, j), part, first_word, starts, ends, h, ids in _scan(table, text_col, id_col):
            gone = np.zeros(len(starts), bool)
            if len(found) and len(h) >= window:
                at = X.find(found, B.windows(h, window))
                pos = np.flatnonzero((at >= 0) & B.inside_one(first_word, window))
                pos = pos[holder[at[pos]] < _owners(first_word, ids, pos)]
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, pos, 1)
                np.add.at(step, pos + window, -1)
                gone = np.cumsum(step[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            n_words.append(np.diff(first_word)), n_removed.append(total[first_word[1:]] - total[first_word[:-1]])
            data = part.tobytes()
            starts, ends = starts.tolist(), ends.tolist()
            for r in range(j - i):
                a, b = int(first_word[r]), int(first_word[r + 1])
                if a == b:
                    texts.append(b"")
                elif n_removed[-1][r]:
                    texts.append(b" ".join([data[starts[x] : ends[x]] for x in (np.flatnonzero(~gone[a:b]) + a).tolist()]))
                else:
                    texts.append(b" ".join(data[starts[a] : ends[b - 1]].split()))
        new = {c: table[c] for c in keep} | {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(np.concatenate(n_words), pa.int64()), "n_removed": pa.array(np.concatenate(n_removed), pa.int64())}
        return pa.table(new)

    texts = dealt
    hits = X.merge(texts.groupBy(own).applyInArrow(probes, X.SENT), shared, parts, bits)
    held = X.merge(texts.groupBy(own).cogroup(hits.groupBy("bucket")).applyInArrow(runs, X.SENT), owned, parts)
    return dealt.groupBy(own).cogroup(held.groupBy("bucket")).applyInArrow(cut, out)
