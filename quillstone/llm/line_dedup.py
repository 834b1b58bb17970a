"""Line deduplication: lines that several documents hold stay only in the first of these documents.

A line's key is the line without white space (``[\\x20\\x09-\\x0D]``) at either end, A-Z in lower case. Each bucket of
documents sends its distinct keys as 96-bit hashes with the number of documents holding each; the merged counts
come back, and each bucket reassembles its texts from the lines that stay, by position.

Defined results: null and empty texts are one empty line; keys under ``min_chars`` code points never go; rows with one
id count as one document; a null id comes after all others; an empty table gives an empty table; other columns pass
through, except that columns named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import exchange as X


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _lines(texts: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, list[list[bytes]], np.ndarray]:
    """For each line with a key: two hashes; the lines of each document; where in all lines the keyed ones stand."""
    split, low, check, at, n = [], [], [], [], 0
    digest = xxhash.xxh3_128_intdigest
    for text in texts:
        split.append(lines := text.split(b"\n"))
        for line in lines:
            key = line.strip().lower()
            if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                h = digest(key)
                low.append(h & 0xFFFFFFFFFFFFFFFF), check.append(h >> 96), at.append(n)
            n += 1
    return np.array(low, np.uint64), np.array(check, np.uint64), split, np.array(at, np.int64)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """``docs`` with the text less the lines held by ``min_docs`` documents or more, except in the document of least id
    among them; with ``n_lines`` (before) and ``n_dropped``."""
    buckets = X.bucket_count(docs, text_col)
    parts = buckets // 2
    coarse = X.coarse(parts)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    own = X.free(docs.columns, "__bucket")
    dealt = X.dealt(docs, buckets, *[F.col(f"`{c}`") for c in keep], id_col=id_col, text_col=text_col, name=own)

    def keys(table: pa.Table) -> pa.Table:
        bucket = table[own][0].as_py()
        low, check, split, at = _lines(_texts(table[text_col]), min_chars)
        counts = np.array([len(x) for x in split])
        ids = np.repeat(B.ordered_ids(table[id_col]), counts)[at]
        order = np.lexsort((ids, low))
        low, check, ids = low[order], check[order], ids[order]
        new_key = np.concatenate(([True], low[1:] != low[:-1])) if len(low) else np.zeros(0, bool)
        new_doc = new_key | np.concatenate(([True], ids[1:] != ids[:-1])) if len(low) else new_key
        first = np.flatnonzero(new_key)
        n_docs = np.add.reduceat(new_doc.astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
        return X.send(bucket, low[first], coarse, ids[first], n_docs << np.uint64(32) | check[first])

    def reduce(keys: np.ndarray, owner: np.ndarray, least: np.ndarray, extra: np.ndarray):
        order = np.lexsort((extra & np.uint64(0xFFFFFFFF), keys))
        k, c = keys[order], (extra & np.uint64(0xFFFFFFFF))[order]
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))))
        group = np.empty(len(keys), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        held = extra >> np.uint64(32)
        total = np.add.reduceat(held[order], first)[group]
        holder = np.minimum.reduceat(least[order], first)[group]
        return (total >= min_docs) & ~((held == 1) & (least == holder)), holder, None

    out_fields = [docs.schema[c] if c != text_col else T.StructField(c, T.StringType()) for c in keep]
    out = T.StructType([*out_fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def drop(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], pa.string() if f.name == text_col else table.schema.field(f.name).type if f.name in keep else pa.int64()) for f in out})
        found, holder, _ = X.answered(back)
        low, _, split, at = _lines(_texts(table[text_col]), min_chars)
        counts = np.array([len(x) for x in split])
        gone = np.zeros(int(counts.sum()), bool)
        i = X.find(found, low)
        hit = i >= 0
        ids = np.repeat(B.ordered_ids(table[id_col]), counts)
        gone[at[hit]] = holder[i[hit]] != ids[at[hit]]
        edges = np.concatenate(([0], np.cumsum(counts)))
        dropped = np.add.reduceat(gone.astype(np.int64), edges[:-1])
        texts = []
        for lines, n, a in zip(split, dropped, edges[:-1], strict=True):
            texts.append(b"\n".join(lines if not n else [x for x, g in zip(lines, gone[a : a + len(lines)], strict=True) if not g]))
        new = {c: table[c] for c in keep} | {text_col: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
        return pa.table(new)

    sent = dealt.groupBy(own).applyInArrow(keys, X.SENT)
    back = X.merge(sent, reduce, parts)
    return dealt.groupBy(own).cogroup(back.groupBy("bucket")).applyInArrow(drop, out)
