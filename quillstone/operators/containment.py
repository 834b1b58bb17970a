"""Which texts hold which of many needles, by hashes of windows.

A sum of code points times powers gives the hash of any window of a text by one subtraction. A needle is known by the hash of its first
characters - as many as the largest class length within it - and by the hash of the whole. One pass over the texts looks up the
windows of each class length, and where one is met the whole, of whatever length; what is found leaves as its own text, which is then
joined with the needles, so hashes decide nothing alone. Texts are read once and never shuffled, and no needle goes through the driver
but as 24 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Lengths of beginnings that needles are known by; bits of the table that most windows are left out by; characters looked at at once.
CLASSES, BITS, CHUNK = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32], 22, 1 << 20
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Windows:
    """Hashes of the windows of a string."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * _powers(FACTOR, self.n), dtype=np.uint64)))
        self.back = _powers(INVERSE, self.n)

    def hashes(self, start: np.ndarray | slice, length: np.ndarray | int) -> np.ndarray:
        """Of windows from each start (a slice: from all of the first ones) of a length each."""
        if isinstance(start, slice):
            end, begin, back = self.sums[length:], self.sums[: self.n - length + 1], self.back[: self.n - length + 1]
        else:
            end, begin, back = self.sums[start + length], self.sums[start], self.back[start]
        with np.errstate(over="ignore"):
            h = (end - begin) * back
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return h ^ (h >> np.uint64(29))


def known_by(needle: str) -> tuple[int, int, int, int]:
    """Class length, hash of the beginning of this length, length and hash of the whole."""
    q = max(c for c in CLASSES if c <= len(needle))
    w, first = Windows(needle), np.zeros(1, np.int64)
    return q, int(w.hashes(first, q)[0]), len(needle), int(w.hashes(first, len(needle))[0])


class Needles:
    def __init__(self, q: np.ndarray, head: np.ndarray, length: np.ndarray, whole: np.ndarray):
        self.of = []
        for c in np.unique(q).tolist():
            own = np.flatnonzero(q == c)
            own = own[np.argsort(head[own], kind="stable")]
            seen = np.zeros(1 << BITS, bool)
            seen[head[own] >> np.uint64(64 - BITS)] = True
            self.of.append((c, seen, head[own], length[own].astype(np.int64), whole[own]))

    def found(self, texts: list[str]) -> list[set[str]]:
        """The needles that each text holds (and, rarely, other windows of equal hashes)."""
        out: list[set[str]] = [set() for _ in texts]
        i = 0
        while i < len(texts):
            j, size = i + 1, len(texts[i])
            while j < len(texts) and size + len(texts[j]) <= CHUNK:
                size, j = size + len(texts[j]), j + 1
            for k, a, n in self._found("".join(texts[i:j]), np.cumsum([0, *map(len, texts[i:j])])):
                out[i + k].add(texts[i + k][a : a + n])
            i = j
        return out

    def _found(self, text: str, offsets: np.ndarray):
        windows = Windows(text)
        for q, seen, head, length, whole in self.of:
            if windows.n < q:
                continue
            h = windows.hashes(slice(None), q)
            at = np.flatnonzero(seen[h >> np.uint64(64 - BITS)])
            a, b = np.searchsorted(head, h[at]), np.searchsorted(head, h[at], "right")
            at, a, n = at[b > a], a[b > a], (b - a)[b > a]
            entry = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + length[entry] <= offsets[doc + 1]
            at, entry, doc = at[inside], entry[inside], doc[inside]
            hit = windows.hashes(at, length[entry]) == whole[entry]
            at, entry, doc = at[hit], entry[hit], doc[hit]
            _, once = np.unique(np.stack([doc, entry]), axis=1, return_index=True) if len(at) else (None, [])
            yield from zip(doc[once].tolist(), (at - offsets[doc])[once].tolist(), length[entry[once]].tolist(), strict=True)


def containment(needles: DataFrame, hays: DataFrame, needle_id: str, needle: str, hay_id: str, hay: str, block_rows: int = 4_000_000) -> DataFrame:
    """``(hay_id, needle_id)`` where the normalised hay holds the normalised needle, forgiving punctuation at the needle's ends; a needle
    that is nothing but that is in every text. Up to ``block_rows`` different needles are looked up in one pass over the hays, more in
    several."""
    spark = hays.sparkSession
    wanted = needles.select(F.col(needle_id).alias("nid"), X.edge_strip(X.norm(needle)).alias("nn"))
    docs = hays.select(F.col(hay_id).alias("hid"), X.norm(hay).alias("hn"))

    def describe(batches):
        for b in batches:
            rows = [known_by(t) for t in b["nn"].to_pylist()]
            columns = [np.array([r[k] for r in rows], np.uint64).view(np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "head", "length", "whole"])

    described = wanted.select("nn").where("nn <> ''").distinct().mapInArrow(describe, "q long, head long, length long, whole long")
    known = described.toArrow()  # 32 bytes a needle
    columns = [known[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("q", "head", "length", "whole")]
    empty = not wanted.where("nn = ''").isEmpty()
    schema = T.StructType([docs.schema["hid"], T.StructField("nn", T.StringType())])

    def looked_up(shared, empty: bool) -> DataFrame:
        def run(batches):
            for b in batches:
                held = [sorted(x | {""} if empty else x) for x in shared.value.found(b["hn"].to_pylist())]
                hid = b["hid"].take(pa.array([k for k, x in enumerate(held) for _ in x], pa.int64()))
                yield pa.RecordBatch.from_arrays([hid, pa.array([t for x in held for t in x], pa.string())], ["hid", "nn"])

        return docs.mapInArrow(run, schema)

    found = None
    for a in range(0, max(1, len(known)), block_rows):
        part = looked_up(spark.sparkContext.broadcast(Needles(*(c[a : a + block_rows] for c in columns))), empty and not a)
        found = part if found is None else found.unionByName(part)
    return found.join(wanted, "nn").select(F.col("hid").alias(hay_id), F.col("nid").alias(needle_id)).distinct()
