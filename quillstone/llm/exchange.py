"""Key exchange between buckets of documents.

Documents are dealt once, by a hash of their id, to buckets of a few MB of text. Facts about keys that many
documents may share (lines, word windows, shingles) are found in two further shuffles:

1. each bucket sends its *distinct* keys, packed as byte planes, one row for each range of the key space;
2. the task of a key range merges what all buckets sent and answers each bucket about its own keys.

A key in a third of all documents is thus one entry for each bucket, never a row for each document, so no key
makes a hot task; and nothing passes through the driver. Bucket and range counts follow the size of the input.

Each bucket writes at most ``COARSE`` rows, so rows grow with the input, not with its square. Where there are more ranges than that,
keys go on in a second hop: the rows of ``BLOCK`` buckets for one coarse range are merged and cut into its finer ranges, and
answers come back the same way. Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Bytes of text for one bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 96
#: Ranges that a bucket sends to, and buckets whose keys go on together, where ranges are more than that.
COARSE, BLOCK = 4096, 256
SENT = "part int, bucket int, n int, keys binary, more binary, extra binary"
ANSWER = "bucket int, part int, n int, keys binary, more binary, extra binary"


def pieces(df: DataFrame, size: int, least: int, text_col: str = "text") -> int:
    """How many pieces of about ``size`` bytes the texts make, ``least`` at least: counted, so that the rows alone decide."""
    total = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(least, min(1 << 24, -(-int(total) // size)))


def bucket_count(df: DataFrame, text_col: str = "text") -> int:
    """Follows the bytes of text, so that a bucket's stay bounded."""
    return pieces(df, BUCKET_BYTES, LEAST_BUCKETS, text_col)


def free(columns: list[str], name: str) -> str:
    """A name for a column of one's own beside these."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def dealt(df: DataFrame, buckets: int, *columns, id_col: str = "doc_id", text_col: str = "text", name: str = "bucket") -> DataFrame:
    """The named columns with a bucket number; rows of null id are dealt by their text."""
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col)))
    return df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(name), *columns)


def coarse(parts: int) -> int:
    """How many ranges buckets send to, for so many that are merged."""
    return min(parts, COARSE)


def send(bucket: int, keys: np.ndarray, parts: int, more: np.ndarray | None = None, extra: np.ndarray | None = None, bits: int = 64) -> pa.RecordBatch:
    """Rows for SENT. keys: ascending distinct 64-bit values, cut to ``bits``; more, extra: values beside each."""
    edges = np.searchsorted(keys, part_edges(parts))
    rows = {"part": [], "bucket": [], "n": [], "keys": [], "more": [], "extra": []}
    cut = keys >> np.uint64(64 - bits)
    for p in np.flatnonzero(np.diff(edges)):
        a, b = edges[p], edges[p + 1]
        rows["part"].append(int(p)), rows["bucket"].append(bucket), rows["n"].append(int(b - a))
        rows["keys"].append(B.pack_sorted(cut[a:b]))
        rows["more"].append(None if more is None else B.pack_ints(more[a:b]))
        rows["extra"].append(None if extra is None else B.pack_ints(extra[a:b]))
    return batch(rows, [("part", pa.int32()), *ANSWER_TYPES[:1], *ANSWER_TYPES[2:]])


ANSWER_TYPES = [("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("extra", pa.binary())]


def batch(rows: dict[str, list], types) -> pa.Table:
    return pa.table({k: pa.array(rows[k], t) for k, t in types})


def part_edges(parts: int) -> np.ndarray:
    """Where key ranges begin: ``parts + 1`` bounds, the last one left open."""
    return np.array([(p << 64) // parts for p in range(parts)] + [(1 << 64) - 1], np.uint64)


def merge(sent: DataFrame, reduce: Callable, parts: int = 1, bits: int = 64) -> DataFrame:
    """``reduce(keys, owner, more, extra)`` sees all keys of a range, one entry for each bucket and key, and the
    bucket of each; it returns a mask of entries to answer, and the values beside them (or None, twice). parts, bits: as sent."""
    if parts > COARSE:
        return _merge_in_two_hops(sent, reduce, parts, bits)

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        n = table["n"].to_numpy()
        keys, more, extra = _unpacked(table.to_pydict())
        keep, more, extra = reduce(keys, np.repeat(np.arange(len(n)), n), more, extra)
        out = {k: [] for k, _ in ANSWER_TYPES}
        edges = np.concatenate(([0], np.cumsum(n)))
        for i, b in enumerate(table["bucket"].to_pylist()):
            at = np.flatnonzero(keep[edges[i] : edges[i + 1]]) + edges[i]
            _add(out, b, part, keys, more, extra, at)
        return batch(out, ANSWER_TYPES)

    return sent.groupBy("part").applyInArrow(run, ANSWER)


def _unpacked(rows: dict[str, list]) -> tuple:
    """Keys and the values beside them (None where none were sent) of all rows, one row after another."""
    keys = np.concatenate([B.unpack_sorted(d, k) for d, k in zip(rows["keys"], rows["n"], strict=True)])
    return keys, *(None if rows[c][0] is None else np.concatenate([B.unpack_ints(d, k) for d, k in zip(rows[c], rows["n"], strict=True)]) for c in ("more", "extra"))


def _add(out: dict[str, list], bucket: int, part: int, keys: np.ndarray, more, extra, at: np.ndarray) -> None:
    if len(at):
        out["bucket"].append(bucket), out["part"].append(part), out["n"].append(len(at))
        out["keys"].append(B.pack_sorted(keys[at]))
        out["more"].append(None if more is None else B.pack_ints(more[at]))
        out["extra"].append(None if extra is None else B.pack_ints(extra[at]))


#: Between hops: a fine range's keys of a block of buckets, ascending, with the bucket of each.
BETWEEN_TYPES = [("fine", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("extra", pa.binary()), ("of", pa.binary())]
BETWEEN = "fine int, part int, block int, n int, keys binary, more binary, extra binary, of binary"


def _merge_in_two_hops(sent: DataFrame, reduce: Callable, parts: int, bits: int) -> DataFrame:
    edges = part_edges(parts) >> np.uint64(64 - bits)

    def ordered(table: pa.Table, keys: np.ndarray, more, extra, of: np.ndarray):
        """Rows by fine range of what is ordered by key."""
        part, block = table["part"][0].as_py(), table["block"][0].as_py()
        fine = np.searchsorted(edges, keys, "right") - 1
        out: dict[str, list] = {k: [] for k, _ in BETWEEN_TYPES}
        cuts = np.flatnonzero(np.concatenate(([True], fine[1:] != fine[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out["fine"].append(int(fine[a])), out["part"].append(part), out["block"].append(block), out["n"].append(b - a)
            out["keys"].append(B.pack_sorted(keys[a:b])), out["of"].append(B.pack_ints(of[a:b]))
            out["more"].append(None if more is None else B.pack_ints(more[a:b]))
            out["extra"].append(None if extra is None else B.pack_ints(extra[a:b]))
        return batch(out, BETWEEN_TYPES)

    def onward(table: pa.Table) -> pa.Table:
        keys, more, extra = _unpacked(table.to_pydict())
        of = np.repeat(table["bucket"].to_numpy().astype(np.uint64), table["n"].to_numpy())
        order = np.argsort(keys, kind="stable")
        return ordered(table, keys[order], *(None if x is None else x[order] for x in (more, extra)), of[order])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        keys, more, extra = _unpacked(rows)
        of = np.concatenate([B.unpack_ints(d, k) for d, k in zip(rows["of"], rows["n"], strict=True)])
        keep, more, extra = reduce(keys, of.astype(np.int64), more, extra)
        out: dict[str, list] = {k: [] for k, _ in BETWEEN_TYPES}
        at_row = np.concatenate(([0], np.cumsum(rows["n"])))
        for i, (part, block) in enumerate(zip(rows["part"], rows["block"], strict=True)):
            at = np.flatnonzero(keep[at_row[i] : at_row[i + 1]]) + at_row[i]
            if len(at):
                out["fine"].append(rows["fine"][i]), out["part"].append(part), out["block"].append(block), out["n"].append(len(at))
                out["keys"].append(B.pack_sorted(keys[at])), out["of"].append(B.pack_ints(of[at]))
                out["more"].append(None if more is None else B.pack_ints(more[at]))
                out["extra"].append(None if extra is None else B.pack_ints(extra[at]))
        return batch(out, BETWEEN_TYPES)

    def home(table: pa.Table) -> pa.Table:
        rows = table.sort_by("fine").to_pydict()
        keys, more, extra = _unpacked(rows)
        of = np.concatenate([B.unpack_ints(d, k) for d, k in zip(rows["of"], rows["n"], strict=True)])
        order = np.argsort(of, kind="stable")  # within a bucket keys stay in order
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(of[order]) != 0, [True])))
        out: dict[str, list] = {k: [] for k, _ in ANSWER_TYPES}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            _add(out, int(of[order[a]]), rows["part"][0], keys, more, extra, order[a:b])
        return batch(out, ANSWER_TYPES)

    blocks = sent.withColumn("block", F.floor(F.col("bucket") / BLOCK).cast("int"))
    between = blocks.groupBy("part", "block").applyInArrow(onward, BETWEEN)
    return between.groupBy("fine").applyInArrow(run, BETWEEN).groupBy("part", "block").applyInArrow(home, ANSWER)


def answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending keys that a bucket got answers for, and both values beside each (zeros where none were sent)."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "n", "keys", "more", "extra")), strict=True), key=lambda r: r[0])
    if not rows:
        return (np.zeros(0, np.uint64),) * 3
    keys = np.concatenate([B.unpack_sorted(r[2], r[1]) for r in rows])
    return keys, *(np.concatenate([np.zeros(r[1], np.uint64) if r[i] is None else B.unpack_ints(r[i], r[1]) for r in rows]) for i in (3, 4))


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands among the sorted ones; -1 if it doesn't."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == wanted, at, -1)


def by_key(keys: np.ndarray, low: np.ndarray, high: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the least ``low`` and largest ``high`` of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if not len(keys):
        return keys, low[:0], (low if high is None else high)[:0]
    return keys[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat((low if high is None else high)[order], first)


def groups(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A dense group number for each entry, equal for equal keys, and how many groups there are."""
    distinct, group = np.unique(keys, return_inverse=True)
    return group, len(distinct)
