"""Best-fit packing of texts into bins of fixed size, under conflicts.

A text of n words takes n + 1 places (one for its end); a longer text than a bin is cut into pieces of a bin's size. Bins are
ordered by what is left in them, and each carries a bitmap of the sources and duplicate clusters it holds: a bin takes a
source once and a cluster once. A piece goes to the tightest bin that it fits in and doesn't conflict with: the search goes on to the
successor until one is compatible, or a new bin is opened. Pieces come longest first.

The successor search is a tree over residuals whose nodes carry the bits that *all* bins below have, so residuals at which every
bin conflicts are stepped over at once, and a source with a third of all texts costs no scan.

Texts are dealt to shards by a hash of their id; a shard of bounded input is packed by one task, so sources and copies of any
frequency are spread over all shards. Only (id, source, length, cluster) is shuffled.

Defined results: null and empty texts take one place; a null source conflicts with nothing; rows of one id are packed each, as
one cluster if their words are equal; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X

SHARD_BYTES, LEAST_SHARDS = 48 << 20, 16
OUT = "doc_id long, piece int, n_pieces int, first_word long, n_places int, shard int, bin int, place int"


class Bins:
    """Open bins by residual; ``tree[i]`` has the bits common to all bins below node i (all bits where there are none)."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 1
        while self.size <= capacity:
            self.size *= 2
        self.tree = [-1] * (2 * self.size)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.residual: list[int] = []

    def _update(self, r: int) -> None:
        common = -1
        for bits in self.at[r]:
            common &= bits
        i = self.size + r
        tree = self.tree
        tree[i] = common
        i //= 2
        while i:
            new = tree[2 * i] & tree[2 * i + 1]
            if tree[i] == new:
                break
            tree[i] = new
            i //= 2

    def _successor(self, r: int, a: int, b: int) -> int | None:
        """The least residual from r on where neither bit a nor bit b is in all bins (0: no such bit)."""
        if r > self.capacity:
            return None
        tree, i = self.tree, self.size + r
        while True:
            common = tree[i]
            if common != -1 and not common & a and not common & b:
                if i >= self.size:
                    return i - self.size
                i *= 2
            else:  # on to what follows this subtree
                while i & 1:
                    i //= 2
                if not i:
                    return None
                i += 1

    def put(self, length: int, a: int, b: int) -> tuple[int, int]:
        """(bin, place) of a piece with source bit a and cluster bit b."""
        mask, r = a | b, length
        while True:
            r = self._successor(r, a, b)
            if r is None or r > self.capacity:
                bin_, r, bits = len(self.residual), self.capacity, 0
                self.residual.append(r)
                break
            found = [(bins[-1], bits) for bits, bins in self.at[r].items() if not bits & mask]
            if found:
                bin_, bits = min(found)
                bins = self.at[r][bits]
                bins.pop()
                if not bins:
                    del self.at[r][bits]
                self._update(r)
                break
            r += 1
        self.residual[bin_] = left = r - length
        if left:
            self.at[left].setdefault(bits | mask, []).append(bin_)
            self._update(left)
        return bin_, self.capacity - r


def pack_shard(docs: list[tuple[int, str | None, int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, first word, places, bin, place) of each piece; docs: id, source, words, cluster."""
    sources: dict[str, int] = {}
    seen: dict[int, int] = {}
    for _, s, _, c in docs:
        if s is not None:
            sources.setdefault(s, len(sources))
        seen[c] = seen.get(c, 0) + 1
    shared = {c: k for k, c in enumerate(c for c, n in seen.items() if n > 1)}
    pieces = []
    for row, (doc, _, n, _) in enumerate(docs):
        total = n + 1
        pieces += [(-min(capacity, total - k), doc, row, k // capacity) for k in range(0, total, capacity)]
    bins, out = Bins(capacity), []
    for length, _, row, k in sorted(pieces):
        _, s, n, c = docs[row]
        a = 0 if s is None else 1 << sources[s]
        b = 1 << len(sources) + shared[c] if c in shared else 0
        if n + 1 > capacity and not a and not b:
            b = 1 << len(sources) + len(shared) + row  # pieces of one text don't share a bin either
        bin_, place = bins.put(-length, a, b)
        out.append((row, k, k * capacity, -length, bin_, place))
    return out


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each piece: of which document, from which word on, in which bin (``shard``, ``bin``) and at which place."""
    shards = X.pieces(docs, SHARD_BYTES, LEAST_SHARDS, text_col)

    def measure(batches):
        for b in batches:
            words = [(t or b"").lower().split() for t in b["text"].cast(pa.binary()).to_pylist()]
            cluster = np.array([xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["shard"], b["doc_id"], b["source"], pa.array([len(w) for w in words], pa.int64()), pa.array(cluster)], ["shard", "doc_id", "source", "n", "cluster"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        ids, sources = table["doc_id"].to_pylist(), table["source"].to_pylist()
        rows = [(-(1 << 63) if i is None else i, s, n, c) for i, s, n, c in zip(ids, sources, table["n"].to_pylist(), table["cluster"].to_pylist(), strict=True)]
        out = pack_shard(rows, capacity)
        pieces = [-(-(r[2] + 1) // capacity) for r in rows]
        column = lambda f, kind: pa.array([f(x) for x in out], kind)
        return pa.table({
            "doc_id": column(lambda x: ids[x[0]], pa.int64()), "piece": column(lambda x: x[1], pa.int32()), "n_pieces": column(lambda x: pieces[x[0]], pa.int32()),
            "first_word": column(lambda x: x[2], pa.int64()), "n_places": column(lambda x: x[3], pa.int32()),
            "shard": pa.array([table["shard"][0].as_py()] * len(out), pa.int32()), "bin": column(lambda x: x[4], pa.int32()), "place": column(lambda x: x[5], pa.int32()),
        })

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")]
    dealt = X.dealt(docs, shards, *columns, id_col=id_col, text_col=text_col, name="shard")
    small = dealt.mapInArrow(measure, "shard int, doc_id long, source string, n long, cluster long")
    return small.groupBy("shard").applyInArrow(run, OUT)
