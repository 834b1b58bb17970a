"""The prefix trie of conversations, by preorder intervals.

A turn is a 16-byte digest of its role and text, a conversation the path of its turns' digests. Conversations are sorted by path, in
ranges of bounded bytes: that is the trie's preorder. A conversation adds the nodes beyond the prefix that it shares with the one
before it; so distinct nodes get their lexicographic rank (``pos``) where they first stand, by running numbers from each range's
offset, and a subtree is the interval of ranks up to its last node (``end``). Leaves and savings of a subtree are then differences of two
prefix sums over the ranks.

Ranges are sorted by (path, id), so that equal conversations and shared prefixes of any frequency are split over ranges. A node whose
interval lies in one range is done there. Others lie on the path at the edge of a range, one node for each depth: each range sends
its share of those, shares are added up in a shuffle, and prefix sums go on from range to range. What the driver sees is a row for each
range and each node at a range's edge, nothing for each conversation. The ids that end at a node form one run of the order; a run
over several ranges is hashed as a stream, in order, a piece of text for each range.

Defined results: a null role or text is empty; turns go by number, null first, those of one number by their digest; rows of a null id take
no part; a conversation without turns ends at the root; an empty table gives an empty table. A conversation's digests are in memory
at once, 24 bytes a turn.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import cut, kept, new_path

DIGEST = 16
#: Bytes of paths for one range, and rows for one batch that leaves a task.
RANGE_BYTES, BATCH_ROWS = 8 << 20, 20_000
NODES = "pos long, end long, depth long, conv_id long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EDGES = "key binary, part int, length long, ids binary"
SCHEMA = f"kind int, {NODES}, {EDGES}"
TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
FIELDS = [(x.split()[0], TYPES[x.split()[1]]) for x in SCHEMA.split(", ")]
NODE, SHARE, RUN, TOTAL = range(4)
#: Largest number of edge nodes that are sent to every task.
FEW_EDGES = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, by: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(by, conv_id, turns)``: each conversation's turns in order, as (turn, digest, n); dealt by ``by``, a function of the id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(text(role_col)).cast("string"), F.lit(":"), text(role_col), text(text_col)))
    rows = conversations.where(F.col(id_col).isNotNull()).select(by.alias("by"), F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.unhex(digest).alias("digest"), F.length(text(text_col)).cast("long").alias("n"))
    return rows.repartition("by").groupBy("by", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "n"))).alias("turns"))


def paths_of(rows: DataFrame) -> DataFrame:
    """``(conv_id, path, lengths)`` of ``(conv_id, turns)``."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return rows.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["n"]).alias("lengths"))


def shared(a: bytes, b: bytes) -> int:
    """How many turns two paths begin alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while high - low > 1:  # alike up to low, not up to high
        mid = (low + high) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid
    return low


def _conversations(batches):
    for b in batches:
        ends = np.cumsum(np.diff(b["lengths"].offsets.to_numpy())).tolist()
        flat, at = b["lengths"].flatten().to_pylist(), 0
        for conv, path, end in zip(b["conv_id"].to_pylist(), b["path"].to_pylist(), ends, strict=True):
            yield conv, path, flat[at:end]
            at = end


def _batch(count: int, kind: int, **columns) -> pa.RecordBatch:
    columns = columns | {"kind": np.full(count, kind, np.int32)}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in FIELDS], [c for c, _ in FIELDS])


def edge_keys(path: bytes, depth: int) -> list[bytes]:
    """Names of the nodes from the root down to a depth of a path."""
    h = hashlib.md5(usedforsecurity=False)
    keys = [h.digest()]
    for d in range(depth):
        h.update(path[d * DIGEST : (d + 1) * DIGEST])
        keys.append(h.copy().digest())
    return keys


class Range:
    """The part of the trie that a range of sorted conversations adds. Its first ``base`` entries are the nodes that it goes on from, those of
    the prefix shared with the range before."""

    def __init__(self, part: int, before: bytes | None, after: bytes | None, offset: int):
        self.part, self.before, self.after, self.offset = part, before, after, offset
        self.depth, self.parent, self.n, self.low, self.children, self.length, self.end = (array("q") for _ in range(7))
        self.ends: dict[int, str] = {}
        self.runs: list[tuple[int, bytes]] = []
        self.stack: list[int] = []

    def _push(self, length: int) -> None:
        k, above = len(self.depth), self.stack[-1] if self.stack else -1
        for column, value in zip((self.depth, self.parent, self.n, self.low, self.children, self.length, self.end), (len(self.stack), above, 0, (1 << 63) - 1, 0, length, -1), strict=True):
            column.append(value)
        self.stack.append(k)

    def _pop(self, depth: int) -> None:
        """Closes all nodes deeper than this."""
        last = len(self.depth) - 1
        while len(self.stack) - 1 > depth:
            k = self.stack.pop()
            self.end[k] = last
            if self.stack:
                self._add(self.stack[-1], self.n[k], self.low[k])

    def _add(self, k: int, n: int, low: int) -> None:
        self.n[k] += n
        self.low[k] = min(self.low[k], low)

    def read(self, conversations) -> None:
        before, first, run, self.base, path = self.before, True, [], 0, b""
        for conv, path, lengths in conversations:
            alike = -1 if before is None else shared(before, path)
            if first:
                for d in range(alike + 1):
                    self._push(lengths[d - 1] if d else 0)
                self.base, first = len(self.depth), False
            elif alike < len(path) // DIGEST or len(before) != len(path):
                self._finish(run, False)
                run = []
            self._pop(alike)
            for d in range(alike + 1, len(lengths) + 1):
                if self.stack:
                    self.children[self.stack[-1]] += 1
                self._push(lengths[d - 1] if d else 0)
            self._add(self.stack[-1], 1, conv)
            run.append(conv)
            before = path
        self._finish(run, self.after == path)
        self._pop(-1 if self.after is None else shared(path, self.after))
        for k, above in zip(self.stack[:0:-1], self.stack[-2::-1], strict=True):  # open nodes count what lies below them
            self._add(above, self.n[k], self.low[k])
        self.path = path

    def _finish(self, run: list[int], goes_on: bool) -> None:
        """The ids that end at the node on top."""
        k, text = self.stack[-1], ",".join(map(str, run)).encode()
        if goes_on or k < self.base:
            self.runs.append((k, text))
        else:
            self.ends[k] = hashlib.sha256(text).hexdigest()

    def rows(self):
        column = lambda a: np.frombuffer(a, np.int64)
        depth, parent, n, low, children, length, end = map(column, (self.depth, self.parent, self.n, self.low, self.children, self.length, self.end))
        size, rank = len(depth), np.arange(len(depth))
        edge = (rank < self.base) | (end < 0)
        leaf = np.concatenate(([0], np.cumsum(np.where(edge, 0, children == 0))))
        saved = np.concatenate(([0], np.cumsum(np.where(edge, 0, (n - 1) * length))))
        keys = dict(zip(range(self.base), edge_keys(self.before or b"", self.base - 1), strict=True)) if self.base else {}
        keys |= dict(zip(self.stack, edge_keys(self.path, len(self.stack) - 1), strict=True)) if self.stack else {}
        to_rank = self.offset - self.base
        done = np.flatnonzero(~edge)
        for a in range(0, len(done), BATCH_ROWS):
            k = done[a : a + BATCH_ROWS]
            up = parent[k]
            at_edge = (up >= 0) & edge[up]
            yield _batch(
                len(k), NODE, pos=k + to_rank, end=end[k] + to_rank, depth=depth[k], conv_id=low[k], n_convs=n[k], n_children=children[k],
                parent_conv_id=pa.array(low[up], pa.int64(), mask=(up < 0) | at_edge), parent_key=[keys[u] if e else None for u, e in zip(up.tolist(), at_edge.tolist(), strict=True)],
                n_leaves=leaf[end[k] + 1] - leaf[k], saved_tokens=saved[end[k] + 1] - saved[k], ends_sha256=[self.ends.get(x, NO_ENDS) for x in k.tolist()],
            )
        # a node at an edge: its share; where it begins (pos) and ends, also this range's sums up to there, in rows of their own
        for k in np.flatnonzero(edge).tolist():
            new, closed = k >= self.base, end[k] >= 0
            yield _batch(
                1, SHARE, key=[keys[k]], part=[self.part], depth=[depth[k]], conv_id=[low[k]], n_convs=[n[k]], n_children=[children[k]], length=[length[k]],
                parent_key=[keys[parent[k]] if depth[k] else None], ends_sha256=[self.ends.get(k)], pos=[k + to_rank if new else None], end=[end[k] + to_rank if closed else None],
                n_leaves=[leaf[k] if new else leaf[end[k] + 1] if closed else None], saved_tokens=[saved[k] if new else saved[end[k] + 1] if closed else None],
            )
        for k, text in self.runs:
            yield _batch(1, RUN, key=[keys[k]], part=[self.part], ids=[text])
        yield _batch(1, TOTAL, part=[self.part], n_leaves=[leaf[size]], saved_tokens=[saved[size]])


def _edges(rows: DataFrame) -> list[dict]:
    """The nodes at edges of ranges, whole: shares added up, prefix sums taken over all ranges."""
    shares, totals = rows.where(F.col("kind") == SHARE), rows.where(F.col("kind") == TOTAL)
    leaves, saved, sums = 0, 0, {}
    for r in totals.select("part", "n_leaves", "saved_tokens").orderBy("part").collect():  # a row a range
        sums[r["part"]] = (leaves, saved)
        leaves, saved = leaves + r["n_leaves"], saved + r["saved_tokens"]
    at = F.struct("part", "n_leaves", "saved_tokens")
    merged = shares.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.max("length").alias("length"),
        F.max("pos").alias("pos"), F.max("end").alias("end"), F.max("ends_sha256").alias("sha"), F.max(F.when(F.col("pos").isNotNull(), at)).alias("begins"), F.max(F.when(F.col("end").isNotNull(), at)).alias("stops"),
    )
    found = sorted((r.asDict() for r in merged.collect()), key=lambda r: r["pos"])  # a row for each node at an edge
    hashes = {bytes(r["key"]): r["sha"] for r in _run_hashes(rows.where(F.col("kind") == RUN)).collect()} if found else {}
    by_key = {bytes(r["key"]): r for r in found}
    total = lambda f: np.concatenate(([0], np.cumsum([f(r) for r in found], dtype=np.int64)))
    own_leaves, own_saved = total(lambda r: r["n_children"] == 0), total(lambda r: (r["n_convs"] - 1) * r["length"])
    ranks = np.array([r["pos"] for r in found])
    for k, r in enumerate(found):
        last = int(np.searchsorted(ranks, r["end"], "right"))
        whole = lambda side, i, r=r: sums[r[side]["part"]][i] + r[side][("n_leaves", "saved_tokens")[i]]
        r["n_leaves"] = whole("stops", 0) - whole("begins", 0) + int(own_leaves[last] - own_leaves[k])
        r["saved_tokens"] = whole("stops", 1) - whole("begins", 1) + int(own_saved[last] - own_saved[k])
        r["parent_conv_id"] = None if r["parent_key"] is None else by_key[bytes(r["parent_key"])]["conv_id"]
        r["ends_sha256"] = hashes.get(bytes(r["key"])) or r["sha"] or NO_ENDS
    return found


def _run_hashes(runs: DataFrame) -> DataFrame:
    """``(key, sha)``: of each key's pieces in order of their ranges, joined by commas. A stream: one piece is in memory at a time."""

    def run(batches):
        key, h = None, None
        for b in batches:
            for k, ids in zip(b["key"], b["ids"], strict=True):
                k, ids = k.as_py(), ids.as_py()
                if k != key:
                    if key is not None:
                        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "sha": [h.hexdigest()]})
                    key, h = k, hashlib.sha256(ids)
                else:
                    h.update(b",")
                    h.update(ids)
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "sha": [h.hexdigest()]})

    return runs.select("key", "part", "ids").repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, "key binary, sha string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations ``(conv_id, path, lengths)``, ids distinct: rank, subtree end, depth, least member,
    that of the parent, members, children, leaves and savings of the subtree, and a hash of the ids that end there."""
    spark = paths.sparkSession
    paths = cut(paths.select("conv_id", "path", "lengths"))
    total = paths.agg(F.sum(F.length("path") + 2 * DIGEST)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // RANGE_BYTES))
    ordered = cut(paths.repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id"))

    def bounds(batches):
        first, last, added = None, None, 0
        for _, path, _ in _conversations(batches):
            if first is None:
                first = path
            else:
                added += len(path) // DIGEST - shared(last, path)
            last = path
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([added], pa.int64())], ["part", "first", "last", "added"])

    edges = sorted(ordered.mapInArrow(bounds, "part int, first binary, last binary, added long").collect(), key=lambda r: r["part"])  # a row a range
    known, offset, before = {}, 0, None
    for k, r in enumerate(edges):
        first, last = bytes(r["first"]), bytes(r["last"])
        after = bytes(edges[k + 1]["first"]) if k + 1 < len(edges) else None
        known[r["part"]] = (before, after, offset)
        offset += r["added"] + len(first) // DIGEST - (-1 if before is None else shared(before, first))
        before = last
    sent = spark.sparkContext.broadcast(known)

    def grow(batches):
        part = TaskContext.get().partitionId()
        if part in sent.value:
            own = Range(part, *sent.value[part])
            own.read(_conversations(batches))
            yield from own.rows()

    rows = kept(ordered.mapInArrow(grow, SCHEMA), new_path(spark, "trie"))
    found = _edges(rows)
    shown = ["pos", "end", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = rows.where(F.col("kind") == NODE)
    out = nodes.where("parent_key IS NULL").select(*shown)
    if not found:
        return out
    at_edges = spark.createDataFrame([(bytearray(r["key"]), *(r[c] for c in shown)) for r in found], "key binary, pos long, end long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    above = at_edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    below = nodes.where("parent_key IS NOT NULL").join(F.broadcast(above) if len(found) <= FEW_EDGES else above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    return out.unionByName(below.select(*shown)).unionByName(at_edges.select(*shown))
