"""Benchmark decontamination: passages of a text within a small edit distance of a benchmark item.

CGK embedding: a random walk reads a window and, at each step, either stays at a character or goes on, as a random function of
step and character says; two windows of small edit distance soon walk in step, so their traces differ in few places. Traces of
``WALKS`` walks are sampled ``SAMPLES`` times at a few steps each (bit-sampling LSH); a window and an item that agree in any
of these repetitions are verified by exact edit distance (bit-parallel), which alone decides. The repetitions are so many that an
item with a tenth of its characters edited is found with a recall over 0.99, wherever its edits stand.

Windows have the size of an item and begin at any character. Most can be left out without loss: an edit of a character destroys at
most the ``q``-byte grams that overlap it, so an occurrence keeps a known number of its item's grams, all within the shift
that the edits allow. Windows without so many grams so near each other, counted exactly, are no occurrences and aren't embedded.

Texts are never shuffled. Items are embedded where they lie and gathered in blocks whose tables, counted in bytes, take at most
``TABLE_BYTES``; a block is broadcast, and a larger benchmark makes more blocks. Of more than ``BLOCKS`` blocks, results are written
before the next are gathered.

Defined results: case of A-Z and kinds of white space are ignored; null or empty texts hold nothing; items that are null or
empty (or under ``min_chars`` bytes) are no evidence; equal items are each reported; of several occurrences of an item in a text the one of
fewest edits counts, then the first; rows of one id or of equal texts are judged each; other columns pass through, except
that ``leaks`` is replaced.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .components import cut

#: Walks, samples of each, steps in a sample; windows embedded at once; growth of lengths in a class of items.
WALKS, SAMPLES, STEPS, WINDOWS, CLASS_GROWTH = 24, 32, 6, 1 << 12, 1.25
#: Bytes of a gram at most; items whose grams might all be destroyed by their edits are counted by shorter ones.
GRAM = 8
#: Bytes of items whose grams are looked up at once; bounds how many items a gram of the text can meet.
GRAM_BYTES = 256 << 10
#: Grams met at once, of whole texts; bounds the temporary arrays.
MET = 1 << 22
#: Bytes of a block's tables, and blocks that are held at once; bytes of tables for an item and for each byte of it: its sampled traces, 32 bits
#: each, and for each gram its hash, item and place.
TABLE_BYTES, BLOCKS = 32 << 20, 8
ITEM_COST, BYTE_COST = 4 * WALKS * SAMPLES + 200, 8 * 3 + 2
FILTER_BITS = 22
NORMAL = B.LOWER.copy()
NORMAL[np.flatnonzero(B.IS_SPACE)] = 32
#: Bytes of the character that a byte begins, 0 within characters.
WIDTH = np.repeat(np.array([1, 0, 2, 3, 4]), [0x80, 0x40, 0x20, 0x10, 0x10])
LEAK = "array<struct<item_id:long,start:long,n_chars:long,edits:int>>"


def best_end(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the substring of ``text`` nearest to ``pattern``, the first of equals; anchored: it starts at 0.
    Bit-parallel dynamic programming by columns, one big integer for all rows."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, edits = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = ((eq & up) + up ^ up) | eq | down
        right_up, right_down = (down | ~(diagonal | up)) & full, up & diagonal
        edits += bool(right_up & top) - bool(right_down & top)
        right_up = (right_up << 1 | anchored) & full
        right_down = right_down << 1 & full
        x = eq | down
        up, down = (right_down | ~(x | right_up)) & full, right_up & x
        if edits < best[0]:
            best = (edits, j + 1)
    return best


def nearest(pattern: str, text: str, most: int | None = None) -> tuple[int, int, int] | None:
    """(edits, start, end) of the nearest substring; None if it has more than ``most`` edits."""
    edits, end = best_end(pattern, text)
    if most is not None and edits > most:
        return None
    _, length = best_end(pattern[::-1], text[:end][::-1], anchored=True)
    return edits, end - length, end


class Tables:
    """What a block of items needs to be found: their grams, how many an occurrence keeps, and their sampled traces."""

    def __init__(self, items: list[tuple[int, str]], keys: np.ndarray, percent: int):
        """items: id and normalised text; keys: what ``embed`` makes of these."""
        self.percent, self.items, self.keys = percent, items, keys
        data = [t.encode() for _, t in self.items]
        kept = [k for k, d in enumerate(data) if d]
        self.need, self.most, self.width, self.sizes = (np.ones(len(data), np.int64) for _ in range(4))
        grouped: dict[int, list[int]] = {}
        for k in kept:
            widths = np.sort(WIDTH[np.frombuffer(data[k], np.uint8)])[::-1]
            self.most[k], self.width[k], self.sizes[k] = len(self.items[k][1]) * percent // 100, widths[0], len(data[k])
            hurt = widths[: self.most[k]]
            left = {q: len(data[k]) - q + 1 - int((q - 1 + hurt).sum()) for q in range(1, GRAM + 1)}
            q = max((q for q in left if left[q] >= 1), default=1)
            self.need[k] = max(1, left[q])
            grouped.setdefault(q, []).append(k)
        self.grams = []
        for q, own in sorted(grouped.items()):
            sizes = np.cumsum([len(data[k]) for k in own]) // GRAM_BYTES
            for part in np.unique(sizes):
                some = [own[x] for x in np.flatnonzero(sizes == part)]
                found = [_grams(np.frombuffer(data[k], np.uint8), q) for k in some]
                n = [len(x) for x in found]
                gram, of, at = np.concatenate(found), np.repeat(some, n), np.concatenate([np.arange(x) for x in n])
                order = np.argsort(gram, kind="stable")
                seen = np.zeros(1 << FILTER_BITS, bool)
                seen[(gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
                self.grams.append((q, seen, gram[order], of[order], at[order]))
        self.class_of = classes(np.array([len(d) for d in data], np.int64))

    def leaks(self, column) -> list[list[tuple[int, int, int, int]]]:
        raw, offsets = B.text_bytes(column)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        for i, j in B.chunks(offsets):
            part, edges = NORMAL[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            for row, item, a, b in self._alike(part, edges, list(self._candidates(part, edges))):
                self._verify(out[i + row], item, part[edges[row] : edges[row + 1]], a - int(edges[row]), b - int(edges[row]))
        return out

    def _candidates(self, part: np.ndarray, edges: np.ndarray):
        """(row, item, first start, last start) of each stretch that has the grams an occurrence must have."""
        width = np.array([WIDTH[part[a:b]].max(initial=1) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        for q, seen, grams, of, offset in self.grams:
            here = _grams(part, q)
            at = np.flatnonzero(seen[(here >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            a, b = np.searchsorted(grams, here[at]), np.searchsorted(grams, here[at], "right")
            at, a, n = at[b > a], a[b > a], (b - a)[b > a]
            first = np.searchsorted(at, edges)
            for i, j in B.chunks(np.concatenate(([0], np.cumsum(n)))[first], MET):
                own = slice(first[i], first[j])
                m = n[own]
                if len(m):
                    entry = np.repeat(a[own], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    yield from self._stretches(edges, width, np.repeat(at[own], m), of[entry], offset[entry])

    def _stretches(self, edges: np.ndarray, width: np.ndarray, at: np.ndarray, item: np.ndarray, offset: np.ndarray):
        pad = 2 * int(self.sizes.max()) + 8 * int(self.most.max()) + 8  # no stretch goes on in the next row
        span = int(edges[-1]) + pad * (len(edges) + 1)
        row = np.searchsorted(edges, at, "right") - 1
        start = np.sort(item * span + at - offset + (row + 1) * pad)  # where the item would begin, by this gram
        item = start // span
        row = np.searchsorted(edges[:-1] + np.arange(len(edges) - 1) * pad + pad // 2, start - item * span, "right") - 1
        shift = self.most[item] * np.maximum(width[row], self.width[item])
        last = np.arange(len(start)) + self.need[item] - 1
        enough = np.flatnonzero(last < len(start))
        enough = enough[start[last[enough]] - start[enough] <= shift[enough]]
        if not len(enough):
            return
        first, last, item, row, shift = start[enough], start[last[enough]], item[enough], row[enough], shift[enough]
        new = np.flatnonzero(np.concatenate(([True], np.diff(first) > shift[:-1])))
        end = np.append(new[1:], len(first)) - 1
        item, row, shift = item[new], row[new], shift[new]
        back = item * span + (row + 1) * pad
        a, b = first[new] - shift - back, last[end] + shift - back
        a, b = np.maximum(a, edges[row]), np.minimum(b, edges[row + 1])
        yield from zip(row.tolist(), item.tolist(), a.tolist(), np.maximum(a, b).tolist(), strict=True)

    def _alike(self, part: np.ndarray, edges: np.ndarray, found: list[tuple[int, int, int, int]]):
        """Those stretches where a window agrees with the item in a sample of a trace, cut to such windows."""
        if not found:
            return
        row, item, a, b = np.array(found, np.int64).T
        for k in np.unique(self.class_of[item]).tolist():
            own = np.flatnonzero(self.class_of[item] == k)
            walk, at = walks(k)
            for lot in np.array_split(own, max(1, -(-int((b - a + 1)[own].sum()) // WINDOWS))):
                n = (b - a + 1)[lot]
                if not n.sum():
                    continue
                start = np.repeat(a[lot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(lot, n)
                whole = (start < edges[row[of] + 1]) & (WIDTH[part[np.minimum(start, len(part) - 1)]] > 0)
                start, of = start[whole], of[whole]
                end = np.minimum(edges[row[of] + 1], start + self.sizes[item[of]])
                hit = np.flatnonzero((traces(part, start, end, walk, at) == self.keys[:, item[of]]).any(0))
                if len(hit):
                    first = np.flatnonzero(np.concatenate(([True], np.diff(of[hit]) != 0)))
                    last = np.append(first[1:], len(hit)) - 1
                    for x, y in zip(hit[first].tolist(), hit[last].tolist(), strict=True):
                        yield int(row[of[x]]), int(item[of[x]]), int(start[x]), int(start[y])

    def _verify(self, out: list, item: int, text: np.ndarray, first: int, last: int) -> None:
        item_id, pattern = self.items[item]
        most = len(pattern) * self.percent // 100
        room = 4 * most + 4
        a = max(0, first - room)
        while a and text[a] & 0xC0 == 0x80:
            a -= 1
        region = text[a : last + len(pattern.encode()) + room].tobytes().decode("utf-8", "ignore")
        found = nearest(pattern, region, most)
        if found is not None:
            before = len(text[:a].tobytes().decode("utf-8", "ignore"))
            new = (item_id, before + found[1], found[2] - found[1], found[0])
            for k, old in enumerate(out):
                if old[0] == item_id:
                    out[k] = min(old, new, key=lambda x: (x[3], x[1]))
                    return
            out.append(new)


def _grams(raw: np.ndarray, q: int) -> np.ndarray:
    return B.mix(B.windows(raw.astype(np.uint64) + np.uint64(1), q))


def normal(text: str) -> str:
    return NORMAL[np.frombuffer(text.encode(), np.uint8)].tobytes().decode()


def traces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each walk and sample, a hash of the sampled symbols of each window: an array (walks * samples, windows)."""
    walks, steps, _ = walk.shape
    seen = np.zeros((steps, walks, len(starts)), np.uint8)
    padded = np.append(raw, np.uint8(0))
    where = np.repeat(starts[None], walks, 0)
    line = np.arange(walks)[:, None]
    for step in range(steps):
        symbol = np.where(where < ends, padded[np.minimum(where, len(raw))], np.uint8(0))
        seen[step] = symbol
        where += walk[line, step, symbol]
    with np.errstate(over="ignore"):
        out = np.zeros((walks, at.shape[1], len(starts)), np.uint64)
        for k in range(at.shape[2]):
            out = out * B.WORD_MUL + seen[at[:, :, k], line] + np.uint64(1)
        return (B.mix(out) >> np.uint64(32)).astype(np.uint32).reshape(-1, len(starts))


def classes(sizes: np.ndarray) -> np.ndarray:
    """The class of each length in bytes: the least length of its class."""
    lows = [1]
    while len(sizes) and lows[-1] <= sizes.max():
        lows.append(max(lows[-1] + 1, int(lows[-1] * CLASS_GROWTH)))
    return np.array(lows)[np.searchsorted(lows, sizes, "right") - 1]


@functools.lru_cache(64)
def walks(low: int) -> tuple[np.ndarray, np.ndarray]:
    """The random walks of a class of lengths and the steps that are sampled: the same wherever they are made."""
    rng, steps = np.random.default_rng([20_240, low]), max(1, int(1.5 * low))
    return rng.integers(0, 2, (WALKS, steps, 256)).astype(np.uint8), rng.integers(0, steps, (WALKS, SAMPLES, STEPS))


def embed(texts: list[str]) -> np.ndarray:
    """Sampled traces of normalised items, that none is empty: (walks * samples, items)."""
    data = [t.encode() for t in texts]
    of, out = classes(np.array([len(d) for d in data], np.int64)), np.zeros((WALKS * SAMPLES, len(data)), np.uint32)
    for low in np.unique(of).tolist():
        own = np.flatnonzero(of == low)
        edges = np.cumsum([0, *[len(data[k]) for k in own]])
        out[:, own] = traces(np.frombuffer(b"".join(data[k] for k in own), np.uint8), edges[:-1], edges[1:], *walks(low))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``leaks``: item, start and length in characters, and edits (at most ``percent`` hundredths of the
    item's characters) of each item that the text holds. One pass over the texts for each block of items."""
    context = docs.sparkSession.sparkContext
    keep = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn("leaks", F.array().cast(LEAK))
    schema = out.schema
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("n_chars", pa.int64()), ("edits", pa.int32())]))

    def marked(shared, df: DataFrame) -> DataFrame:
        def run(batches):
            for b in batches:
                new = [[dict(zip(("item_id", "start", "n_chars", "edits"), x, strict=True)) for x in sorted(row)] for row in shared.value.leaks(b[text_col])]
                old = b["leaks"].to_pylist()
                yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array([o + n for o, n in zip(old, new, strict=True)], arrow)], [*keep, "leaks"])

        return df.mapInArrow(run, schema)

    def embedded(batches):
        for b in batches:
            texts = [normal(t) for t in b["text"].to_pylist()]
            for i in range(0, len(texts), 256):
                some = texts[i : i + 256]
                yield pa.RecordBatch.from_arrays([b["id"].slice(i, 256), pa.array(some, pa.string()), pa.array([k.tobytes() for k in embed(some).T], pa.binary())], ["id", "text", "keys"])

    wanted = items.where(F.col(item_id).isNotNull() & (F.octet_length(F.col(item_text)) >= max(1, min_chars))).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    wanted = wanted.orderBy("id", "text").mapInArrow(embedded, "id long, text string, keys binary")
    block, size, held = [], 0, []
    for r in itertools.chain(wanted.toLocalIterator(prefetchPartitions=True), [None]):
        cost = 0 if r is None else ITEM_COST + BYTE_COST * len(r["text"].encode())
        if block and (r is None or size + cost > TABLE_BYTES):
            if len(held) == BLOCKS:
                out = cut(out)
                while held:
                    held.pop().destroy()
            keys = np.frombuffer(b"".join(bytes(k) for _, _, k in block), np.uint32).reshape(len(block), -1).T
            held.append(context.broadcast(Tables([x[:2] for x in block], np.ascontiguousarray(keys), percent)))
            out, block, size = marked(held[-1], out), [], 0
        if r is not None:
            block.append((r["id"], r["text"], r["keys"]))
            size += cost
    return out
