"""Vectorised text primitives on Arrow string columns, shared by the operators of this subpackage.

Everything here works on the UTF-8 bytes of a whole column at once: a batch of documents is one byte
array plus document offsets, and words, hashes and windows are numpy arrays over it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the polynomial hashes.
BYTE_MUL, WORD_MUL, WORD_MUL2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F)
#: The largest number of text bytes handled at once; bounds the temporary arrays (about 60 bytes a text byte).
CHUNK = 2 << 20
#: White space of all word and line rules: space, tab, newline, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of an Arrow column and their offsets (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK):
    """Consecutive row ranges of about ``most`` bytes; a longer document is a range by itself."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word, and for each document the index of its first word (rows + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[raw]
    first = np.empty(len(raw), bool)
    first[0], first[1:] = inside[0], inside[1:] & ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    first[edges] = inside[edges]
    last = np.empty(len(raw), bool)
    last[-1], last[:-1] = inside[-1], inside[:-1] & (~inside[1:] | first[1:])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are disjoint, in order and not empty."""
    n = ends - starts
    total = int(n.sum())
    if not total:
        return np.zeros(len(starts), U64)
    head = np.concatenate(([0], np.cumsum(n)[:-1]))
    rel = np.arange(total, dtype=np.int64) - np.repeat(head, n)
    powers = np.full(int(n.max()), BYTE_MUL, U64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(powers)
        value = powers[rel]
        value *= raw[rel + np.repeat(starts, n)].astype(U64) + U64(1)
        return mix(np.add.reduceat(value, head) + n.astype(U64))


def windows(words: np.ndarray, k: int, mul: np.uint64 = WORD_MUL) -> np.ndarray:
    """A hash for each run of k consecutive values; ``len(words) - k + 1`` of them (none when shorter)."""
    if len(words) < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out, have, span, power, size = None, 0, words, mul, 1
        rest = k
        while rest:
            if rest & 1:  # append this power of two behind what is gathered
                out = span if out is None else out[: len(out) - size] * power + span[have : have + len(out) - size]
                have += size
            rest >>= 1
            if rest:
                span = span[: len(span) - size] * power + span[size:]
                power = power * power
                size *= 2
        return out[: len(words) - k + 1]


def inside_one(first_word: np.ndarray, k: int) -> np.ndarray:
    """For windows of k words over a batch: is the window within one document?"""
    total = int(first_word[-1])
    if total < k:
        return np.zeros(0, bool)
    ends = np.repeat(first_word[1:], np.diff(first_word))
    return np.arange(total - k + 1) + k <= ends[: total - k + 1]


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences, as narrow as these allow."""
    if not len(a):
        return b""
    d = np.diff(a)
    width = max(1, (int(d.max()).bit_length() + 7) // 8) if len(d) else 0
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() if width else b""
    return int(a[0]).to_bytes(8, "little") + bytes([width]) + planes


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, U64)
    width = data[8]
    out = np.zeros(n, U64)
    out[0] = int.from_bytes(data[:8], "little")
    if n > 1:
        d = np.zeros((n - 1, 8), np.uint8)
        d[:, :width] = np.frombuffer(data, np.uint8, width * (n - 1), 9).reshape(width, n - 1).T
        out[1:] = d.view(U64)[:, 0]
    return np.cumsum(out, dtype=U64)


def pack_ints(a: np.ndarray) -> bytes:
    """Unsigned values as byte planes above their minimum, as narrow as the range allows."""
    if not len(a):
        return b""
    low = a.min()
    a = (a - low).astype(U64)
    width = max(1, (int(a.max()).bit_length() + 7) // 8)
    return int(low).to_bytes(8, "little") + bytes([width]) + np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_ints(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, U64)
    out = np.zeros((n, 8), np.uint8)
    out[:, : data[8]] = np.frombuffer(data, np.uint8, data[8] * n, 9).reshape(data[8], n).T
    return out.view(U64)[:, 0] + U64(int.from_bytes(data[:8], "little"))


def ordered_ids(column) -> np.ndarray:
    """Document ids as unsigned values in the same order; null comes after all others."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ids = column.cast(pa.int64()).fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
    return ids.astype(np.int64).view(U64) ^ U64(1 << 63)
