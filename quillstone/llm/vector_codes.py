"""Vector code compression: product codes whose codebooks come from Lloyd's rounds, maintained by differences.

Components become integers, ``floor(scale * x)``, and a vector is cut into equal consecutive parts, each coded by the nearest entry
of its position's codebook. Integers make every sum and distance exact, so results depend on no order of rows, tasks or retries.

What a round needs of the vectors are, for each entry, the number of its parts and their sum. These run on: a table keeps each
vector's codes of the round before, and a task adds up, for parts whose entry is another one now, minus at the old entry and plus at
the new one. It sends a row for each entry that changed, ``parts * entries`` at most whatever it read; a part that stays sends
nothing. The driver holds the running sums and codebooks, ``parts * entries`` rows by parameter, and tasks get the codebooks.

Defined results: rows whose vector is null or holds null or non-finite components go; a vector shorter than the longest, or than a
multiple of ``parts``, is filled up with zeros; rows of one id are coded each, and precede one another by their components; rows of
a null id come after all others; ties of distance go to the lower entry; with fewer rows than entries the codebooks have fewer;
integers of 2^62 and more are taken as 2^62, and an error beyond a long as the largest long; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
import decimal
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .components import delete, kept, new_path

MOST, LONG = 1 << 62, (1 << 63) - 1
#: Largest number of label sums that are sent to every task.
FEW_LABELS = 100_000


@dataclasses.dataclass
class Codebooks:
    """Entries of each part position: integers of shape (parts, entries, width)."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The integers that a code stands for."""
        return np.concatenate([book[c] for book, c in zip(self.entries, bytes.fromhex(code), strict=True)])


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry, the lower one in ties, and its squared distance; exact at any size of the integers."""
    most = max(int(abs(x).max(initial=0)), int(abs(book).max(initial=0)))
    kind = np.float64 if (2 * most) ** 2 * max(1, x.shape[1]) < 1 << 53 else object  # doubles hold these integers exactly
    x, book = x.astype(kind), book.astype(kind)
    if kind is object:
        far = ((x[:, None, :] - book[None]) ** 2).sum(2)
    else:
        far = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]
    code = far.argmin(1) if len(x) else np.zeros(0, np.int64)
    return code.astype(np.uint8), far[np.arange(len(x)), code]


class Changes:
    """Numbers and sums that entries gain and lose."""

    def __init__(self, shape: tuple[int, int, int]):
        self.n, self.sums = np.zeros(shape[:2], np.int64), np.zeros(shape, object)

    def add(self, part: int, code: np.ndarray, x: np.ndarray, sign: int) -> None:
        used = np.unique(code)
        at = np.searchsorted(used, code)
        self.n[part, used] += sign * np.bincount(at)
        order = np.argsort(at, kind="stable")
        rows = x[order] if int(abs(x).max(initial=0)) < 1 << 40 else x[order].astype(object)
        self.sums[part, used] += sign * np.add.reduceat(rows, np.searchsorted(at[order], np.arange(len(used)))).astype(object)

    def rows(self) -> dict[str, list]:
        part, entry = np.nonzero((self.n != 0) | (self.sums != 0).any(2))
        return {"part": part.tolist(), "entry": entry.tolist(), "n": self.n[part, entry].tolist(), "sums": [list(map(decimal.Decimal, s)) for s in self.sums[part, entry].tolist()]}


def _state(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = F.transform("v", lambda x: F.least(F.greatest(F.floor(x * scale), F.lit(-MOST)), F.lit(MOST)))
    return rows.select("vec_id", "label", whole.alias("v"), F.lit(None).cast("binary").alias("codes"))


def _first(state: DataFrame, count: int, low: int | None, high: int | None) -> list:
    """Vectors of the ``count`` least ids. Rows are narrowed down by the id alone first, so that few go to the task that orders them."""
    span = count
    while low is not None and low + span <= high:
        if state.where(F.col("vec_id") < low + span).count() >= count:
            state = state.where(F.col("vec_id") < low + span)
            break
        span *= 8
    return [r["v"] for r in state.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(count).collect()]


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == length).all():
        return flat.reshape(-1, length)
    out = np.zeros((len(n), length), np.int64)
    out[np.arange(length)[None] < n[:, None]] = flat
    return out


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """``(vec_id, label, code, error, label_error)`` - a code has two hex digits a part, errors are squared distances of vectors from
    what their codes stand for, summed over a vector and over equal labels - and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for a part: 1 to 256 entries")
    spark = vectors.sparkSession
    state = kept(_state(vectors, id_col, vector_col, label_col, scale), path := new_path(spark, "vector_parts"))
    size = state.agg(F.max(F.size("v")).alias("length"), F.min("vec_id").alias("low"), F.max("vec_id").alias("high")).first()
    width = max(1, -(-(size["length"] or 1) // parts))
    length = width * parts
    label_type = state.schema["label"].dataType
    arrow_label = to_arrow_type(label_type)
    first = [list(v) + [0] * (length - len(v)) for v in _first(state, entries, size["low"], size["high"])]
    shape = (parts, len(first), width)
    book = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2) if first else np.zeros(shape, np.int64)
    n, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, object)

    def assigned(sent):
        """One pass: rows with their codes of now, and last the task's changes."""

        def run(batches):
            book, changes = sent.value, Changes(shape)
            for b in batches:
                x = _matrix(b["v"], length)
                old = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(-1, parts) if not b["codes"].null_count else None
                codes = np.empty((len(x), parts), np.uint8)
                for p in range(parts):
                    own = x[:, p * width : (p + 1) * width]
                    codes[:, p], _ = nearest_entries(own, book[p])
                    moved = np.arange(len(x)) if old is None else np.flatnonzero(codes[:, p] != old[:, p])
                    if len(moved):
                        changes.add(p, codes[moved, p], own[moved], 1)
                        if old is not None:
                            changes.add(p, old[moved, p], own[moved], -1)
                data = pa.array([c.tobytes() for c in codes], pa.binary())
                yield _table(0, {"vec_id": b["vec_id"], "label": b["label"], "v": b["v"], "codes": data}, len(x))
            rows = changes.rows()
            yield _table(1, {c: pa.array(rows[c], t) for c, t in CHANGE_TYPES}, len(rows["n"]))

        return run

    types = [("vec_id", pa.int64()), ("label", arrow_label), ("v", pa.list_(pa.int64())), ("codes", pa.binary()), *CHANGE_TYPES, ("kind", pa.int32())]

    def _table(kind: int, columns: dict, count: int) -> pa.RecordBatch:
        columns = columns | {"kind": pa.array(np.full(count, kind, np.int32))}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(count, t) for c, t in types], [c for c, _ in types])

    field = lambda name, kind: T.StructField(name, kind)
    schema = T.StructType([field("vec_id", T.LongType()), field("label", label_type), *T._parse_datatype_string("v array<long>, codes binary, part int, entry int, n long, sums array<decimal(38,0)>, kind int")])
    for _ in range(rounds):
        before, path = path, new_path(spark, "vector_parts")
        both = kept(state.select("vec_id", "label", "v", "codes").mapInArrow(assigned(spark.sparkContext.broadcast(book)), schema), path)
        delete(spark, before)
        state = both.where("kind = 0")
        # a row an entry: parts * entries at most
        for r in both.where("kind = 1").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect():
            n[r["part"], r["entry"]] += r["n"]
            sums[r["part"], r["entry"]] += np.array([int(r[f"s{i}"]) for i in range(width)], object)
        book = np.array([[s // m if m else b for s, m, b in zip(*z, strict=True)] for z in zip(sums, n.tolist(), book, strict=True)], np.int64).reshape(shape)
    sent = spark.sparkContext.broadcast(book)

    def coded(batches):
        for b in batches:
            x = _matrix(b["v"], length)
            found = [nearest_entries(x[:, p * width : (p + 1) * width], sent.value[p]) for p in range(parts)]
            code = np.stack([c for c, _ in found], 1)
            error = [min(sum(map(int, e)), LONG) for e in zip(*(far.tolist() for _, far in found), strict=True)]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    out_type = T.StructType([*schema.fields[:2], field("code", T.StringType()), field("error", T.LongType())])
    rows = kept(state.select("vec_id", "label", "v").mapInArrow(coded, out_type), new_path(spark, "vector_codes"))
    delete(spark, path)
    sums_by = rows.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"))
    few = sums_by.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    return rows.join(F.broadcast(sums_by) if few else sums_by, F.col("label").eqNullSafe(F.col("of"))).drop("of"), Codebooks(book)


CHANGE_TYPES = [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))]
