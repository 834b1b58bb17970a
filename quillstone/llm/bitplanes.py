"""Token ids in plane-shuffled files.

Texts are encoded with a public tokenizer and written in ascending order of document id, one file for each range of ids. A file
holds chunks of a fixed number of ids; a chunk's ids are transposed into byte planes (or bit planes), each compressed with
zstandard by itself, since the planes of high bytes are nearly constant. A footer lists where each chunk and plane is, and which
ids are whose, so a reader fetches the chunks it needs.

    file    = chunks | documents | index | length of documents, length of index (2 x u64) | MAGIC
    chunk   = planes, each a zstandard frame
    index   = u64 rows: offset, ids, length of each plane
    documents = i64 ids, u64 lengths, u8 nulls, as one zstandard frame

Files are written under another name and moved, so a task that is run again leaves one whole file. They are in the folder that
driver and executors share. Where a file's ids begin is a sum over runs of files, then within them; the driver holds 8 bytes for
each file, the least id in it, which is all that is broadcast besides the tokenizer.

Defined results: null and empty texts have the end id alone; rows of equal id stand in the order of their token ids' bytes; a null
id comes last; an empty table makes no file.
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import exchange as X
from .components import cut, shared_folder

MAGIC = b"QSPLANE1"
CHUNK_IDS = 1 << 16
#: Bytes of text for one file, the least number of files, and files whose ids are summed up together.
FILE_BYTES, LEAST_FILES, RUN_FILES = 16 << 20, 16, 1024
#: Words whose ids a worker remembers, and bytes of text whose words are numbered at once.
REMEMBERED, PART_BYTES = 500_000, 12 << 20
#: Marks that are pieces by themselves beside letters (none that special tokens begin with), and a word that is one token.
MARKS, BETWEEN = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{}~", "™"
IS_MARK = np.isin(np.arange(256), list(MARKS))
IS_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


class Encoder:
    """A tokenizer that remembers the ids of words. It must cut at white space, as word-level vocabularies do: then the ids of a
    text are those of its words, and only words that differ are encoded: a whole column is cut into words at once, these are
    numbered by Arrow, and the ids of the distinct ones are dealt out to where they stand. Words of plain letters are looked up in
    lower case and without marks behind them if the tokenizer ignores case and cuts off marks, which is tried out; new ones of
    these are encoded many at a time, where the tokens tell the end of a word."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.uint32 if self.wide else np.uint16
        self.code = "I" if self.wide else "H"
        self.known: dict[bytes, bytes] = {}
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = ids("one Two\n three, \t four.") == [i for w in ("one", "Two", "three,", "four.") for i in ids(w)]
        self.plain = self.by_word and ids("Étude") == ids("étude") and all(ids(m + "Étude" + m + m) == ids(m) + ids("étude") + ids(m + m) for m in MARKS.decode())
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        self.ends = None
        if self.plain and suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            self.bare = Tokenizer.from_str(definition)  # for letters alone, in lower case and composed
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            tried = ["étude", "ñandú", "thorough", "x", "weißer"]
            if [x.ids for x in self.bare.encode_batch_fast(tried, add_special_tokens=False)] != [ids(w) for w in tried]:
                self.ends = None
        between = ids(BETWEEN)
        self.between = between[0] if self.by_word and len(between) == 1 else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[bytes], letters: bool) -> list[bytes]:
        """Ids of words encoded many at a time, cut where a word ends: by the tokens, if each word is letters alone and so one piece
        to the tokenizer, or by a mark put between them. Where the cuts don't fit the words these are encoded each."""
        out: list[bytes] = []
        for k in range(0, len(words), 1024):
            part = words[k : k + 1024]
            text = (b" " if letters else f" {BETWEEN} ".encode()).join(part).decode()
            ids = np.array((self.bare if letters else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1 if letters else np.append(np.flatnonzero(ids == self.between), len(ids))
            if len(ends) != len(part) or ends[-1] != len(ids):
                out += self._encode([w.decode() for w in part])
                continue
            data, size = ids.tobytes(), ids.itemsize
            starts = np.concatenate(([0], ends[:-1] + (not letters)))
            out += [data[a:b] for a, b in zip((starts * size).tolist(), (ends * size).tolist(), strict=True)]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Puts the ids of distinct unknown words among those known."""
        known = self.known
        if not self.plain or self.ends is None or self.between is None:
            known.update(zip(words, self._encode([w.decode() for w in words]), strict=True))
            return
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        starts = ends - size
        here = np.arange(len(raw))
        begin = np.minimum.reduceat(np.where(IS_MARK[raw], len(raw), here), starts)  # of what isn't marks before or behind
        stop = np.maximum.reduceat(np.where(IS_MARK[raw], -1, here), starts) + 1
        begin, stop = np.minimum(begin, ends), np.maximum(stop, np.minimum(begin, ends))
        latin = np.zeros(len(raw) + 1, bool)  # the second bytes of letters from À to ÿ
        latin[1:-1] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0xBF) & (raw[1:] & 0x1F != 0x17)
        fine = np.concatenate(([0], np.cumsum(IS_LETTER[raw] | latin[:-1] | latin[1:])))
        letters = (stop > begin) & (fine[stop] - fine[begin] == stop - begin)
        upper = np.concatenate(([0], np.cumsum((latin[:-1] & (raw < 0x9F)) | (raw >= 65) & (raw <= 90))))
        loud = letters & (upper[stop] > upper[begin])
        changed = letters & ((begin > starts) | (stop < ends) | loud)
        marked = []
        for k, x, y, u in zip(*(v[changed].tolist() for v in (np.arange(len(words)), begin - starts, stop - starts, loud)), strict=True):
            w = words[k]
            marked.append((w, w[:x], w[x:y].decode().lower().encode() if u else w[x:y], w[y:]))
        new = list(set(itertools.compress(words, (letters & ~changed).tolist())).union([x[2] for x in marked]) - known.keys())
        other = list(set(itertools.compress(words, (~letters).tolist())).union([m for x in marked for m in x[1::2] if m]) - known.keys())
        known.update(zip(other, self._together(other, False), strict=True))
        known.update(zip(new, self._together(new, True), strict=True))
        known[b""] = b""
        known.update([(w, known[x] + known[c] + known[y]) for w, x, c, y in marked])

    def _words(self, part: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word's text among the distinct ones, first word of each row, ids of the distinct ones, their edges)."""
        if self.plain:  # lower case of A-Z first, so that fewer words differ; not where it could make the name of a special token
            lower = B.LOWER[part]
            for r in np.unique(np.searchsorted(edges, np.flatnonzero((part[:-1] == 60) & (part[1:] == 124)), "right") - 1):
                lower[edges[r] : edges[r + 1]] = part[edges[r] : edges[r + 1]]
            part = lower
        starts, ends, first = B.word_spans(part, edges)
        at = np.concatenate(([0], np.cumsum(ends - starts)))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(part[~B.IS_SPACE[part]]))]).dictionary_encode()
        words = found.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in words if w in self.known}
        ids = list(map(self.known.get, words))
        new = [w for w, x in zip(words, ids, strict=True) if x is None]
        if new:
            self._learn(new)
            ids = [self.known[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind().itemsize
        return found.indices.to_numpy(), first, np.frombuffer(b"".join(ids), self.kind), np.concatenate(([0], np.cumsum(size)))

    def __call__(self, column, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column, an end id behind each, and where each text's begin (one more than rows)."""
        raw, offsets = B.text_bytes(column)
        end = np.array([] if end_id is None else [end_id], self.kind)
        out, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for i, j in B.chunks(offsets, PART_BYTES):
            part, edges = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not self.by_word:
                found = [np.frombuffer(x, self.kind) for x in self._encode([part[a:b].tobytes().decode() for a, b in zip(edges[:-1], edges[1:], strict=True)])]
                out += [np.concatenate([x, end]) for x in found]
                sizes.append(np.array([len(x) + len(end) for x in found]))
                continue
            word, first, ids, at = self._words(part, edges)
            ids, at = np.concatenate([ids, end]), np.append(at, at[-1] + len(end))  # the end is one more word
            word = np.insert(word.astype(np.int64), first[1:], len(at) - 2)
            size = np.diff(at)[word]
            to = np.concatenate(([0], np.cumsum(size)))
            out.append(ids[np.arange(to[-1]) + np.repeat(at[word] - to[:-1], size)])
            sizes.append(np.diff(to[first + np.arange(len(first))]))
        return np.concatenate(out), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte (or bit) planes of unsigned ids, least first."""
    raw = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(ids.itemsize)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(spread.shape[1])]


def from_planes(planes: list[bytes], n: int, itemsize: int, bits: bool) -> np.ndarray:
    kind = np.uint16 if itemsize == 2 else np.uint32
    if not bits:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8, n) for p in planes], 1)).view(kind)[:, 0]
    spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.ascontiguousarray(np.packbits(spread, axis=1, bitorder="little")).view(kind)[:, 0]


def write_file(out, ids: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, bits: bool, level: int = 3) -> None:
    """ids: all of the file; doc_ids, null, lengths: of its documents in order."""
    pack = zstandard.ZstdCompressor(level=level).compress
    index, at = [], 0
    for k in range(0, len(ids), CHUNK_IDS):
        planes = [pack(p) for p in to_planes(ids[k : k + CHUNK_IDS], bits)]
        for p in planes:
            out.write(p)
        index.append([at, len(ids[k : k + CHUNK_IDS]), *map(len, planes)])
        at += sum(map(len, planes))
    documents = pack(struct.pack("<QBB", len(doc_ids), ids.itemsize, bits) + doc_ids.astype("<i8").tobytes() + lengths.astype("<u8").tobytes() + null.astype("u1").tobytes())
    table = np.array(index, "<u8").tobytes()
    out.write(documents + table + struct.pack("<QQ", len(documents), len(table)) + MAGIC)


class Reader:
    """A file's documents, and any run of its ids."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = self._read(size - 24, 24)
        if tail[16:] != MAGIC:
            raise ValueError("not a plane-shuffled file")
        n_documents, n_index = struct.unpack("<QQ", tail[:16])
        body = self._read(size - 24 - n_index - n_documents, n_documents + n_index)
        unpack = zstandard.ZstdDecompressor().decompress
        documents = unpack(body[:n_documents])
        n, self.itemsize, self.bits = struct.unpack_from("<QBB", documents)
        self.doc_ids = np.frombuffer(documents, "<i8", n, 10)
        self.lengths = np.frombuffer(documents, "<u8", n, 10 + 8 * n).astype(np.int64)
        self.null = np.frombuffer(documents, np.uint8, n, 10 + 16 * n).astype(bool)
        planes = self.itemsize * (8 if self.bits else 1)
        self.index = np.frombuffer(body, "<u8", n_index // 8, n_documents).reshape(-1, 2 + planes).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        data, planes, a = self._read(at, sum(sizes)), [], 0
        unpack = zstandard.ZstdDecompressor().decompress
        for size in sizes:
            planes.append(unpack(data[a : a + size]))
            a += size
        return from_planes(planes, n, self.itemsize, self.bits)

    def documents(self):
        """(id or None, its ids) in order, holding one document and chunk at a time."""
        k, have = 0, np.zeros(0, np.uint16 if self.itemsize == 2 else np.uint32)
        for i, n, null in zip(self.doc_ids.tolist(), self.lengths.tolist(), self.null.tolist(), strict=True):
            parts, missing = [have[:n]], n - len(have)
            have = have[n:]
            while missing > 0:
                chunk = self.chunk(k)
                k += 1
                parts.append(chunk[:missing])
                have, missing = chunk[missing:], missing - len(chunk)
            yield (None if null else i), np.concatenate(parts)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", bits: bool = False) -> DataFrame:
    """Writes the files and returns ``(file, path, n_ids, start)`` for each: ``start`` ids stand in the files before it.
    tokenizer: path of a tokenizer's definition, read here and broadcast (a few MB, whatever the corpus)."""
    spark = docs.sparkSession
    folder = f"{(folder or shared_folder(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    key = F.col(id_col).cast("long")
    files = X.pieces(docs, FILE_BYTES, LEAST_FILES, text_col)
    cuts = docs.select(F.percentile_approx(key, [k / files for k in range(1, files)], F.lit(20 * files)).alias("cuts")).first()["cuts"] or []
    edges = np.array(sorted(set(cuts)), np.int64).view(np.uint64) ^ np.uint64(1 << 63)

    def encode(batches):
        encoder = remembered(shared.value)
        for b in batches:
            ids, at = encoder(b["text"], end_id)
            found = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            file = np.searchsorted(edges, B.ordered_ids(b["doc_id"]), "right")
            yield pa.RecordBatch.from_pydict({"file": pa.array(file, pa.int32()), "doc_id": b["doc_id"].cast(pa.int64()), "wide": pa.array([encoder.wide] * b.num_rows), "ids": found})

    def write(table: pa.Table) -> pa.Table:
        doc_ids = B.ordered_ids(table["doc_id"])
        order = np.argsort(doc_ids, kind="stable")
        if (np.diff(doc_ids[order]) == 0).any():
            order = np.array(sorted(order.tolist(), key=lambda k: (int(doc_ids[k]), table["ids"][k].as_py())), np.int64)
        table = table.take(pa.array(order))
        found = table["ids"].to_pylist()
        kind = np.uint32 if table["wide"][0].as_py() else np.uint16
        lengths = np.array([len(x) for x in found], np.int64) // kind().itemsize
        ids = np.frombuffer(b"".join(found), kind)
        name = f"{folder}/{table['file'][0].as_py():08d}.planes"
        fs, path = pafs.FileSystem.from_uri(name)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        hidden = f"{path}.{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(hidden) as out:
            write_file(out, ids, table["doc_id"].combine_chunks().fill_null(0).to_numpy(), table["doc_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False), lengths, bits)
        fs.move(hidden, path)
        return pa.table({"file": pa.array([table["file"][0].as_py()], pa.int32()), "path": [name], "n_ids": pa.array([len(ids)], pa.int64())})

    texts = docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = texts.mapInArrow(encode, "file int, doc_id long, wide boolean, ids binary")
    written = cut(encoded.groupBy("file").applyInArrow(write, "file int, path string, n_ids long")).withColumn("run", F.floor(F.col("file") / RUN_FILES))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row for a run of files
    runs = written.groupBy("run").agg(F.sum("n_ids").alias("n")).select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("run").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return written.join(runs, "run").select("file", "path", "n_ids", (F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("start"))


_ENCODERS: dict[int, Encoder] = {}


def remembered(definition: str) -> Encoder:
    """One encoder for each worker process and definition, with the words it knows."""
    key = zlib.crc32(definition.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def read_token_files(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files themselves."""
    count = max(1, files.count())

    def run(batches):
        for b in batches:
            for name, start in zip(b["path"].to_pylist(), b["start"].to_pylist(), strict=True):
                fs, path = pafs.FileSystem.from_uri(name)
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
                with fs.open_input_file(path) as f:
                    for doc_id, ids in Reader(f).documents():
                        out["doc_id"].append(doc_id), out["start"].append(start), out["n_tokens"].append(len(ids))
                        out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return files.select("path", "start", "file").repartitionByRange(count, "file").select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
