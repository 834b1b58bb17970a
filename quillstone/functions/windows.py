"""Windows and chunks of documents."""

from __future__ import annotations

import array
import bisect
import functools
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def token_windows(n: Column, content: int = 14_000, stride: int = 12_000, budget: int | None = None, overhead: int = 0) -> Column:
    """Token windows in closed form, as an array of structs: one window where ``n + overhead`` is within the budget (without a
    budget, where it is within ``content``), else one every ``stride`` tokens until one reaches the end."""
    fits = n + overhead <= (budget if budget is not None else content)
    last = F.greatest(F.ceil((n - content) / F.lit(stride)), F.lit(0)).cast("int")
    many = F.transform(F.sequence(F.lit(0), last), lambda w: F.struct(w.alias("window"), (w * stride).cast("int").alias("tok_start"), F.least(w * stride + content, n).cast("int").alias("tok_end"), F.lit(True).alias("windowed")))
    one = F.array(F.struct(F.lit(0).alias("window"), F.lit(0).alias("tok_start"), n.cast("int").alias("tok_end"), F.lit(False).alias("windowed")))
    return F.when(fits, one).when(n > 0, many).otherwise(F.array().cast("array<struct<window:int,tok_start:int,tok_end:int,windowed:boolean>>"))


class Places:
    """Where a text has a character, for asking which is the last in a range."""

    def __init__(self, text: str, char: str):
        self.at = [m.start() for m in re.finditer(re.escape(char), text)]

    def last(self, low: int, high: int) -> int:
        """The last one in ``[low, high)``; -1 if there is none."""
        k = bisect.bisect_left(self.at, high) - 1
        return self.at[k] if k >= 0 and self.at[k] >= low else -1


def whitespace_starts(text: str) -> Sequence[int]:
    """The stand-in tokenizer: where runs of characters that aren't white space begin."""
    return array.array("q", (m.start() for m in re.finditer(r"\S+", text)))


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True  # their strings in a text are ordinary text
    return out


class Starts(Sequence):
    """Where the tokens of an encoding begin, looked up as asked: windows ask for few of them."""

    def __init__(self, encoding):  # noqa: ANN001
        self.encoding, self.n = encoding, len(encoding)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        return self.encoding.token_to_chars(k)[0]


def file_starts(path: str) -> Callable[[str], Sequence[int]]:
    """The tokens of a tokenizer file of the ``tokenizers`` library, which all workers must have at this path: where each begins."""
    return lambda text: Starts(_tokenizer(path).encode(text, add_special_tokens=False))


def chunk_spans(n: int, size: int, overlap: int, snap: Callable[[int, int], int]) -> Iterator[tuple[int, int]]:
    """Spans over n characters of ``size`` each, the next beginning ``overlap`` before the end of one; ``snap(begin, end)`` moves an end
    that isn't the last one."""
    begin = end = 0
    while end < n:
        end = begin + size
        end = snap(begin, end) if end < n else n
        yield begin, end
        begin = max(begin + 1, end - overlap)


def space_chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """An end moves back to a space in its chunk's second half."""
    spaces = Places(text, " ")

    def snap(begin: int, end: int) -> int:
        found = spaces.last(begin + max(1, size // 2), end)
        return end if found < 0 else found

    return chunk_spans(len(text), size, overlap, snap)


def line_windows(text: str, starts: Sequence[int], tokens: int, overlap: int, snap: int) -> Iterator[tuple[int, int]]:
    """Windows of at most ``tokens`` tokens, each beginning ``overlap`` tokens before the end of the one before. Both ends of the overlap
    move back to behind a line break where one is within ``snap`` characters and inside the window."""
    if len(starts) <= tokens:
        yield 0, len(text)
        return
    breaks = Places(text, "\n")

    def snapped(place: int, begin: int) -> int:
        found = breaks.last(max(begin + 1, place - snap), place)
        return place if found < 0 else found + 1

    first = 0
    while len(starts) - first > tokens:
        begin = starts[first]
        end = snapped(starts[first + tokens], begin)
        yield begin, end
        again = starts[max(first + 1, bisect.bisect_left(starts, end) - overlap)]
        first = max(first + 1, bisect.bisect_left(starts, snapped(again, begin)))
    yield starts[first], len(text)


def estimated(text: str, tokens: int, overlap: int, chars_per_token: float, snap: int, count: Callable[[str], int] | None) -> Iterator[tuple[int, int]]:
    """Windows of as many characters as ``tokens`` are estimated to have; with ``count``, one that measures too long shrinks by a
    tenth until it fits."""
    breaks, size = Places(text, "\n"), int(tokens * chars_per_token)

    def fitting(begin: int, end: int) -> int:
        while count is not None and end - begin > 1 and count(text[begin:end]) > tokens:
            end = begin + max(1, (end - begin) * 9 // 10)
        return end

    begin, end = 0, -1
    while end < len(text):
        end = fitting(begin, min(begin + size, len(text)))
        if end < len(text) and (line := breaks.last(max(begin + 1, end - snap), end)) >= 0:
            end = line + 1
        yield begin, end
        begin = max(begin + 1, end - int(overlap * chars_per_token))


#: Bytes of rows that Python is handed at once.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches bounded by bytes, not only by their number, in queries started after this call: a worker then holds
    as much whatever its part of a table is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def _each(docs: DataFrame, text: str, schema: str, cut: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """``docs`` with a row for each piece of a text, as a table function that yields them one by one: a text's pieces are never one array."""

    @F.udtf(returnType=schema, useArrow=True)
    class Pieces:
        def eval(self, text: str):  # noqa: ANN202
            yield from cut(text or "")

    small_batches(docs.sparkSession)
    return docs.lateralJoin(Pieces(F.col(text).outer()))


def char_chunks(docs: DataFrame, text: str = "text", size: int = 900, overlap: int = 200) -> DataFrame:
    """``docs`` with (chunk, start, end, chunk_text) for each chunk."""
    return _each(docs, text, "chunk int, start int, `end` int, chunk_text string", lambda t: ((k, a, b, t[a:b]) for k, (a, b) in enumerate(space_chunks(t, size, overlap))))


def parent_chunks(docs: DataFrame, text: str = "text", child: int = 300, parent: int = 1200, overlap: int = 80) -> DataFrame:
    """``docs`` with small chunks, each with the larger one about its middle: (chunk, start, child, parent)."""

    def cut(t: str) -> Iterator[tuple]:
        for k, (a, b) in enumerate(space_chunks(t, child, overlap)):
            low = max(0, (a + b - parent) // 2)
            yield k, a, t[a:b], t[low : low + parent]

    return _each(docs, text, "chunk int, start int, child string, parent string", cut)


def serving_windows(docs: DataFrame, tokens: int, overlap: int, text: str = "text", snap: int = 400, starts: Callable[[str], Sequence[int]] = whitespace_starts) -> DataFrame:
    """``docs`` with (window, start, end) for each window; ``starts``: text -> where its tokens begin, as ``file_starts`` gives."""
    return _each(docs, text, "window int, start int, `end` int", lambda t: ((k, *x) for k, x in enumerate(line_windows(t, starts(t), tokens, overlap, snap))))


def estimated_windows(docs: DataFrame, tokens: int, overlap: int, text: str = "text", chars_per_token: float = 3.6, snap: int = 400, count: Callable[[str], int] | None = None) -> DataFrame:
    """The same by an estimate of characters for a token."""
    return _each(docs, text, "window int, start int, `end` int", lambda t: ((k, *x) for k, x in enumerate(estimated(t, tokens, overlap, chars_per_token, snap, count))))


def size_estimate(text: Column, chars_per_token: float = 3.6, tokens: int = 14_000, stride: int = 12_000) -> Column:
    """Estimated tokens, windows, and words."""
    n = F.bround(F.length(text) / F.lit(chars_per_token)).cast("int")
    return F.struct(n.alias("tokens"), F.when(n <= tokens, 1).otherwise(F.ceil((n - tokens) / F.lit(stride)) + 1).cast("int").alias("windows"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("words"))
