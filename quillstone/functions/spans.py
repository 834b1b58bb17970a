"""Where quoted text stands in a document, in characters of the document as it is."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import EDGE

SPAN = "array<struct<text:string,start:int,end:int>>"


class Located:
    """A normalised text and, for each of its characters, the place of the one it came from. Characters whose lower case is longer
    than one keep all of it, with one place each; ``shifted`` says that there are such."""

    def __init__(self, text: str):
        pieces, places = [], []
        at = 0
        for word in text.split():
            start = text.index(word, at)
            at = start + len(word)
            if pieces:
                pieces.append(" ")
                places.append(last)
            last = at
            low = word.lower() if len(word.lower()) == len(word) else "".join(c.lower() for c in word)
            pieces.append(low)
            places += range(start, at)
        self.norm, self.places = "".join(pieces), places
        self.shifted = len(self.norm) != len(places)

    def find(self, quote: str) -> tuple[int, int] | None:
        """Start and end of the first occurrence, forgiving punctuation at the quote's ends; None if there is none."""
        wanted = " ".join(quote.lower().split())
        for needle in (wanted, wanted.strip(EDGE)):
            if needle and (at := self.norm.find(needle)) >= 0 and at + len(needle) <= len(self.places):
                return self.places[at], self.places[at + len(needle) - 1] + 1
        return None


def locate(text: Column, quotes: Column) -> Column:
    """The quotes that occur in the text, with their places; others are left out. The text is normalised once for all."""

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, quotes_ in zip(texts, lists, strict=True):
            doc, found = Located(t or ""), []
            for q in [] if quotes_ is None else list(np.asarray(quotes_, object)):
                if q is not None and (place := doc.find(q)):
                    found.append({"text": q, "start": place[0], "end": place[1]})
            out.append(found)
        return pd.Series(out)

    return run(text, quotes)


def distinct_quotes(quotes: Column, norm) -> Column:
    """The first of each text that normalises alike, without empty ones; norm: Column -> Column."""
    return F.aggregate(
        quotes,
        F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("kept")),
        lambda acc, q: F.when((norm(q) == "") | F.array_contains(acc["keys"], norm(q)), acc).otherwise(
            F.struct(F.array_append(acc["keys"], norm(q)).alias("keys"), F.array_append(acc["kept"], q).alias("kept"))
        ),
    )["kept"]


def disjoint_marks(marks: Column) -> Column:
    """Marks by start, the longer first, without those that begin before the end of the last one kept; marks: structs with
    ``start`` and ``end``."""
    ordered = F.array_sort(F.transform(marks, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("far"))))
    folded = F.aggregate(
        ordered,
        F.struct(F.lit(-1).cast("int").alias("last"), F.array().cast("array<struct<start:int,end:int>>").alias("kept")),
        lambda acc, m: F.when(m["start"] >= acc["last"], F.struct((-m["far"]).cast("int").alias("last"), F.array_append(acc["kept"], F.struct(m["start"].cast("int").alias("start"), (-m["far"]).cast("int").alias("end"))).alias("kept"))).otherwise(acc),
    )
    return folded["kept"]
