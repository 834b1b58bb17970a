"""Positions of a playbook as column expressions: tables of lines and sentences, and rules over them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of a playbook.
SEVERITY = r"\b(HIGH|MEDIUM|LOW|CRITICAL)\b"
LIST_MARK = r"(?i)^\s*(\(?[a-z0-9]{1,3}[.)]|[-•*]|\d{1,3})\s+"
SUPPORTING = r"(?i)^(why|fallback|rationale|note|guidance|severity|example)\b[:\s]"
MODAL = r"(?i)\b(may|must|shall|should|will not|cannot|is not|are not)\b"
HEADING = r"(?i)^(section|appendix|schedule|part|annex|version|owner|effective|review cycle)\b"
BOILERPLATE = r"(?i)(\b(internal|page \d+|v\d+\.\d+|©|all rights reserved)\b|@|https?:)"
CAPITALS_BEFORE = r"^(?:[A-Z][A-Z&/\-—·'’\s]{3,}?)(?=[A-Z][a-z])"
AFTER_CAPITALS = r"(?:[A-Z][A-Z&/\-—·'’]{2,}[\s—·-]+)+([A-Z][a-z].*)$"
SHORTEST, LONGEST, FEWEST_MARKED, MOST_POSITIONS = 25, 320, 3, 40

#: What stands before a mark or between sentences while a text is cut; no text holds it.
CUT = "\ue000"


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def tidy(s: Column) -> Column:
    """A sentence without list marks, running capitals before it, and doubled white space."""
    bare = F.regexp_replace(F.regexp_replace(s, LIST_MARK, ""), CAPITALS_BEFORE, "")
    return F.regexp_replace(stripped(bare), r"\s+", " ")


def sentences(s: Column) -> Column:
    parts = F.split(F.regexp_replace(s, r"([.!?])\s+", f"$1{CUT}"), CUT)
    return F.filter(F.transform(parts, tidy), lambda x: x != "")


def closing(s: Column) -> Column:
    """The last sentence of a piece of text; of one that is too long, what follows its capitals."""
    last = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), sentences(s)), -1), F.lit(""))
    after = F.regexp_extract(last, AFTER_CAPITALS, 1)
    return F.when(F.length(last) <= LONGEST, last).otherwise(tidy(F.when(after != "", after).otherwise(last)))


def before_marks(lines: Column) -> Column:
    """What stands before each severity: in its line, or, if a line is little else, in the line above."""

    def of_line(line: Column, i: Column) -> Column:
        pieces = F.split(F.regexp_replace(line, SEVERITY, f"{CUT}$1"), CUT)
        upto = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, F.lit(1), k), ""))
        rest = F.length(F.trim(F.concat(F.get(pieces, F.lit(0)), F.regexp_replace(F.get(pieces, F.lit(1)), f"^{SEVERITY}", ""), F.array_join(F.slice(pieces, F.lit(3), F.size(pieces)), ""))))
        above = F.array(F.coalesce(F.get(lines, i - 1), F.lit("")))
        return F.when(F.size(pieces) == 1, F.array().cast("array<string>")).when(rest < 4, above).otherwise(F.slice(upto, F.lit(1), F.size(upto) - 1))

    return F.flatten(F.transform(lines, of_line))


#: A position satisfies all of these.
RULES = [
    lambda s: F.length(s).between(SHORTEST, LONGEST),
    lambda s: ~s.rlike(SUPPORTING),
    lambda s: ~s.rlike(HEADING),
    lambda s: ~s.rlike(BOILERPLATE),
    lambda s: (F.length(F.regexp_replace(s, "[^A-Za-z]", "")) < 4) | s.rlike("[a-z]"),
]


def positions(playbook: Column) -> Column:
    """The positions of a playbook: sentences marked with a severity, or, where fewer than three are, those with a modal verb; of
    equal ones, but for case and punctuation, the first; 40 at most."""
    lines = F.filter(F.transform(F.split(F.coalesce(playbook, F.lit("")), "\n"), stripped), lambda s: s != "")
    every = lambda s: functools.reduce(operator.and_, (rule(s) for rule in RULES))
    marked = F.filter(F.transform(before_marks(lines), closing), every)
    modal = F.filter(F.flatten(F.transform(lines, sentences)), lambda s: every(s) & s.rlike(MODAL))
    chosen = F.when(F.size(marked) < FEWEST_MARKED, modal).otherwise(marked)
    keyed = F.transform(chosen, lambda s: F.struct(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")).alias("key"), F.when(s.rlike("[.!?]$"), s).otherwise(F.concat(s, F.lit("."))).alias("s")))
    first = F.filter(keyed, lambda x, i: (x["key"] != "") & (F.array_position(F.transform(keyed, lambda y: y["key"]), x["key"]) == i + 1))
    return F.slice(F.transform(first, lambda x: x["s"]), 1, MOST_POSITIONS)
