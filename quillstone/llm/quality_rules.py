"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them, the posterior decides.

Each rule looks at one rate of a text and votes good, bad, or not at all where the rate says little. That all must pass is replaced by a
model of two hidden classes: a rule votes right, wrong or not at all at rates of its own in each class, independently within a class.
Expectation-maximisation over the votes of *all* texts estimates these rates, so the rules' accuracies, and the share of good texts,
without any label; a text stays if its posterior probability of being good reaches ``least``.

A text's votes are one of 3^rules patterns, so the model is fitted on counts of patterns: partial counts in each task, one small
shuffle, and 3^rules rows at most on the driver, however many texts there are. Texts are read once, their measures kept.

Defined results: a null or empty text has zero of everything, fails the base rule and is not kept; rows of one id are judged each;
rules whose rate has no denominator abstain; where no rule votes the posterior is the share of good texts; an empty table gives an
empty table. Words are runs of other bytes than ASCII white space, lines are parted by newlines.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .components import kept, new_path


@dataclasses.dataclass(frozen=True)
class Rule:
    """Votes on ``top / bottom``: good within ``good``, bad outside ``fair``, else no vote; none below ``enough`` at the bottom."""

    name: str
    top: str
    bottom: str
    good: tuple[float, float]
    fair: tuple[float, float]
    enough: int = 1


ANY = float("inf")
RULES = (
    Rule("word_length", "word_chars", "n_words", (4.0, 7.0), (3.0, 10.0), 20),
    Rule("symbols", "n_symbols", "n_words", (0, 0.02), (0, 0.1), 20),
    Rule("same_lines", "n_dup_lines", "n_lines", (0, 0.1), (0, 0.3), 4),
    Rule("same_words", "n_repeat_words", "n_words", (0, 0.1), (0, 0.3), 20),
    Rule("capitals", "n_capitals", "n_letters", (0, 0.1), (0, 0.3), 40),
    Rule("sentences", "n_ended", "n_lines", (0.6, 1), (0.1, 1), 4),
    Rule("letters", "n_letters", "word_chars", (0.8, 1), (0.7, 1), 40),
    Rule("bare_marks", "n_bare", "n_words", (0, 0.05), (0, 0.2), 20),
    Rule("exclamations", "n_exclaimed", "n_words", (0, 0.05), (0, 0.25), 20),
)
#: Texts that each kind of vote of a rule is thought to have had in either class beforehand, and the first guess of being good by number of bad votes.
PSEUDO, FIRST = 0.5, np.array([0.95, 0.3, 0.1, 0.05])
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_letters", "n_capitals", "n_exclaimed", "n_bare"]


def _among(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SYMBOL, ENDS, CAPITAL = _among(b"#*$%&|<>"), _among(b".!?"), _among(bytes(range(65, 91)))
LETTER = CAPITAL | _among(bytes(range(97, 123))) | _among(bytes(range(0xC3, 256)))  # and what begins a letter beyond ASCII
SPOKEN = LETTER | _among(b"0123456789")
BEGINS = ~_among(bytes(range(0x80, 0xC0)))  # not a code point's further byte


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of a text's bytes (or words) are marked."""
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])


def _seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one before them, and which an equal one anywhere."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return before, twice


def _lines(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each line that has a word, and the end of its last word."""
    breaks = np.flatnonzero(raw == 10)
    begin = np.union1d(offsets[:-1], breaks + 1)
    begin = begin[begin < len(raw)]
    line = np.searchsorted(begin, starts, "right") - 1  # of each word
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    last = np.concatenate((first[1:], [len(line)])) - 1
    begin = begin[line[first]]
    stop = np.concatenate((breaks, [len(raw)]))[np.searchsorted(breaks, begin)]
    doc = np.searchsorted(offsets, begin, "right") - 1
    return begin, np.minimum(stop, offsets[doc + 1]), doc, ends[last]


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text."""
    raw, offsets = B.text_bytes(column)
    out = {k: np.zeros(len(offsets) - 1, np.int64) for k in MEASURES}
    for i, j in B.chunks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        part = raw[offsets[i] : offsets[j]]
        starts, ends, first_word = B.word_spans(part, at)
        if not len(starts):
            continue
        put = lambda name, x: out[name].__setitem__(slice(i, j), x)  # noqa: E731, B023
        put("n_words", np.diff(first_word))
        put("word_chars", _sums(BEGINS[part] & ~B.IS_SPACE[part], at))
        put("n_symbols", _sums(SYMBOL[part], at))
        put("n_letters", _sums(LETTER[part], at))
        put("n_capitals", _sums(CAPITAL[part], at))
        put("n_exclaimed", _sums(part == 33, at))
        spoken = np.concatenate(([0], np.cumsum(SPOKEN[part])))
        put("n_bare", _sums(spoken[ends] == spoken[starts], first_word))
        begin, stop, doc, ended = _lines(part, at, starts, ends)
        count = j - i
        put("n_lines", np.bincount(doc, minlength=count))
        put("n_ended", np.bincount(doc, ENDS[part[ended - 1]], minlength=count).astype(np.int64))
        lines = B.mix(B.span_hashes(part, begin, stop) ^ B.mix(doc.astype(np.uint64), 3))
        put("n_dup_lines", np.bincount(doc, _seen(lines)[0], minlength=count).astype(np.int64))
        of_word = np.repeat(np.arange(count), np.diff(first_word))
        inside = B.inside_one(first_word, 3)
        runs = np.flatnonzero(inside)
        if len(runs):
            hashes = B.windows(B.span_hashes(part, starts, ends), 3)[runs]
            again = runs[_seen(B.mix(hashes ^ B.mix(of_word[runs].astype(np.uint64), 5)))[1]]
            covered = np.zeros(len(starts), bool)
            for k in range(3):
                covered[again + k] = True
            put("n_repeat_words", _sums(covered, first_word))
    return out


def votes(found: dict[str, np.ndarray], rules: tuple[Rule, ...] = RULES) -> np.ndarray:
    """(texts, rules): 1 good, -1 bad, 0 no vote."""
    out = np.zeros((len(found["n_words"]), len(rules)), np.int8)
    for r, rule in enumerate(rules):
        bottom = found[rule.bottom]
        rate = found[rule.top] / np.maximum(bottom, 1)
        inside = lambda bounds: (rate >= bounds[0]) & (rate <= bounds[1])  # noqa: E731, B023
        out[:, r] = np.where(bottom < rule.enough, 0, np.where(inside(rule.good), 1, np.where(inside(rule.fair), 0, -1)))
    return out


@dataclasses.dataclass
class Model:
    """``share``: of good texts. ``rates[c, r]``: how often rule r votes bad, not at all, and good on texts of class c (0 bad, 1 good)."""

    share: float
    rates: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """(class, rule): how often a rule is right where it votes."""
        right = np.stack([self.rates[0, :, 0], self.rates[1, :, 2]])
        return right / (self.rates[:, :, 0] + self.rates[:, :, 2])

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Probability of being good for each row of votes."""
        rule = np.arange(v.shape[1])
        bad, good = (np.log(self.rates[c, rule, v.astype(np.int64) + 1]).sum(1) + np.log(s) for c, s in ((0, 1 - self.share), (1, self.share)))
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fit(v: np.ndarray, n: np.ndarray, rounds: int = 500, enough: float = 1e-9) -> Model:
    """Expectation-maximisation over distinct rows of votes and how many texts have each. It begins from what rules that must all pass
    would say, softened by how many do not; a rule that its class's texts contradict is taken as worthless, not as its opposite."""
    p = FIRST[np.minimum((v == -1).sum(1), len(FIRST) - 1)]
    rates, share = np.full((2, v.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds):
        counts = np.stack([[(weight[:, None] * (v == x)).sum(0) for x in (-1, 0, 1)] for weight in ((1 - p) * n, p * n)]).transpose(0, 2, 1) + PSEUDO
        before, rates = rates, counts / counts.sum(2, keepdims=True)
        wrong = (rates[0, :, 0] < rates[1, :, 0]) | (rates[0, :, 2] > rates[1, :, 2])
        whole = counts.sum(0) / counts.sum((0, 2))[:, None]
        rates = np.where(wrong[None, :, None], whole[None], rates)
        share = float((p @ n + 1) / (n.sum() + 2))
        model = Model(share, rates)
        p = model.posterior(v)
        if abs(rates - before).max(initial=0) < enough:
            break
    return model


def unpacked(pattern: np.ndarray, rules: int) -> np.ndarray:
    """Votes of pattern numbers: base 3, the first rule lowest, 0 bad, 1 none, 2 good."""
    return (pattern[:, None] // 3 ** np.arange(rules) % 3 - 1).astype(np.int8)


def judge_quality(docs: DataFrame, least: float = 0.5, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """``(doc_id, measures, base_failed, votes, quality, kept)`` and the model. base_failed: under 50 words, or more than half of them in runs of
    three that the text repeats; votes: one of ``+-.`` a rule."""
    if len(rules) > 12:
        raise ValueError("patterns of more than 12 rules are too many to count: 3^12 is half a million")

    def measured(batches):
        for b in batches:
            found = measures(b["text"])
            pattern = (votes(found, rules).astype(np.int64) + 1) @ 3 ** np.arange(len(rules))
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(found[k]) for k in MEASURES], pa.array(pattern)], ["doc_id", *MEASURES, "pattern"])

    schema = ", ".join(f"{c} long" for c in ["doc_id", *MEASURES, "pattern"])
    rows = kept(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(measured, schema), new_path(docs.sparkSession, "quality"))
    counts = rows.groupBy("pattern").count().orderBy("pattern").collect()  # 3^rules rows at most
    pattern = np.array([r["pattern"] for r in counts], np.int64)
    v = unpacked(pattern, len(rules))
    model = fit(v, np.array([r["count"] for r in counts], np.float64))
    shown = ["".join(".+-"[x] for x in row) for row in v.tolist()]
    table = rows.sparkSession.createDataFrame(list(zip(pattern.tolist(), shown, model.posterior(v).tolist(), strict=True)), "pattern long, votes string, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(F.broadcast(table), "pattern").withColumn("base_failed", failed)
    return out.select("doc_id", *MEASURES, "base_failed", "votes", "quality", (~F.col("base_failed") & (F.col("quality") >= least)).alias("kept")), model
