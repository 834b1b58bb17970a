"""Building labelled datasets: nested inputs to rows, prompts and back, label rules, unions of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def flatten_inference(raw: DataFrame) -> DataFrame:
    """Documents with spans by offset and annotations by hypothesis -> a row for each document and hypothesis, evidence as text:
    indices out of bounds and blank spans are dropped and counted."""
    docs = raw.select(F.explode("documents").alias("d"), "labels")
    rows = docs.select("d.id", "d.text", "d.spans", F.explode(F.element_at("d.annotation_sets", 1)["annotations"]).alias("hypothesis_id", "a"), "labels")
    inside = F.filter("a.spans", lambda i: (i >= 0) & (i < F.size("spans")))
    texts = F.transform(inside, lambda i: X.bind(F.element_at("spans", (i + 1).cast("int")), lambda s: F.trim(F.substring(F.col("text"), s[0] + 1, s[1] - s[0]))))
    rows = rows.withColumn("all", texts)
    return rows.select(
        F.col("id").alias("doc_id"), "hypothesis_id", F.col("labels")[F.col("hypothesis_id")]["hypothesis"].alias("hypothesis"), F.col("a.choice").alias("verdict"),
        F.filter("all", lambda t: t != "").alias("evidence"), (F.size("a.spans") - F.size(F.filter("all", lambda t: t != ""))).alias("n_dropped"), "text",
    )


def flatten_questions(raw: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Paragraphs with questions -> a row for each contract and category; the category is what follows the last ``__`` of the id.
    Answers that the context doesn't hold are dropped; a question whose answers all are is dropped itself."""
    paragraphs = raw.select(F.explode("data").alias("x")).select("x.title", F.explode("x.paragraphs").alias("p"))
    rows = paragraphs.select(F.col("title").alias("contract"), F.col("p.context").alias("text"), F.explode("p.qas").alias("q"))
    rows = rows.select("contract", "text", F.element_at(F.split("q.id", "__"), -1).alias("category"), F.transform("q.answers", lambda a: a["text"]).alias("given"))
    if categories is not None:
        rows = rows.where(F.col("category").isin(categories))
    evidence = X.bind(X.norm("text"), lambda hay: F.array_distinct(F.filter(F.col("given"), lambda a: (X.norm(a) != "") & F.contains(hay, X.norm(a)))))
    rows = rows.withColumn("evidence", evidence)
    return rows.where((F.size("given") == 0) | (F.size("evidence") > 0)).select("contract", "category", (F.size("evidence") > 0).alias("present"), "evidence", "text")


def message(messages: Column, role: str) -> Column:
    """Content of the first message of a role."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def turns(conversations: DataFrame) -> DataFrame:
    """A row for each conversation with its messages in order of turn."""
    return conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def prompt(system: Column, user: Column, reply: Column | None = None, examples: Column | None = None) -> Column:
    """Chat messages: system, turns of examples (structs of user and assistant), the question and, for training, the reply."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    parts = [F.array(turn("system", system))]
    if examples is not None:
        parts.append(F.flatten(F.transform(examples, lambda e: F.array(turn("user", e["user"]), turn("assistant", e["assistant"])))))
    parts.append(F.array(turn("user", user), *([] if reply is None else [turn("assistant", reply)])))
    return F.concat(*parts)


def between(c: Column, head: str, tail: Column) -> Column:
    """What a template put between a fixed head and a tail; null if the text isn't of that shape."""
    return F.when(F.startswith(c, F.lit(head)) & F.endswith(c, tail), F.substring(c, F.lit(len(head) + 1), F.length(c) - len(head) - F.length(tail)))


def question_of(c: Column, mark: str = "\n\nQUESTION: ") -> Column:
    return F.substring_index(c, mark, -1)


def remap(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def union_tasks(parts: dict[str, DataFrame]) -> DataFrame:
    """All tasks in one wide table, each row with its ``task``; fields a task lacks are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("task", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def zip_rows(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Two tables side by side by the number of their row; a row that only one has stands with nulls."""
    return left.join(right, row, "full")


def leaks_schema(reply: Column, keys: list[str]) -> Column:
    """Is a training target a JSON object with just these keys?"""
    return F.coalesce(F.array_sort(F.json_object_keys(reply)) == F.array(*map(F.lit, sorted(keys))), F.lit(False))


def visible(gold: Column, text: Column, from_char: Column, mode: str = "grounded") -> Column:
    """Gold spans still within a text cut off on the left; ``plain`` containment or one that forgives edge punctuation."""
    test = X.grounded if mode == "grounded" else X.contains_norm
    return X.bind(X.norm(F.substring(text, from_char + 1, F.length(text))), lambda hay: F.filter(gold, lambda g: test(X.norm(g), hay)))


def label_windows(windows: DataFrame, gold: str, text: str) -> DataFrame:
    """Windows (with ``char_start`` and ``char_end``) of documents with gold spans: what is visible in each, and presence."""
    part = F.substring(F.col(text), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    seen = X.bind(X.norm(part), lambda hay: F.filter(F.col(gold), lambda g: (X.norm(g) != "") & F.contains(hay, X.norm(g))))
    return windows.withColumn("evidence", seen).withColumn("present", F.size("evidence") > 0)


def or_over_windows(votes: DataFrame, key: list[str], rule: str = "any") -> DataFrame:
    """A question's answer over a document's windows. ``rule``: a window votes for presence if its answer says so (any), if one of
    its quotes is also grounded (grounded), or if one is located (located)."""
    vote = {"any": F.col("present"), "grounded": F.col("present") & (F.col("n_grounded") > 0), "located": F.col("present") & (F.col("n_located") > 0)}[rule]
    rows = votes.withColumn("vote", F.coalesce(vote, F.lit(False)))
    ordered = F.array_sort(F.collect_list(F.when(F.col("vote"), F.struct("window", "evidence"))))
    return rows.groupBy(*key).agg(F.bool_or("vote").alias("present"), F.count_if("vote").alias("n_votes"), F.count("*").alias("n_windows"), F.flatten(F.transform(ordered, lambda x: x["evidence"])).alias("evidence"))


def strongest_verdict(votes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first verdict of an order that any window gives (the last of it without any), with the evidence of those windows."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("verdict"))
    rows = votes.withColumn("r", F.when(rank > 0, rank))
    best = rows.groupBy(*key).agg(F.coalesce(F.min("r"), F.lit(len(order))).alias("best"), F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("window", "r", "evidence")))).alias("all"))
    return best.select(*key, F.element_at(F.array(*map(F.lit, order)), F.col("best").cast("int")).alias("verdict"), F.flatten(F.transform(F.filter("all", lambda x: x["r"] == F.col("best")), lambda x: x["evidence"])).alias("evidence"))


def filter_reasons(df: DataFrame, low: Column, high: Column, strict: bool = False) -> DataFrame:
    """Adds ``reasons`` and ``kept`` to rationales: quotes grounded, evidence in accord with gold, the verdict the prose ends on, and
    length. Needs columns reasoning, verdict, asserted, gold, evidence, text, n_tokens, finish_reason."""
    bad = X.bind(X.norm("text"), lambda hay: F.size(F.filter(X.quoted("reasoning"), lambda q: ~X.grounded(X.norm(q), hay))))
    mode = X.evidence_mode(F.col("gold"), F.col("evidence"))
    accepted = ["ok", "exact"] if strict else ["ok", "exact", "superset", "partial"]
    n = F.col("n_tokens")
    length = F.when(F.col("finish_reason") == "length", "f4_truncated").when(n < low, "f4_too_short").when(n > high, "f4_too_long")
    prose = F.when(F.coalesce(F.col("verdict"), F.lit("")) == "", "f3_no_verdict").when(F.col("asserted").isNull(), "f3_not_stated").when(F.col("asserted") != F.col("verdict"), F.concat(F.lit("f3_concludes_"), F.col("asserted")))
    out = df.withColumn("mode", mode).withColumn("bad", bad)
    found = F.array(F.when(F.col("bad") > 0, F.concat(F.lit("f1_ungrounded_"), F.col("bad").cast("string"))), F.when(~F.col("mode").isin(accepted), F.concat(F.lit("f2_"), F.col("mode"))), prose, length)
    return out.withColumn("reasons", F.array_compact(found)).withColumn("kept", F.size("reasons") == 0).drop("bad")


def note_reasons(df: DataFrame, low: Column, high: Column, white: str = X.WHITE) -> DataFrame:
    """Adds ``reasons`` to notes (columns note, clause): one sentence, length, grounded quotes. Runs of ``white`` become one space."""
    note = F.array_join(F.filter(F.split(F.trim(F.col("note")), white), lambda t: t != ""), " ")
    out = df.withColumn("note", note).withColumn("n_sentences", X.sentence_count("note")).withColumn("n_words", F.size(F.filter(F.split("note", " "), lambda t: t != "")))
    quotes = F.regexp_extract_all("note", F.lit('"([^"]{8,})"'), F.lit(1))
    bad = F.size(F.filter(quotes, lambda q: ~F.contains(X.norm("clause"), X.norm(q))))
    found = F.array(F.when(F.col("n_sentences") != 1, F.concat(F.lit("f1_sentences_"), F.col("n_sentences").cast("string"))), F.when(F.col("n_words") < low, "f2_too_short").when(F.col("n_words") > high, "f2_too_long"), F.when(bad > 0, "f3_ungrounded_quote"))
    return out.withColumn("reasons", F.array_compact(found))


def target_budget(n_prompt: Column, n_target: Column, budget: int) -> Column:
    """Training bookkeeping: the target is kept whole, the prompt gives way on the left."""
    kept = F.greatest(F.least(n_prompt, budget - n_target), F.lit(0))
    return F.struct(kept.alias("n_prompt"), F.least(n_target, F.lit(budget)).alias("n_target"), (kept < n_prompt).alias("truncated"), X.ratio(F.least(n_target, F.lit(budget)), kept + F.least(n_target, F.lit(budget))).alias("loss_share"))


def stratum(task: Column, verdict: Column, present: Column) -> Column:
    """What a stratified draw keeps in proportion: the task, with its answer."""
    return F.concat_ws(":", task, F.coalesce(verdict, F.when(present, "present").when(~present, "absent")))


def char_windows(df: DataFrame, text: str, size: int, stride: int) -> DataFrame:
    """Adds ``window``, ``char_start`` and ``char_end``: windows of ``size`` characters every ``stride``, the last to the end."""
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / F.lit(stride)), F.lit(0)).cast("int")
    rows = df.withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    return rows.withColumn("char_start", F.col("window") * stride).withColumn("char_end", F.least(F.col("window") * stride + size, n))


def overlap_probes(windows: DataFrame, key: str, text: str, length: int, step: int) -> DataFrame:
    """Spans of ``length`` characters within the overlap of two windows next to each other, with their place in each: mapped back, both
    places are one."""
    from pyspark.sql import Window

    follow = F.lead("char_start").over(Window.partitionBy(key).orderBy("window"))
    rows = windows.withColumn("next_start", follow).where(F.col("next_start") + length <= F.col("char_end"))
    at = F.explode(F.sequence(F.col("next_start"), F.col("char_end") - length, F.lit(step)))
    rows = rows.withColumn("at", at).withColumn("in_first", F.col("at") - F.col("char_start")).withColumn("in_second", F.col("at") - F.col("next_start"))
    return rows.withColumn("span", F.substring(F.col(text), F.col("at") + 1, F.lit(length)))
