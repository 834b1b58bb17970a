"""Reviews of contracts: summaries, order of work, reports, and their store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tones in order of triage, decisions and how reports call them.
TONES = ["red", "amb", "grn", "gry"]
DECISIONS = {"ok": "Accepted", "flag": "Flagged", "skip": "Dismissed"}
ID_SHAPE = "^[A-Za-z0-9_-]{1,64}$"


def summary(items: DataFrame, review: str = "review_id") -> DataFrame:
    """Counts of a review's findings by tone, kind and decision. Items: kind (position or clause), tone, decision."""
    position, clause, tone = F.col("kind") == "position", F.col("kind") == "clause", F.col("tone")
    one = lambda c: F.count_if(c)
    return items.groupBy(review).agg(
        *[one(position & (tone == t)).alias(t) for t in TONES[:3]], one(clause & (tone == "grn")).alias("found"), one(clause & (tone == "gry")).alias("missing"),
        one(F.col("decision").isNotNull()).alias("decided"), one(F.col("decision") == "flag").alias("flagged"), F.count("*").alias("total"),
    )


def dashboard(summaries: DataFrame) -> DataFrame:
    """Totals over the reviews that are done."""
    done = F.col("status") == "done"
    return summaries.agg(F.count_if(done).alias("reviews_done"), *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c) for c in ("red", "amb", "grn", "found", "decided", "total")])


def tone_rank() -> Column:
    return F.array_position(F.array(*map(F.lit, TONES)), F.col("tone"))


def triage(items: DataFrame, review: str = "review_id", position: str = "pos") -> DataFrame:
    """Adds ``place``: positions before clauses, by tone, then as they stood."""
    w = Window.partitionBy(review).orderBy(F.when(F.col("kind") == "position", 0).otherwise(1), tone_rank(), position)
    return items.withColumn("place", F.row_number().over(w))


def shown(items: DataFrame, tone: str | None, undecided: bool, open_item: Column, review: str = "review_id") -> DataFrame:
    """Items that a filter shows, with the open one; all of a review where it would show none."""
    wanted = F.lit(True) if tone is None else F.col("tone") == tone
    if undecided:
        wanted = wanted & F.col("decision").isNull()
    rows = items.withColumn("__w", wanted).withColumn("__any", F.max(F.col("__w").cast("int")).over(Window.partitionBy(review)))
    return rows.where(F.col("__w") | open_item | (F.col("__any") == 0)).drop("__w", "__any")


def next_undecided(placed: DataFrame, review: str = "review_id") -> DataFrame:
    """Adds ``next``: the place of the next item without a decision, going round; null without one."""
    after = Window.partitionBy(review).orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    undecided = F.when(F.col("decision").isNull(), F.col("place"))
    first = F.min(undecided).over(Window.partitionBy(review))
    return placed.withColumn("next", F.coalesce(F.min(undecided).over(after), first))


def status_now(status: Column, updated: Column, now: Column, after_s: int = 180) -> Column:
    """A run that hasn't been heard of for a while is an error."""
    return F.when(status.isin("queued", "running") & (now - updated > after_s), "error").otherwise(status)


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(ID_SHAPE), F.lit(False))


def valid_decision(c: Column) -> Column:
    return c.isNull() | c.isin(list(DECISIONS))


def nda(text: Column, chars: int = 6_000) -> Column:
    # Fixed value: what a non-disclosure agreement says of itself.
    return F.substring(text, 1, chars).rlike(r"(?i)non-?\s?disclosure|confidentiality agreement|\bNDA\b")


def is_heading(line: Column) -> Column:
    """All capitals, or a short numbered line that doesn't end a sentence."""
    t = F.trim(line)
    letters = F.regexp_replace(t, "[^A-Za-z]", "")
    # How sections begin and sentences end.
    numbered = t.rlike(r"^(\d+(\.\d+)*\.?|§\s*\d+|[A-Z]\.|ARTICLE\s+[IVXLC\d]+|Section\s+\d+)\s") & (F.length(t) < 60) & ~t.rlike("[.;:!?][\"'”’)]*$")
    return (t != "") & (F.length(t) <= 80) & (((F.length(letters) >= 4) & (letters == F.upper(letters))) | numbered)


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, block, kind, start, end)``: lines that aren't blank, with their kinds and offsets; these are running sums of lengths."""
    line = F.col("line")
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select(key, "pos", F.when(F.trim(line) != "", F.when(is_heading(line), "heading").otherwise("para")).alias("kind"), F.length(line).alias("n"), F.length(F.ltrim(line)).alias("bare"))
    of = Window.partitionBy(key).orderBy("pos")
    end = F.sum(F.col("n") + 1).over(of) - 1
    rows = lines.select(key, "pos", "kind", (end - F.col("bare")).cast("int").alias("start"), end.cast("int").alias("end")).where("kind IS NOT NULL")
    return rows.select(key, (F.row_number().over(of) - 1).alias("block"), "kind", "start", "end")


def contract_markdown(title: Column, text: Column) -> Column:
    """The contract with its headings marked."""
    parts = F.transform(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), lambda s: F.concat(F.when(is_heading(s), "## ").otherwise(""), F.trim(s), F.lit("\n")))
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(parts, "\n"))


def called(decision: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv]), decision), decision)


def item_markdown() -> Column:
    """A finding as Markdown: status and decision, note, comment, quotes."""
    reviewer = F.when(F.col("decision").isNotNull(), F.concat(F.lit(" · Reviewer: **"), called(F.col("decision")), F.lit("**"))).otherwise(" · Not yet reviewed")
    quotes = F.transform("quotes", lambda q: F.concat(F.lit("> "), F.trim(F.regexp_replace(q, r"\s+", " ")), F.lit("\n\n")))
    return F.concat(
        F.lit("### "), "title", F.lit("\n\n**"), "status", F.lit("**"), reviewer, F.lit("\n\n"),
        F.when(F.col("note") != "", F.concat(F.lit("**Why it matters:** "), "note", F.lit("\n\n"))).otherwise(""),
        F.when(F.col("comment") != "", F.concat(F.lit("**Reviewer comment:** "), "comment", F.lit("\n\n"))).otherwise(""), F.array_join(quotes, ""),
    )


# The groups of a report, the rows of its table by task, and how tasks are called.
GROUPS = [("position", "red", "Needs attention"), ("position", "amb", "Not addressed"), ("position", "grn", "Meets standard"), ("clause", "grn", "Clauses found"), ("clause", "gry", "Clauses not detected")]
TABLE = {"compliance": [("Needs attention", "red"), ("Not addressed", "amb"), ("Meets standard", "grn")], "clauses": [("Clauses found", "found"), ("Clauses not detected", "missing")]}
TASKS = {"compliance": "playbook positions", "clauses": "clause inventory"}


def review_markdown(items: DataFrame, reviews: DataFrame, review: str = "review_id") -> DataFrame:
    """``(review_id, markdown)``: what was reviewed, when, for whom and how far, a table of counts, and the findings by group. Reviews:
    document_name, reviewed (as it is to be shown), representing, tasks. A review's findings are tens of rows."""
    titles = F.create_map(*[F.lit(x) for k, t, name in GROUPS for x in (f"{k}/{t}", name)])
    bullet = F.concat(F.lit("- "), "title", F.coalesce(F.concat(F.lit(" ("), called(F.col("decision")), F.lit(")")), F.lit("")), F.lit("\n"))
    rows = triage(items, review).withColumn("group", F.element_at(titles, F.concat("kind", F.lit("/"), "tone"))).withColumn("md", F.when(F.col("group") == GROUPS[-1][2], bullet).otherwise(item_markdown()))
    joined = lambda order, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c.alias("md")))), lambda x: x["md"]), "")
    grouped = rows.where("group IS NOT NULL").groupBy(review, "group").agg(F.min("place").alias("first"), F.count("*").alias("n"), joined("place", F.col("md")).alias("md"))
    after = F.when(F.col("group") == GROUPS[-1][2], "\n").otherwise("")
    body = grouped.groupBy(review).agg(joined("first", F.concat(F.lit("## "), "group", F.lit(" ("), "n", F.lit(")\n\n"), "md", after)).alias("body"))
    names = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("\n"))
    head = F.concat(
        line("# Contract review: ", F.col("document_name")), F.lit("\n"), line("- Reviewed: ", F.col("reviewed")),
        F.when(F.col("representing") != "", line("- Acting for: ", F.col("representing"))).otherwise("\n"),
        line("- Checks: ", F.array_join(F.transform("tasks", lambda t: names[t]), ", ")),
        line("- Reviewer progress: ", F.col("decided").cast("string"), " of ", F.col("total").cast("string"), " findings decided", F.when(F.col("flagged") > 0, F.concat(F.lit(", "), "flagged", F.lit(" flagged"))).otherwise("")),
        F.lit("\n## Summary\n\n| | Count |\n|---|---|\n"),
    )
    table = F.concat(*[F.when(F.array_contains("tasks", task), F.concat(*[line(f"| {name} | ", F.col(c).cast("string"), " |") for name, c in of])).otherwise("") for task, of in TABLE.items()])
    whole = F.concat(head, table, F.lit("\n"), F.coalesce("body", F.lit("")))
    return reviews.join(summary(items, review), review).join(body, review, "left").select(review, F.substring(whole, F.lit(1), F.length(whole) - 1).alias("markdown"))
