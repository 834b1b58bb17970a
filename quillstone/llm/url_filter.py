"""URL filters by dated lists: every capture is judged by the entries active when it was fetched. DataFrame functions only.

List entries are changes: a pattern is added to or removed from a list at a time. The changes of a pattern become validity
intervals, cut into periods; a capture's URL gives the patterns that may match it (its host, the domains above that, the prefixes
of its path), and an as-of join on pattern and period finds the interval that the fetch time falls in. A capture is blocked if a
blocking list matches and no allowing list does.

Hot hosts: patterns that many captures of a period ask for are counted, and only these are salted by the captures' ids, their
intervals repeated for each salt. There are at most ``HOT_KEYS`` of them, which bounds what is broadcast. Changes of one pattern are
first reduced within each period, so that no window sees more than a pattern's changes of state. Matches are grouped by capture.

Defined results: a null or unreadable URL, or a null fetch time, matches nothing and isn't blocked; an addition and a removal at
one time leave the pattern on the list; an entry holds from its own time on, up to but without that of its removal; repeated entries
count once; entries with nulls count not at all; other columns of captures pass through, whatever their names, except that ``lists``
and ``blocked`` are replaced. Rows are judged each by their own URL and time, whatever their ids: null, or of several rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import cut
from .exchange import free

PERIOD_S = 360 * 86_400
#: Captures of a pattern and period that one task takes at least, and keys above that at most.
HOT_ROWS, HOT_KEYS = 1_000, 10_000
KINDS = ("host", "domain", "path")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]]+)", 1))
    return F.when(host != "", host)


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]+(/[^?#]*)", 1), "/"), lambda x: x != "")


def _upto(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def patterns(url: Column, depth: int) -> Column:
    """All ``kind:pattern`` that a list could hold of this URL; paths of ``depth`` segments at most."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(_upto(F.size(labels) - 1), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = _segments(url)
    paths = F.transform(_upto(F.least(F.size(segments), F.lit(depth))), lambda i: F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    return F.when(host.isNotNull(), F.concat(F.array(F.concat(F.lit("host:"), host)), domains, paths))


def _folded(pattern: Column) -> Column:
    """Hosts in lower case; paths as they are, for their case counts."""
    return F.concat(F.lower(F.regexp_extract(pattern, "^[^/]*", 0)), F.regexp_replace(pattern, "^[^/]*", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, allows, pattern, since, until)`` from changes ``(list, allows, kind, pattern, action, at)``; until: null if open."""
    changes = entries.where(F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove")).select(
        "list", "allows", F.concat("kind", F.lit(":"), _folded(F.col("pattern"))).alias("pattern"), F.col("at").cast("timestamp").alias("at"), (F.col("action") == "add").alias("on")
    )
    changes = changes.dropna().groupBy("list", "allows", "pattern", "at").agg(F.max("on").alias("on"))
    key = ["list", "allows", "pattern"]
    changes = changes.withColumn("period", F.floor(F.unix_timestamp("at") / PERIOD_S))
    for parts, first in ((["period"], None), ([], False)):  # within periods, then over all
        w = Window.partitionBy(*key, *parts).orderBy("at")
        before = F.lag("on").over(w)
        changes = changes.withColumn("before", before if first is None else F.coalesce(before, F.lit(first)))
        changes = changes.where(F.col("before").isNull() | (F.col("before") != F.col("on"))).drop("before")
    w = Window.partitionBy(*key).orderBy("at")
    return changes.withColumn("until", F.lead("at").over(w)).where("on").select(*key, F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """``captures`` with ``lists`` (sorted names of the lists that match, blocking and allowing) and ``blocked``."""
    captures = captures.drop("lists", "blocked")
    mine, of, lists, allowed, listed = (free(captures.columns, c) for c in ("__mine", "__id", "__lists", "__allowed", "__listed"))
    depth = entries.where("kind = 'path'").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    time, period = F.col(f"`{time_col}`").cast("timestamp"), lambda t: F.floor(F.unix_timestamp(t) / PERIOD_S)
    parts = (F.col(f"`{id_col}`").cast("string"), F.unix_micros(time).cast("string"), F.col(f"`{url_col}`"))
    key = F.unhex(F.md5(F.concat(*[x for c in parts for x in (F.coalesce(c, F.lit("~")), F.lit("|"))])))  # equal only where id, time and URL are
    asked = captures.select(key.alias("__id"), time.alias("__t"), F.explode(patterns(F.col(f"`{url_col}`"), depth)).alias("pattern"))
    asked = asked.where("__t IS NOT NULL").withColumn("period", period(F.col("__t")))
    counts = cut(asked.groupBy("pattern", "period").count())
    size = counts.agg(F.sum("count").alias("n"), F.min("period").alias("first"), F.max("period").alias("last")).first()
    most = max(HOT_ROWS, -(-(size["n"] or 0) // HOT_KEYS))
    hot = F.broadcast(counts.where(F.col("count") > most).select("pattern", "period", F.ceil(F.col("count") / most).cast("int").alias("salts")))  # HOT_KEYS rows at most
    held = intervals(entries).withColumn("from", F.greatest(period(F.col("since")), F.lit(size["first"])))
    held = held.withColumn("to", F.least(F.coalesce(period(F.col("until")), F.lit(size["last"])), F.lit(size["last"]))).where("`from` <= `to`")
    held = held.withColumn("period", F.explode(F.sequence("from", "to"))).drop("from", "to").join(hot, ["pattern", "period"], "left")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    asked = asked.join(hot, ["pattern", "period"], "left").withColumn("salt", F.pmod(F.xxhash64("__id"), F.coalesce("salts", F.lit(1))).cast("int"))
    active = asked.join(held, ["pattern", "period", "salt"]).where("__t >= since AND (until IS NULL OR __t < until)")
    matched = active.groupBy("__id").agg(F.array_sort(F.collect_set("list")).alias(lists), F.bool_or("allows").alias(allowed), F.bool_or(~F.col("allows")).alias(listed))
    out = captures.withColumn(mine, key).join(matched.withColumnRenamed("__id", of), F.col(mine) == F.col(of), "left")
    return out.select(
        *[F.col(f"`{c}`") for c in captures.columns],
        F.coalesce(lists, F.array().cast("array<string>")).alias("lists"),
        F.coalesce(F.col(listed) & ~F.col(allowed), F.lit(False)).alias("blocked"),
    )
