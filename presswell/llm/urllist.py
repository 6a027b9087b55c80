"""URL filters by a temporal list join.

A list is a history of dated changes: on a day an entry is added or removed.
Consecutive changes of an entry become validity intervals, and each capture is
matched as of its fetch time: with the entries that were active then.  An entry
is a host, which covers its subdomains, or a host and the start of a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswell.llm.common import let, spare

#: Days of one bucket of time; an interval is listed in each bucket it touches.
BUCKET_DAYS = 32


def intervals(changes: DataFrame) -> DataFrame:
    """(entry, valid_from, valid_to) from (entry, day, action).

    ``action`` is 'add' or 'remove'.  An interval runs from an addition to the
    entry's next removal, and without one has no end (null).  A repeated
    addition or removal changes nothing; of changes on one day removal is the
    last.  Rows with a null, or another action, are ignored.
    """
    known = changes.where("entry IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    known = known.select(F.lower(F.rtrim(F.col("entry"), F.lit("/"))).alias("entry"), F.to_date("day").alias("day"), (F.col("action") == "add").alias("on"))
    daily = known.groupBy("entry", "day").agg(F.min("on").alias("on"))
    each = Window.partitionBy("entry").orderBy("day")
    turns = daily.withColumn("was", F.lag("on").over(each)).where("(was IS NULL AND on) OR on <> was")
    return turns.withColumn("valid_to", F.lead("day").over(each)).where("on").select("entry", F.col("day").alias("valid_from"), "valid_to")


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port or a trailing dot; '' if none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])\.?(?::[0-9]*)?(?:[/?#]|$)", 1))


def keys(url: Column) -> Column:
    """All entries that would cover a URL: its host, the host's parents, and
    the host with each start of its path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    part = lambda items, first, many, mark: F.array_join(F.slice(items, first, many), mark)
    parents = lambda labels: F.transform(labels, lambda _, i: part(labels, i + 1, F.size(labels), "."))
    starts = lambda h, steps: F.transform(steps, lambda _, i: F.concat(h, F.lit("/"), part(steps, F.lit(1), i + 1, "/")))
    steps = F.filter(F.split(F.lower(path), "/"), lambda s: s != "")
    both = lambda h: F.concat(let(F.split(h, r"\."), parents), let(steps, lambda s: starts(h, s)))
    return let(host(url), lambda h: F.when(h != "", F.array_distinct(both(h))).otherwise(F.array().cast("array<string>")))


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BUCKET_DAYS).cast("int")


def judged(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``captures`` (url, fetched_at, ...) with ``blocked`` and its reason.

    Adds host, blocked, entry and listed_on: the longest entry that was active
    on the day of the fetch (the first by name among equals) and the day from
    which it was.  A capture's own column of such a name stays and the added one
    gets an underscore in front.  Equal captures are matched once and joined
    back, so neither a popular host nor a repeated capture is dealt to one task
    as a whole: the list side of the join has a row per entry and bucket, and
    Spark may split the captures.  Null or malformed URLs, of any length, and
    null fetch times match nothing and stay, not blocked; all rows and columns
    stay; an empty table of captures gives an empty result, and an empty list
    blocks nothing.
    """
    day = F.to_date("fetched_at")
    once = captures.where("url IS NOT NULL AND fetched_at IS NOT NULL").select("url", "fetched_at").distinct()
    spans = intervals(changes)
    top = F.lit(once.agg(F.max(day)).first()[0]).cast("date")
    ends = F.greatest("valid_from", F.least(F.coalesce("valid_to", top), top))
    listed = (
        spans.where(F.col("valid_from") <= top)
        .withColumn("bucket", F.explode(F.sequence(_bucket(F.col("valid_from")), _bucket(ends))))
        .select("entry", "bucket", "valid_from", "valid_to")
    )
    asked = once.select("url", "fetched_at", F.explode(keys(F.col("url"))).alias("entry"), _bucket(day).alias("bucket"), day.alias("day"))
    met = asked.join(listed, ["entry", "bucket"]).where("valid_from <= day AND (valid_to IS NULL OR day < valid_to)")
    why = met.groupBy("url", "fetched_at").agg(
        F.min(F.struct((-F.length("entry")).alias("size"), "entry", F.col("valid_from").alias("listed_on"))).alias("why"))
    same = (F.col("c.url") == F.col("w.url")) & (F.col("c.fetched_at") == F.col("w.fetched_at"))
    names = {n: spare(captures, n) for n in ("host", "blocked", "entry", "listed_on")}
    return captures.alias("c").join(why.alias("w"), same, "left").select(
        "c.*", host(F.col("c.url")).alias(names["host"]), F.col("w.why").isNotNull().alias(names["blocked"]),
        F.col("w.why.entry").alias(names["entry"]), F.col("w.why.listed_on").alias(names["listed_on"]))
