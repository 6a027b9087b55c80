"""Mixing sources to target weights by weighted fair queueing (native).

Each document of a source enters the queue in shuffled order and, after the
last, once more, for up to three passes.  Its virtual finish time is the
source's cumulative tokens divided by its target.  A document during which its
source's target is reached enters as two entries, so that the first of them
ends there.  All entries are sorted by virtual finish time, over all sources, by
range, and the queue is truncated at the total budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswell.llm.common import materialize, n_words, running, spare

#: Documents that one running sum may hold, on average.
RUN_ROWS = 20_000


def targets(sizes: DataFrame, repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    The budget is the sum of all sizes.  Sources in code point order, null
    last, have ``weights`` in turn; a target stops at ``repeat`` times its
    source's size and the excess is shared by weight among the others, which
    is the water level L with sum(min(cap, L * weight)) = budget.  Ranks and
    levels run over ranges of sources, so that no task holds all of them.
    """
    sums = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    ranked = running(sums, [F.col("source").asc_nulls_last()], F.lit(1).cast("long"), "rank", "source-ranks")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * repeat
    ranked = ranked.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", cap.cast("double") / F.col("weight"))
    order = [F.col("level"), F.col("source").asc_nulls_last()]
    below = running(ranked, order, F.col("cap"), "caps_below", "source-levels")
    below = running(below, order, F.col("weight"), "weights_below", "source-weights")
    budget, all_weights = sums.agg(F.sum("source_size").cast("double")).scalar(), ranked.agg(F.sum("weight")).scalar()
    # What all sources together take at the level where this one is full.
    filled = F.col("caps_below") + F.col("cap") + F.col("level") * (all_weights - F.col("weights_below") - F.col("weight"))
    levels = below.withColumn("budget", budget).withColumn("capped", filled < F.col("budget"))
    free = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0))
    left = F.max("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0))
    levels = levels.withColumn("common", levels.agg(F.when(free > 0, left / free)).scalar())
    cap = F.col("cap").cast("double")
    share = F.when(F.col("capped") | F.col("common").isNull(), cap).otherwise(F.least(cap, F.col("common") * F.col("weight")))
    return levels.select("source", "source_size", F.col("weight").cast("double").alias("weight"), share.alias("target"))


def shuffled(docs: DataFrame, repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "") -> DataFrame:
    """(doc_id, source, size, copies, copy, source_size, target, key, before): one row per input row.

    ``before`` counts the source's words ahead of the document in one pass over
    its shuffled rows.  The shuffle follows ``key``, the MD5 of seed and doc_id,
    so reruns agree.  Rows that agree in source, doc_id and size are one run
    until the end, where ``copy`` numbers them.  The running sum of a source is
    cut by the leading digits of that hash: sums of the cuts are added up first,
    then each cut on its own, so a source with a third of all rows is spread
    over as many tasks as it needs.
    """
    sizes = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "sizes"
    )
    runs = (
        sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("key", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
        .withColumn("words", F.col("size") * F.col("copies"))
    )
    digits = max(1, math.ceil(math.log(max(1, sizes.count() / RUN_ROWS), 16)) + 1)
    runs = runs.withColumn("cut", F.substring("key", 1, digits))
    earlier = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = runs.groupBy("source", "cut").agg(F.sum("words").alias("cut_words")).withColumn("ahead", F.coalesce(F.sum("cut_words").over(earlier), F.lit(0)))
    within = Window.partitionBy("source", "cut").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("inner", F.coalesce(F.sum("words").over(within), F.lit(0)))
    goals = targets(sizes, repeat, weights)
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    return (
        placed.join(cuts, same(placed, cuts, "source", "cut"))
        .select(placed["source"], "doc_id", "size", "copies", "key", (F.col("ahead") + F.col("inner")).alias("before"))
        .alias("p").join(goals.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source")))
        .select("doc_id", "p.source", "size", "copies", "key", "source_size", "target", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        .withColumn("before", F.col("before") + F.col("copy") * F.col("size"))
    )


def queue(docs: DataFrame, repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "") -> tuple[DataFrame, DataFrame]:
    """The shuffled rows, and the queue's entries with ``place`` and ``taken``.

    ``place`` counts the words of all sources that finish earlier, and
    ``taken`` the entry's words that are served before the budget, which is the
    sum of the targets in whole words, is used up.  Documents without words, or
    of a source without a target, have no entry.
    """
    rows = materialize(shuffled(docs, repeat, weights, seed), "shuffled")
    passes = rows.where("size > 0 AND target > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    passes = passes.withColumn("start", F.col("pass") * F.col("source_size") + F.col("before"))
    goal, end = F.floor("target"), F.col("start") + F.col("size")
    # Where the target lies inside, up to there and from there.
    ends = F.when((F.col("start") < goal) & (goal < end), F.array(goal, end)).otherwise(F.array(end))
    parts = passes.select("*", F.posexplode(ends).alias("part", "end"))
    entries = parts.withColumn("words", F.col("end") - F.when(F.col("part") == 1, goal).otherwise(F.col("start"))).withColumn("finish", F.col("end") / F.col("target"))
    order = [F.col("finish"), F.col("key"), F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("size"), F.col("copy"), F.col("pass"), F.col("part")]
    entries = entries.select("doc_id", "source", "size", "copies", "copy", "key", "pass", "part", "words", "finish")
    queued = running(entries, order, F.col("words"), "place", "queue")
    budget = rows.groupBy("source").agg(F.floor(F.max("target")).alias("goal")).agg(F.sum("goal")).scalar()
    return rows, queued.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), budget - F.col("place"))))


_ROW = ("doc_id", "source", "size", "copy")


def mix(docs: DataFrame, repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "") -> DataFrame:
    """What the mix takes of each row of ``docs``.

    Returns (doc_id, size, source_size, target, taken, source, first_finish):
    ``taken`` adds up the words taken over all passes, ``first_finish`` is the
    virtual finish time of the first pass.  Null texts have size 0; null
    sources are one source; sources without words get target 0; null doc_ids
    come first in their source's hash order like any other key; rows may
    repeat; texts of any length count whole; extra columns are ignored; an
    empty table gives an empty result.
    """
    rows, entries = queue(docs, repeat, weights, seed)
    served = entries.where("taken > 0").groupBy(*_ROW).agg(F.sum("taken").alias("taken"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _ROW]
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("r.size")) / F.col("target"))
    return rows.alias("r").join(served.alias("s"), same, "left").select(
        "r.doc_id", "r.size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "r.source", finish.alias("first_finish")
    )


def mixed_documents(docs: DataFrame, repeat: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in queue order.

    A document of which the queue takes a part is cut after the words taken.
    Columns stay, extra ones too; rows come sorted by their place in the queue.
    Null and empty texts, and sources without words, have nothing to take and
    go; a null source is one source and null doc_ids are ordinary keys; each of
    several equal rows has its own places; an empty table gives an empty result.
    """
    columns = docs.columns
    ids = {n: spare(docs, n) for n in ("_id", "_source", "_size", "_row", "_entries", "_e")}
    key = [ids["_id"], ids["_source"], ids["_size"]]
    _, entries = queue(docs, repeat, weights, seed)
    # A document's two parts of one pass are one row; the later place orders it.
    passes = entries.where("taken > 0").groupBy(*_ROW, "copies", "pass").agg(F.max("place").alias("place"), F.sum("taken").alias("taken"))
    lists = materialize(
        passes.groupBy(F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("size").alias(key[2]), F.col("copy").alias(ids["_row"]), "copies")
        .agg(F.sort_array(F.collect_list(F.struct("place", "taken"))).alias(ids["_entries"])), "taken")
    named = docs.withColumns({key[0]: F.col("doc_id").cast("long"), key[1]: F.col("source").cast("string"), key[2]: n_words(F.col("text"))})
    same = lambda *cols: [F.col(f"d.{c}").eqNullSafe(F.col(f"l.{c}")) for c in cols]
    meet = lambda rows, found, *by: rows.alias("d").join(found.hint("shuffle_hash").alias("l"), same(*by)).select(
        *[F.col(f"d.{c}") for c in (*columns, key[2])], F.col(f"l.{ids['_entries']}"))
    out = meet(named, lists.where("copies = 1"), *key)
    # Only where rows agree in id, source and size are the texts dealt out a second time, to number them.
    several = lists.where("copies > 1")
    if not several.isEmpty():
        agree = several.select(*key).distinct()
        again = named.alias("d").join(agree.hint("shuffle_hash").alias("l"), same(*key), "left_semi")
        number = F.row_number().over(Window.partitionBy(*key).orderBy(F.md5("text"))) - 1
        out = out.union(meet(again.withColumn(ids["_row"], number.cast("long")), several, *key, ids["_row"]))
    out = out.withColumn(ids["_e"], F.explode(ids["_entries"]))
    taken = F.col(f"{ids['_e']}.taken")
    whole = taken >= F.col(key[2])
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), taken.cast("int")), " ")
    place = spare(docs, "_place")
    changed = {place: F.col(f"{ids['_e']}.place"), "text": F.when(whole, F.col("text")).otherwise(head)}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(head).cast(docs.schema["n_chars"].dataType))
    return out.withColumns(changed).orderBy(place, "doc_id").select(*columns)
