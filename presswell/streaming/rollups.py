"""The current view and its rollups, kept right while batches arrive.

The state of a key is one row: its best article and the best sentiment it has
seen (``dedup.states``).  A batch is merged with the states of its own keys
alone; what these keys gave before is retracted from the rollups and what they
give now is added, as signed counts.  States and counts of a batch appear
together, by one commit.  Rollups may be compacted at any time.

Partial states that only ever grow (with sketches, which cannot retract) can be
appended per micro-batch and merged on read, while a key stays in one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswell.functions.compat import dedup_key, hour, month
from presswell.operators import dedup, views
from presswell.schemas import ARTICLES
from presswell.sources.sinks import Warehouse
from presswell.sources.snapshots import Part, Snapshots

#: Texts, which no rollup counts; the score has their lengths.
BODIES = ("raw_text", "clean_text", "nlp_text", "summary")

#: What is appended per batch, by name.
PARTIALS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "articles": views.articles_by_hour, "keywords": views.keywords_by_hour,
    "entities": lambda d: views.entities_by_hour(d, "entities_persons"), "sentiment": views.sentiment_state,
}
#: What is counted, and can be retracted: sentiments by their value.
COUNTS: dict[str, Callable[[DataFrame], DataFrame]] = PARTIALS | {"sentiment": views.sentiment_values}


def folded(partials: DataFrame) -> DataFrame:
    """Partial rows of equal keys as one: counts and sums added up, sketches merged."""
    kinds = {"cnt": F.sum("cnt"), "score_sum": F.sum("score_sum"), "score_n": F.sum("score_n"),
             "score_sketch": F.kll_merge_agg_double(F.when(F.col("score_n") > 0, F.col("score_sketch"))) if "score_n" in partials.columns else None}
    keys = [c for c in partials.columns if c not in kinds]
    return partials.groupBy(*keys).agg(*[kinds[c].alias(c) for c in partials.columns if c in kinds])


def merged(partials: DataFrame, name: str) -> DataFrame:
    """Partial rows summed up; readers always come through here."""
    return views.sentiment_merged(partials) if name == "sentiment" else folded(partials.drop("batch"))


def append_partials(spark: SparkSession, gold: str, out: str, checkpoint: str) -> None:
    """Take all new files of ``gold`` and write their partial states under ``out``.

    A micro-batch owns a folder that a repeated run overwrites, so each row
    counts once.
    """
    def write(batch: DataFrame, number: int) -> None:
        best = dedup.by_enrichment(batch)
        for name, build in PARTIALS.items():
            build(best).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    stream = spark.readStream.schema(ARTICLES).parquet(gold).writeStream.foreachBatch(write)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def refresh_hours(articles: DataFrame, rollup: DataFrame, batch: DataFrame) -> DataFrame:
    """The hourly article counts after ``batch`` has joined ``articles``.

    Hours of the batch's keys, before and after, are computed again and the
    others are kept.
    """
    keys = batch.select(dedup_key().alias("k")).distinct()
    touched = articles.unionByName(batch).withColumn("k", dedup_key()).join(keys, "k", "left_semi").select(hour("published_at").alias("ts_hour")).distinct()
    winners = dedup.by_enrichment(articles.unionByName(batch)).withColumn("ts_hour", hour("published_at"))
    again = views.articles_by_hour(winners.join(touched, "ts_hour", "left_semi"))
    return rollup.join(touched, "ts_hour", "left_anti").unionByName(again)


def _schema(spark: SparkSession, build: Callable[[DataFrame], DataFrame]) -> T.StructType:
    return build(spark.createDataFrame([], ARTICLES)).schema


def _counted(spark: SparkSession, name: str) -> T.StructType:
    return _schema(spark, lambda none: COUNTS[name](dedup.by_enrichment(none)))


def _state(spark: SparkSession, without: Iterable[str]) -> T.StructType:
    return _schema(spark, lambda none: dedup.states(none, without))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("dedup_key"), F.lit(buckets)).cast("int")


def _by_months(store: Snapshots, table: str, rows: DataFrame) -> list[Part]:
    path = store.stage(rows.withColumn("month", month("ts_hour")).repartition("month"), "month")
    return [{"table": table, "month": value, "path": own} for own, value in store.folders(path)]


def apply_batch(store: Snapshots, batch: DataFrame, number: int, names: Iterable[str] = tuple(COUNTS), buckets: int = 64, everything: DataFrame | None = None,
                without: Iterable[str] = ()) -> None:
    """Take the articles of a batch into the states of their keys and the rollups ``names``.

    Reads the states of the buckets that the batch's keys are in, and writes
    these anew; all others keep their files.  A batch whose number, or a later
    one, was committed before is left out.  With ``everything``, the articles
    there are now, the states of the batch's keys are made of these alone, as
    after a batch whose rows replace or remove others.  The states hold the
    articles without the columns ``without``, always the same ones for one store.
    """
    version, spark = store.version(), store.spark
    done = store.tag("batch", version)
    if done is not None and done >= number:
        return
    state, bucket = _state(spark, without), _bucket(buckets)
    new = store.read([{"path": store.stage(dedup.states(batch, without))}], state)
    keys = new.select("dedup_key")
    touched = {r["b"] for r in keys.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets``
    parts = [p for p in store.parts("state", version) if p["bucket"] in touched]
    held = store.read(parts, state)
    mine = held.join(keys, "dedup_key", "left_semi")
    after = dedup.merged_states(mine, new) if everything is None else dedup.states(
        everything.withColumn("dedup_key", dedup_key()).join(keys, "dedup_key", "left_semi"), without)
    signed = T.StructType([*state.fields, T.StructField("sign", T.IntegerType())])
    changes = store.read([{"path": store.stage(mine.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1))))}], signed)
    now, before = (changes.where(F.col("sign") == s).drop("sign") for s in (1, -1))
    kept = held.join(keys, "dedup_key", "left_anti").unionByName(now).withColumn("bucket", bucket)
    staged = store.stage(kept.repartition("bucket"), "bucket")
    added: list[Part] = [{"table": "state", "bucket": int(value), "path": own} for own, value in store.folders(staged)]
    for name in names:
        build = COUNTS[name]
        lost = build(dedup.winners(before))
        delta = folded(build(dedup.winners(now)).unionByName(lost.withColumn("cnt", -F.col("cnt")))).where("cnt <> 0")
        added += _by_months(store, name, delta)
    gone = {p["path"] for p in parts}
    store.commit(lambda all_parts: [p for p in all_parts if p["path"] not in gone] + added, seen=version, batch=number)


def maintain(spark: SparkSession, gold: str, out: str, checkpoint: str, names: tuple[str, ...] = tuple(COUNTS), files: int | None = None, buckets: int = 64,
             without: Iterable[str] = ()) -> None:
    """Take all new files of ``gold`` and keep the view and the rollups under ``out`` right, also for keys that come again.

    A row without a time counts in an hour of its own (null).  A micro-batch
    that is repeated after a failure changes nothing twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        apply_batch(Snapshots(batch.sparkSession, out), batch, number, names, buckets, without=without)

    reader = spark.readStream.schema(ARTICLES)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    stream = reader.parquet(gold).writeStream.foreachBatch(write)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_view(store: Snapshots, version: int | None = None, without: Iterable[str] = ()) -> DataFrame:
    """The de-duplicated articles as of a version: read, not computed again."""
    return dedup.winners(store.read(store.parts("state", version), _state(store.spark, without)))


def refresh_view(warehouse: Warehouse, store: Snapshots, names: Iterable[str] = (), buckets: int = 64, without: Iterable[str] = ()) -> int:
    """Bring the view under ``store`` to the warehouse's last version, and return that.

    Looks at the parts that were added or removed since the version it was last
    brought to.  Keys of added parts are merged; where parts were removed, the
    keys of both are made anew from what is left.
    """
    last, seen = warehouse.store.version(), store.tag("batch") or 0
    if last <= seen:
        return last
    was, now = ({p["path"]: p for p in warehouse.store.parts("articles", v)} for v in (seen, last))
    added, removed = [p for k, p in now.items() if k not in was], [p for k, p in was.items() if k not in now]
    changed = warehouse.store.read(added + removed, ARTICLES)
    apply_batch(store, changed, last, names, buckets, warehouse.articles(last) if removed else None, without)
    return last


def maintained(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rollup that ``maintain`` keeps, with retracted counts gone."""
    store = Snapshots(spark, out)
    counts = folded(store.read(store.parts(name), _counted(spark, name))).where("cnt <> 0")
    return views.sentiment_of_values(counts) if name == "sentiment" else counts


def append(store: Snapshots, name: str, partials: DataFrame) -> None:
    """Add partial states, by month."""
    parts = _by_months(store, name, partials)
    store.commit(lambda seen: seen + parts)


def compact(store: Snapshots, name: str, schema: T.StructType | None = None) -> int:
    """Fold the parts of each month that has several into one, and put it in their place; how many months.

    Readers see all old parts or the new one.  What others have added in the
    meantime stays beside it.
    """
    by_month: dict[str, list[Part]] = {}
    for part in store.parts(name):
        by_month.setdefault(str(part["month"]), []).append(part)
    old = [p for parts in by_month.values() if len(parts) > 1 for p in parts]
    if not old:
        return 0
    rows = folded(store.read(old, schema or _counted(store.spark, name)))
    new = _by_months(store, name, rows.where("cnt <> 0"))
    gone = {p["path"] for p in old}

    def change(parts: list[Part]) -> list[Part]:
        if not gone <= {p["path"] for p in parts}:
            raise RuntimeError(f"parts of {name} were folded by someone else")
        return [p for p in parts if p["path"] not in gone] + new

    store.commit(change)
    return len({p["month"] for p in old})


def tumbling_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per event-time window, closed once the watermark has passed."""
    return (events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("cnt"))
            .select(F.col("window.start").alias("ts_start"), "event_type", "cnt"))
