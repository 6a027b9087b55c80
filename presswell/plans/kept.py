"""Queries of tables that are kept up to date: clustered, versioned, rolled up and folded."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.functions.compat import dedup_key
from presswell.operators import dedup, terms, views
from presswell.plans.registry import ORACLES, QUERIES
from presswell.plans.warehouse_oracles import _ARTICLES, _DEDUP
from presswell.schemas import ARTICLES, align
from presswell.sources import adapter, arrays, footers, sinks
from presswell.sources.shared import shared_dir
from presswell.sources.snapshots import Snapshots
from presswell.streaming import rollups

#: What the queries of the current view show.
SHOWN = ("dedup_key", "id", "source", "source_type", "published_at", "lang", "sentiment_label", "sentiment_score", "batch_id", "entities_orgs_canon",
         "entities_geo_canon", "best_clean_len")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _number() -> Column:
    return F.expr("CAST(substring(id, 2) AS bigint)")


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """The current dedup over a table in buckets by key: no row is shuffled after it is stored."""
    rows, name = adapter.articles(spark, d).withColumn("dedup_key", dedup_key()), f"articles_{uuid.uuid4().hex}"
    table = sinks.clustered_table(rows, name, _folder(spark, "clustered"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dedup.by_enrichment(table).select(*SHOWN)


def after_three_batches(spark: SparkSession, d: str) -> DataFrame:
    """The current view, kept while three batches arrive that share keys."""
    store, rows = Snapshots(spark, _folder(spark, "current")), align(adapter.articles(spark, d), ARTICLES)
    for i in range(3):
        rollups.apply_batch(store, rows.where(F.pmod(F.xxhash64("id", "ingest_object_name"), F.lit(3)) == i), i, (), buckets=8, without=rollups.BODIES)
    return rollups.current_view(store, without=rollups.BODIES).select(*SHOWN)


def after_reloads(spark: SparkSession, d: str) -> DataFrame:
    """The current view of a warehouse whose objects were loaded, reloaded with other rows, and emptied.

    It follows after the first loads and again after the reloads.
    """
    root, at = _folder(spark, "warehouse"), datetime(2026, 1, 1)
    house, store, rows = sinks.Warehouse(spark, root), Snapshots(spark, f"{root}/current"), adapter.articles(spark, d)
    own = lambda k: rows.where(_number() % 4 == k)
    house.load(own(0).withColumn("lang", F.lit("xx")), "o0", "20260101T000000Z", at)
    house.load(own(1), "o1", "", at)
    rollups.refresh_view(house, store, buckets=8, without=rollups.BODIES)
    house.load(own(2), "o2", "20260103T000000Z", at)
    house.load(own(3), "o3", "20260103T000000Z", at)
    rollups.refresh_view(house, store, buckets=8, without=rollups.BODIES)
    house.load(own(1).limit(0), "o1", "", at)  # loaded before
    house.load(own(0), "o0", "20260101T000000Z", at, force=True)
    house.load(own(3).limit(0), "o3", "20260103T000000Z", at, force=True)
    rollups.refresh_view(house, store, buckets=8, without=rollups.BODIES)
    return rollups.current_view(store, without=rollups.BODIES).select(*SHOWN)


def loads(spark: SparkSession, d: str) -> DataFrame:
    """The load log of the same warehouse, with the batch and the rows that are stored for each object."""
    house, rows, at = sinks.Warehouse(spark, _folder(spark, "loads")), adapter.articles(spark, d), datetime(2026, 1, 1)
    own = lambda k: rows.where(_number() % 4 == k)
    for k, batch in enumerate(("20260101T000000Z", "", "20260103T000000Z", "20260104T000000Z")):
        house.load(own(k), f"o{k}", batch, at)
    house.load(own(2).limit(1), "o2", "20260103T000000Z", datetime(2026, 1, 2))
    house.load(own(2).limit(0), "o2", "20260103T000000Z", datetime(2026, 1, 3), force=True)
    house.delete_batch("20260104T000000Z")
    stored = house.articles().groupBy("ingest_object_name", "batch_id").agg(F.count(F.lit(1)).alias("stored"), F.min("id").alias("first_id"))
    log = house.load_log().withColumnRenamed("object_name", "ingest_object_name")
    return log.join(stored, "ingest_object_name", "left").select("ingest_object_name", "batch_id", "loaded_at", "rows_loaded", "stored", "first_id")


def _gold(rows: DataFrame, root: str) -> None:
    # The one text that is measured; the others are never read.
    align(rows.drop(*set(rollups.BODIES) - {"clean_text"}), ARTICLES).repartition(3, "id").write.mode("append").parquet(f"{root}/gold")


def _without_times(rows: DataFrame) -> DataFrame:
    return rows.withColumn("published_at", F.when(_number() % 7 != 0, F.col("published_at")))


def null_hours(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts kept over three micro-batches, with articles that have no time."""
    root = _folder(spark, "rollup")
    _gold(_without_times(adapter.articles(spark, d)), root)
    rollups.maintain(spark, f"{root}/gold", f"{root}/out", f"{root}/state", ("articles",), files=1, buckets=8, without=rollups.BODIES)
    return rollups.maintained(spark, f"{root}/out", "articles")


def compacted(name: str):
    """A rollup of which two batches were folded by month and a third one came after."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        store, rows = Snapshots(spark, _folder(spark, "folded")), align(adapter.articles(spark, d), ARTICLES)
        for i in range(3):
            rollups.apply_batch(store, rows.where(F.pmod(F.xxhash64("id", "ingest_object_name"), F.lit(3)) == i), i, (name,), buckets=8, without=rollups.BODIES)
            if i == 1:
                rollups.compact(store, name)
        return rollups.maintained(spark, store.root, name)

    return run


def compacted_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of the hourly sentiment, appended three times, folded in between, merged on read."""
    store, best = Snapshots(spark, _folder(spark, "sketches")), dedup.by_enrichment(adapter.articles(spark, d))
    for i in range(3):
        part = views.sentiment_state(best.where(F.pmod(F.xxhash64("dedup_key"), F.lit(3)) == i))
        rollups.append(store, "sketches", part)
        if i == 1:
            rollups.compact(store, "sketches", part.schema)
    return views.sentiment_merged(store.read(store.parts("sketches"), part.schema))


def constants(spark: SparkSession, d: str) -> DataFrame:
    """For each object, whether its stored file holds its name alone, by the footer; one file has two objects."""
    root, rows = _folder(spark, "constants"), adapter.articles(spark, d)
    rows = rows.withColumn("file", F.when(F.col("ingest_object_name") == "gold_1.parquet", "gold_0.parquet").otherwise(F.col("ingest_object_name")))
    rows.select("id", "ingest_object_name", "file").repartition("file").write.partitionBy("file").parquet(root)
    found = footers.footers(spark, root, "ingest_object_name").withColumn("object", F.regexp_extract("path", "file=([^/]*)/", 1))
    return found.groupBy("object").agg(F.sum("rows").alias("rows"), F.min(F.when(F.col("nulls") == 0, F.col("low"))).alias("low"), F.max("high").alias("high")).select(
        "object", "rows", ((F.col("low") == F.col("object")) & (F.col("high") == F.col("object"))).alias("constant"))


def json_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON arrays and read back by byte ranges that cut through records."""
    path = _folder(spark, "arrays")
    arrays.write_arrays(spark.read.parquet(f"{d}/documents.parquet"), path)
    return arrays.read_array(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint", range_bytes=1 << 18, glob="*.txt")


def lemma_texts(chars: int):
    """Documents with plurals as singulars, by a dictionary of the words that occur in both forms."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
        words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("form")).distinct()
        plural = words.where(F.col("form").endswith("s")).select("form", F.expr("left(form, length(form) - 1)").alias("lemma"))
        lemmas = plural.join(words.withColumnRenamed("form", "lemma"), "lemma", "left_semi")
        return terms.lemmatized(docs, "doc_id", "text", lemmas, chars).select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))

    return run


def closed_hours(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, as a stream gives them: the hours that the watermark has passed."""
    root, events = _folder(spark, "hours"), spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartition(3, "event_id").write.parquet(f"{root}/events")
    found = rollups.tumbling_counts(spark.readStream.schema(events.schema).parquet(f"{root}/events")).withColumn("ts_start", F.col("ts_start").cast("timestamp_ntz"))
    stream = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    stream.start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out")


QUERIES |= {
    "t01_closed_hours": closed_hours,
    "k05_footer_constants": constants,
    "s01_json_arrays": json_arrays,
    "n02_lemma_texts": lemma_texts(terms.SENT_CHARS),
    "n02_lemma_texts_join": lemma_texts(-1),
    "k10_clustered_dedup": clustered,
    "v01_current_view": after_three_batches,
    "v01_current_after_reloads": after_reloads,
    "k08_snapshot_loads": loads,
    "k14_streaming_null_hours": null_hours,
    "k13_compacted_articles": compacted("articles"),
    "k13_compacted_keywords": compacted("keywords"),
    "k13_compacted_entities": compacted("entities"),
    "k13_compacted_sentiment": compacted("sentiment"),
    "k13_compacted_sketches": compacted_sketches,
}

_BASE = _ARTICLES.replace("articles AS (", "base AS (", 1)
_SHOWN = f"SELECT {', '.join(SHOWN)} FROM d"
_NO_TIME = "coalesce(published_at, TIMESTAMP '0001-01-01')"
_LEMMAS = r"""WITH x AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ё', 'е'), '[A-Za-zА-Яа-яЁё]+') AS ws, regexp_extract_all(lower(text), '[a-z]{4,}') AS ls FROM documents),
    l AS (SELECT DISTINCT unnest(ls) AS w FROM x), m AS (SELECT w AS form, left(w, length(w) - 1) AS lemma FROM l WHERE w LIKE '%s' AND left(w, length(w) - 1) IN (SELECT w FROM l)),
    t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM x),
    j AS (SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS s FROM t LEFT JOIN m ON form = w GROUP BY doc_id)
    SELECT doc_id, length(coalesce(s, '')) AS chars, md5(coalesce(s, '')) AS digest FROM documents LEFT JOIN j USING (doc_id)"""
ORACLES |= {
    "t01_closed_hours": """SELECT * FROM (SELECT date_trunc('hour', ts) AS ts_start, event_type, count(*) AS cnt FROM events GROUP BY 1, 2)
        WHERE ts_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
    "k05_footer_constants": f"""WITH {_ARTICLES} SELECT CASE ingest_object_name WHEN 'gold_1.parquet' THEN 'gold_0.parquet' ELSE ingest_object_name END AS object, count(*)::BIGINT AS rows,
        count(DISTINCT ingest_object_name) = 1 AS constant FROM articles GROUP BY object""",
    "s01_json_arrays": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "n02_lemma_texts": _LEMMAS, "n02_lemma_texts_join": _LEMMAS,
    "k10_clustered_dedup": ORACLES["w05_dedup_v3"],
    "v01_current_view": ORACLES["w05_dedup_v3"],
    "v01_current_after_reloads": f"""WITH {_BASE}, articles AS (SELECT * REPLACE ('o' || substr(id, 2)::BIGINT % 4 AS ingest_object_name,
        CASE substr(id, 2)::BIGINT % 4 WHEN 0 THEN '20260101T000000Z' WHEN 1 THEN '' ELSE '20260103T000000Z' END AS batch_id) FROM base WHERE substr(id, 2)::BIGINT % 4 < 3)
        {_DEDUP.replace("strptime(batch_id, '%Y-%m-%dT%H:%M:%SZ')", "strptime(batch_id, '%Y%m%dT%H%M%SZ')")} {_SHOWN}""",
    "k08_snapshot_loads": f"""WITH {_ARTICLES}, o AS (SELECT substr(id, 2)::BIGINT % 4 AS k, count(*) AS n, min(id) AS first_id FROM articles GROUP BY ALL),
        l AS (SELECT k, TIMESTAMP '2026-01-01' AS loaded_at, n AS rows_loaded, n, first_id FROM o UNION ALL SELECT 2, TIMESTAMP '2026-01-03', 0, 0, NULL)
        SELECT 'o' || k AS ingest_object_name, CASE k WHEN 0 THEN '20260101T000000Z' WHEN 1 THEN '' END AS batch_id, loaded_at, rows_loaded,
               CASE WHEN k < 2 THEN n END AS stored, CASE WHEN k < 2 THEN first_id END AS first_id FROM l""",
    "k14_streaming_null_hours": f"""WITH {_BASE}, articles AS (SELECT * REPLACE (CASE WHEN substr(id, 2)::BIGINT % 7 <> 0 THEN published_at END AS published_at) FROM base)
        {_DEDUP.replace("loaded_at, published_at, id", f"loaded_at, {_NO_TIME}, id")}
        SELECT date_trunc('hour', published_at) AS ts_hour, source, lang, count(*) AS cnt FROM d GROUP BY ALL""",
    "k13_compacted_articles": ORACLES["v39a_bi_articles_by_hour"], "k13_compacted_keywords": ORACLES["v39b_bi_keywords_by_hour"],
    "k13_compacted_entities": ORACLES["v39c_bi_entities_by_hour"], "k13_compacted_sentiment": ORACLES["v39d_bi_sentiment_merged"],
    "k13_compacted_sketches": ORACLES["v39d_bi_sentiment_merged"],
}
