"""Warehouse tables (articles, load log, coverage) from the generic test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _some(tokens: Column, first: int, many: int, mark: str) -> Column:
    return F.array_join(F.slice(tokens, first, many), mark)


def nlp_text() -> Column:
    return F.trim(F.concat(F.col("title"), F.lit(". "), F.col("clean_text")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per document; copies share a link, every tenth has none.

    Every fiftieth was ingested a second time, by another object and batch.
    """
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("quality") - F.col("toxic")).cast("double").alias("sentiment_score"))
    docs = _table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    small = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    capital = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))
    number, again = F.col("doc_id"), F.col("again")
    docs = docs.withColumn("again", F.explode(F.when(number % 50 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    tag = F.when(number % 3 == 0, "telegram:").when(number % 3 == 1, "rss:").otherwise("")
    day = F.concat(F.lit("0"), (number % 5 + 1).cast("string"))
    batch = (
        F.when(again, "articles_20240109T000000Z").when(number % 4 == 0, "").when(number % 4 == 1, F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00Z")))
        .when(number % 4 == 2, F.concat(F.lit("articles_202401"), day, F.lit("T000000Z")))
        .otherwise(F.concat(F.lit("articles_"), (number % 3).cast("string"), F.lit(".json")))
    )
    k, c = F.col("k"), F.col("c")
    score = F.col("sentiment_score")
    return (
        docs.withColumn("k", small).withColumn("c", capital)
        .withColumn("clean_text", F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
        .withColumn("title", F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80))
        .select(
            F.concat(F.lit("d"), number.cast("string")).alias("id"),
            F.lit("").alias("uid"),
            F.when(number % 3 == 0, F.col("source")).otherwise("").alias("channel"),
            "title",
            F.when(number % 10 == 0, "").otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.md5("text"))).alias("link"),
            F.expr("timestamp_ntz '2024-01-01 00:00:00' + doc_id * 97 * interval '1' second").alias("published_at"),
            F.concat(tag, F.col("source")).alias("source"),
            F.col("text").alias("raw_text"),
            "clean_text",
            nlp_text().alias("nlp_text"),
            F.substring("clean_text", 1, 200).alias("summary"),
            _some(k, 1, 8, "; ").alias("keywords"),
            F.length("clean_text").cast("long").alias("text_length_chars"),
            F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("num_sentences"),
            F.size(F.slice(k, 1, 8)).cast("long").alias("num_keywords"),
            batch.alias("batch_id"),
            F.when(again, "gold_again.parquet").otherwise(F.concat(F.lit("gold_"), (number % 7).cast("string"), F.lit(".parquet"))).alias("ingest_object_name"),
            _some(c, 1, 3, "; ").alias("entities_persons"),
            _some(c, 4, 2, "; ").alias("entities_orgs"),
            _some(c, 6, 2, "|").alias("entities_geo"),
            F.size(F.slice(c, 1, 3)).alias("num_persons"),
            F.size(F.slice(c, 4, 2)).alias("num_orgs"),
            F.size(F.slice(c, 6, 2)).alias("num_geo"),
            F.when((F.size(c) >= 2) & (F.size(k) >= 3), F.concat(
                F.element_at(c, 1), F.lit(":"), F.element_at(k, 1), F.lit(" , "), F.element_at(k, 2), F.lit("|"),
                F.element_at(c, 2), F.lit(": "), F.element_at(k, 3))).when(F.size(c) >= 1, F.element_at(c, 1)).otherwise("").alias("persons_actions"),
            _some(k, 3, 3, ";").alias("actions_verbs"),
            F.when(number % 13 == 0, 1).otherwise(0).alias("is_digest"),
            F.lower(_some(c, 1, 3, ";")).alias("entities_persons_canon"),
            F.lower(_some(c, 4, 2, ";")).alias("entities_orgs_canon"),
            F.lower(_some(c, 6, 2, ";")).alias("entities_geo_canon"),
            F.when(number % 9 == 0, "unknown").otherwise(F.col("lang")).alias("lang"),
            _some(k, 9, 4, ";").alias("keyphrases"),
            F.when(score > 0, "pos").when(score < 0, "neg").when(score == 0, "neu").otherwise("").alias("sentiment_label"),
            "sentiment_score",
            F.when(score.isNotNull(), 1).otherwise(0).alias("sentiment_ok"),
        )
    )


def load_log(spark: SparkSession) -> DataFrame:
    """Loads of five of the seven gold objects; one twice, one of another layer."""
    rows = [("gold", f"gold_{i}.parquet", f"2024-01-0{i + 1} 12:00:00", 10 * i) for i in range(5)]
    rows += [("gold", "gold_2.parquet", "2024-01-05 12:00:00", 20), ("silver", "gold_6.parquet", "2024-02-01 00:00:00", 5)]
    return spark.createDataFrame(rows, "layer string, object_name string, at string, rows_loaded bigint").select(
        "layer", "object_name", F.to_timestamp_ntz("at").alias("loaded_at"), "rows_loaded")


def ingestion_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("b"), n.cast("string")).alias("batch_id"),
        F.col("event_type").alias("source_type"),
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("source"),
        F.expr("ts - (event_id % 60) * interval '1' second").alias("run_started_at"),
        F.col("ts").alias("run_finished_at"),
        (n % 60 * 1000).alias("duration_ms"),
        (n % 100).alias("items_found"),
        (n % 90).alias("items_saved"),
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts - interval '20' day END").alias("min_published_at"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts - (event_id % 30) * interval '1' day END").alias("max_published_at"),
        F.when(n % 3 == 0, "ok").when(n % 3 == 1, "warn").otherwise("error").alias("status"),
        F.lit("").alias("error_message"),
        F.concat(F.lit("raw/"), n.cast("string"), F.lit(".json")).alias("raw_object_name"),
    )
