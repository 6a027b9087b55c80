"""Best-row selection: inside a batch and over the warehouse."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswell.functions.compat import EPOCH, dedup_key, loaded_at, text

#: Last resorts among equal scores, so that reruns and engines agree.
TIES = ("id", "ingest_object_name")


def _desc(names) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def best_rows(df: DataFrame, key: str, score: list[str], skip_null: tuple[str, ...] = ()) -> DataFrame:
    """The row with the highest score of each key; ties by id, then object.

    Each task keeps one row per key before the shuffle, so that a key with very
    many rows, like the empty one, costs a row per task.  Columns in
    ``skip_null`` come from the best row that has them, by partial aggregation.
    """
    order = Window.partitionBy(key).orderBy(*_desc([*score, *TIES]))
    best = df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    for name in skip_null:
        known = df.where(F.col(name).isNotNull()).groupBy(key).agg(F.max_by(name, F.struct(*score, *TIES)).alias(name))
        best = best.drop(name).join(known.hint("merge"), key, "left")  # both are dealt out by the key as it is
    return best


def _measured(articles: DataFrame, body: int) -> DataFrame:
    clean_len = F.length(text("clean_text")).cast("long")
    # A stored key, by which a table may be in buckets, stays as it is.
    key = {} if "dedup_key" in articles.columns else {"dedup_key": dedup_key()}
    return articles.withColumns(key | {"clean_len": clean_len, "has_body": (clean_len >= body).cast("int")})


def by_load(articles: DataFrame, load_log: DataFrame, nullable: tuple[str, ...] = ()) -> DataFrame:
    """Dedup that prefers a body, length, the last load, then newer rows."""
    gold = load_log.where("layer = 'gold'")
    latest = gold.groupBy("object_name").agg(F.max("loaded_at").alias("loaded_at"))
    newest = gold.agg(F.max("loaded_at").alias("newest"))
    epoch = F.expr(EPOCH)
    joined = (
        _measured(articles, 40).join(latest, F.col("ingest_object_name") == F.col("object_name"), "left").drop("object_name")
        .withColumn("loaded_at", F.coalesce("loaded_at", epoch))
    )
    joined = joined.withColumn("batch_priority", F.col("loaded_at").eqNullSafe(newest.scalar()).cast("int"))
    found = best_rows(joined, "dedup_key", ["has_body", "clean_len", "batch_priority", "published_at", "loaded_at"], nullable)
    return found.withColumnRenamed("clean_len", "best_clean_len")


#: The current score, best first, before the ties.
ENRICHED = ("source_rank", "has_body", "clean_len", "has_nlp_extras", "has_persons_canon", "has_sentiment", "has_actions", "loaded_at", "published_at")


def enriched(articles: DataFrame) -> DataFrame:
    """Articles with their key and what the current score is made of."""
    labelled = (F.col("sentiment_label") != "neu") | (F.coalesce("sentiment_score", F.lit(0.0)) != 0)
    return _measured(articles, 400).withColumns({
        "source_type": F.when(F.col("source").startswith("telegram:"), "telegram").when(F.col("source").startswith("rss:"), "rss").otherwise("unknown"),
        "source_rank": F.when(F.col("source").startswith("telegram:"), 3).when(F.col("source").startswith("rss:"), 2).otherwise(1),
        "has_nlp_extras": ((F.col("lang") != "unknown") | (text("keyphrases") != "") | labelled).cast("int"),
        "has_persons_canon": (text("entities_persons_canon") != "").cast("int"),
        "has_sentiment": labelled.cast("int"),
        "has_actions": ((text("persons_actions") != "") | (text("actions_verbs") != "")).cast("int"),
        "loaded_at": loaded_at(),
    })


def by_enrichment(articles: DataFrame) -> DataFrame:
    """Current dedup: source kind, body, length, enrichment, then load time."""
    return best_rows(enriched(articles), "dedup_key", list(ENRICHED), ("sentiment_score",)).withColumnRenamed("clean_len", "best_clean_len")


def states(articles: DataFrame, without: Iterable[str] = ()) -> DataFrame:
    """One row per key that later rows of the key can be merged with: the best
    row, and ``known``, the score and sentiment of the best row that has one.

    Columns named in ``without`` are measured and go before any row is shuffled.
    """
    rows = enriched(articles).drop(*without)
    known = F.max(F.when(F.col("sentiment_score").isNotNull(), F.struct(*ENRICHED, *TIES, "sentiment_score")))
    return best_rows(rows, "dedup_key", list(ENRICHED)).join(rows.groupBy("dedup_key").agg(known.alias("known")).hint("merge"), "dedup_key")


def merged_states(*some: DataFrame) -> DataFrame:
    """States of the union of what each was made of."""
    both = some[0]
    for more in some[1:]:
        both = both.unionByName(more)
    return best_rows(both.drop("known"), "dedup_key", list(ENRICHED)).join(both.groupBy("dedup_key").agg(F.max("known").alias("known")).hint("merge"), "dedup_key")


def winners(found: DataFrame) -> DataFrame:
    """States as ``by_enrichment`` gives them."""
    return found.withColumn("sentiment_score", F.col("known.sentiment_score")).drop("known").withColumnRenamed("clean_len", "best_clean_len")


def by_length(articles: DataFrame) -> DataFrame:
    """Legacy dedup: the longest text; times and counts are each key's maxima."""
    rows = _measured(articles, 40)
    maxima = rows.groupBy("dedup_key").agg(
        *[F.max(c).alias(c) for c in ("published_at", "text_length_chars", "num_sentences", "num_keywords")], F.max("clean_len").alias("best_clean_len"))
    best = best_rows(rows, "dedup_key", ["clean_len", "published_at"]).select(
        "dedup_key", "id", "title", "link", "source", "raw_text", "clean_text", "nlp_text", "summary", "keywords", "ingest_object_name")
    return best.join(maxima, "dedup_key")


def batch_dedup_key() -> Column:
    """The source and link, or the source, title and time of a row without a link."""
    link = F.trim(text("link"))
    return F.when(link != "", F.concat_ws("|", text("source"), link)).otherwise(
        F.concat_ws("|", text("source"), text("title"), F.coalesce(F.col("published_at").cast("string"), F.lit(""))))


def within_batch(silver: DataFrame, order: str = "id") -> DataFrame:
    """One row per source and link, or per source, title and time without a link.

    Rows with a body come first, then longer, then newer ones; ``order`` breaks
    the remaining ties as the input's order would.
    """
    size = F.length(text("clean_text"))
    best = Window.partitionBy("_key").orderBy((size > 0).desc(), size.desc(), F.col("published_at").desc_nulls_last(), order)
    return silver.withColumn("_key", batch_dedup_key()).withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_key", "_rank")


def latest_coverage(coverage: DataFrame) -> DataFrame:
    """The last run of each source; publication times from the last run that has them."""
    key = ["source_type", "source"]
    order = Window.partitionBy(*key).orderBy(F.col("run_finished_at").desc(), F.col("batch_id").desc())
    last = coverage.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "min_published_at", "max_published_at")
    at = F.struct("run_finished_at", "batch_id")
    known = coverage.groupBy(*key).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), at)).alias(n) for n in ("min_published_at", "max_published_at")])
    # A run without a source is a source too.
    here, there = last.alias("l"), known.alias("k")
    same = F.col("l.source_type").eqNullSafe(F.col("k.source_type")) & F.col("l.source").eqNullSafe(F.col("k.source"))
    return here.join(there, same).select("l.*", "k.min_published_at", "k.max_published_at")
