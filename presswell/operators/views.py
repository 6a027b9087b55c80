"""The warehouse's named views and checks as DataFrame builders.

``a`` is the table of articles and ``d`` its de-duplicated view.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswell.functions.compat import batch_key, dedup_key, element, hour, items, minutes_between, one_line, share, text

# Keywords that say nothing about a topic.
STOP_KEYWORDS = ("стать известно", "стать", "известно", "назвать", "рассказать", "объяснить", "раскрыть", "новый")
STOP_TOPICS = ("стать известно", "назвать", "рассказать", "объяснить", "раскрыть", "новый")
BODY = 40


def _rows(name: str = "cnt") -> Column:
    return F.count(F.lit(1)).alias(name)



def _bodies(total: str = "total", body: str = "has_body", short: str = "title_only") -> list[Column]:
    has = F.length(text("clean_text")) >= BODY
    return [_rows(total), F.count_if(has).alias(body), F.count_if(~has).alias(short)]


def health_overview(a: DataFrame) -> DataFrame:
    return a.agg(_rows("rows"), F.min("published_at").alias("min_dt"), F.max("published_at").alias("max_dt"),
                 F.count_if(F.col("published_at") < F.expr("timestamp_ntz '2000-01-01 00:00:00'")).alias("bad_dates"))


def count_by(df: DataFrame, *keys: str, name: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(_rows(name))


def health_ids(a: DataFrame) -> DataFrame:
    found = a.agg(_rows("total"), F.count_if(text("ingest_object_name") == "").alias("empty_ingest_object_name"),
                  F.count_if(text("batch_id") == "").alias("empty_batch_id"))
    return found.select("*", *[share(F.col(c), F.col("total")).alias(f"share_{c}") for c in ("empty_ingest_object_name", "empty_batch_id")])


def content_quality(a: DataFrame) -> DataFrame:
    return a.agg(*_bodies()).withColumn("share_has_body", share(F.col("has_body"), F.col("total")))


def title_only_examples(a: DataFrame, limit: int = 10) -> DataFrame:
    return (a.where(F.length(text("clean_text")) < BODY).select("id", "title", "link", "published_at", "source")
            .orderBy(F.col("published_at").desc(), "id").limit(limit))


def quality_by_batch(a: DataFrame) -> DataFrame:
    return a.groupBy(batch_key().alias("batch_key")).agg(*_bodies()).withColumn("share_has_body", share(F.col("has_body"), F.col("total")))


def _keywords(d: DataFrame, stop: tuple[str, ...], *keep: str) -> DataFrame:
    kws = F.transform(F.split(text("keywords"), ";"), lambda x: F.lower(F.trim(x)))
    wanted = F.filter(kws, lambda x: (F.length(x) > 2) & ~x.isin(*stop))
    return d.where("is_digest = 0").select(*keep, F.explode(wanted).alias("kw"))


def top_keywords(d: DataFrame, limit: int = 30) -> DataFrame:
    return count_by(_keywords(d, STOP_KEYWORDS), "kw").orderBy(F.col("cnt").desc(), "kw").limit(limit)


def top_keywords_last_batch(a: DataFrame, d: DataFrame, limit: int = 30) -> DataFrame:
    last = a.where("batch_id <> ''").agg(F.max("batch_id"))
    rows = _keywords(d.where(F.col("batch_id") == last.scalar()), STOP_KEYWORDS, "batch_id")
    return count_by(rows, "batch_id", "kw").orderBy(F.col("cnt").desc(), "kw").limit(limit)


def _entities(d: DataFrame, persons: str, orgs: str = "entities_orgs", geo: str = "entities_geo") -> DataFrame:
    """One scan for all three kinds."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), items(c).alias("names")) for k, c in (("persons", persons), ("orgs", orgs), ("geo", geo))])
    return (d.select(hour("published_at").alias("ts_hour"), "source", "lang", F.explode(kinds).alias("e"))
            .select("ts_hour", "source", "lang", F.col("e.kind").alias("entity_type"), F.explode("e.names").alias("entity"))
            .withColumn("entity", F.lower("entity")))


def entities_by_hour(d: DataFrame, persons: str = "entities_persons_canon") -> DataFrame:
    return count_by(_entities(d, persons), "ts_hour", "source", "lang", "entity_type", "entity")


def sentiment_by_hour(d: DataFrame) -> DataFrame:
    # The exact median from how often each value occurs, so that a large hour costs its different values.
    return sentiment_values(d).groupBy("ts_hour", "source", "lang").agg(
        F.sum("cnt").alias("cnt"), (F.sum(F.col("sentiment_score") * F.col("cnt")) / F.sum(F.when(F.col("sentiment_score").isNotNull(), F.col("cnt")))).alias("sentiment_avg"),
        F.percentile("sentiment_score", 0.5, F.col("cnt")).alias("sentiment_p50"))


def topics_by_hour(d: DataFrame, limit: int = 50) -> DataFrame:
    rows = _keywords(d, STOP_TOPICS, hour("published_at").alias("hour"))
    return count_by(rows, "hour", "kw").orderBy(F.col("hour").desc(), F.col("cnt").desc(), "kw").limit(limit)


def batches(a: DataFrame) -> DataFrame:
    return a.groupBy(batch_key().alias("batch_key")).agg(
        *_bodies("rows_loaded"), F.min("published_at").alias("min_dt"), F.max("published_at").alias("max_dt")
    ).withColumn("share_has_body", share(F.col("has_body"), F.col("rows_loaded")))


def batch_survival(a: DataFrame, d: DataFrame) -> DataFrame:
    loaded = a.groupBy(batch_key().alias("batch_key")).agg(
        *_bodies("rows_loaded", "has_body_rows", "title_only_rows"), F.min("published_at").alias("min_dt"), F.max("published_at").alias("max_dt"))
    won = d.groupBy(batch_key().alias("batch_key")).agg(_rows("winners"))
    return (loaded.join(won, "batch_key", "left").withColumn("winners", F.coalesce("winners", F.lit(0).cast("long")))
            .withColumn("share_winners", F.round(F.col("winners") / F.col("rows_loaded"), 3)))


def batch_internal_dupes(a: DataFrame) -> DataFrame:
    keys = a.groupBy(batch_key().alias("batch_key"), dedup_key().alias("k")).agg(_rows())
    return keys.groupBy("batch_key").agg(
        F.sum("cnt").alias("rows"), _rows("uniq_keys"), (F.sum("cnt") - F.count(F.lit(1))).alias("duplicate_rows"),
        F.count_if(F.col("cnt") > 1).alias("duplicate_keys"))


def batch_top_dupes(a: DataFrame, limit: int = 50) -> DataFrame:
    return (a.groupBy(batch_key().alias("batch_key"), dedup_key().alias("dedup_key")).agg(_rows("c")).where("c > 1")
            .orderBy(F.col("c").desc(), "batch_key", "dedup_key").limit(limit))


#: How duplicates are found: the columns that name a row, and those shown.
DUPES = {
    "id": (("id",), ("source", "title")),
    "source_link": (("source", "link"), ("title",)),
    "source_title_time": (("source", "title", "published_at"), ()),
    "dedup_key": (("dedup_key",), ("source", "title")),
}


def _dupes(df: DataFrame, how: str) -> DataFrame:
    keys, shown = DUPES[how]
    if how == "dedup_key":
        df = df.withColumn("dedup_key", dedup_key())
    if how != "source_title_time":
        df = df.where(F.col(keys[-1]) != "")
    aggs = [_rows(), *[F.min(c).alias(c) for c in shown]]
    if how != "source_title_time":
        aggs.append(F.max("published_at").alias("max_published_at"))
    return df.groupBy(*keys).agg(*aggs).where("cnt > 1")


def dupes(df: DataFrame, layer: str, how: str, limit: int = 50) -> DataFrame:
    found = _dupes(df, how)
    order = [F.col("cnt").desc(), *([F.col("max_published_at").desc()] if "max_published_at" in found.columns else []), *DUPES[how][0]]
    clean = [F.col(c) if c in ("cnt", "published_at", "max_published_at") else one_line(c).alias(c) for c in found.columns]
    return found.orderBy(*order).limit(limit).select(F.lit(f"{layer}_dupe_{how}").alias("kind"), *clean)


def dupes_total(df: DataFrame, layer: str, how: str) -> DataFrame:
    return _dupes(df, how).agg(_rows("value")).select(F.lit(f"{layer}_dupe_{how}_total").alias("kind"), "value")


def total(df: DataFrame, kind: str) -> DataFrame:
    return df.agg(_rows("value")).select(F.lit(kind).alias("kind"), "value")


def top(df: DataFrame, kind: str, column: str, limit: int = 30) -> DataFrame:
    return count_by(df, column).orderBy(F.col("cnt").desc(), column).limit(limit).select(F.lit(kind).alias("kind"), column, "cnt")


def session_facts(df: DataFrame, as_of: datetime) -> DataFrame:
    """The report's clock and time zone; the clock is a parameter."""
    now = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S"))
    return df.sparkSession.range(1).select(F.explode(F.array(
        F.struct(F.lit("ch_now").alias("kind"), now.alias("value")), F.struct(F.lit("ch_timezone").alias("kind"), F.current_timezone().alias("value")))).alias("f")).select("f.*")


def status_columns(df: DataFrame, part: str = "status") -> DataFrame:
    rows = [("raw_status_columns", n, t) for n, t in sorted(df.dtypes) if part in n.lower()]
    return df.sparkSession.createDataFrame(rows, "kind string, column_name string, column_type string")


def since(d: DataFrame, kind: str, as_of: datetime, hours: int) -> DataFrame:
    edge = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval '{hours}' hour")
    return total(d.where(F.col("published_at") >= edge), kind)


def newest(d: DataFrame) -> DataFrame:
    return d.agg(F.date_format(F.max("published_at"), "yyyy-MM-dd HH:mm:ss").alias("value")).select(F.lit("dedup_max_published_at").alias("kind"), "value")


_ARTICLE = ("published_at", "source", "id", "title", "link", "ingest_object_name", "batch_id")


def _pairs(d: DataFrame) -> DataFrame:
    """(person, verb) of 'person:verb,verb|person:verb'; what follows a second ':' is lost."""
    pair = d.where(text("persons_actions") != "").withColumn("pair", F.explode(F.split("persons_actions", "[|]")))
    parts = F.split("pair", ":")
    return (pair.withColumn("person", F.lower(F.trim(element(parts, 1)))).withColumn("verb", F.explode(F.split(element(parts, 2), ",")))
            .withColumn("verb", F.lower(F.trim("verb"))).where("verb <> ''"))


def persons_actions_flat(d: DataFrame) -> DataFrame:
    return _pairs(d).where("person <> ''").select(*_ARTICLE, "person", "verb")


def persons_actions_narrow(d: DataFrame) -> DataFrame:
    return _pairs(d).where(F.instr("pair", ":") > 0).select(F.col("published_at").alias("ts"), "source", "person", "verb")


def actions_verbs_flat(d: DataFrame) -> DataFrame:
    return d.select(*_ARTICLE, F.explode(items("actions_verbs")).alias("verb")).withColumn("verb", F.lower("verb"))


def per_time(flat: DataFrame, item: str, daily: bool) -> DataFrame:
    when = F.to_date("published_at").alias("dt") if daily else hour("published_at").alias("ts_hour")
    rows = "actions_rows" if item == "person" else "verb_rows"
    return flat.groupBy(when, item).agg(_rows(rows), F.count_distinct("id").alias("articles"))


def list_flat(d: DataFrame, column: str, name: str) -> DataFrame:
    return d.select(F.col("published_at").alias("ts"), "source", F.explode(items(column)).alias(name)).withColumn(name, F.lower(name))


def articles_by_hour(d: DataFrame) -> DataFrame:
    return count_by(d.withColumn("ts_hour", hour("published_at")), "ts_hour", "source", "lang")


def keywords_by_hour(d: DataFrame) -> DataFrame:
    rows = d.select(hour("published_at").alias("ts_hour"), "source", "lang", F.explode(items("keywords")).alias("keyword")).withColumn("keyword", F.lower("keyword"))
    return count_by(rows, "ts_hour", "source", "lang", "keyword")


def sentiment_state(d: DataFrame) -> DataFrame:
    """Mergeable partial states of the hourly sentiment: counts, sums and a sketch."""
    return d.groupBy(hour("published_at").alias("ts_hour"), "source", "lang").agg(
        _rows(), F.sum("sentiment_score").alias("score_sum"), F.count("sentiment_score").alias("score_n"),
        F.kll_sketch_agg_double("sentiment_score").alias("score_sketch"))


def sentiment_merged(state: DataFrame) -> DataFrame:
    """Partial states merged on read; the median is the lower one of the merged sketch."""
    some = state.groupBy("ts_hour", "source", "lang").agg(
        F.sum("cnt").alias("cnt"), F.sum("score_n").alias("n"), F.sum("score_sum").alias("total"),
        F.kll_merge_agg_double(F.when(F.col("score_n") > 0, F.col("score_sketch"))).alias("sketch"))
    median = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)))
    return some.select("ts_hour", "source", "lang", "cnt", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("sentiment_avg"), median.alias("sentiment_p50"))


def sentiment_values(d: DataFrame) -> DataFrame:
    """How often each sentiment occurs in an hour: counts that can be taken back."""
    return count_by(d.withColumn("ts_hour", hour("published_at")), "ts_hour", "source", "lang", "sentiment_score")


def sentiment_of_values(counts: DataFrame) -> DataFrame:
    """The hourly sentiment from counts of its values; the median is the lower one."""
    keys = ("ts_hour", "source", "lang")
    whole = Window.partitionBy(*keys)
    score = F.col("sentiment_score")
    felt = F.when(score.isNotNull(), F.col("cnt")).otherwise(0)
    run = counts.withColumns({"n": F.sum(felt).over(whole), "upto": F.sum(felt).over(whole.orderBy(score.asc_nulls_last()))})
    return run.groupBy(*keys).agg(
        F.sum("cnt").alias("cnt"), (F.sum(score * F.col("cnt")) / F.nullif(F.max("n"), F.lit(0))).alias("sentiment_avg"),
        F.min(F.when(2 * F.col("upto") >= F.col("n"), score)).alias("sentiment_p50"))


def events(d: DataFrame, column: str, name: str) -> DataFrame:
    return (d.where(text(column) != "").select("published_at", "source", "link", "title", F.explode(items(column, ";|")).alias(name))
            .withColumn(name, F.lower(name)))


def mentions_hourly(found: DataFrame, name: str, when: str = "dt") -> DataFrame:
    return count_by(found.withColumn(when, hour("published_at")), when, "source", name, name="mentions")


def sources_hourly(d: DataFrame) -> DataFrame:
    return count_by(d.withColumn("ts_hour", hour("published_at")), "ts_hour", "source", name="articles")


def coverage_status(latest: DataFrame, as_of: datetime) -> DataFrame:
    """Latest runs with staleness (14 days) and the lag of those that are not stale."""
    now = F.lit(as_of).cast("timestamp_ntz")
    stale = F.col("max_published_at").isNull() | (F.col("max_published_at") < now - F.expr("interval '14' day"))
    return latest.withColumn("is_stale", stale.cast("int")).withColumn("lag_minutes", F.when(~stale, minutes_between(F.col("max_published_at"), now)))


def between(d: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows from ``start`` on and before ``end``."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return d.where((F.col("published_at") >= at(start)) & (F.col("published_at") < at(end)))


def report_window(d: DataFrame, hours: int) -> DataFrame:
    """Rows of the last hours before the newest row."""
    newest_at = d.agg(F.max("published_at"))
    return d.where((F.col("published_at") >= newest_at.scalar() - F.expr(f"interval '{hours}' hour")) & (F.col("published_at") <= newest_at.scalar()))


def report_summary(w: DataFrame) -> DataFrame:
    return w.agg(_rows("articles"), F.count_distinct("source").alias("sources"), F.min("published_at").alias("min_dt"), F.max("published_at").alias("max_dt"),
                 F.round(F.avg("text_length_chars"), 1).alias("avg_len_chars"), F.round(F.avg("num_sentences"), 2).alias("avg_sentences"),
                 F.round(F.avg("num_keywords"), 2).alias("avg_keywords"))


def report_sources(w: DataFrame, limit: int = 30) -> DataFrame:
    return count_by(w, "source", name="n").orderBy(F.col("n").desc(), "source").limit(limit)


def report_hourly(w: DataFrame) -> DataFrame:
    return count_by(w.withColumn("hour", hour("published_at")), "hour", name="n").orderBy("hour")


def report_keywords(w: DataFrame, limit: int = 30) -> DataFrame:
    kws = F.filter(F.transform(F.split(F.lower(text("keywords")), r"[,;|\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 1)
    return count_by(w.select(F.explode(kws).alias("kw")), "kw", name="n").orderBy(F.col("n").desc(), "kw").limit(limit)
