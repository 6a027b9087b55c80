"""Gates and reports on silver and gold layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.compat import text
from presswell.functions.records import language_reason, source_type

SILVER_COLUMNS = ("published_at", "title", "link", "source")
GOLD_COLUMNS = ("id", "title", "link", "published_at", "source", "clean_text", "summary", "keywords")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def validate_silver(df: DataFrame) -> int:
    """0 if valid, 1 if empty, 2 if columns are missing."""
    return 2 if missing_columns(df, SILVER_COLUMNS) else int(df.isEmpty())


def validate_gold(df: DataFrame, min_rows: int = 1) -> tuple[int, dict[str, float]]:
    """0 if valid, 1 if rows are too few or columns missing, and the shares of empty summaries and keywords."""
    if missing_columns(df, GOLD_COLUMNS):
        return 1, {}
    found = df.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.avg((text(c) == "").cast("int")), F.lit(0.0)).alias(c) for c in ("summary", "keywords")]).first()
    return int(found["rows"] < min_rows), {"empty_summary": found["summary"], "empty_keywords": found["keywords"]}


def precheck_silver(df: DataFrame, rows: int = 20) -> bool:
    """Whether any of the first ``rows`` has a title and a time of publication."""
    if missing_columns(df, ("published_at", "title")):
        return False
    return not df.limit(rows).where("published_at IS NOT NULL AND title IS NOT NULL").isEmpty()


def gold_non_empty(df: DataFrame) -> bool:
    return not df.isEmpty()


def missing_settings(found: dict[str, str], required: tuple[str, ...]) -> list[str]:
    """The required settings that are absent or blank."""
    return [n for n in required if not str(found.get(n) or "").strip()]


#: Fixed values that stand for a setting that no one has filled in.
PLACEHOLDERS = ("__FILL_ME__", "__REPLACE_ME__", "FILL_ME", "REPLACE_ME", "change-me-please")


def setting_faults(
    found: dict[str, str], required: tuple[str, ...], pairs: tuple[tuple[str, str], ...] = (), ports: tuple[str, ...] = (), one_of: tuple[tuple[str, ...], ...] = (),
) -> list[str]:
    """What is wrong with settings: absent or blank ones, placeholders, pairs that differ, ports that are no number from 1 to 65535.

    Of the groups in ``one_of`` the first that has any of its settings must be whole.
    """
    begun = [group for group in one_of if any(found.get(n) for n in group)]
    wanted = (*required, *(begun[0] if begun else ()))
    faults = [f"missing: {n}" for n in missing_settings(found, wanted)]
    if one_of and not begun:
        faults.append("missing: one of " + ", ".join(group[0] for group in one_of))
    faults += [f"placeholder: {n}" for n in wanted if found.get(n) in PLACEHOLDERS]
    faults += [f"different: {a}, {b}" for a, b in pairs if found.get(a) != found.get(b)]
    return faults + [f"no port: {n}" for n in ports if found.get(n) and not (str(found[n]).isdecimal() and 0 < int(found[n]) < 65536)]


def media_stats(posts: DataFrame) -> DataFrame:
    """Posts, their lengths, and the shares with video and photo; one row."""
    size = F.length(text("content"))
    share = lambda c: F.round(100 * F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), 1)
    return posts.agg(F.count(F.lit(1)).alias("posts"), F.floor(F.avg(size)).alias("avg_length"), F.min(size).cast("long").alias("min_length"), F.max(size).cast("long").alias("max_length"),
                     share("has_video").alias("video_percent"), share("has_photo").alias("photo_percent"))


def all_null_columns(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    """Columns without any value, in one pass."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if not counts[c]]


def share_nonempty(column: str, least: int = 1) -> Column:
    return F.coalesce(F.avg((F.length(F.trim(text(column))) >= least).cast("int")), F.lit(0.0))


def gold_gate(df: DataFrame, rows: int = 20, body: float = 0.05, body_chars: int = 50, empty_summary: float = 0.95, empty_keywords: float = 0.95) -> DataFrame:
    """(metric, value, threshold, passed), one row per rule."""
    found = df.agg(
        F.count(F.lit(1)).cast("double").alias("rows"), share_nonempty("clean_text", body_chars).alias("body_share"),
        (1 - share_nonempty("summary")).alias("empty_summary"), (1 - share_nonempty("keywords")).alias("empty_keywords"))
    rule = lambda name, limit, least: F.struct(
        F.lit(name).alias("metric"), F.round(F.col(name), 6).alias("value"), F.lit(float(limit)).alias("threshold"),
        (F.col(name) >= limit if least else F.col(name) <= limit).alias("passed"))
    rules = F.array(rule("rows", rows, True), rule("body_share", body, True), rule("empty_summary", empty_summary, False), rule("empty_keywords", empty_keywords, False))
    return found.select(F.explode(rules).alias("r")).select("r.*")


def nlp_coverage(df: DataFrame) -> DataFrame:
    """Rows and shares with a language, key phrases and a sentiment, per kind of source."""
    ok = lambda c: F.round(F.avg(c.cast("int")), 6)
    return df.groupBy(source_type(F.col("source")).alias("source_type")).agg(
        F.count(F.lit(1)).alias("rows"), ok(~text("lang").isin("", "unknown")).alias("lang"), ok(text("keyphrases") != "").alias("keyphrases"),
        ok(text("sentiment_label") != "").alias("sentiment"))


def nlp_samples(df: DataFrame, rows: int = 5) -> DataFrame:
    """A few rows for a reader of the coverage report, the newest first."""
    return df.select("id", "source", "lang", "keyphrases", "sentiment_label", "published_at").orderBy(F.col("published_at").desc_nulls_last(), "id").limit(rows)


def nlp_gate(df: DataFrame, lang: float = 0.9, keyphrases: float = 0.8, sentiment: float = 0.15) -> DataFrame:
    limits = {"lang": lang, "keyphrases": keyphrases, "sentiment": sentiment}
    rules = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(v).alias("threshold"), (F.col(k) >= v).alias("passed")) for k, v in limits.items()])
    return nlp_coverage(df).select("source_type", F.explode(rules).alias("r")).select("source_type", "r.*")


def language_reasons(df: DataFrame, column: str = "nlp_text") -> DataFrame:
    return df.groupBy(language_reason(F.col(column), F.col("lang")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def raw_text_stats(df: DataFrame, warn: float = 0.8) -> DataFrame:
    """Per source: rows, empty raw texts, and those that repeat the title."""
    raw = F.trim(text("raw_text"))
    found = df.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(raw == "").alias("empty"), F.count_if((raw != "") & (raw == F.trim(text("title")))).alias("same_as_title"))
    return found.withColumn("warn", (F.col("empty") + F.col("same_as_title")) / F.col("total") >= warn)


def wrong_constant(df: DataFrame, column: str, value: str) -> bool:
    """Whether any row has another value than the constant."""
    return not df.where(~F.col(column).eqNullSafe(F.lit(value))).isEmpty()
