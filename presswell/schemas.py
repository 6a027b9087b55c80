"""Schemas of the layers, and fitting a frame to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = """id uid channel title link source raw_text clean_text nlp_text summary keywords batch_id ingest_object_name entities_persons entities_orgs
entities_geo persons geo persons_actions actions_verbs entities_persons_canon entities_orgs_canon entities_geo_canon lang keyphrases sentiment_label""".split()
_LONG = ("text_length_chars", "num_sentences", "num_keywords")
_INT = ("num_persons", "num_orgs", "num_geo", "is_digest", "sentiment_ok")

ARTICLES = T.StructType(
    [T.StructField("published_at", T.TimestampNTZType())] + [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField(n, T.LongType()) for n in _LONG] + [T.StructField(n, T.IntegerType()) for n in _INT]
    + [T.StructField("sentiment_score", T.DoubleType())])
COVERAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("batch_id", "source_type", "source")]
    + [T.StructField(n, T.TimestampNTZType()) for n in ("run_started_at", "run_finished_at")]
    + [T.StructField(n, T.LongType()) for n in ("duration_ms", "items_found", "items_saved")]
    + [T.StructField(n, T.TimestampNTZType()) for n in ("min_published_at", "max_published_at")]
    + [T.StructField(n, T.StringType()) for n in ("status", "error_message", "raw_object_name")])
LOAD_LOG = "layer string, object_name string, loaded_at timestamp_ntz, rows_loaded bigint"
RAW_RECORD = "id string, uid string, title string, link string, source string, channel string, published_at string, raw_text string, content string, batch_id string"


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: cast where present, else the default.

    Texts default to '', numbers to 0, and what may be unknown to null; columns
    that the schema does not know are dropped.
    """
    def column(field: T.StructField):
        if field.name in df.columns:
            found = F.col(field.name).cast(field.dataType)
            return (F.coalesce(found, F.lit("")) if isinstance(field.dataType, T.StringType) else found).alias(field.name)
        default = "" if isinstance(field.dataType, T.StringType) else 0 if isinstance(field.dataType, (T.LongType, T.IntegerType)) else None
        return F.lit(default).cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])
