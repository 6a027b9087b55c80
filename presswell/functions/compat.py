"""Column helpers with the warehouse dialect's semantics, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"


def text(c: Column | str) -> Column:
    """The column, '' where null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def items(c: Column | str, mark: str = ";") -> Column:
    """Trimmed non-empty elements of a list kept in a string."""
    return F.filter(F.transform(F.split(text(c), f"[{mark}]"), lambda x: F.trim(x)), lambda x: x != "")


def element(c: Column, n: int) -> Column:
    """n-th element, from 1; '' beyond the end."""
    return F.coalesce(F.try_element_at(c, F.lit(n)), F.lit(""))


def one_line(c: Column | str) -> Column:
    """Tabs and line ends as spaces."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\t\r\n]", " ")


def dedup_key() -> Column:
    """The link, or else the id, or else ''."""
    return F.coalesce(F.nullif("link", F.lit("")), F.nullif("id", F.lit("")), F.lit(""))


def batch_key() -> Column:
    """The batch, or else the object it was loaded from."""
    return F.when(text("batch_id") == "", F.col("ingest_object_name")).otherwise(F.col("batch_id"))


def month(c: Column | str) -> Column:
    """yyyyMM, by which tables are partitioned."""
    return F.date_format(c, "yyyyMM")


def once(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hour(c: Column | str) -> Column:
    return F.date_trunc("HOUR", c).cast("timestamp_ntz")


def share(part: Column, whole: Column) -> Column:
    """Ratio to three places; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(part, whole), 3))


def minutes_between(a: Column, b: Column) -> Column:
    """Minute boundaries crossed from a to b."""
    minute = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / 60)
    return (minute(b) - minute(a)).cast("long")


def loaded_at(batch: str = "batch_id") -> Column:
    """Load time that a batch name carries, the epoch if it has none.

    Names that start with 20 are times in any of the usual forms; others may
    hold yyyyMMddTHHmmssZ.
    """
    tried = lambda value, pattern: F.expr(f"try_to_timestamp({value}, \"{pattern}\")").cast("timestamp_ntz")
    plain = f"regexp_replace({batch}, '([.][0-9]+)?(Z|[+]00:?00)?$', '')"
    known = F.coalesce(*[tried(plain, p) for p in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd'T'HHmmss", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")])
    packed = tried(f"nullif(regexp_extract({batch}, '([0-9]{{8}}T[0-9]{{6}})Z', 1), '')", "yyyyMMdd'T'HHmmss")
    return F.coalesce(F.when(F.col(batch).startswith("20"), known).otherwise(packed), F.expr(EPOCH))
