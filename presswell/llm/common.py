"""Reading, materialising and small numeric helpers that the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswell.sources.shared import materialize, shared_dir  # noqa: F401  the operators take them from here

#: Java/RE2 class of the six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters as text, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(df: DataFrame, order: list[Column], value: Column, name: str, tag: str) -> DataFrame:
    """``df`` with a column ``name``: the sum of ``value`` (bigint) over the rows ahead in ``order``.

    Rows are dealt out by range and written, the ranges' sums are added up, and
    each range runs on its own, so that no task holds more than a range.
    ``order`` must tell all rows apart, or equal rows must be alike.
    """
    part, own = spare(df, "_part"), spare(df, "_value")
    dealt = materialize(df.withColumn(own, value).repartitionByRange(*order).withColumn(part, F.spark_partition_id()), tag)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ahead = dealt.groupBy(part).agg(F.sum(own).alias(own)).select(part, F.coalesce(F.sum(own).over(before), F.lit(0)).alias(name))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn(own, F.coalesce(F.sum(own).over(within), F.lit(0)))
    return inner.join(F.broadcast(ahead), part).withColumn(name, F.col(name) + F.col(own)).drop(part, own)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands at most ``rows`` rows at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return freed memory to the system; workers are reused and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def spare(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` has."""
    while name in df.columns:
        name = "_" + name
    return name


def n_words(text: Column) -> Column:
    """Number of maximal runs of non-space characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word as uint64."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, from the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += words[i : i + n]
    return mix64(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
