"""Sharding by extendible hashing.

A directory maps leading bits of a row's hash to shards.  Only a bucket over
the byte limit is split on its next bit.  Sizes are summed from a histogram over
prefixes: splitting begins at the depth above which no bucket fits, and goes on
inside each oversized bucket on its own until every shard fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswell.llm.common import materialize

BITS = 60
#: Bits that one pass looks beyond its first depth.
AHEAD = 6


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, bytes, hash): one row per input row with its own 60-bit hash.

    The hash covers doc_id, text and the number among rows that agree in both;
    those are counted first and numbered from the count, so that neither a
    repeated doc_id nor a repeated row makes a bucket that cannot be split.
    """
    text = F.coalesce("text", F.lit(""))
    runs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.md5(text).alias("key")
    ).groupBy("doc_id", "bytes", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = runs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "key", F.col("i").cast("string"))
    return rows.select("doc_id", "bytes", F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long").alias("hash"))


def _prefix(depth: int, column: str = "hash", bits: int = BITS) -> Column:
    return F.expr(f"shiftright({column}, {bits} - {depth})")


def _fits(limit_bytes: int, size: Column, rows: Column, depth: Column) -> Column:
    return (size <= limit_bytes) | (rows == 1) | (depth == BITS)


def _first_depth(leaves: DataFrame, high: int, guess: int, limit_bytes: int) -> int:
    """The deepest depth, from ``guess`` upwards, above which no bucket fits."""
    low = guess
    while low > 0:
        above = leaves.groupBy(_prefix(low - 1, "leaf", high).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        if above.where(_fits(limit_bytes, F.col("bytes"), F.col("rows"), F.lit(low - 1))).isEmpty():
            break
        low -= 1
    return low


def _split(leaves: DataFrame, low: int, high: int, limit_bytes: int) -> DataFrame:
    """(leaf, s): the shallowest bucket from depth ``low`` to ``high`` that fits; leaves without one are left out.

    All buckets below one of depth ``low`` are split in one place; its leaves
    are at most 2 ** (high - low).
    """
    own = leaves.withColumn("root", _prefix(low, "leaf", high)).repartition("root")
    levels = own.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.expr(f"shiftright(leaf, {high} - depth)"))
    bucket = Window.partitionBy("root", "depth", "prefix")
    sums = levels.withColumns({"shard_bytes": F.sum("bytes").over(bucket), "shard_rows": F.sum("rows").over(bucket)})
    fit = sums.where(_fits(limit_bytes, F.col("shard_bytes"), F.col("shard_rows"), F.col("depth")))
    return fit.groupBy("root", "leaf").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("s")).select("leaf", "s")


def shards(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """(doc_id, bytes, depth, prefix, shard_bytes, shard_rows), one row per input row.

    A shard is named by ``depth`` leading hash bits, ``prefix``.  Its bytes of
    UTF-8 text stay within ``limit_bytes``, but for a shard that is one
    document over the limit by itself.  A null text has 0 bytes; a null doc_id
    is hashed as empty; rows may repeat; extra columns are ignored; an empty
    table gives an empty result.
    """
    rows = materialize(keyed(docs), "hashes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, done, left = max(0, math.floor(math.log2(max(1, total / limit_bytes))) - 1), [], rows
    while True:
        high = min(BITS, low + AHEAD)
        leaves = materialize(left.groupBy(_prefix(high).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")), "histogram")
        if not done:
            low = _first_depth(leaves, high, low, limit_bytes)
        chosen = materialize(_split(leaves, low, high, limit_bytes), "directory")
        named = left.withColumn("leaf", _prefix(high))
        done.append(named.join(chosen, "leaf").select("doc_id", "bytes", "s.depth", "s.prefix", "s.shard_bytes", "s.shard_rows"))
        rest = materialize(named.join(chosen, "leaf", "left_anti").select(*rows.columns), "oversized")
        if high == BITS or rest.isEmpty():
            break
        left, low = rest, high
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def directory(found: DataFrame) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows): the shards that ``found`` names."""
    return found.groupBy("depth", "prefix").agg(F.max("shard_bytes").alias("shard_bytes"), F.max("shard_rows").alias("shard_rows"))
