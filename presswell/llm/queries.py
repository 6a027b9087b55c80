"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.llm import bpe, fim, merkle, mixing, oracles, phrases, quality_rules, rulefit, sharding, simhash, substring, toxicity, urllist, warc
from presswell.llm.common import table


SHARD_BYTES = 1 << 20
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.drop("ids")


def op7_quality_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulefit.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def url_changes(pages: DataFrame) -> DataFrame:
    """(entry, day, action): the history of a list over the hosts and paths of ``pages``.

    Every host below a registered domain, and every start of a path, that occurs
    is listed if the digest of its name begins with 0 to 4.  It is added on a day
    that its digest gives; a third of the entries are removed later, and a third
    are removed and added again.  Some are added and removed on one day.
    """
    number = lambda first, many: F.conv(F.substring(F.md5("entry"), first, many), 16, 10).cast("int")
    entries = pages.select(F.explode(urllist.keys(F.col("url"))).alias("entry")).distinct()
    listed = entries.where(F.col("entry").rlike(r"^[^./]+[.][^./]+[.]") & (F.substring(F.md5("entry"), 1, 1) < "5"))
    day = lambda n: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), n), "yyyy-MM-dd")
    first, kind, gap = number(2, 4) % 280, number(6, 2) % 3, number(8, 2) % 50 + 5
    change = lambda n, action: F.struct(day(n).alias("day"), F.lit(action).alias("action"))
    turns = F.when(kind == 0, F.array(change(first, "add"))).when(kind == 1, F.array(change(first, "add"), change(first + gap, "remove"))).otherwise(
        F.array(change(first, "add"), change(first + gap, "remove"), change(first + gap + 20, "add")))
    same_day = F.when(number(10, 1) == 0, F.array(change(first, "remove"))).otherwise(F.slice(turns, 1, 0))
    return listed.select("entry", F.explode(F.concat(turns, same_day)).alias("c")).select("entry", "c.day", "c.action")


def op9_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch time; page_id spreads them over the days of 2024."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(CAST(page_id * 37 % 366 AS INT), CAST(page_id % 24 AS INT))")
    return urllist.judged(pages.select("page_id", "url", fetched.alias("fetched_at")), url_changes(pages))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_merkle_fingerprint": op3_merkle_fingerprint,
    "op4_source_mixing": op4_source_mixing,
    "op5_extendible_sharding": op5_extendible_sharding,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_rule_ensemble": op7_quality_rule_ensemble,
    "op8_simhash_anchor": op8_simhash_anchor,
    "op9_url_list": op9_url_list,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_warc_members": op12_warc_members,
    "op13_phrase_mining": op13_phrase_mining,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": oracles.OP2,
    "op4_source_mixing": oracles.OP4,
    "op5_extendible_sharding": oracles.OP5,
    "op9_url_list": oracles.OP9,
    "op11_fill_in_middle": oracles.OP11,
    "op12_warc_members": oracles.OP12,
    "op13_phrase_mining": oracles.OP13,
}
