"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints that differ in at most three bits differ in at most one
bit of one 32-bit half.  The first 31 bits of a half are covered by the perfect
Hamming code of radius 1: its codewords are the anchors.  A fingerprint's home
is the only anchor within radius 1; it is also replicated to every anchor
within radius 1 + 1 (at most 16).  A linked pair therefore meets at the home of
either, in one of the halves, and the exact distance is then compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.llm.common import give_back, materialize
from presswell.llm.graph import connected_components, forest

#: Fingerprints of one anchor that are compared as one block.
BLOCK = 1024
#: Home members from which an anchor's comparison is dealt out in blocks.
CROWDED = 64


def _pairs_of(s: int) -> list[int]:
    return [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)]


#: For a syndrome s > 0, the masks that lead from a word to its anchors within
#: radius 2: the one-bit correction, then the pairs of bits with that syndrome.
MASKS = [[0]] + [[1 << (s - 1)] + _pairs_of(s) for s in range(1, 32)]
#: Bit sets whose parities are the five bits of the syndrome.
CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, as an unsigned integer.

    A-Z are lower-cased; fewer than ``size`` words make one shingle; null or
    no word gives 0.  A bit is set if it is set in over half of the hashes.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :])] or [digest(line, seed)], dtype=">u8"
    )
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        block = hashes[k : k + 8192]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; one row per input row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = [_signed(fingerprint(t, size, seed)) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _syndrome(word: Column) -> Column:
    bits = [F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(c))).bitwiseAND(F.lit(1)), k) for k, c in enumerate(CHECKS)]
    out = bits[0]
    for b in bits[1:]:
        out = out + b
    return out


def _halves(fps: DataFrame) -> DataFrame:
    """(fp, half, word, syndrome): 31 bits of each half of a fingerprint."""
    word = [F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit((1 << 31) - 1)) for h in (0, 1)]
    return (
        fps.select("fp", F.explode(F.array(*[F.struct(F.lit(h).alias("half"), w.alias("word")) for h, w in enumerate(word)])).alias("h"))
        .select("fp", "h.half", "h.word")
        .withColumn("syndrome", _syndrome(F.col("word")))
    )


def _anchor(word: Column, mask: Column) -> Column:
    return word.bitwiseXOR(mask)


def anchor_links(fps: DataFrame, threshold: int = 3, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
    """(a, b) links that connect exactly the fingerprints within ``threshold``.

    Anchors with few home members compare by an equi-join.  At crowded anchors
    both sides, members and replicas, are cut into blocks of ``block`` by their own
    counts; each pair of blocks is its own group and returns the spanning forest of its links, so that neither a task
    nor the result grows with the square of a crowd.
    """
    if threshold > 3:
        raise ValueError("two halves with radius 1 cover thresholds up to 3")
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in MASKS])
    halves = _halves(fps)
    first = F.element_at(masks, F.col("syndrome") + 1)[0]
    home = halves.select("half", _anchor(F.col("word"), first).alias("anchor"), F.col("fp").alias("a"))
    near = halves.select(
        "half", "word", F.col("fp").alias("b"), F.explode(F.element_at(masks, F.col("syndrome") + 1)).alias("mask")
    ).select("half", _anchor(F.col("word"), F.col("mask")).alias("anchor"), "b")
    sizes = home.groupBy("half", "anchor").agg(F.count(F.lit(1)).alias("n"))
    # Replicas are many times the rows that Spark estimates, so that no side may be broadcast by that estimate.
    home = home.join(sizes.hint("merge"), ["half", "anchor"])
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    plain = (
        home.where(F.col("n") <= crowded).drop("n")
        .join(near.hint("merge"), ["half", "anchor"]).where((F.col("a") != F.col("b")) & close).select("a", "b")
    )

    crowd = sizes.where(F.col("n") > crowded)
    # Written, as the replicas of a crowded anchor are counted before they are cut.
    replicas = materialize(near.join(crowd.hint("merge"), ["half", "anchor"]), "crowded-replicas")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    cuts = replicas.groupBy("half", "anchor").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("r")).select("half", "anchor", blocks("n").alias("own"), blocks("r").alias("other"))
    cut = lambda c, many: F.pmod(F.xxhash64(c), F.col(many))
    each = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    left = (
        home.where(F.col("n") > crowded).join(cuts.hint("merge"), ["half", "anchor"])
        .select("half", "anchor", F.col("a").alias("fp"), cut("a", "own").alias("i"), each("other").alias("j"), F.lit(True).alias("home"))
    )
    right = (
        replicas.join(cuts.hint("merge"), ["half", "anchor"])
        .select("half", "anchor", F.col("b").alias("fp"), each("own").alias("i"), cut("b", "other").alias("j"), F.lit(False).alias("home"))
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        at_home = rows["home"].to_numpy()
        fp = rows["fp"].to_numpy()
        a, b = fp[at_home], fp[~at_home]
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(0, len(a), 256):
            x, y = np.nonzero(np.bitwise_count((a[k : k + 256, None] ^ b[None, :]).view(np.uint64)) <= threshold)
            out.append((a[k + x], b[y]))
            node, root = forest(np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out]))
            out = [(node, root)]
        node, root = out[0] if out else (fp[:0], fp[:0])
        return pd.DataFrame({"a": root, "b": node})[node != root]

    crowds = left.unionByName(right.select(*left.columns)).groupBy("half", "anchor", "i", "j").applyInPandas(compare, "a bigint, b bigint")
    return plain.union(crowds)


def near_duplicates(docs: DataFrame, threshold: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    Fingerprints within ``threshold`` bits are linked and ``component_id`` is
    the smallest doc_id that a document reaches, itself included.  Documents
    without words have the zero fingerprint and are linked like any other.
    Equal fingerprints are one node, so copies cost one row each.  A null
    doc_id is returned as null and never becomes a component_id while its
    component has another.  Other columns are ignored; an empty table gives an
    empty result.
    """
    sigs = materialize(signatures(docs, size, seed), "simhash")
    reps = materialize(sigs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    roots = materialize(connected_components(anchor_links(reps.select("fp"), threshold)), "components")
    joined = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = joined.select("fp", "root").join(low, "root").select("fp", "component_id")
    return sigs.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest doc_id.

    Of rows that repeat a doc_id one stays.  Rows without a doc_id have no
    place in that order and stay.  Null and empty texts have the zero
    fingerprint and are near-duplicates of one another; all columns stay, also
    such as the operator uses itself; an empty table gives an empty result.
    """
    found = near_duplicates(docs, **options)
    verdicts = materialize(
        found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept"
    )
    once, repeated = (verdicts.where(n).select("doc_id") for n in ("n = 1", "n > 1"))
    kept = docs.join(once.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id IS NULL"))
    # Ids are dealt out by hash at every size: they grow with the documents.
    # Only where ids repeat are the texts dealt out a second time.
    if repeated.isEmpty():
        return kept
    return kept.union(docs.join(repeated.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
