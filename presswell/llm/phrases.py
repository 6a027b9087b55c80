"""Phrase collocation mining by word-id suffix arrays.

Each task joins the words of a shard of documents, as numbers, to one array
and sorts its suffixes by numpy prefix doubling.  Neighbours in that order share
a prefix of some words; a maximal run of neighbours that share n words or more
is an LCP interval, and its size is the count of one n-gram in the shard.
Counts are merged by key over all shards, so that a phrase costs a row per
task, however frequent it is: first those of one and two words, then longer
ones in which every pair of words is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswell.llm.common import give_back, materialize, mix64, word_hashes

#: Bytes of the texts that make one shard.
SHARD_BYTES = 4_000_000
#: Texts that are dealt to the shards of their languages at once.
TEXTS = 512
#: Phrases that are put into words at once.
BATCH = 1 << 16
#: What ends a piece, and what is between words.
_ENDS = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_BETWEEN = np.isin(np.arange(256), [0x20, 0x09]) | _ENDS


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` (0 ends a piece) in the order of the ``depth`` words from there on.

    Prefix doubling: the rank of 2k words is that of the first k, then that of
    the k after them.  It stops once ``depth`` words are told apart, or all are.
    """
    n = len(ids)
    rank, known = ids.astype(np.int64), 1
    order = np.argsort(rank) if depth == 1 else None
    while known < depth:
        after = np.zeros(n, np.int64)
        after[: n - known] = rank[known:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key)
        ranked = key[order]
        new = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        known *= 2
        if n and new[-1] == n - 1:
            break
    return order


def shared_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(lcp, room): words, up to ``depth``, that each suffix shares with the one
    before it in ``order``, and words from it to the end of its piece."""
    padded = np.append(ids, np.zeros(depth, ids.dtype))
    lcp, room = np.zeros(len(ids), np.int8), np.zeros(len(ids), np.int8)
    same = inside = np.ones(len(ids), bool)
    for j in range(depth):
        word = padded[order + j]
        inside = inside & (word != 0)
        same = same & inside & np.append(False, word[1:] == word[:-1])
        lcp += same
        room += inside
    return lcp, room


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(vocabulary in byte order, ids): the words of all texts as 1, 2, ... and a 0 after each piece."""
    lines = pc.binary_join_element_wise(pc.ascii_lower(pc.fill_null(texts, "")), "", "\n")
    ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    raw = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]  # all texts, each with a line end
    inside = np.concatenate([[False], ~_BETWEEN[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return pa.array([], pa.string()), np.empty(0, np.int32)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside[1:-1]].tobytes())]).dictionary_encode()
    by = np.asarray(pc.sort_indices(words.dictionary))
    number = np.empty(len(by), np.int32)
    number[by] = np.arange(1, len(by) + 1, dtype=np.int32)
    # A piece's end after a word: where an end mark lies before the next word.
    marks = np.append(0, np.cumsum(_ENDS[raw]))
    last = np.append(marks[starts[1:]] != marks[ends[:-1]], True)
    ids = np.zeros(len(starts) + int(last.sum()), np.int32)
    ids[np.arange(len(starts)) + np.append(0, np.cumsum(last[:-1]))] = number[np.asarray(words.indices)]
    return words.dictionary.take(pa.array(by)), ids


def pair_places(first: np.ndarray, second: np.ndarray, lang: int, bits: int) -> np.ndarray:
    """A place among 2**bits for pairs of words, from the words' hashes."""
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xD6E8FEB86659FD93) + np.uint64(lang)) >> np.uint64(64 - bits)


def linked(ids: np.ndarray, hashes: np.ndarray, lang: int, marks: np.ndarray) -> np.ndarray:
    """``ids`` cut between words whose pair is not in the bitmap ``marks``, without words that stand alone then."""
    bits = int(len(marks) * 8).bit_length() - 1
    both = (ids[:-1] != 0) & (ids[1:] != 0)
    place = pair_places(hashes[ids[:-1][both] - 1], hashes[ids[1:][both] - 1], lang, bits)
    link = np.zeros(len(ids) + 1, bool)  # whether a word goes on from the one before it
    link[1:-1][both] = marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)
    kept = np.flatnonzero((ids != 0) & (link[:-1] | link[1:]))
    last = ~link[kept + 1]
    out = np.zeros(len(kept) + int(last.sum()), np.int32)
    out[np.arange(len(kept)) + np.append(0, np.cumsum(last[:-1]))[: len(kept)]] = ids[kept]
    return out


def shard_counts(texts: pa.Array, depth: int, lang: str = "", marks: np.ndarray | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, counts) of the runs of one to ``depth`` words, and of all words under the empty phrase.

    With ``marks``, those of three words or more of which all pairs are marked.
    """
    vocabulary, ids = words_of(texts)
    words = np.count_nonzero(ids)
    if marks is not None and words:
        ids = linked(ids, word_hashes([w.encode() for w in vocabulary.to_pylist()]), xxhash.xxh64_intdigest(lang), marks)
    if not len(ids):
        return
    order = suffix_order(ids, depth)
    lcp, room = shared_prefixes(ids, order, depth)
    if marks is None:
        yield pa.array([""]), np.array([words])
    for n in range(1 if marks is None else 3, depth + 1):
        turns = np.flatnonzero(lcp < n)  # an interval of n shared words ends before each of these
        sizes = np.diff(np.append(turns, len(ids)))
        whole = room[turns] >= n
        at = order[turns[whole]]
        sizes = sizes[whole]
        for i in range(0, len(at), BATCH):
            parts = [vocabulary.take(pa.array(ids[at[i : i + BATCH] + j] - 1)) for j in range(n)]
            yield (pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]), sizes[i : i + BATCH]


def _counted(docs: DataFrame, depth: int, marks: bytes | None = None) -> DataFrame:
    """(lang, phrase, f) over all shards; see ``shard_counts``."""
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if sent.value is None else np.frombuffer(sent.value, np.uint8)
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}

        def counted(lang: str) -> Iterator[pa.RecordBatch]:
            size.pop(lang)
            for phrases, counts in shard_counts(pa.concat_arrays(held.pop(lang)), depth, lang, bitmap):
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(pa.scalar(lang), phrases, "\n"), pa.array(counts, pa.int64())], ["key", "f"])
            give_back()

        # Few texts at a time, so that a batch of long ones is not held twice.
        for part in (p.slice(i, TEXTS) for p in parts for i in range(0, len(p), TEXTS)):
            langs = pc.fill_null(part.column("lang"), "und").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = part.column("text").filter(pc.equal(langs.indices, k))
                shard = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(own), 0), np.int64)) // SHARD_BYTES
                cuts = np.append(np.flatnonzero(np.diff(shard, prepend=0)) + 1, len(own))
                for begin, end in zip(np.append(0, cuts[:-1]), cuts):  # after each text with which a shard is full
                    texts = own[int(begin) : int(end)]
                    held.setdefault(lang, []).append(texts)
                    size[lang] = size.get(lang, 0) + (pc.sum(pc.binary_length(texts)).as_py() or 0)
                    if size[lang] >= SHARD_BYTES:
                        yield from counted(lang)
            if sum(size.values()) >= 2 * SHARD_BYTES:  # very many languages
                for lang in list(held):
                    yield from counted(lang)
        for lang in list(held):
            yield from counted(lang)
        give_back()

    # One key column: what is shuffled is little more than the phrases.
    rows = docs.select("lang", "text").mapInArrow(run, "key string, f bigint").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", -1)  # no word has a line end
    return rows.select(F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")


def _marks(pairs: DataFrame, most_bits: int) -> bytes:
    """A bitmap of the places of pairs (lang, phrase): 16 bits for each, 2**most_bits at most."""
    bits = min(max(int(16 * pairs.count()).bit_length(), 15), most_bits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs = part.column("lang").dictionary_encode()
            words = pc.split_pattern(part.column("phrase"), " ").flatten()
            hashes = word_hashes([w.encode() for w in words.to_pylist()])
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(np.asarray(langs.indices) == k)
                yield pa.RecordBatch.from_arrays([pa.array(pair_places(hashes[2 * own], hashes[2 * own + 1], xxhash.xxh64_intdigest(lang), bits).astype(np.int64))], ["place"])

    # Numbers from 1 in the functions' buckets of 32,768 bits.
    places = pairs.select("lang", "phrase").mapInArrow(run, "place bigint").select((F.col("place") + 1).alias("place"))
    chunks = places.groupBy(F.bitmap_bucket_number("place").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for b, chunk in chunks:
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(chunk, np.uint8)
    return out.tobytes()


def phrase_counts(docs: DataFrame, depth: int = 3, least: int = 1, most_bits: int = 27) -> DataFrame:
    """(lang, phrase, f) of all runs of one to ``depth`` words inside pieces that occur ``least`` times.

    Texts are in lower case (A-Z only), cut into pieces at ``.,;:!?`` and line
    ends, and those into words at spaces and tabs.  The empty phrase counts all
    words.  A null lang is 'und'; a null or empty text has no words; texts are
    taken whole, whatever their length, one that is longer than a shard by
    itself; rows may repeat and each counts; extra columns are ignored.

    Longer phrases are counted in a second pass.  Of those that occur ``least``
    times all pairs of words do, so the texts are cut first where a pair does
    not.  The frequent pairs go to the tasks as a bitmap of fixed size (16 MiB
    at most) in which others may be marked too: these are counted and then left
    out, so that a full bitmap costs time and no phrase.
    """
    short = _counted(docs, min(depth, 2))
    frequent = materialize(short.where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")
    if depth <= 2:
        return frequent
    marks = _marks(frequent.where(F.contains("phrase", F.lit(" "))), most_bits)
    return frequent.union(materialize(_counted(docs, depth, marks).where(F.col("f") >= least), "long-phrases"))


def _cuts(words: Column, n: Column, front: bool) -> Column:
    """The first, or the last, words of a phrase for each place to cut it."""
    ks = F.sequence(F.lit(1), n - 1)
    part = (lambda k: F.slice(words, F.lit(1), k)) if front else (lambda k: F.slice(words, k + 1, n - k))
    return F.transform(ks, lambda k: F.array_join(part(k), " "))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, covered: int = 50, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    Candidates are the phrases of 2 to ``longest`` words that occur ``a`` times,
    ``least`` or more.  Cut after some words, ``l`` and ``r`` are the counts of
    both parts and the score is floor(1000000 a a / (l r)); the cut of the
    lowest score counts, the first among equals.  A candidate inside a longer one
    that has ``covered`` % of its occurrences is dropped.  The first ``most`` by
    score, then a, then the phrase are kept; ``n`` is the number of all words.

    Only phrases that occur ``least`` times are looked at after the merge, as
    the parts of a candidate do so too.  Numbers are decimals of 38 digits, which
    holds for a up to 10**15.  See ``phrase_counts`` for odd rows; languages
    without a candidate, and an empty table, give no row.
    """
    frequent = phrase_counts(docs, longest, least)
    words = F.split("phrase", " ")
    candidates = frequent.where(F.contains("phrase", F.lit(" ")))
    # The most frequent longer phrase that holds each phrase.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ws") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("ws") - m + 1), lambda i: F.array_join(F.slice("ws", i, m), " "))))
    longer = candidates.withColumn("ws", words).where(F.size("ws") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("within"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("within").isNull() | (100 * F.col("within") < covered * F.col("f"))).drop("within")
    cut = kept.withColumn("ws", words).select("lang", "phrase", F.col("f").alias("a"), F.posexplode(
        F.arrays_zip(_cuts(F.col("ws"), F.size("ws"), True).alias("front"), _cuts(F.col("ws"), F.size("ws"), False).alias("back"))).alias("k", "parts"))
    # Written, so that a word which very many candidates begin or end with is split over tasks.
    cut = materialize(cut.select("lang", "phrase", "a", "k", "parts.front", "parts.back"), "phrase-cuts")
    of = lambda part, name: frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)).hint("shuffle_hash")
    halves = materialize(cut.join(of("front", "l"), ["lang", "front"]), "phrase-halves").join(of("back", "r"), ["lang", "back"])
    score = F.expr("(CAST(1000000 AS decimal(7,0)) * (CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0)))) div (CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0)))")
    lowest = halves.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = lowest.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    totals = frequent.where(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
