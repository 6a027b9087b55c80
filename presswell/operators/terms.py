"""Corpus-wide term operators: TF-IDF keywords, stop-word mining, persons' names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswell.functions import constants as K
from presswell.functions.compat import text
from presswell.functions.records import _clean_name, _name_tokens, normalized, strip
from presswell.sources.shared import materialize


def words_of(column: str, stop: list[str] | None = None, lemma=None, keep=None) -> Column:
    """The kept words of a text, in lower case and ё as е.

    ``lemma`` takes a word to its base form and ``keep`` tells which words
    count, as a tagger of parts of speech would.
    """
    stop = [*K.STOP_TFIDF, *K.DOMAIN_WORDS] if stop is None else stop
    fold = lambda c: F.replace(c, F.lit("ё"), F.lit("е"))
    kept = lambda w: ~w.isin(*[w.replace("ё", "е") for w in stop])
    lower = F.lower(text(column))
    if lemma is None and keep is None:
        return F.filter(F.regexp_extract_all(fold(lower), F.lit("[a-zа-я]{2,}"), F.lit(0)), kept)
    words = F.regexp_extract_all(lower, F.lit("[a-zа-яё]{2,}"), F.lit(0))
    if keep is not None:
        words = F.filter(words, keep)
    words = F.transform(words, lambda w: fold(lemma(w) if lemma else w))
    return F.filter(words, lambda w: kept(w) & (F.length(w) >= 2))


def common_runs(words: DataFrame, most: int, limit: float, longest: int = 3, sent: int | None = None) -> DataFrame:
    """(term, tf): runs of words of the arrays ``ws``, among them all of the ``most`` most frequent ones that at most ``limit`` rows have.

    A run is not more frequent than the shorter ones inside it, so that longer
    runs are counted only where both runs inside are frequent enough: as the
    ``most``-th of those known so far that at most ``limit`` rows can have.  Up
    to ``sent`` such runs are broadcast; if there are more, all are counted.
    """
    sent = SENT_FEATURES if sent is None else sent
    run = lambda first, last: F.concat_ws(" ", *[f"w{k}" for k in range(first, last + 1)])
    found, least = None, 1
    for k in range(1, longest + 1):
        # From an outer generator no filter is inferred, which would make the arrays once more.
        ahead = F.arrays_zip(*[F.slice("ws", i, F.greatest(F.size("ws"), F.lit(0))) for i in range(1, k + 1)])
        rows = words.select(F.inline_outer(ahead).alias(*[f"w{i}" for i in range(1, k + 1)]) if k > 1 else F.explode_outer("ws").alias("w1")).where(F.col(f"w{k}").isNotNull())
        if k > 1 and least > 1:
            inner = found.where((F.col("n") == k - 1) & (F.col("tf") >= least)).select(F.col("term").alias("inner"))
            if inner.count() <= sent:
                for first in (1, 2):
                    rows = rows.join(F.broadcast(inner), run(first, first + k - 2) == F.col("inner"), "left_semi")
        counted = rows.groupBy(run(1, k).alias("term")).agg(F.count(F.lit(1)).alias("tf")).where(F.col("tf") >= least)
        counted = materialize(counted.withColumn("n", F.lit(k)), "common-runs")
        found = counted if found is None else found.union(counted)
        # A run in more than ``limit`` rows is in them more than ``limit`` times.
        last = found.where(F.col("tf") <= limit).orderBy(F.col("tf").desc()).limit(most).agg(F.count(F.lit(1)), F.min("tf")).first()
        least = max(least, last[1]) if last[0] == most else least
    return found.where(F.col("tf") >= least).select("term", "tf")


class _Vocabulary:
    """Terms by their places in alphabetical order, looked up in lists of words."""

    def __init__(self, terms: list[str]) -> None:
        split = [t.split(" ") for t in terms]
        words = sorted({w for ws in split for w in ws})
        at = {w: i for i, w in enumerate(words)}
        self.size, self.words, self.base = len(terms), pa.array(words, pa.string()), max(len(words), 1)
        self.runs: list[tuple[int, np.ndarray, np.ndarray]] = []
        for k in sorted({len(ws) for ws in split}):
            places = np.array([i for i, ws in enumerate(split) if len(ws) == k], np.int64)
            codes = self._codes([np.array([at[split[i][j]] for i in places], np.int64) for j in range(k)])
            order = np.argsort(codes)
            self.runs.append((k, codes[order], places[order]))

    def _codes(self, ids: list[np.ndarray]) -> np.ndarray:
        return sum(x * self.base ** (len(ids) - 1 - j) for j, x in enumerate(ids))

    def counts(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, times): which terms each list has."""
        ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        found = [np.empty(0, np.int64)]
        for k, codes, places in self.runs:
            many = max(len(ids) - k + 1, 0)
            own = [ids[j : j + many] for j in range(k)]
            good = np.flatnonzero(np.logical_and.reduce([x >= 0 for x in own]) & (row[:many] == row[k - 1 : k - 1 + many]))
            code = self._codes([x[good] for x in own])
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[at] == code
            found.append(row[good[hit]] * self.size + places[at[hit]])
        both, times = np.unique(np.concatenate(found), return_counts=True)
        return both // max(self.size, 1), both % max(self.size, 1), times


def _best_terms(words: DataFrame, key: str, n: int, most: int, limit: float, max_features: int) -> DataFrame:
    """(key, rank, term): the ``most`` best terms of the arrays ``ws`` by ``tfidf_keywords``."""
    common = materialize(common_runs(words, max_features, limit), "common-terms")
    # So many of them may yet be in too many rows.
    spare = common.where(F.col("tf") > limit).count()
    listed = sorted((r["term"], r["tf"]) for r in common.orderBy(F.col("tf").desc(), "term").limit(max_features + spare).collect())
    maybe = _Vocabulary([t for t, _ in listed])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(maybe.size, np.int64)
        for batch in batches:
            df += np.bincount(maybe.counts(batch.column(0))[1], minlength=maybe.size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"place": at, "df": df[at]})

    df = {r["place"]: r["df"] for r in words.select("ws").mapInArrow(seen, "place bigint, df bigint").groupBy("place").agg(F.sum("df").alias("df")).collect()}
    kept = sorted((-tf, t, df[i]) for i, (t, tf) in enumerate(listed) if df[i] <= limit)[:max_features]
    kept = sorted((t, d) for _, t, d in kept)
    terms, vocabulary = pa.array([t for t, _ in kept], pa.string()), _Vocabulary([t for t, _ in kept])
    idf = np.log((1 + n) / (1 + np.array([d for _, d in kept], float))) + 1

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, times = vocabulary.counts(batch.column(1))
            weight = times * idf[place]
            weight = np.floor(weight / np.sqrt(np.bincount(row, weight * weight))[row] * 1e9 + 0.5)
            order = np.lexsort((place, -weight, row))
            row, place = row[order], place[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
            good = rank <= most
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[good])), pa.array(rank[good]), terms.take(pa.array(place[good]))], [key, "rank", "term"])

    schema = T.StructType([words.schema[key], T.StructField("rank", T.LongType()), T.StructField("term", T.StringType())])
    return words.select(key, "ws").mapInArrow(best, schema)


def frequencies(rows: DataFrame, found: str, *keys: str) -> DataFrame:
    """(*keys, term, tf, df): how often the terms of the arrays ``found`` occur, and in how many rows.

    Each row gives its terms and then, once each, its different ones, so that
    both numbers are sums by term: they are added up where the rows are, and
    only a term's sums are shuffled, no row's own counts.
    """
    listed = rows.select(*keys, F.size(found).alias("size"), F.posexplode_outer(F.concat(found, F.array_distinct(found))).alias("at", "term"))
    # From an outer generator no filter is inferred, which would make the arrays once more.
    listed = listed.where("term IS NOT NULL")
    again = F.col("at") >= F.col("size")
    return listed.groupBy(*keys, "term").agg(F.count_if(~again).alias("tf"), F.count_if(again).alias("df"))


#: Characters of a dictionary up to which it is sent to all tasks.
SENT_CHARS = 16_000_000

#: Terms of a vocabulary up to which it is sent to all tasks.
SENT_FEATURES = 100_000


def lemmatized(docs: DataFrame, key: str, column: str, lemmas: DataFrame, sent_chars: int = SENT_CHARS) -> DataFrame:
    """(key, column): texts with each word as the dictionary (form, lemma) has it, in lower case and ё as е.

    Words are taken out with their places, joined to the dictionary and put
    back in order.  Up to ``sent_chars`` characters the dictionary is broadcast;
    a larger one is shuffled, where Spark may split a word that very many texts
    have.  Of several lemmas of a form the first by alphabet counts; a word that
    the dictionary does not know stays; marks between words become a space; a
    null text has no words.  The key must tell the rows apart.
    """
    fold = lambda c: F.replace(F.lower(c), F.lit("ё"), F.lit("е"))
    known = lemmas.where("form IS NOT NULL AND lemma IS NOT NULL").select(fold(F.col("form")).alias("word"), "lemma").groupBy("word").agg(F.min("lemma").alias("lemma"))
    size = known.agg(F.coalesce(F.sum(F.length("word") + F.length("lemma")), F.lit(0))).first()[0]
    words = docs.select(key, F.posexplode(F.regexp_extract_all(fold(text(column)), F.lit("[A-Za-zА-Яа-яЁё]+"), F.lit(0))).alias("at", "word"))
    joined = words.join(F.broadcast(known) if size <= sent_chars else known, "word", "left").select(key, F.struct("at", F.coalesce("lemma", "word").alias("w")).alias("t"))
    whole = joined.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["w"]), " ").alias(column))
    return docs.select(key).join(whole, key, "left").select(key, text(column).alias(column))


def tfidf_keywords(
    docs: DataFrame, key: str, column: str, most: int = 8, max_df: float = 0.85, max_features: int = 50_000, least: int = 3, stop: list[str] | None = None,
    lemma=None, keep=None,
) -> DataFrame:
    """(key, keywords): the best terms of each document, longest first.

    Weights are tf * (ln((1 + n) / (1 + df)) + 1), normalised to length 1 per
    document.  Terms in more than ``max_df`` of at least five documents are
    left out, then the ``max_features`` most frequent are kept.  Of the best
    ``most`` terms those that only make noise, and those inside another one,
    are dropped.  Under three documents, frequency alone ranks the single words.
    The key must tell the rows apart.  The words of a text are written once; the
    kept terms, at most ``max_features``, and the few more that may turn out to
    be in too many documents are sent to all tasks, by way of the driver.
    """
    n = docs.count()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = docs.select(key, column).repartition(parts, key).select(key, words_of(column, stop, lemma, keep).alias("ws"))
    if n >= 3:
        best = _best_terms(materialize(words, "words"), key, n, most, n if n < 5 else max_df * n, max_features)
    else:
        counted = words.select(key, F.explode("ws").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
        order = Window.partitionBy(key).orderBy(F.col("tf").desc(), "term")
        best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    top = best.where((F.length("term") >= least) & ~_noise(F.col("term")))
    ranked = top.groupBy(key).agg(F.collect_list(F.struct(
        (-F.size(F.split("term", " "))).alias("words"), (-F.length("term")).alias("size"), "rank", "term")).alias("ts"))
    listed = F.transform(F.array_sort("ts"), lambda t: t["term"])
    spaced = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    outer = ranked.select(key, listed.alias("ts")).select(key, F.filter("ts", lambda t: ~F.exists("ts", lambda s: (s != t) & F.contains(spaced(s), spaced(t)))).alias("ts"))
    found = outer.select(key, F.array_join("ts", "; ").alias("keywords"))
    return docs.select(key).join(found, key, "left").select(key, text("keywords").alias("keywords"))


def _noise(term: Column) -> Column:
    """Whether a term is a news word, has one, or begins or ends with a stop word."""
    words, stops = F.split(term, " "), [w.replace("ё", "е") for w in K.STOP_TFIDF]
    return (
        term.isin(*K.DOMAIN_TERMS) | term.startswith("слово ") | F.element_at(words, 1).isin(*stops) | F.element_at(words, -1).isin(*stops)
        | F.arrays_overlap(words, F.array(*[F.lit(w.replace("ё", "е")) for w in K.DOMAIN_WORDS]))
    )


def tf_df(docs: DataFrame, *keys: str, min_chars: int = K.MIN_CLEAN_CHARS, most_docs: int | None = None, order: str = "clean_text") -> DataFrame:
    """(*keys, term, tf, df, df_ratio) from rows of (*keys, clean_text).

    Texts under ``min_chars`` and texts without tokens do not count.  With
    ``most_docs`` only so many documents by ``order`` are looked at.  Keys named
    lang, source_type and source are in lower case, and 'unknown', 'other' and
    the source type where there is none.
    """
    if most_docs is not None:
        docs = docs.orderBy(order).limit(most_docs)
    words = F.filter(F.regexp_extract_all(normalized(F.col("clean_text")), F.lit("[a-zа-я]+"), F.lit(0)), lambda w: (F.length(w) >= 2) | w.isin(*K.ONE_LETTER_TOKENS))
    given = lambda value, other: F.coalesce(F.nullif(F.lower(value), F.lit("")), other)
    known = {"lang": F.lit("unknown"), "source_type": F.lit("other")}
    named = {k: given(F.col(k), known[k]) for k in keys if k in known}
    if "source" in keys:
        named["source"] = given(strip(text("source")), named.get("source_type", F.lit("other")))
    rows = docs.where(F.length(text("clean_text")) >= min_chars).withColumns(named).select(*keys, words.alias("ws"))
    # A text with tokens has the empty one too, once, so that texts are counted along with terms and read once.
    rows = rows.select(*keys, F.when(F.size("ws") > 0, F.concat("ws", F.array(F.lit("")))).alias("ws"))
    counts = materialize(frequencies(rows, "ws", *keys), "term-counts")
    totals = counts.where("term = ''").select(*keys, F.col("df").alias("docs"))
    here, there = counts.where("term <> ''").alias("c"), totals.alias("t")
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    joined = here.join(there, reduce(and_, same)) if keys else here.join(F.broadcast(there))
    return joined.select("c.*", (F.col("df") / F.col("docs")).alias("df_ratio"))


def candidates(stats: DataFrame, ratio: float = 0.6, tf: int = 50, most: int = 2000) -> DataFrame:
    """Frequent terms without digits, the likely stop words."""
    return (stats.where((F.col("df_ratio") >= ratio) & (F.col("tf") >= tf) & ~F.col("term").rlike("[0-9]"))
            .orderBy(F.col("df_ratio").desc(), F.col("tf").desc(), "term").limit(most))


def source_terms(stats: DataFrame, high: str, low: str, lang: str, hi: float = 0.25, lo: float = 0.03, tf: int = 30, most: int = 500, merged: bool = False) -> DataFrame:
    """Terms of sources of type ``high`` that sources of type ``low`` seldom use.

    Each pair of sources is a row; ``merged`` adds up the low sources first.
    The statistics of both are written once, as they are read twice.
    """
    stats = materialize(stats.where(F.col("source_type").isin(high, low) & (F.col("lang") == lang)).select("term", "tf", "df_ratio", "source_type"), "source-terms")
    of = lambda kind, tag: stats.where(F.col("source_type") == kind).select(
        "term", F.col("tf").alias(f"tf_{tag}"), F.col("df_ratio").alias(f"df_ratio_{tag}"))
    below = of(low, "lo")
    if merged:
        below = below.groupBy("term").agg(F.sum("tf_lo").alias("tf_lo"), F.max("df_ratio_lo").alias("df_ratio_lo"))
    joined = of(high, "hi").join(below, "term", "left").na.fill({"tf_lo": 0, "df_ratio_lo": 0.0})
    return (joined.where((F.col("df_ratio_hi") >= hi) & (F.col("df_ratio_lo") <= lo) & (F.col("tf_hi") >= tf))
            .orderBy(F.col("df_ratio_hi").desc(), F.col("tf_hi").desc(), "term", "tf_lo", "df_ratio_lo").limit(most))


def domain_terms(stats: DataFrame, lang: str, hi: float = 0.15, lo: float = 0.08, tf: int = 10, most: int = 200, common: float = 0.3, common_tf: int = 50,
                 stop: list[str] | None = None) -> DataFrame:
    """(source, term, ...): terms typical of one RSS source, for all sources at once.

    A term's ratio elsewhere is the 95th percentile over the other sources that
    have it.  Stop words and terms common elsewhere are left out.
    """
    rss = stats.where((F.col("source_type") == "rss") & (F.col("lang") == lang)).select("source", "term", "tf", "df_ratio")
    stops = K.STOP_RU if stop is None else stop
    own = rss.where((F.col("df_ratio") >= hi) & (F.col("tf") >= tf) & ~F.lower("term").isin(*stops))
    # One row per term that is typical of any source, with the three ratios of all sources around the place.
    wide = rss.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.sum("tf").alias("tf_all"), F.sort_array(F.collect_list("df_ratio")).alias("ratios"))
    rest = F.size("ratios") - 1
    place = (rest - 1) * 0.95
    below, above = F.greatest(F.floor(place), F.lit(0)), F.ceil(place)
    wide = wide.select("term", "tf_all", rest.alias("rest"), place.alias("place"), below.alias("below"), above.alias("above"), F.slice(
        "ratios", (below + 1).cast("int"), F.lit(3)).alias("near"))
    rest, place, below, above = (F.col(n) for n in ("rest", "place", "below", "above"))
    # The k-th ratio of the others: from the own entry on, the one after.
    at = lambda k: F.get("near", (k - below).cast("int"))
    other = lambda k: F.when(F.col("df_ratio") <= at(k), at(k + 1)).otherwise(at(k))
    ratio = F.when(rest > 0, other(below) + (other(above) - other(below)) * (place - below)).otherwise(0.0)
    found = own.join(wide, "term").select(
        "source", "term", F.col("tf").alias("tf_hi"), F.col("df_ratio").alias("df_ratio_hi"), (F.col("tf_all") - F.col("tf")).alias("tf_lo"), ratio.alias("df_ratio_lo"))
    kept = found.where((F.col("df_ratio_lo") <= lo) & ~((F.col("df_ratio_lo") >= common) & (F.col("tf_lo") >= common_tf)))
    order = Window.partitionBy("source").orderBy(F.col("df_ratio_hi").desc(), F.col("tf_hi").desc(), "term")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def auto_stopwords(stats: DataFrame, ratio: float = 0.6, most: int = 600, shortest: int = 2, longest: int = 20) -> DataFrame:
    """The words that most documents of a language have, per language."""
    order = Window.partitionBy("lang").orderBy(F.col("df_ratio").desc(), F.col("df").desc(), "term")
    good = stats.where((F.col("df_ratio") >= ratio) & F.length("term").between(shortest, longest))
    return good.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def final_list(manual: DataFrame, auto: DataFrame, black: DataFrame, white: DataFrame) -> DataFrame:
    """(manual and auto and black) without white; one column ``term``, sorted."""
    clean = lambda d: d.select(F.lower(strip(F.col("term"))).alias("term")).where("term <> '' AND NOT startswith(term, '#')")
    return clean(manual).union(clean(auto)).union(clean(black)).distinct().join(clean(white).distinct(), "term", "left_anti").orderBy("term")


def added_terms(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.select("term").subtract(old.select("term"))


def canon_persons(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, persons): names in one form over the whole batch, as ';' lists.

    A surname in -а or -я becomes the form without it where the batch has that
    form or its stem; a lone surname becomes the most frequent full name with it
    (the first by alphabet among equals).  Plural and place noise is dropped.
    """
    split = F.filter(F.transform(F.split(text(column), ";"), _clean_name), lambda x: x != "")
    named = docs.select(key, F.posexplode(split).alias("pos", "raw"))
    last = F.element_at(F.split("raw", " "), -1)
    stems = F.when((F.length("last") >= 4) & F.col("last").rlike("[ая]$"), F.expr("substring(last, 1, length(last) - 1)"))
    forms = named.select(last.alias("last")).select(F.explode(F.array_compact(F.array("last", stems))).alias("form")).distinct()
    words = named.withColumn("ws", _name_tokens(F.col("raw"))).where(F.size("ws") > 0).withColumn("last", F.element_at("ws", -1))
    words = words.withColumn("cut", F.when(F.col("last").rlike("[ая]$"), F.expr("substring(last, 1, length(last) - 1)")))
    known = words.join(forms.withColumnRenamed("form", "cut"), "cut", "left_semi").select(key, "pos").withColumn("has", F.lit(True))
    words = words.join(known, [key, "pos"], "left").withColumn("last", F.when(F.col("has"), F.col("cut")).otherwise(F.col("last")))
    single = F.size("ws") == 1
    noise = single & (((F.length("last") >= 4) & F.col("last").rlike("[ыи]$")) | F.col("last").isin("россия", "рф", "ес"))
    front = F.slice("ws", F.lit(1), F.greatest(F.size("ws") - 1, F.lit(0)))
    names = words.where(~noise).withColumn("name", F.array_join(F.concat(front, F.array("last")), " "))
    once = names.groupBy(key, "name").agg(F.min("pos").alias("pos"), F.first("last").alias("last"), F.max(~single).alias("full"))
    counts = once.where("full").groupBy("last", "name").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("last").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("best")).select("last", F.col("best.name").alias("best"))
    mapped = once.join(best, "last", "left").withColumn("name", F.when(F.col("full"), F.col("name")).otherwise(F.coalesce("best", "name")))
    kept = mapped.groupBy(key, "name").agg(F.min("pos").alias("pos")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("ps"))
    lists = kept.select(key, F.array_join(F.transform("ps", lambda p: p["name"]), ";").alias("persons"))
    return docs.select(key).join(lists, key, "left").select(key, text("persons").alias("persons"))


def keyword_pivot(d: DataFrame, keywords: list[str]) -> DataFrame:
    """Hourly counts with a column for each keyword, 0 where it does not occur."""
    rows = d.select(F.date_trunc("HOUR", "published_at").cast("timestamp_ntz").alias("ts_hour"), F.explode(F.split("keywords", ";")).alias("k"))
    return rows.withColumn("k", F.lower(F.trim("k"))).where(F.col("k").isin(*keywords)).groupBy("ts_hour").pivot("k", keywords).agg(F.count(F.lit(1))).na.fill(0)
