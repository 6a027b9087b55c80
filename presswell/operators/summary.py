"""Extractive summaries, and actions of persons; the sequential parts use Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswell.functions import constants as K
from presswell.functions.compat import text
from presswell.functions.records import strip
from presswell.operators.gazetteer import fold, named

_WORD = re.compile(r"[A-Za-zА-Яа-яЁё]{2,}")
_CAPITALISED = re.compile(r"\b(?:[А-ЯЁ][а-яё]+|[A-Z][a-z]+)(?:\s+(?:[А-ЯЁ][а-яё]+|[A-Z][a-z]+)){0,2}\b")
#: Words that the weights leave out, ё as е.
_STOPS = frozenset(w.replace("ё", "е") for w in (*K.STOP_TFIDF, *K.DOMAIN_WORDS))
_SPLIT = re.compile(r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ0-9])")


def _informative(sentence: str) -> bool:
    marks = sum(map(sentence.count, "!?:;…"))
    return len(sentence) >= 25 and len(_WORD.findall(sentence)) >= 5 and marks < max(4, len(sentence) // 25)


def _weights(sentences: list[str]) -> list[dict[str, float]]:
    """Sparse unit TF-IDF rows over words and word pairs of the sentences, the 4,000 most frequent."""
    grams = []
    for s in sentences:
        words = [w for w in (w.replace("ё", "е") for w in _WORD.findall(s.lower())) if w not in _STOPS]
        grams.append(Counter(words))
        grams[-1].update(map(" ".join, zip(words, words[1:])))
    df = Counter(g for c in grams for g in c)
    n = len(sentences)
    # Once for each count, as most words are as rare as many others.
    by_count = {k: np.log((1 + n) / (1 + k)) + 1 for k in set(df.values()) if k <= 0.95 * n}
    idf = {g: by_count[k] for g, k in df.items() if k in by_count}
    if len(idf) > 4000:
        # In place: a sum of counters would copy all words of the text for each sentence.
        total: Counter[str] = Counter()
        for c in grams:
            total.update(c)
        idf = {g: idf[g] for g in sorted(idf, key=lambda g: (-total[g], g))[:4000]}
    rows = [{g: k * idf[g] for g, k in c.items() if g in idf} for c in grams]
    norms = [sum(w * w for w in row.values()) ** 0.5 for row in rows]
    return [{g: w / norm for g, w in row.items()} for row, norm in zip(rows, norms)]


def _names(text: str, most: int) -> list[str]:
    """Runs of capitalised words, as ``records.capitalised`` finds them, in lower case."""
    found: dict[str, None] = {}
    for run in _CAPITALISED.findall(text):
        name = re.sub(r"\s+", " ", run.replace("ё", "е").replace("Ё", "Е")).lower()
        if name not in K.ENTITY_SINGLE and name.split()[0] not in K.ENTITY_BAD_START:
            found.setdefault(name)
    return list(found)[:most]


def summarize(body: str | None, most: int = 3, chars: int = 700, spread: float = 0.7, bonus: float = 0.25, repeat: float = 0.15) -> str:
    """Up to ``most`` sentences by weight, each unlike those chosen before.

    Earlier sentences weigh more, and so do those with names that the text
    begins with (``bonus``); names of a chosen sentence make others weigh less
    (``repeat``).  The chosen ones keep their order.
    """
    parts = [p.strip() for p in _SPLIT.split(re.sub(r"\s+", " ", (body or "").strip())) if p.strip()]
    parts = [p for p in parts if _informative(p)] or parts
    return " ".join(_choose(parts, most, spread, _names(body or "", 6), bonus, repeat))[:chars].strip()


def _choose(parts: list[str], most: int, spread: float, names: list[str], bonus: float, repeat: float) -> list[str]:
    if len(parts) <= most:
        return parts
    x = _weights(parts)
    if not any(x):
        return parts[:most]
    score = np.array([sum(row.values()) for row in x]) * np.linspace(1.0, 0.7, len(parts))
    hits = np.array([sum(n in low for n in names) for low in (p.lower().replace("ё", "е") for p in parts)], float)
    if hits.max() > 0:
        score = score + bonus * (score.mean() + 1e-9) * hits / hits.max()
    own = [_names(p, 5) for p in parts]
    chosen: list[int] = []
    used: set[str] = set()
    nearest = np.zeros(len(parts))
    # Among equal gains the higher score, then the earlier sentence.
    order = np.argsort(-score, kind="stable")
    for _ in range(most):
        gain = score - spread * nearest - repeat * np.array([sum(n in used for n in names_of) for names_of in own])
        gain[chosen] = -np.inf
        chosen.append(int(order[np.argmax(gain[order])]))
        used.update(own[chosen[-1]])
        last = x[chosen[-1]]
        nearest = np.maximum(nearest, [sum(w * last[g] for g, w in row.items() if g in last) for row in x])
    return [parts[i] for i in sorted(chosen)]


@F.pandas_udf(T.StringType())
def summary(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(summarize)


#: Finds verbs in a lower-case sentence; without a tagger there are none.
VerbHook = Callable[[Column], Column]


def no_verbs(sentence: Column) -> Column:
    return F.array().cast("array<string>")


def listed_verbs(*verbs: str) -> VerbHook:
    """A hook that knows a closed list of verbs."""
    return lambda sentence: F.filter(F.regexp_extract_all(sentence, F.lit("[а-яёa-z]+"), F.lit(0)), lambda w: w.isin(*verbs))


def spoken(verbs: VerbHook) -> VerbHook:
    """A hook's verbs with those of speech as one, without those that say nothing."""
    canon = F.create_map(*[F.lit(x) for kv in K.VERB_CANON.items() for x in kv])
    one = lambda v: F.coalesce(F.try_element_at(canon, v), v)
    return lambda sentence: F.filter(F.transform(verbs(sentence), one), lambda v: ~v.isin(*K.STOP_VERBS))


def actions_near(docs: DataFrame, key: str, body: str, persons: str, verb: Callable[[Column], Column], reach: int = 8, each: int = 10) -> DataFrame:
    """(key, person, verbs): verbs within ``reach`` words of a mention of a person.

    ``verb`` takes a word to its verb, or null.  A person is mentioned by the
    full name, its last two words, or the last one, also with -а or -я.  A verb
    counts once a sentence; the most frequent come first, then the earliest.
    """
    folded = F.replace(F.lower(strip(text(body))), F.lit("ё"), F.lit("е"))
    sentence = F.filter(F.split(F.regexp_replace(folded, r"(?U)\s+", " "), r"(?<=[.!?…])\s+"), lambda s: s != "")
    names = F.array_distinct(F.filter(F.transform(F.split(F.replace(F.lower(text(persons)), F.lit("ё"), F.lit("е")), ";"), strip), lambda p: F.length(p) >= 3))
    lasts = F.transform(names, lambda p: F.struct(p, F.element_at(F.split(p, " +"), -1)))
    # From an outer generator no filter is inferred, which would make the sentences once more.
    rows = docs.select(key, lasts.alias("ps"), F.posexplode_outer(sentence).alias("at", "s")).select(key, "at", "s", F.inline_outer("ps").alias("person", "last"))
    # Each mention has the last word, and few sentences do; only these are taken apart.
    rows = rows.where(F.contains("s", "last")).select(
        key, "at", "person", F.regexp_extract_all("s", F.lit("[A-Za-zА-Яа-яЁё-]+"), F.lit(0)).alias("ts"), F.split("person", " +").alias("ns"))
    ts, ns, size = F.col("ts"), F.col("ns"), F.size("ns")
    last = F.element_at(ns, -1)
    alone = lambda t: (t == last) | ((size > 1) & ~last.rlike("[ая]$") & t.isin(F.concat(last, F.lit("а")), F.concat(last, F.lit("я"))))
    run = lambda i, k: (F.slice(ts, i + 1, k + 1) == F.slice(ns, size - k, k + 1)) & (k > 0)
    named = lambda t, i: F.when(size == 1, t == last).otherwise(alone(t) | run(i, F.lit(1)) | run(i, size - 1))
    marks = F.transform(ts, lambda t, i: F.when(named(t, i), i))
    rows = rows.withColumn("ms", F.array_compact(marks))
    near = F.transform(ts, lambda t, i: F.when(F.exists("ms", lambda m: F.abs(m - i) <= reach), verb(t)))
    hits = rows.select(key, "person", "at", F.posexplode_outer(F.array_distinct(F.array_compact(near))).alias("i", "verb")).where("verb IS NOT NULL")
    counts = hits.groupBy(key, "person", "verb").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "i")).alias("first"))
    order = Window.partitionBy(key, "person").orderBy(F.col("n").desc(), "first", "verb")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "verb")))
    return best.groupBy(key, "person").agg(F.array_join(F.transform(ranked, lambda r: r["verb"]), ",").alias("verbs"))


def person_verb_pairs(docs: DataFrame, body: str, persons: str, verbs: VerbHook) -> DataFrame:
    """(person, verb, n) over all sentences that name the person; no verb is left out."""
    sentence = F.split(F.lower(strip(text(body))), r"(?<=[.!?…])\s+")
    rows = docs.select(F.filter(F.transform(F.split(F.lower(text(persons)), ";"), strip), lambda p: p != "").alias("ps"), F.explode(sentence).alias("s"))
    rows = rows.select("s", F.explode("ps").alias("person"), verbs(F.col("s")).alias("vs"))
    rows = rows.where(F.contains("s", "person") | F.contains("s", F.element_at(F.split("person", " "), -1)))
    return rows.select("person", F.explode("vs").alias("verb")).groupBy("person", "verb").agg(F.count(F.lit(1)).alias("n"))


def persons_actions(docs: DataFrame, key: str, body: str, persons: str, verbs: VerbHook = no_verbs, each: int = 10, overall: int = 15) -> DataFrame:
    """(key, persons_actions, actions_verbs): what persons do, by sentence.

    A person acts in the sentences that name them as whole words, in full or,
    of several words, by the last one, also with -а or -я; ё is е.  Verbs rank by
    count, then by first appearance.
    """
    folded = fold(F.regexp_replace(strip(text(body)), r"(?U)\s+", " "))
    people = F.array_distinct(F.filter(F.transform(F.split(fold(text(persons)), ";"), strip), lambda p: p != ""))
    rows = docs.select(key, people.alias("ps"), F.posexplode(F.split(folded, r"(?<=[.!?…])\s+")).alias("at", "s"))
    rows = rows.select(key, "at", "s", F.explode("ps").alias("person"), verbs(F.col("s")).alias("vs")).where(F.size("vs") > 0)
    rows = rows.where(named(F.col("s"), F.col("person")))
    hits = rows.select(key, "person", "at", F.posexplode("vs").alias("i", "verb"))

    def ranked(*by: str) -> DataFrame:
        counts = hits.groupBy(*by, "verb").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "i")).alias("first"))
        order = Window.partitionBy(*by).orderBy(F.col("n").desc(), "first", "verb")
        return counts.withColumn("rank", F.row_number().over(order))

    join = lambda rank: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "verb"))), lambda r: r["verb"]), rank)
    per = ranked(key, "person").where(F.col("rank") <= each).groupBy(key, "person").agg(F.concat(F.col("person"), F.lit(":"), join(",")).alias("packed"))
    by_name = F.transform(F.array_sort(F.collect_list(F.struct("person", "packed"))), lambda p: p["packed"])
    packed = per.groupBy(key).agg(F.array_join(by_name, "|").alias("persons_actions"))
    top = ranked(key).where(F.col("rank") <= overall).groupBy(key).agg(join(";").alias("actions_verbs"))
    return docs.select(key).join(packed, key, "left").join(top, key, "left").na.fill("")
