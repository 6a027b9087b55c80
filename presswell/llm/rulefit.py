"""Quality classifier: a sparse ensemble of rules over text statistics.

Small gradient-boosted trees are grown on the statistics of a bounded sample of
labelled documents; every path from a root to a node is a conjunctive rule.
Logistic regression with an L1 penalty gives most rules weight zero, and the
rest become one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswell.llm.common import give_back, spare

STATISTICS = (
    "words", "mean_word", "longest_word", "capitals", "digits", "symbols", "sentence_ends", "commas", "exclaims", "bars",
    "line_words", "dup_lines", "distinct_words", "dup_trigrams", "marked_words",
)
#: Labelled documents that are learned from, at most; chosen by hash of doc_id.
SAMPLE_ROWS = 20_000
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>@^~_=+{}[]\\/"


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; all zero for null or no word."""
    raw = text.encode() if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    size = sum(map(len, words))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    distinct = set(words)
    trigrams = max(1, n - 2)
    seen = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    marked = sum(w[-1] in b"#*$%&|<>!" for w in words)
    return [
        float(n), size / n, float(max(map(len, distinct))), count(_CAPITALS) / size, count(_DIGITS) / size, count(_SYMBOLS) / size,
        count(b".!?") / n, raw.count(b",") / n, raw.count(b"!") / n, raw.count(b"|") / n,
        n / len(lines), 1 - len(set(lines)) / len(lines), len(distinct) / n, 1 - seen / trigrams, marked / n,
    ]


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))
def _statistics(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame([statistics(t) for t in part], columns=list(STATISTICS), dtype=float)
    give_back()


#: Evaluated once, although several columns read it.
text_statistics = _statistics.asNondeterministic()


@dataclass
class Rule:
    """A conjunction of (statistic, above, bound), and its weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        met = np.ones(len(x), bool)
        for f, above, bound in self.terms:
            met &= (x[:, f] > bound) == above
        return met

    def column(self, stats: str) -> Column:
        met = F.lit(True)
        for f, above, bound in self.terms:
            value = F.col(f"{stats}.{STATISTICS[f]}")
            met = met & (value > bound if above else value <= bound)
        return F.when(met, self.weight).otherwise(0.0)


@dataclass
class Model:
    bias: float
    rules: list[Rule]

    def score(self, stats: str) -> Column:
        """Probability of label 1 as a column over the statistics struct."""
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column(stats)
        return 1 / (1 + F.exp(-total))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bias + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(x))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _bins(x: np.ndarray, most: int = 32) -> list[np.ndarray]:
    return [np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1])) for column in x.T]


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 8, seed: int = 0) -> list[Rule]:
    """The rules of all nodes below the roots of boosted regression trees."""
    rng = np.random.default_rng(seed)
    edges = _bins(x)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    found: dict[tuple, Rule] = {}
    for _ in range(trees):
        p = _sigmoid(margin)
        g, h = y - p, p * (1 - p) + 1e-6
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        todo = [(rows, np.arange(len(y)), ())]
        while todo:
            own, all_rows, terms = todo.pop()
            best = None
            if len(terms) < depth and len(own) >= 2 * least:
                total_g, total_h = g[own].sum(), h[own].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    at = binned[own, f]
                    left_g = np.cumsum(np.bincount(at, g[own], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(at, h[own], len(e) + 1))[:-1]
                    left_n = np.cumsum(np.bincount(at, minlength=len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    gain[(left_n < least) | (len(own) - left_n < least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k)
            if best is None:
                if terms:
                    margin[all_rows] += rate * g[own].sum() / (h[own].sum() + 1)
                continue
            _, f, k = best
            for above in (False, True):
                path = (*terms, (f, above, float(edges[f][k])))
                found.setdefault(tuple(sorted(path)), Rule(path))
                todo.append((own[(binned[own, f] > k) == above], all_rows[(binned[all_rows, f] > k) == above], path))
    return list(found.values())


def lasso(rules: list[Rule], x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> Model:
    """L1-penalised logistic weights by accelerated proximal gradient."""
    z = np.stack([r.holds(x) for r in rules], 1).astype(np.float32) if rules else np.zeros((len(x), 0), np.float32)
    mean = z.mean(0)
    z -= mean
    lip = 0.25 * (np.linalg.norm(z, 2) ** 2 / len(z) if z.size else 0) + 0.25
    w = v = np.zeros(z.shape[1])
    b = c = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(steps):
        error = _sigmoid(z @ v.astype(np.float32) + c) - y
        new = v - (z.T @ error.astype(np.float32)) / len(y) / lip
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lip, 0)
        new_b = c - error.mean() / lip
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    kept = [Rule(r.terms, float(k)) for r, k in zip(rules, w) if k != 0]
    return Model(float(b - (w * mean).sum()), kept)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled documents where ``learn_from``.

    The sample is the smallest MD5 of doc_id; it is broadcast, as its size is
    bounded.  Without any label every document scores one half.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn_from)
        .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_label"))
        .orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_id")).select("_id", "_label", text_statistics("text").alias("s"))
    got = rows.select("_id", "_label", "s.*").toPandas().sort_values(["_id", *STATISTICS])
    if not len(got):
        return Model(0.0, [])
    x, y = got[list(STATISTICS)].to_numpy(float), (got["_label"] == 1).to_numpy(float)
    return lasso(tree_rules(x, y), x, y)


def fold(doc_id: str, parts: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % parts


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1.

    Null and empty texts have all statistics zero and are scored like any
    other; all columns and rows stay.
    """
    stats = spare(docs, "_stats")
    return docs.withColumn(stats, text_statistics("text")).withColumn(name, model.score(stats)).drop(stats)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    Labels of held-out ids (CRC-32 of the id modulo 3 is 1) are never learned
    from.  A null doc_id is not held out.  Extra columns are ignored; an empty
    table gives an empty result.
    """
    model = fit(docs, labels, fold("doc_id", 3) != 1)
    return scored(docs.select(F.col("doc_id").cast("long"), "text"), model).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject.

    Null and empty texts have all statistics zero and are judged by them like
    any other text; rows with a null doc_id, and rows that repeat, are judged
    one by one; all columns stay, also such as the operator uses itself; without
    labels every row stays; an empty table gives an empty result.
    """
    model = fit(docs, labels, fold("doc_id", 3) != 1)
    score = spare(docs, "_score")
    return scored(docs, model, score).where(F.col(score) >= 0.5).drop(score)
