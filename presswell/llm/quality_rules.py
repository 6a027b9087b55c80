"""Quality rules with risk-controlled thresholds (native).

Counts over whole texts give a few ratios.  For every stratum and ratio a grid
of cutoffs is tested on labelled good documents: a cutoff holds if the exact
binomial bound shows that it rejects at most a given share of them.  The strata
and ratios share the error by Bonferroni's correction.  The cutoffs of one ratio
need no shares of their own: they are tested in a fixed sequence, from the
loosest, until one does not hold.  The strictest that holds is taken; where none
holds, the ratio rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswell.llm.common import SPACE_CHARS, let, materialize

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Cutoffs in thousandths, the strictest first.
GRID = (20, 35, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800, 900)
RULES = ("symbols", "dup_lines", "repeats", "capitals")


def _grams(hashes: Column, size: int) -> Column:
    many = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(F.size(hashes) >= size, many).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column, size: int) -> Column:
    """Words inside grams that occur twice or more."""
    ranked = F.sort_array(F.transform(grams, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    twice = lambda p: F.filter(p, lambda e, k: (e["x"] == F.get(p, k - 1)["x"]) | (e["x"] == F.get(p, k + 1)["x"]))
    at = let(ranked, lambda p: F.sort_array(F.transform(twice(p), lambda e: e["i"])))
    zero = F.struct(F.lit(0).alias("total"), F.lit(-size).alias("last"))
    step = lambda acc, i: F.struct((acc["total"] + F.least(F.lit(size), i - acc["last"])).alias("total"), i.alias("last"))
    return F.aggregate(at, zero, step, lambda acc: acc["total"])


def repeat_words(words: Column, size: int = 5) -> Column:
    """Words in ``size``-word windows found twice or more, the first included.

    Windows are compared by a 64-bit hash; texts without a repeated window are
    told by their distinct count and go no further.
    """
    def of(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(_covered(grams, size))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(_grams(h, size), of)).cast("long")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, ``keep`` and the counts of each whole text; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.col("doc_id").cast("long"), *keep, text.alias("text")).withColumn(
        "words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    ).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    return found.select(
        "doc_id", *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without(CAPITALS).cast("long").alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratios() -> dict[str, tuple[Column, Column]]:
    return {
        "symbols": (F.col("n_symbols"), F.col("word_chars")),
        "dup_lines": (F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": (F.col("n_repeat_words"), F.col("n_words")),
        "capitals": (F.col("n_capitals"), F.col("word_chars")),
    }


def cutoffs(stats: DataFrame, labels: DataFrame, stratum: str, risk: float, error: float) -> DataFrame:
    """(stratum, rule, cutoff): cutoffs that are shown to reject few good rows.

    ``risk`` bounds the share of good documents that all rules together reject
    in a stratum; each rule may spend an equal part.  With probability 1 -
    ``error`` all bounds hold at once.  A stricter cutoff rejects whatever a
    looser one does, so the fixed sequence ends where too many are rejected.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long")).distinct()
    rows = stats.where(~base_failed()).join(good, "doc_id").select(F.col(stratum).alias("stratum"), *[c for c in stats.columns if c.startswith("n_") or c == "word_chars"])
    passed = lambda top, size: sum([(1000 * top > c * size).cast("int") for c in GRID[1:]], (1000 * top > GRID[0] * size).cast("int"))
    levels = F.array(*[F.struct(F.lit(r).alias("rule"), passed(*pair).alias("level")) for r, pair in _ratios().items()])
    counts = rows.select("stratum", F.explode(levels).alias("l")).groupBy("stratum", "l.rule", "l.level").agg(F.count(F.lit(1)).alias("n"))
    # The k-th cutoff (from 1) rejects the rows at level k and above.
    above = counts.select("stratum", "rule", "n", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("k")).groupBy("stratum", "rule", "k").agg(F.sum("n").alias("rejected"))
    each = above.where("k = 0").select("stratum", F.col("rejected").alias("n")).distinct()
    tests = F.lit(len(RULES)) * F.count(F.lit(1)).over(Window.partitionBy())
    p = risk / len(RULES)
    in_order = Window.partitionBy("stratum").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    j = F.col("j")
    log_pmf = F.sum(F.when(j == 0, F.col("n") * F.log(F.lit(1 - p))).otherwise(F.log((F.col("n") - j + 1) / j) + F.log(F.lit(p / (1 - p))))).over(in_order)
    allowed = (
        each.withColumn("limit", F.lit(error) / tests)
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") * p))))
        .withColumn("pmf", F.exp(log_pmf)).withColumn("cdf", F.sum("pmf").over(in_order))
        .where("cdf <= limit").groupBy("stratum").agg(F.max("j").alias("most"))
    )
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(k + 1).alias("k"), F.lit(c).alias("cutoff")) for r in RULES for k, c in enumerate(GRID)]))
    tested = allowed.select(F.col("stratum").alias("s"), "most", grid.alias("g")).select("s", "most", "g.*").alias("t")
    seen = above.alias("a")
    return (
        tested.join(seen, F.col("t.s").eqNullSafe(F.col("a.stratum")) & (F.col("t.rule") == F.col("a.rule")) & (F.col("t.k") == F.col("a.k")), "left")
        .where(F.coalesce("rejected", F.lit(0)) <= F.col("most"))
        .groupBy(F.col("s").alias("stratum"), F.col("t.rule").alias("rule")).agg(F.min("cutoff").alias("cutoff"))
    )


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for each row of ``docs``.

    ``kept`` is false for rows that fail the base rules or exceed a cutoff of
    their stratum.  Strata without enough labels have no cutoffs and keep what
    passes the base rules; null is a stratum of its own.  Null texts count as
    empty and fail the base rules.  Extra columns are ignored, rows may repeat
    and an empty table gives an empty result.
    """
    stats = materialize(statistics(docs, stratum), "text-statistics")
    found = cutoffs(stats, labels, stratum, risk, error).groupBy("stratum").pivot("rule", list(RULES)).agg(F.min("cutoff"))
    over = [F.coalesce(1000 * top > F.col(r) * size, F.lit(False)) for r, (top, size) in _ratios().items()]
    fails = over[0]
    for o in over[1:]:
        fails = fails | o
    return (
        stats.alias("d").join(found.alias("f"), F.col(f"d.{stratum}").eqNullSafe(F.col("f.stratum")), "left")
        .withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~fails)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )
