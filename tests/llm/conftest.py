from __future__ import annotations

import pytest

TEXT = " ".join(f"word{i}" for i in range(80))


@pytest.fixture
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        (1, TEXT, "en", "a", 5), (1, TEXT, "en", "a", 5), (2, TEXT, None, None, None), (3, None, "en", "b", 0), (4, "", "de", "b", 0),
        (None, "some words of a row without id", "en", "a", 1), (None, None, None, None, None), (5, "x " * 30_000 + "end", "en", "c", 9),
        (6, "a" * 5_000, "en", "c", 9), (7, " \n\t ", "fr", "c", 3), (8, "Ünïcode 🙂 text\nline\nline", "fr", "a", 4),
    ]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, names)
    # Names that the operators use themselves.
    for extra in ("fp", "a", "b", "k", "size", "n", "words", "hash", "score", "rep", "key", "cut", "v", "d", "part", "leaf", "taken", "_id", "copies"):
        df = df.selectExpr("*", f"1 AS {extra}")
    return df


@pytest.fixture
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (4, 0, 0), (6, 1, 1), (8, 1, 0), (8, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


BIG = 9007199254740993  # the first number that a float cannot tell from the one before


@pytest.fixture
def twice(spark):
    """Ids beyond floats beside a null one, one id with two texts, and all names that operators return."""
    other = " ".join(f"other{i}" for i in range(160))
    rows = [(BIG, TEXT), (BIG + 2, TEXT), (None, "no id"), (7, TEXT), (9, other), (9, other + " " + TEXT), (9, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    for extra in ("n_words", "word_chars", "kept", "base_failed", "fingerprint", "near_next", "edited_from", "target", "place", "finish", "pass", "part", "depth", "prefix",
                  "shard_bytes", "leaf", "bytes", "ids", "n_tokens", "held_out", "predicted", "component_id", "digest", "start_word", "own", "crowded", "copy", "root"):
        df = df.selectExpr("*", f"'x' AS {extra}")
    return df
