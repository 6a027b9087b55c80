"""Fill-in-the-middle transformation by lookaround splitting.

A unit grammar says which characters stay together.  It is translated to a
pattern of zero width that looks at the classes of the two characters beside a
place and matches where a unit ends; Spark's ``split`` then gives the units, and
put together they are the text again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.llm.common import spare


class Grammar(NamedTuple):
    """``runs``: bodies of disjoint character classes whose runs are one unit
    each.  ``ends``: body of a class whose characters end the unit they are in,
    with all before them.  Any other character is a unit by itself, or with
    ``ends`` goes on to the next end."""

    runs: tuple[str, ...] = ()
    ends: str = ""


LETTERS = Grammar(runs=("A-Za-z",))  # words of letters, all else alone
WORDS = Grammar(runs=(r"\x20\x09-\x0D", r"^\x20\x09-\x0D"))  # words and the space between
LINES = Grammar(ends=r"\n")
CHARACTERS = Grammar()

#: The three marks: before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


def _class(*bodies: str, beside: bool = False) -> str:
    """The class of all bodies' characters; ``beside``: of all others."""
    inside = "".join(f"[{b}]" for b in bodies)
    return (f"[^{inside}]" if beside else f"[{inside}]") if bodies else r"[\s\S]" if beside else "(?!)"


def boundary(grammar: Grammar) -> str:
    """A pattern that matches, with no width, wherever one unit ends and the next begins.

    After a run's character a unit ends where the next one is not of that run;
    after any other character it ends always.  No place at either end of a
    text matches.
    """
    if grammar.ends:
        return rf"(?<=[{grammar.ends}])(?=[\s\S])"
    turns = [f"(?<={_class(r)})(?={_class(r, beside=True)})" for r in grammar.runs]
    alone = rf"(?<={_class(*grammar.runs, beside=True)})(?=[\s\S])"
    return "|".join([*turns, alone])


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text in order; none of an empty or null one."""
    return F.when(text != "", F.split(text, boundary(grammar), -1)).otherwise(F.array().cast("array<string>"))


def _draws(key: Column) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of a text."""
    return [F.conv(F.substring(F.sha2(key, 256), 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, grammar: Grammar = LETTERS, seed: int = 1, rate: int = 90, spm_rate: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n, form, prefix, middle, suffix and output.

    Two draws by ``seed`` and doc_id cut the units in prefix, middle and suffix;
    two others choose the form: of 100 texts ``rate`` are rearranged, of these
    ``spm_rate`` with the suffix in front ('spm') and the rest with the prefix
    ('psm').  'plain' texts stay as they are and have no parts (null): those
    that are empty, not drawn, or have a mark themselves, so that ``restored``
    is exact for all.  No mark may begin as another one ends.  A null text is empty; a null doc_id draws as an empty
    one; texts of any length are cut whole; equal rows are cut alike; all rows
    and columns stay, and an added column whose name is taken gets an underscore
    in front; an empty table gives an empty result.
    """
    p, s, m = marks
    own = {n: spare(docs, n) for n in ("n", "form", "prefix", "middle", "suffix", "output", "_units", "_first", "_last")}
    whole = F.coalesce(F.col("text"), F.lit(""))
    cut1, cut2, drawn, turned = _draws(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    marked = F.contains(whole, F.lit(p)) | F.contains(whole, F.lit(s)) | F.contains(whole, F.lit(m))
    form = F.when((whole == "") | marked | (drawn % 100 >= rate), "plain").when(turned % 100 < spm_rate, "spm").otherwise("psm")
    cut = docs.withColumn(own["_units"], units(whole, grammar)).withColumn(own["n"], F.size(own["_units"]).cast("long"))
    many = F.col(own["n"]) + 1
    cut = cut.withColumns({own["form"]: form, own["_first"]: F.least(cut1 % many, cut2 % many), own["_last"]: F.greatest(cut1 % many, cut2 % many)})
    first, last = F.col(own["_first"]), F.col(own["_last"])

    def part(begin: Column, size: Column) -> Column:
        return F.when(F.col(own["form"]) != "plain", F.array_join(F.slice(own["_units"], (begin + 1).cast("int"), size.cast("int")), ""))

    parts = cut.withColumns({
        own["prefix"]: part(F.lit(0), first), own["middle"]: part(first, last - first), own["suffix"]: part(last, F.col(own["n"]) - last)})
    one, two, three = (F.col(own[n]) for n in ("prefix", "middle", "suffix"))
    output = F.when(F.col(own["form"]) == "psm", F.concat(F.lit(p), one, F.lit(s), three, F.lit(m), two)).when(
        F.col(own["form"]) == "spm", F.concat(F.lit(s), three, F.lit(p), one, F.lit(m), two)).otherwise(whole)
    return parts.withColumn(own["output"], output).drop(own["_units"], own["_first"], own["_last"])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``transformed`` made ``output`` from: parts between the marks, in their order."""
    quoted = "|".join(rf"\Q{m}\E" for m in marks)
    piece = lambda i: F.get(F.split(output, quoted, -1), F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``transformed``."""
    found = transformed(docs.select("doc_id", "text"))
    back = found.withColumn("back", restored(F.col("output"), F.col("form")))
    return back.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("back", 256).alias("restored_sha256"))
