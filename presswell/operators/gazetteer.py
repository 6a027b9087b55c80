"""Names in texts: whole words, ё as е, surnames also with -а and -я."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswell.functions.compat import text
from presswell.functions.records import strip
from presswell.sources.shared import materialize

#: Fixed value: the characters that words are made of, beside which no name begins or ends.
WORD = r"[\p{L}\p{N}_]"
#: Characters of the names that one automaton is built from and sent to all tasks.
AUTOMATON_CHARS = 4_000_000
#: Characters of texts that a larger gazetteer's names are sent for at once, where there are many.
LOT_CHARS = 1 << 25
#: Bits of the map of what forms begin with, which is sent to all tasks; and rows that a task hands on at once.
MARKED_BITS, AT_ONCE = 1 << 23, 1 << 16

_WORDS = re.compile(r"\w+")


def fold(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit("ё"), F.lit("е"))


def variants(name: Column) -> Column:
    """What a folded name is looked for by: itself, and of several words the last one, as it is and with -а and -я."""
    last = F.element_at(F.split(name, r"\s+"), -1)
    some = F.when(last.rlike("[ая]$"), F.array(name, last)).otherwise(F.array(name, last, F.concat(last, F.lit("а")), F.concat(last, F.lit("я"))))
    return F.array_distinct(F.when(F.size(F.split(name, r"\s+")) > 1, some).otherwise(F.array(name)))


def named(sentence: Column, name: Column) -> Column:
    """Whether a folded sentence has a folded name, as whole words."""
    quoted = F.transform(variants(name), lambda v: F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    found = F.rlike(sentence, F.concat(F.lit(f"(?<!{WORD})(?:"), F.array_join(quoted, "|"), F.lit(f")(?!{WORD})")))
    # All forms have the last word in them, so that most sentences need no pattern.
    return F.when(F.contains(sentence, F.element_at(F.split(name, r"\s+"), -1)), found).otherwise(False)


def patterns(names: DataFrame) -> DataFrame:
    """(pattern, kind, name): what to look for, from (kind, name); names without a letter or digit are left out."""
    known = names.select("kind", fold(strip(text("name"))).alias("name")).where(F.col("name").rlike(WORD)).distinct()
    return known.select(F.explode(variants(F.col("name"))).alias("pattern"), "kind", "name").distinct()


def tagged(docs: DataFrame, key: str, body: str, names: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(key, kind, name, n, first): the names of a gazetteer (kind, name) that texts have.

    ``n`` counts the places of all forms of the name, which may overlap, and
    ``first`` is the first place, from 0, in code points.  Up to
    ``automaton_chars`` characters of forms go to all tasks as one automaton
    (Aho-Corasick) that passes each text once, in Arrow batches; of a larger
    gazetteer each lot of texts is sent the forms whose first two words it has.
    Both give the same, and in both the forms of a name are put together while
    a key's texts are at hand, so that what is found is not shuffled.  Null
    texts have no names; rows of one key count together.
    """
    # Written, as they are counted before they are looked for.
    forms = materialize(patterns(names), "forms")
    size = forms.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    return _by_automaton(docs, key, body, forms) if size <= automaton_chars else _by_join(docs, key, body, forms)


def _finder(patterns: list[str]) -> Callable[[str], dict[int, list[int]]]:
    """How often a text has each of different patterns as whole words, and where first, by the pattern's number."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, pattern in enumerate(patterns):
        machine.add_word(pattern, i)
    if patterns:
        machine.make_automaton()
    sizes, inside = [len(p) for p in patterns], lambda c: c == "_" or c.isalnum()

    def found(s: str) -> dict[int, list[int]]:
        seen: dict[int, list[int]] = {}
        for end, i in machine.iter(s) if s and patterns else ():
            at = end + 1 - sizes[i]
            if (at and inside(s[at - 1])) or (end + 1 < len(s) and inside(s[end + 1])):
                continue
            seen.setdefault(i, [0, at])[0] += 1
        return seen

    return found


def _tags(forms: Iterable[tuple], texts: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(key, kind, name, n, first), one row for a key's name, from all (pattern, kind, name) of names and (key, s) by key."""
    named: dict[tuple, int] = {}
    of: dict[str, list[int]] = {}
    for pattern, *name in forms:
        of.setdefault(pattern, []).append(named.setdefault(tuple(name), len(named)))
    kinds, names = (pa.array([n[i] for n in named], pa.string()) for i in (0, 1))
    found, many = _finder(list(of)), np.array([len(x) for x in of.values()], np.int64)
    numbers, begin = np.array([i for x in of.values() for i in x], np.int64), np.cumsum(many) - many
    sizes = many.tolist()
    keys: list = []
    rows: list[tuple[int, int, int, int]] = []
    own: dict[int, list[int]] = {}
    at, size = None, 0

    def batch() -> pa.RecordBatch:
        group, form, n, first = np.array(rows, np.int64).T
        times = many[form]
        name = numbers[np.arange(int(times.sum())) + np.repeat(begin[form] - (np.cumsum(times) - times), times)]
        group, n, first = (np.repeat(x, times) for x in (group, n, first))
        order = np.lexsort((name, group))
        group, name, n, first = (x[order] for x in (group, name, n, first))
        new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (name[1:] != name[:-1])))
        group, name = group[new], pa.array(name[new])
        values = [pa.array(keys, schema[0].type).take(pa.array(group)), kinds.take(name), names.take(name), pa.array(np.add.reduceat(n, new)), pa.array(np.minimum.reduceat(first, new))]
        return pa.RecordBatch.from_arrays(values, schema=schema)

    for part in texts:
        for key, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            if own and key != at:
                rows += [(len(keys), i, n, first) for i, (n, first) in own.items()]
                size += sum(sizes[i] for i in own)
                keys.append(at)
                own = {}
                if size >= AT_ONCE:
                    yield batch()
                    keys, rows, size = [], [], 0
            at = key
            if not own:
                own = found(s)
                continue
            for i, (n, first) in found(s).items():
                before = own.setdefault(i, [0, first])
                before[0] += n
                before[1] = min(before[1], first)
    if own:
        rows += [(len(keys), i, n, first) for i, (n, first) in own.items()]
        keys.append(at)
    if rows:
        yield batch()


def _searched(texts: DataFrame, key: str, search: Callable[[], Callable[[str], Iterator[tuple]]], columns: str) -> DataFrame:
    """What a search finds in each text of (key, s), as rows of (key, *columns), handed on before they are many."""
    schema = pa.schema([pa.field(n, {"string": pa.string(), "bigint": pa.int64()}[t]) for n, t in (c.split() for c in columns.split(", "))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = search()
        for part in parts:
            rows, values = [], []

            def batch() -> pa.RecordBatch:
                own = [pa.array(v, f.type) for v, f in zip(zip(*values), schema)] if values else [pa.array([], f.type) for f in schema]
                return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *own], [key, *schema.names])

            for i, s in enumerate(part.column(1)):
                own = list(found(s.as_py() or ""))
                rows += [i] * len(own)
                values += own
                if len(rows) >= AT_ONCE:
                    yield batch()
                    rows, values = [], []
            yield batch()

    return texts.mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, {columns}")


def _form_counts(docs: DataFrame, key: str, body: str, forms: DataFrame) -> DataFrame:
    """(key, pattern, n, at): how often a text has each form, and where first; a row for each form that it has."""
    sent = docs.sparkSession.sparkContext.broadcast([r[0] for r in forms.select("pattern").distinct().collect()])  # bounded by automaton_chars

    def search() -> Callable[[str], Iterator[tuple]]:
        found = _finder(sent.value)
        return lambda s: ((sent.value[i], n, at) for i, (n, at) in found(s).items())

    return _searched(docs.select(key, fold(F.col(body)).alias("s")), key, search, "pattern string, n bigint, at bigint")


def _tagging(texts: DataFrame, key: str) -> tuple[str, pa.Schema]:
    """What tags of texts look like, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"`{key}` {texts.schema[key].dataType.simpleString()}, kind string, name string, n bigint, first bigint"
    return ddl, to_arrow_schema(texts.sparkSession.createDataFrame([], ddl).schema)


def _by_automaton(docs: DataFrame, key: str, body: str, forms: DataFrame) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in forms.select("pattern", "kind", "name").collect()])  # bounded by automaton_chars
    texts = docs.select(key, fold(F.col(body)).alias("s")).where("s IS NOT NULL")
    ddl, schema = _tagging(texts, key)
    # The rows of a key come one after another.
    return texts.repartition(key).sortWithinPartitions(key).mapInArrow(lambda parts: _tags(sent.value, parts, schema), ddl)


def _begun(s: str) -> Iterator[tuple[int, str]]:
    """The words of a text with their places, each alone and with what is up to the end of the next one."""
    before = None
    for m in _WORDS.finditer(s):
        yield m.start(), m.group()
        if before is not None:
            yield before, s[before : m.end()]
        before = m.start()


def _beginnings(forms: DataFrame) -> DataFrame:
    """(pattern, gram, ahead, whole): the first two words of each form, or its only one, what is ahead of them, and whether they are all of it."""
    def search() -> Callable[[str], Iterator[tuple]]:
        def found(pattern: str) -> Iterator[tuple]:
            begun = list(_begun(pattern))
            if begun:
                at, gram = begun[2] if len(begun) > 2 else begun[0]
                yield gram, at, int(gram == pattern)

        return found

    return _searched(forms.select("pattern", F.col("pattern").alias("s")).distinct(), "pattern", search, "gram string, ahead bigint, whole bigint")


def _marked(grams: DataFrame) -> dict[int, bytes]:
    """By ``whole``, a bitmap of the hashes of the beginnings."""
    place = F.pmod(F.crc32("gram"), F.lit(MARKED_BITS)) + 1
    rows = grams.groupBy("whole", F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = {k: bytearray(MARKED_BITS // 8) for k in (0, 1)}
    for whole, bucket, bits in rows.collect():  # at most twice MARKED_BITS bits
        out[whole][(bucket - 1) * len(bits) : bucket * len(bits)] = bits
    return {k: bytes(v) for k, v in out.items()}


def _gram_counts(docs: DataFrame, key: str, body: str, grams: DataFrame) -> DataFrame:
    """(key, gram, whole, n, at, near): what texts have of the beginnings of forms.

    Where the beginning is a whole form there is one row a text, with the number
    of places and the first of them; else one for each place, with as much of
    the text to both sides as a form and the characters beside it may take.
    A wrong mark costs a row that meets no form.
    """
    longest = grams.where("whole = 0").agg(F.coalesce(F.max(F.length("pattern")), F.lit(0))).first()[0]
    sent = docs.sparkSession.sparkContext.broadcast(_marked(grams))

    def search() -> Callable[[str], Iterator[tuple]]:
        part, all_of_it = sent.value[0], sent.value[1]

        def found(s: str) -> Iterator[tuple]:
            seen: dict[str, list[int]] = {}
            for at, gram in _begun(s):
                if gram in seen:
                    seen[gram][0] += 1
                    h = crc32(gram.encode()) % MARKED_BITS if longest else 0
                else:
                    h = crc32(gram.encode()) % MARKED_BITS
                    if all_of_it[h >> 3] >> (h & 7) & 1:
                        seen[gram] = [1, at]
                if longest and part[h >> 3] >> (h & 7) & 1:
                    yield gram, 0, 1, at, s[max(0, at - longest) : at + longest + 1]
            for gram, (n, at) in seen.items():
                yield gram, 1, n, at, None

        return found

    texts = docs.select(key, fold(F.col(body)).alias("s")).where("s IS NOT NULL")
    return _searched(texts, key, search, "gram string, whole bigint, n bigint, at bigint, near string").withColumn("lead", F.least("at", F.lit(longest)))


def _by_join(docs: DataFrame, key: str, body: str, forms: DataFrame) -> DataFrame:
    """Each lot of texts is sent the forms of which it has the beginning, and searched as by an automaton.

    The texts of a lot wait in a file until its forms come, by name; each
    AUTOMATON_CHARS characters of these, whole names, make one automaton.
    """
    grams = materialize(_beginnings(forms), "beginnings")
    # Written, as they are counted, and passed twice.
    texts = materialize(docs.select(key, fold(F.col(body)).alias("s")).where("s IS NOT NULL"), "texts")
    size = texts.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0]
    many = max(-(-size // LOT_CHARS), min(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // AT_ONCE)), 1)
    lot = F.pmod(F.xxhash64(key), F.lit(many))
    had = _gram_counts(texts, key, "s", grams).select(lot.alias("lot"), "gram").distinct()
    met = had.join(grams.select("gram", "pattern"), "gram").select("lot", "pattern")
    # Forms without a word, as of "J ." its last one, may be anywhere.
    bare = forms.join(grams.select("pattern"), "pattern", "left_anti").select("pattern").distinct()
    met = met.union(bare.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("lot"), "pattern"))
    met = met.join(forms, "pattern").select("lot", "kind", "name", "pattern")
    own = texts.select(lot.alias("lot"), F.lit(0).alias("form"), key, "s", *(F.lit(None).cast("string").alias(n) for n in ("kind", "name", "pattern")))
    rows = own.unionByName(met.withColumn("form", F.lit(1)), allowMissingColumns=True).repartition("lot").sortWithinPartitions("lot", "form", key, "kind", "name", "pattern")
    ddl, schema = _tagging(texts, key)
    most, asked = AUTOMATON_CHARS, pa.schema([schema[0].with_name("key"), pa.field("s", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = _Held(asked, most), None
        for part in parts:
            lots, kinds = part.column(0).to_numpy(), part.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (lots[1:] != lots[:-1]) | (kinds[1:] != kinds[:-1]))[: len(lots)])
            for i, j in zip(edges, np.append(edges[1:], len(lots))):
                if lots[i] != at:
                    yield from held.tags(schema)
                    held, at = _Held(asked, most), lots[i]
                piece = part.slice(i, j - i)
                if not kinds[i]:
                    held.keep(piece.column(2), piece.column(3))
                    continue
                for form in zip(*(piece.column(k).to_pylist() for k in (6, 4, 5))):
                    if held.full(form):
                        yield from held.tags(schema)
                    held.add(form)
        yield from held.tags(schema)

    return rows.select("lot", "form", key, "s", "kind", "name", "pattern").mapInArrow(run, ddl)


class _Held:
    """The texts of a lot, in a file, and some of its forms."""

    def __init__(self, schema: pa.Schema, most: int) -> None:
        self.schema, self.most, self.file, self.writer = schema, most, None, None
        self.forms: list[tuple] = []
        self.size = 0

    def keep(self, keys: pa.Array, texts: pa.Array) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
            self.writer = pa.ipc.new_stream(self.file, self.schema)
        self.writer.write_batch(pa.RecordBatch.from_arrays([keys.cast(self.schema[0].type), texts.cast(pa.string())], schema=self.schema))

    def full(self, form: tuple) -> bool:
        return self.size >= self.most and self.forms[-1][1:] != form[1:]

    def add(self, form: tuple) -> None:
        self.forms.append(form)
        self.size += len(form[0])

    def tags(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """What the texts have of the forms, which are then gone."""
        forms, self.forms, self.size = self.forms, [], 0
        if not forms or self.file is None:
            return
        if self.writer is not None:
            self.writer.close()
            self.writer = None
        self.file.seek(0)
        yield from _tags(forms, pa.ipc.open_stream(self.file), schema)
