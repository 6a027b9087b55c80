"""JSON files that are one array, read by many tasks.

Whether a byte is inside a string, and how deep it is nested, depends on all
bytes before it.  So each byte range first tells how it would change both, for
either way that it may begin; running sums over the ranges then tell how each
one does begin, and the second pass cuts the records that begin in its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
_QUOTE, _BACKSLASH = 0x22, 0x5C
_STEP = np.zeros(256, np.int8)
_STEP[[*b"[{"]], _STEP[[*b"]}"]] = 1, -1


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark lists it, and the path in it."""
    scheme, colon, rest = path.partition(":")
    return fs.FileSystem.from_uri(f"{scheme}://{rest}" if colon and not rest.startswith("//") else path)


def _quotes(raw: np.ndarray, before: int) -> np.ndarray:
    """Places of the quotes that no backslash escapes; ``before`` backslashes end what comes before."""
    at = np.flatnonzero(raw == _QUOTE)
    # The last byte before each quote that is no backslash.
    plain = np.where(raw != _BACKSLASH, np.arange(len(raw)), -1)
    last = np.append(-1, np.maximum.accumulate(plain))[at]
    run = at - 1 - last + np.where(last < 0, before, 0)
    return at[run % 2 == 0]


def _inside(raw: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each byte is in a string (its opening quote is)."""
    turn = np.zeros(len(raw), np.int8)
    turn[quotes] = 1
    return ((np.cumsum(turn) + inside) % 2).astype(bool)


def _backslashes(source: fs.NativeFile, start: int) -> int:
    """How many backslashes end right before ``start``."""
    many, size = 0, 1 << 10
    while start - many > 0:
        begin = max(0, start - many - size)
        source.seek(begin)
        raw = source.read(start - many - begin)
        own = len(raw) - len(raw.rstrip(b"\\"))
        many += own
        if own < len(raw):
            break
    return many


def _ranged(source: fs.NativeFile, start: int, end: int) -> np.ndarray:
    source.seek(start)
    return np.frombuffer(source.read(end - start), np.uint8)


def _effects(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for path, start, end in zip(*(part.column(i).to_pylist() for i in range(3))):
            store, at = open_store(path)
            with store.open_input_file(at) as source:
                before = _backslashes(source, start)
                raw = _ranged(source, start, end)
            quotes = _quotes(raw, before)
            steps = _STEP[raw].astype(np.int64)
            out = int(steps[~_inside(raw, quotes, False)].sum())
            rows.append((path, start, end, len(quotes) % 2, out, int(steps.sum()) - out))
        names = ["path", "start", "end", "turns", "deeper_out", "deeper_in"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.string() if i == 0 else pa.int64()) for i in range(6)], names)


def _records(raw: np.ndarray, source: fs.NativeFile, end: int, inside: bool, depth: int, before: int, level: int) -> Iterator[bytes]:
    """The objects at ``level`` that begin in ``raw``; the last one may go on behind ``end``."""
    data, held, at = raw, 0, end
    quotes = _quotes(data, before)
    strings = _inside(data, quotes, inside)
    steps = np.where(strings, 0, _STEP[data])
    depths = depth + np.cumsum(steps)
    begins = np.flatnonzero((data == 0x7B) & (steps == 1) & (depths == level + 1))
    ends = np.flatnonzero((data == 0x7D) & (steps == -1) & (depths == level))
    if len(begins):
        ends = ends[ends > begins[0]]
    for b, e in zip(begins, ends):
        yield data[b : e + 1].tobytes()
        held += 1
    if held == len(begins):
        return
    # What follows, until the last record is whole.
    record, depth = data[begins[-1] :].tobytes(), int(depths[-1])
    inside = bool(strings[-1]) if len(strings) else inside
    while True:
        source.seek(at)
        more = np.frombuffer(source.read(1 << 16), np.uint8)
        if not len(more):
            raise ValueError("the file ends inside a record")
        tail = len(record) - len(record.rstrip(b"\\"))
        quotes = _quotes(more, tail)
        strings = _inside(more, quotes, inside)
        steps = np.where(strings, 0, _STEP[more])
        depths = depth + np.cumsum(steps)
        closed = np.flatnonzero((steps == -1) & (depths == level))
        if len(closed):
            yield record + more[: closed[0] + 1].tobytes()
            return
        record, depth, inside, at = record + more.tobytes(), int(depths[-1]), bool(strings[-1]), at + len(more)


def read_array(spark: SparkSession, path: str, schema: str, level: int = 1, range_bytes: int = RANGE_BYTES, glob: str = "*") -> DataFrame:
    """The objects of JSON array files, by byte ranges of about ``range_bytes``.

    ``level`` is how many brackets are open around a record: 1 in a list, 2 in a
    bundle with the list in a field.  Other values at that level are no records.
    A task holds its range and the record that goes on behind it.  A file that
    ends inside a record raises; empty files and lists have no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).select("path", "start", F.least("length", F.col("start") + range_bytes).alias("end"))
    tasks = max(1, int(ranges.count()))
    effects = ranges.repartition(tasks, "path", "start").mapInArrow(_effects, "path string, start long, end long, turns long, deeper_out long, deeper_in long")
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sure = effects.withColumn("inside", F.coalesce(F.sum("turns").over(ahead), F.lit(0)) % 2)
    sure = sure.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 1, F.col("deeper_in")).otherwise(F.col("deeper_out"))).over(ahead), F.lit(0)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, start, end, inside, depth in zip(*(part.column(i).to_pylist() for i in range(5))):
                store, own = open_store(at)
                with store.open_input_file(own) as source:
                    before = _backslashes(source, start)
                    rows, size = [], 0
                    for record in _records(_ranged(source, start, end), source, end, bool(inside), depth, before, level):
                        rows.append(record)
                        size += len(record)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], ["value"])
                            rows, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string())], ["value"])

    found = sure.select("path", "start", "end", "inside", "depth").repartition(tasks, "path", "start").mapInArrow(run, "value string")
    return found.select(F.from_json("value", schema).alias("r")).select("r.*")


def write_arrays(df: DataFrame, path: str) -> None:
    """Rows as JSON arrays, one file per task, a record per line; of no rows an empty file or array."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for part in parts:
            values = part.column(0).to_pylist()
            if values:
                yield pa.RecordBatch.from_arrays([pa.array([mark + values[0], *("," + v for v in values[1:])])], ["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], ["value"])

    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(run, "value string").write.text(path)
