"""What Parquet footers tell, read on the executors: row groups, and the bounds of each column in them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.sources.arrays import open_store

_SCHEMA = "path string, row_group int, column string, rows long, nulls long, low string, high string"


def footers(spark: SparkSession, path: str | list[str], *columns: str) -> DataFrame:
    """(path, row_group, column, rows, nulls, low, high) of all Parquet files of folders; no page is read.

    ``low`` and ``high`` are null where a file has no statistics, or all is null.
    Without ``columns`` all flat columns are listed.
    """
    wanted = set(columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for name in part.column("path").to_pylist():
                store, own = open_store(name)
                with store.open_input_file(own) as file:
                    meta = pq.ParquetFile(file).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        column = group.column(c)
                        if wanted and column.path_in_schema not in wanted:
                            continue
                        s = column.statistics
                        bounds = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                        rows.append((name, g, column.path_in_schema, group.num_rows, s.null_count if s is not None and s.has_null_count else None, *bounds))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns_of = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_of, kinds)], [f.split()[0] for f in _SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    return files.select("path").mapInArrow(run, _SCHEMA)


def not_constant(spark: SparkSession, path: str | list[str], column: str, value: str) -> DataFrame:
    """The row groups that do not, or not provably, hold ``value`` alone in a text column: with ``proven``, whether the footer says so.

    Bounds that are equal to the value, without nulls, prove a group; other
    bounds or a null prove the contrary; without statistics only a scan can tell.
    """
    found = footers(spark, path, column)
    other = (F.col("low") != value) | (F.col("high") != value) | (F.col("nulls") > 0)
    same = (F.col("low") == value) & (F.col("high") == value) & (F.col("nulls") == 0)
    return found.where(~F.coalesce(same, F.lit(False)) & (F.col("rows") > 0)).withColumn("proven", F.coalesce(other, F.lit(False)))


def is_constant(spark: SparkSession, path: str | list[str], column: str, value: str) -> bool:
    """Whether all rows have the value; only groups whose footers do not tell are scanned."""
    doubtful = not_constant(spark, path, column, value)
    if not doubtful.where("proven").isEmpty():
        return False
    files = [r["path"] for r in doubtful.select("path").distinct().collect()]
    return not files or spark.read.parquet(*files).where(~F.col(column).eqNullSafe(F.lit(value))).isEmpty()
