"""Writers: files, the idempotent warehouse load, and rollups."""

from __future__ import annotations

import json
import warnings
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from presswell.functions.compat import month
from presswell.schemas import ARTICLES, COVERAGE, align
from presswell.sources.snapshots import Part, Snapshots


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_words(terms: DataFrame, path: str) -> None:
    terms.select("term").orderBy("term").write.mode("overwrite").text(path)


def gold_name(stem: str) -> str:
    """The one name of the gold file of an input."""
    return f"{stem.rpartition('/')[2].removesuffix('.json').removesuffix('.parquet').removesuffix('_clean')}_processed.parquet"


def gold_paths(inputs: list[str], output: str | None, folder: str = "data/gold") -> list[str]:
    """Where each input's gold goes: one file for one input, else a folder."""
    if output is None or len(inputs) > 1:
        if output is not None and output.lower().endswith(".parquet"):
            raise ValueError(f"{len(inputs)} inputs need a folder, not the file {output}")
        return [f"{(output or folder).rstrip('/')}/{gold_name(i)}" for i in inputs]
    return [output for _ in inputs]


def write_gold(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def raw_key(source: str, at: datetime) -> str:
    """The key of a raw batch in the object store."""
    return f"raw/{at:%Y-%m-%d}/{source}/articles_{at:%Y%m%d_%H%M%S}.json"


def write_csv(df: DataFrame, path: str) -> None:
    """Rows as CSV with a header, quotes doubled, as the readers take it."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def store_report(spark: SparkSession, root: str, report: str, at: datetime, last_hours: int | None = None, commit: str = "") -> str:
    """Put a report and what is known about it under keys of its own; the report's key."""
    run, day = f"{at:%Y%m%d_%H%M%S}", f"{at:%Y-%m-%d}"
    base = f"reports/dt={day}/run_id={run}"
    facts = {"run_id": run, "dt": day, "report_object_key": f"{base}/daily_report.md", "last_hours": "" if last_hours is None else str(last_hours), "git_commit": commit,
             "uploaded_at": f"{at:%Y-%m-%dT%H:%M:%SZ}"}
    for name, content in (("daily_report.md", report), ("metadata.json", json.dumps(facts, indent=2, ensure_ascii=False))):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{base}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(content.encode())
        out.close()
    return facts["report_object_key"]


def write_months(df: DataFrame, path: str, column: str) -> None:
    """A table partitioned by the month of ``column``; the months that ``df`` has are replaced."""
    by_month = df.withColumn("month", month(column))
    by_month.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def create_views(views: dict[str, DataFrame]) -> None:
    """Name frames for SQL; they are computed when asked, like the frames."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def clustered_table(df: DataFrame, name: str, path: str, by: str = "dedup_key", sort: tuple[str, ...] = ("source", "published_at", "id"), buckets: int = 64) -> DataFrame:
    """A catalog table in buckets by ``by``, each a file sorted by ``sort``; read back.

    What is grouped, windowed or joined by ``by`` needs no shuffle then.
    """
    files = df.repartition(buckets, by).write.mode("overwrite").option("path", path)
    files.bucketBy(buckets, by).sortBy(*sort).saveAsTable(name)
    return df.sparkSession.table(name)


def rebuild_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table anew and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tsv(df: DataFrame) -> str:
    """A small result as lines of tab-separated fields, with marks escaped."""
    shown = lambda v: "\\N" if v is None else str(v).replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")
    return "".join("\t".join(map(shown, row)) + "\n" for row in df.toLocalIterator())


def json_lines(df: DataFrame) -> DataFrame:
    """One column ``value`` with each row as JSON."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


class Warehouse:
    """Articles by batch and object, their load log and the coverage of runs, under one folder.

    Articles are parts of a snapshot table: what a load has staged is seen, and
    logged, by one commit.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.coverage_path, self.store = spark, f"{root}/coverage", Snapshots(spark, f"{root}/articles")

    def articles(self, version: int | None = None) -> DataFrame:
        return self.store.read(self.store.parts("articles", version), ARTICLES)

    def load_log(self) -> DataFrame:
        rows = [("gold", p["object_name"], p["at"], p["rows"]) for p in self.store.parts("load_log")]
        log = self.spark.createDataFrame(rows, "layer string, object_name string, at string, rows_loaded bigint")
        return log.select("layer", "object_name", F.to_timestamp_ntz("at").alias("loaded_at"), "rows_loaded")

    def coverage(self) -> DataFrame:
        schema = T.StructType([*COVERAGE.fields, T.StructField("month", T.StringType())])
        try:
            return self.spark.read.schema(schema).parquet(self.coverage_path).drop("month")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema).drop("month")

    def load(self, gold: DataFrame, object_name: str, batch_id: str, at: datetime, force: bool = False) -> int:
        """Load one gold object; 0 rows if it was loaded before.

        A batch may have many objects.  ``force`` replaces the object's own rows
        and no others, also by none.  Rows are staged and counted before they are
        seen; a load that fails at any step leaves all as it was.
        """
        def loaded(parts: list[Part]) -> bool:
            return any((p["table"], p["object_name"]) == ("load_log", object_name) for p in parts)

        if not force and loaded(self.store.parts()):
            return 0
        rows = align(gold.withColumns({"ingest_object_name": F.lit(object_name), "batch_id": F.lit(batch_id)}), ARTICLES)
        seen = Observation()
        path = self.store.stage(rows.observe(seen, F.count(F.lit(1)).alias("rows")).sortWithinPartitions("source", "published_at", "id"))
        part: Part = {"table": "articles", "path": path, "object_name": object_name, "batch_id": batch_id}
        count = self.store.read([part], ARTICLES).count()
        if count != seen.get["rows"]:
            raise ValueError(f"{object_name}: stored rows differ from those loaded")
        entry: Part = {"table": "load_log", "object_name": object_name, "at": at.strftime("%Y-%m-%d %H:%M:%S"), "rows": count}
        done = []

        def change(parts: list[Part]) -> list[Part]:
            # Someone else may have loaded the object meanwhile.
            done[:] = [force or not loaded(parts)]
            own = lambda p: p["table"] == "articles" and (p["object_name"], p["batch_id"]) == (object_name, batch_id)
            return [*(p for p in parts if not own(p)), part, entry] if done[0] else parts

        self.store.commit(change)
        return count if done[0] else 0

    def delete_batch(self, batch_id: str) -> bool:
        """Remove a batch with all its objects before it is loaded anew; whether there was one."""
        if all(p["batch_id"] != batch_id for p in self.store.parts("articles")):
            return False
        self.store.commit(lambda parts: [p for p in parts if p["table"] != "articles" or p["batch_id"] != batch_id])
        return True

    def append_coverage(self, runs: DataFrame) -> bool:
        """Add rows about collector runs, by month; a failure is a warning and false."""
        try:
            rows = align(runs, COVERAGE)
            rows.withColumn("month", month("run_finished_at")).write.mode("append").partitionBy("month").parquet(self.coverage_path)
        except PySparkException as error:
            warnings.warn(f"coverage not written: {error}", stacklevel=2)
            return False
        return True


def new_objects(batch: DataFrame, load_log: DataFrame) -> DataFrame:
    """Rows of objects that the gold layer has not loaded."""
    done = load_log.where("layer = 'gold'").select(F.col("object_name").alias("ingest_object_name")).distinct()
    return batch.join(done, "ingest_object_name", "left_anti")


def delete_batch(articles: DataFrame, batch_id: str) -> DataFrame:
    return articles.where(~F.col("batch_id").eqNullSafe(F.lit(batch_id)))


def markdown(title: str, summary: dict, tables: dict[str, DataFrame], limit: int = 100) -> str:
    """A report of a few facts and small tables; a longer table says where it ends."""
    lines = [f"# {title}", "", *[f"- {k}: {v}" for k, v in summary.items()]]
    for name, df in tables.items():
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        rows = df.limit(limit + 1).collect()
        lines += ["| " + " | ".join(str(v).replace("|", "\\|") for v in row) + " |" for row in rows[:limit]]
        if len(rows) > limit:
            lines.append(f"\nThe first {limit} rows.")
    return "\n".join(lines) + "\n"
