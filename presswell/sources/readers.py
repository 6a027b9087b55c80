"""Readers of raw, silver and gold files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswell.functions.compat import text
from presswell.schemas import RAW_RECORD

FORMATS = ("json", "jsonl", "parquet", "csv")


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file, folder or glob by its suffix; a folder is Parquet."""
    suffix = path.rstrip("/").rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else "parquet"
    if suffix not in FORMATS:
        raise ValueError(f"no reader for .{suffix}")
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == "json":
        return reader.option("multiLine", True).json(path)
    if suffix == "csv":
        return reader.option("header", True).option("escape", '"').csv(path)
    return reader.json(path) if suffix == "jsonl" else reader.parquet(path)


def read_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All files of a folder in the known formats, under one schema."""
    out = None
    for suffix in FORMATS:
        reader = spark.read.schema(schema).option("pathGlobFilter", f"*.{suffix}")
        found = {"json": lambda r: r.option("multiLine", True).json(folder), "jsonl": lambda r: r.json(folder), "parquet": lambda r: r.parquet(folder),
                 "csv": lambda r: r.option("header", True).csv(folder)}[suffix](reader)
        out = found if out is None else out.unionByName(found)
    return out


#: Bytes that a task reads at most by Spark's default.
SPLIT_BYTES = 1 << 27


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows, dealt out by ``by`` where the files that they come from would not fill the cores.

    A file of one row group is read by one task.  Rows of as many files as there
    are cores, of more bytes than a split for each core, or of no files stay
    where they are, so that no large table is shuffled.
    """
    spark, paths = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if not paths or len(paths) >= cores:
        return df
    files = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    size = sum(f.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(f).getLen() for f in files)
    return df.repartition(cores, *by) if size <= cores * SPLIT_BYTES else df


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modified, length) of files; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
            .select("path", F.col("modificationTime").alias("modified"), "length"))


def latest(spark: SparkSession, folder: str, glob: str = "*", without: tuple[str, ...] = ()) -> str | None:
    """Path of the newest file; the last by name among equals."""
    found = listing(spark, folder, glob)
    for part in without:
        found = found.where(~F.contains(F.element_at(F.split("path", "/"), -1), F.lit(part)))
    return found.agg(F.max(F.struct("modified", "path"))["path"]).first()[0]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of a file that is a list, or a bundle with the list in ``items``."""
    found = spark.read.option("multiLine", True).schema(f"{RAW_RECORD}, items array<struct<{RAW_RECORD.replace(' string', ':string')}>>").json(path)
    plain = found.where("items IS NULL").drop("items")
    return plain.unionByName(found.where("items IS NOT NULL").select(F.inline("items")))


_CHILDREN = "guid string, id string, title string, description string, summary string, content string, pubDate string, published string, updated string"


def read_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Items of RSS files and entries of Atom files; what has neither title nor link is dropped.

    Names are taken without their namespaces.  A file that is an HTML page has
    no items.
    """
    def children(tag: str, link: str) -> DataFrame:
        reader = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("mode", "PERMISSIVE")
        return reader.schema(f"{_CHILDREN}, link {link}").load(path)

    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names], F.lit(""))
    # An Atom entry has links with a place and a kind; the one for readers comes first.
    links = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    href = F.coalesce(F.try_element_at(links, F.lit(1))["_href"], F.try_element_at(F.col("link"), F.lit(1))["_href"], F.lit(""))
    items = children("item", "string").unionByName(children("entry", "array<struct<_href:string,_rel:string,_VALUE:string>>").withColumn("link", F.trim(href)))
    return items.select(
        first("guid", "id", "link").alias("id"), F.trim(text("title")).alias("title"), F.trim(text("link")).alias("link"),
        first("pubDate", "published", "updated").alias("published_at"), F.lit(source).alias("source"),
        first("summary", "description", "content", "title").alias("raw_text")).where("NOT (title = '' AND link = '')")


def read_settings(path: str) -> dict:
    """Settings of a YAML file; none if there is no file."""
    import yaml

    try:
        with open(path, encoding="utf-8") as file:
            return yaml.safe_load(file) or {}
    except FileNotFoundError:
        return {}


def feeds(settings: dict, only: tuple[str, ...] = ()) -> list[dict]:
    """The RSS sources that are enabled, or those named in ``only`` whether enabled or not."""
    listed = ((settings.get("sources") or {}).get("rss")) or []
    return [f for f in listed if (f.get("name") in only if only else f.get("enabled", True))]


def channels(lines: list[str], given: str = "") -> list[str]:
    """Channels of a comma-separated list, then of a file's lines: without '@' and comments, in order, once each."""
    listed = [*given.split(","), *(x for x in map(str.strip, lines) if not x.startswith("#"))]
    return list(dict.fromkeys(c for c in (x.strip().lstrip("@").strip() for x in listed) if c))


def footer(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Column names and number of rows of Parquet files, from their footers."""
    found = spark.read.parquet(path)
    return found.columns, found.count()


def preview(spark: SparkSession, folder: str, glob: str, files: int = 10, rows: int = 5) -> tuple[list[str], DataFrame | None]:
    """The newest files of a folder, and the first rows of the newest."""
    found = listing(spark, folder, glob).orderBy(F.col("modified").desc(), F.col("path").desc()).limit(files)
    paths = [r["path"] for r in found.select("path").collect()]
    return paths, read(spark, paths[0]).limit(rows) if paths else None


def read_tsv(lines: str) -> list[list[str]]:
    """Rows of a tab-separated result."""
    return [line.split("\t") for line in lines.splitlines() if line]


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Terms of word lists: trimmed, lower case, without comments, once each."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where("term <> '' AND NOT startswith(term, '#')").distinct()


def columns(df: DataFrame) -> DataFrame:
    """(position, name, type) of a table's columns."""
    return df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes, 1)], "position int, name string, type string")
