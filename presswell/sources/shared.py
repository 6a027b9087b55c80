"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where the setting is
    absent, as in local tests, a temporary folder of this machine is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.gettempdir() + "/presswell-checkpoints"
    return named.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: what is read afterwards survives the loss of an executor
    and is never computed twice.
    """
    path, schema = _written(df, tag)
    return df.sparkSession.read.schema(schema).parquet(path)


def _written(df: DataFrame, tag: str) -> tuple[str, StructType]:
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return path, df.schema


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside gives its shuffle files back when it is written, as nobody reads them again.

    Else they stay until the driver happens to collect garbage, and the steps of a query add up on disk.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Where results were written and their schemas, by application, name and the state of their sources.
_KEPT: dict[tuple, tuple[str, StructType]] = {}


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """``build()``, written once and read by all who ask for it while its sources stay as they are.

    The state of the sources is the number, the bytes and the last change of
    their files, which are listed each time.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sources)
    state = listed.agg(F.count(F.lit(1)), F.sum("length"), F.max("modificationTime").cast("long")).first()
    key = (spark.sparkContext.applicationId, name, *sources, *state)
    path, schema = _KEPT.get(key, (None, None))
    files = spark._jvm.org.apache.hadoop.fs.Path
    if path is None or not files(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(files(f"{path}/_SUCCESS")):
        path, schema = _written(build(), name)
        _KEPT[key] = path, schema
    return spark.read.schema(schema).parquet(path)
