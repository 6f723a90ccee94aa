"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one that ``spark.checkpoint.dir`` names. Only where that is unset and Spark runs on this one machine, as
    in tests, is a folder of this machine taken, and then set as the context's checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Remove what is at a path when the application ends."""
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: its lineage ends there, and a lost executor
    costs a re-read, not a recomputation. What is written goes when the application ends."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a materialized table that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        files, place = _file_system(df.sparkSession, path)
        files.delete(place, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: a batch has at most so many rows (or 16 MB).

    Spark reads these settings when a plan runs, so they stay set. They are only ever lowered."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(name).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Remembered(dict):
    """What a worker keeps of words it has met: at most twice ``most`` entries. Once there are ``most`` new ones, those
    that are not met again until the next time are dropped."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def unknown(self, words: set[str]) -> set[str]:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        new = words - self.keys()
        if self.older:
            again = new & self.older.keys()
            self.update((w, self.older[w]) for w in again)
            new -= again
        return new
