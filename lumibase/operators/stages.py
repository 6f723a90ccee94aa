"""Tables between the steps of an operator, written once to the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a session on this one machine, as in tests, gets a folder of
    its own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing is at; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The table as it is now: its lineage ends there, each later step reads only the columns it needs, and numbers that
    Spark gives by partition stay what they are."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores by keys, for few bytes that become many rows, which Spark would leave to one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def ordered_blocks(df: DataFrame, order: list[Column | str], label: str, blocks: int | None = None) -> DataFrame:
    """The table in an order, cut into blocks of about equally many rows by a range shuffle, with _block and _row (a number
    that rises by one within a block and further from block to block). A key that very many rows have lies in many
    blocks, as long as the order goes on below it. Without a number of blocks Spark's for a shuffle is taken."""
    dealt = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    return written(dealt.sortWithinPartitions(*order).withColumns({"_block": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), label)
