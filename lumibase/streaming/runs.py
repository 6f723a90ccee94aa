"""Running a stream over what is there, and going on after a stop."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def arrived(rows: list[DataFrame], path: str) -> None:
    """Writes tables one after the other, as files that come in this order."""
    for n, part in enumerate(rows):
        part.coalesce(1).write.parquet(f"{path}/{n}")


def files(spark: SparkSession, schema, path: str, each: int | None = 1) -> DataFrame:
    """The stream of a folder's tables, so many files a batch; without a number all that have come are one batch."""
    read = spark.readStream.schema(schema)
    return (read.option("maxFilesPerTrigger", each) if each else read).parquet(f"{path}/*")


def run(writer: Callable[[], DataStreamWriter], batches: int | None = None) -> int:
    """Runs what a writer makes over all that has arrived, or until so many batches are done, and then stops. How many
    batches this run has done. The next run goes on from the writer's checkpoint."""
    query = writer().trigger(availableNow=True).start()
    while batches is not None and query.isActive and len(query.recentProgress) < batches:
        time.sleep(0.05)
    if batches is not None:
        query.stop()
    query.awaitTermination()
    return len(query.recentProgress)


def to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> Callable[[], DataStreamWriter]:
    """A writer of Parquet files, each batch of which is seen once."""
    return lambda: stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
