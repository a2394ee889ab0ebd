"""Starting and draining streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewatch.workspace import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for streams on the same cluster; the settings of ``spark`` stay as they are.

    State lives in RocksDB, which spills to disk.  A stateful stream keeps the number of
    state partitions it starts with, so that number is set for the whole cluster:
    ``tidewatch.state.partitions``, or one per core.
    """
    session = spark.newSession()
    partitions = spark.conf.get("tidewatch.state.partitions", str(spark.sparkContext.defaultParallelism))
    session.conf.set("spark.sql.shuffle.partitions", partitions)
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return session


def write_available(stream: DataFrame, root: str, name: str | None = None) -> StreamingQuery:
    """Append what is available now to ``root/rows`` and stop; offsets and state go to ``root/checkpoint``."""
    writer = stream.writeStream.queryName(name) if name else stream.writeStream
    query = (
        writer.format("parquet")
        .option("path", f"{root}/rows")
        .option("checkpointLocation", f"{root}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, root: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off what is available now in micro-batches and stop; ``work`` may be called twice for a batch."""
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drained(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    """The rows of a stream over data that is all there, as a table of session ``spark``."""
    root = new_folder(spark, purpose)
    write_available(stream, root)
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
