"""Starting streaming jobs that read what is there and stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.listener import StreamingQueryProgress

# State lives on local disk with changelogs in the checkpoint, not on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(stream: DataFrame, checkpoint: str, sink: Callable[[DataStreamWriter], DataStreamWriter]) -> list[StreamingQueryProgress]:
    """Run to the end of the input with one state partition per core of the cluster.

    A query takes its settings when it starts and keeps the number of state
    partitions in its checkpoint, so the session gets its own value back. Gives the
    progress of the latest batches.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
        query = sink(writer.trigger(availableNow=True)).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    query.awaitTermination()
    return list(query.recentProgress)


def append_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> list[StreamingQueryProgress]:
    """Append all available rows; a later call with the same checkpoint goes on from there."""
    return _run(stream, checkpoint, lambda writer: writer.format("parquet").option("path", path))


def for_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    _run(stream, checkpoint, lambda writer: writer.foreachBatch(write))
