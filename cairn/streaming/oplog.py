"""Applying an operation stream to tables, exactly once a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import references


def _run(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def apply_operations(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Append a stream of operations (ns, key, op, ts, version, size) to a log table.

    A batch goes to its own folder, named by its number and overwritten when the batch is repeated
    after a failure, so replays change nothing. ``current`` reads the live references back.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _run(stream, apply, checkpoint, once)


def current(spark, path: str) -> DataFrame:
    """Live references of an operation log."""
    return references.live_refs(spark.read.parquet(path))


def live_stats(spark, path: str) -> DataFrame:
    """Objects and bytes of every namespace as they stand after overwrites and deletes, from an operation log."""
    return current(spark, path).groupBy("ns").agg(F.count("*").alias("blob_count"), F.sum("size").alias("bytes_stored"))


def maintain_stats(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Keep per-namespace counters of written objects and bytes as one small table a batch.

    These are counters of traffic (overwrites count again, deletes don't); ``live_stats`` has what
    stands. Each batch stores its own sums under its number; readers add them up, which makes a
    repeated batch harmless without reading old totals.
    """

    def apply(batch: DataFrame, number: int) -> None:
        puts = batch.where("op = 'put'").groupBy("ns").agg(F.count("*").alias("writes"), F.sum("size").alias("bytes_written"))
        puts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _run(stream, apply, checkpoint, once)


def totals(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("ns").agg(F.sum("writes").alias("writes"), F.sum("bytes_written").alias("bytes_written"))
