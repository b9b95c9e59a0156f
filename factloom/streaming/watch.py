"""Checks of files as they arrive: Structured Streaming with one batch query for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, schema: str, check: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Runs ``check`` on each micro-batch of new Parquet files. A batch writes to a folder of its own number, so that
    one that is repeated after a failure replaces what it had written."""

    def each(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
