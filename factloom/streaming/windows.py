"""Stateful streams: tumbling and session windows with watermarks, exactly once, restarted from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, width: str, delay: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """(window_start, window_end, keys, measures) of each window and key. Rows more than ``delay`` behind the latest seen
    in earlier batches may find their window closed and given out; such rows are dropped. Null times are in no window."""
    window = F.window(at, width)
    counted = events.withWatermark(at, delay).groupBy(window.alias("window"), *keys).agg(*measures)
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in counted.columns if c != "window"])


def sessions(events: DataFrame, at: str, gap: str, delay: str, keys: list[str], measures: list[Column]) -> DataFrame:
    """(session_start, session_end, keys, measures) of each run of a key's rows that follow one another within ``gap``; it
    ends ``gap`` after the last. State is one row an open session; sessions of late rows are treated as in ``tumbling``."""
    counted = events.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("session"), *keys).agg(*measures)
    return counted.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *[c for c in counted.columns if c != "session"])


def first_of_each(events: DataFrame, at: str, delay: str, keys: list[str]) -> DataFrame:
    """Rows but repeated deliveries: of rows with the same keys within ``delay`` the first to come."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def advance(spark: SparkSession, folder: str, schema: str, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int | None = None) -> DataFrame:
    """Takes in the Parquet files that came since the checkpoint, ``files`` a batch, and returns all that ``build`` has
    given out so far. Windows are given out once, when the watermark has passed their end. Sources' offsets, state and
    watermark are in the checkpoint and the sink keeps a log of its files, so a stream that is stopped or broken off
    goes on where it was, without loss or repetition."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    built = build(stream)
    query = built.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(built.schema).parquet(out)


def replayed(spark: SparkSession, slices: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What ``build`` gives out over slices that arrive one after the other; the stream is stopped and restarted between."""
    given = None
    for rows in slices:
        rows.write.mode("append").parquet(f"{folder}/in")
        given = advance(spark, f"{folder}/in", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), build, f"{folder}/out", f"{folder}/checkpoint")
    return given
