"""Structured Streaming forms: tumbling means, bursts as session windows, and ingestion of new files batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def window_means(frames: DataFrame, width: str, keys: tuple[str, ...] = (), time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """(keys, start, n, mean): tumbling windows per key; on a stream, rows later than `late` behind the newest are left out."""
    marked = frames.withWatermark(time, late) if frames.isStreaming else frames
    found = marked.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return found.select(*keys, F.col("w.start").alias("start"), "n", "mean")


def bursts(events: DataFrame, gap: str, keys: tuple[str, ...], time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """(keys, first, last, n, total): runs of rows of one key with no pause longer than `gap`."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    found = marked.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(*keys, "first", "last", "n", "total")


def watch(spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there, handing each batch to `handle`, and stop. The checkpoint lets the next call go on
    from where this one ended; a batch that failed comes again under the same number."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()


def ingest(stream: DataFrame, target: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append each batch of new rows, changed, to a table with one folder a batch; a repeated batch replaces its folder, so
    that rows arrive once."""

    def handle(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    drain(stream, handle, checkpoint)


def latest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Write the whole state of an aggregation after each batch (complete mode), replacing the state before."""
    drain(stream, lambda batch, _: batch.write.mode("overwrite").parquet(target), checkpoint, "complete")


def lag_behind(time: Column) -> Column:
    """Seconds by which a row's time lies behind the clock."""
    return F.unix_micros(F.current_timestamp()) / 1e6 - F.unix_micros(time.cast("timestamp")) / 1e6
