"""Streaming forms: event-time windows, sessions, and resumable work on arriving tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and key; events later than `late` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def resumable(tiles: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Work on tiles as they arrive, each once: the checkpoint holds what is done, and a batch that was cut off is
    written anew under its own number, so that a restart neither loses nor repeats results."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return tiles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
