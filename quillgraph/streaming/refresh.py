"""Repeated refreshes: once, never, or by an interval, and by new files as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Intervals below this one run once.
LEAST_INTERVAL = 30


def plan(interval: int) -> str:
    """``never`` for -1, ``once`` below the least interval, else ``repeat``."""
    if interval == -1:
        return "never"
    return "repeat" if interval >= LEAST_INTERVAL else "once"


def every(spark: SparkSession, interval: int, refresh: Callable[[], object], checkpoint: str) -> StreamingQuery | None:
    """Runs ``refresh`` at the interval. Each run is a micro-batch, so one that fails is run again."""
    what = plan(interval)
    if what == "never":
        return None
    if what == "once":
        refresh()
        return None
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda df, epoch: refresh()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{interval} seconds").start()


def on_new_files(spark: SparkSession, directory: str, apply: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.json", once: bool = True) -> StreamingQuery:
    """Applies ``apply`` to the lines of files that are new in a directory since the last run."""
    lines = spark.readStream.format("text").option("pathGlobFilter", glob).load(directory)
    writer = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{LEAST_INTERVAL} seconds")).start()
