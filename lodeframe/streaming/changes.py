"""Change streams of class path entries: the first report of each change, and counts per window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_reports(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows whose keys were not reported within ``delay`` of event time before; state is dropped behind the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, keys: list[str], time: str, width: str, delay: str) -> DataFrame:
    """(window_start, keys, n) per window of ``width``; rows later than ``delay`` are left out, as they come after its result."""
    found = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("window_start"), *keys, "n")
