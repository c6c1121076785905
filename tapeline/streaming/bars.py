"""Append-only bars: the resampler over a stream of ticks, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, time: str, key: str, price: str, order: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Open, high, low, close and count for each key and window; a window is final once the watermark has passed it."""
    at = F.struct(F.col(time), *[F.col(c) for c in order], F.col(price).alias("_p"))
    bars = ticks.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.min(at)["_p"].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(at)["_p"].alias("close"), F.count("*").alias("n"))
    return bars.select(key, F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "n")
