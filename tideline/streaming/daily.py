"""The daily roll-up as a stream: events to daily bars with a watermark, written as days
close. For monthly figures that late events still change see :mod:`.monthly`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(events: DataFrame, keys: Sequence[str], time: str, value: str, delay: str = "2 days") -> DataFrame:
    """(keys, date, close, high, low, n) of each day, late events up to ``delay``
    counted; works on a stream and on a batch alike."""
    source = events.withWatermark(time, delay) if events.isStreaming else events
    day = F.window(F.col(time), "1 day")
    bars = source.groupBy(*keys, day.alias("day")).agg(F.avg(value).alias("close"), F.max(value).alias("high"), F.min(value).alias("low"), F.count(value).alias("n"))
    return bars.select(*keys, F.col("day.start").cast("date").alias("date"), "close", "high", "low", "n")


def run_available(bars: DataFrame, path: str, checkpoint: str):
    """Write what a stream of bars has so far as Parquet, once per closed day, and stop."""
    return bars.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
