"""Bars from points and from smaller bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import bucket_close, bucket_start, micros


def from_points(points: DataFrame, minutes: int, time: str, price: str, volume: str, keys: tuple[str, ...], tie: tuple[str, ...] = ()) -> DataFrame:
    """OHLCV bars: first, highest, lowest and last price and summed volume of each bucket with a point.

    Points of the same time are in the order of `tie`, and then of their prices."""
    at = F.struct(time, *tie, price)
    b = points.withColumn("open_time", bucket_start(F.col(time), minutes)).groupBy(*keys, "open_time")
    out = b.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum(volume).alias("volume"))
    return out.withColumn("close_time", bucket_close(F.col("open_time"), minutes))


def resampled(bars: DataFrame, minutes: int, keys: tuple[str, ...]) -> DataFrame:
    """Larger bars from smaller ones; a bucket closes at its nominal end, whatever bars it holds."""
    b = bars.withColumn("_start", bucket_start(F.col("open_time"), minutes)).groupBy(*keys, "_start")
    out = b.agg(F.min_by("open", F.struct("open_time", "open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", F.struct("open_time", "close")).alias("close"), F.sum("volume").alias("volume"))
    return out.withColumnRenamed("_start", "open_time").withColumn("close_time", bucket_close(F.col("open_time"), minutes))


def last_per_minute(points: DataFrame, time: str, values: tuple[str, ...], keys: tuple[str, ...], tie: tuple[str, ...] = ()) -> DataFrame:
    """The last point of each minute: later snapshots overwrite earlier ones, at the same time by `tie`, then by value."""
    b = points.withColumn("minute", bucket_start(F.col(time), 1)).groupBy(*keys, "minute")
    last = F.max_by(F.struct(*values), F.struct(micros(F.col(time)).alias("_at"), *tie, *values))
    return b.agg(last.alias("_last")).select(*keys, "minute", "_last.*")
