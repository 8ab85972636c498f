"""Times on regular grids. Times stay without a zone, so that results don't depend on the session's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes of the timeframes.
TIMEFRAMES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440}


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def floored(ts: Column, seconds: int) -> Column:
    """The start of the grid slot that holds a time, slots counted from the epoch."""
    step = seconds * 1_000_000
    return from_micros(micros(ts) - F.pmod(micros(ts), F.lit(step)))


def bucket_start(ts: Column, minutes: int) -> Column:
    return floored(ts, 60 * minutes)


def bucket_close(start: Column, minutes: int) -> Column:
    """The last millisecond of a bucket."""
    return from_micros(micros(start) + (60_000_000 * minutes - 1000))


def date_parts(ts: Column) -> list[Column]:
    """Hive partition columns of a record, from its event time."""
    return [F.date_format(ts, p).alias(n) for p, n in (("yyyy", "year"), ("MM", "month"), ("dd", "day"))]


def grid(bounds: DataFrame, start: str, end: str, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each slot from the one that holds start to the one that holds end, for each row of bounds."""
    step = seconds * 1_000_000
    first, last = (micros(floored(F.col(x), seconds)) for x in (start, end))
    slots = bounds.select(*keys, F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("_us"))
    return slots.select(*keys, from_micros(F.col("_us")).alias("slot"))
