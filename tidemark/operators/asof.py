"""Joins by time: backward as-of, sums over trailing ranges and over intervals.

None holds a whole series in a task: time is cut into blocks, each block is sorted by itself, and what one block
hands to the next is one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import micros

BLOCK_S = 86400


def asof(left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_time: str, right_time: str, values: tuple[str, ...], block_s: int = BLOCK_S, tie: tuple[str, ...] = ()) -> DataFrame:
    """left with the values of the last row of right of the same keys at or before its time; null before the first.

    Of rows of right at the same time the last is the one of the largest `tie`, columns of right, then of the largest
    values, so that the result doesn't depend on how rows are partitioned."""
    block = lambda t: F.floor(micros(F.col(t)) / (block_s * 1_000_000)).cast("long")
    held, ranked = F.struct(*values), F.struct(*tie, *values)
    r = right.select(*keys, block(right_time).alias("_block"), micros(F.col(right_time)).alias("_at"), F.lit(0).alias("_side"), ranked.alias("_tie"), held.alias("_right"), F.lit(None).cast(left.schema).alias("_left"))
    own = left.select(*keys, block(left_time).alias("_block"), micros(F.col(left_time)).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(ranked.alias("x")).schema["x"].dataType).alias("_tie"), F.lit(None).cast(right.select(held.alias("x")).schema["x"].dataType).alias("_right"), F.struct(*left.columns).alias("_left"))
    order = Window.partitionBy(*keys, "_block").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    here = r.unionByName(own).withColumn("_here", F.last("_right", ignorenulls=True).over(order)).filter("_side = 1")
    # the last value of each block, handed on over blocks without one
    ends = r.groupBy(*keys, "_block").agg(F.max_by("_right", F.struct("_at", "_tie")).alias("_right"))
    blocks = ends.unionByName(own.select(*keys, "_block").distinct().withColumn("_right", F.lit(None).cast(ends.schema["_right"].dataType)))
    blocks = blocks.groupBy(*keys, "_block").agg(F.first("_right", ignorenulls=True).alias("_right"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_right", ignorenulls=True).over(earlier).alias("_carried"))
    found = F.coalesce("_here", "_carried")
    return here.join(carried, [*keys, "_block"], "left").select("_left.*", *(found[v].alias(v) for v in values))


def trailing_range_sum(left: DataFrame, points: DataFrame, keys: tuple[str, ...], left_time: str, point_time: str, minutes: int, value: str, where: Column, name: str) -> DataFrame:
    """left with the sum of the points of the same keys within the last minutes, both ends included, that satisfy
    `where`, a condition on columns of both; 0 where there is none, null where the keys have no point at all.

    Points are looked up by buckets as long as the range, so that each row of left meets two of them. Equal rows of left
    are one row with a count until they have their sum."""
    step = minutes * 60_000_000
    counted = left.groupBy(*left.columns).agg(F.count("*").alias("_copies"))
    to = counted.withColumn("_to", micros(F.col(left_time)))
    l = to.withColumn("_b", F.explode(F.array(F.floor(F.col("_to") / step), F.floor(F.col("_to") / step) - 1)))  # noqa: E741
    own = {k: f"_k{i}" for i, k in enumerate(keys)}
    p = points.withColumnsRenamed(own).withColumn("_p", micros(F.col(point_time))).withColumn("_bucket", F.floor(F.col("_p") / step))
    same = reduce(Column.__and__, [F.col(k) == F.col(o) for k, o in own.items()], F.col("_b") == F.col("_bucket"))
    met = l.join(p, same & (F.col("_p") <= F.col("_to")) & (F.col("_p") >= F.col("_to") - step) & where, "left")
    sums = met.groupBy(*left.columns, "_copies").agg(F.sum(value).alias("_sum"))
    seen = points.select(*keys).distinct().withColumn("_seen", F.lit(True))
    known = sums.join(seen, list(keys), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return known.select(*left.columns, F.when(F.col("_seen"), F.coalesce("_sum", F.lit(0.0))).alias(name))


def interval_sum(trades: DataFrame, points: DataFrame, keys: tuple[str, ...], entry: str, exit_: str, point_time: str, value: str, name: str) -> DataFrame:
    """trades with the sum of the points in (entry, exit]: the running sum at the exit less that at the entry."""
    running = Window.partitionBy(*keys).orderBy(point_time).rowsBetween(Window.unboundedPreceding, 0)
    sums = points.groupBy(*keys, point_time).agg(F.sum(value).alias(value)).withColumn("_sum", F.sum(value).over(running)).select(*keys, point_time, "_sum")
    at_exit = asof(trades, sums, keys, exit_, point_time, ("_sum",)).withColumnRenamed("_sum", "_out")
    both = asof(at_exit, sums, keys, entry, point_time, ("_sum",))
    total = F.coalesce("_out", F.lit(0.0)) - F.coalesce("_sum", F.lit(0.0))
    return both.select(*trades.columns, F.when(F.col(exit_) > F.col(entry), total).otherwise(0.0).alias(name))
