"""Running sums, counts and extremes of long series, in blocks: a hot key is many tasks.

A row's value is that of the rows before it in its block, and of the blocks before. The first is a window over a key and
a block, the second one over a row for each block. Blocks follow the order of the rows: stretches of time, or of values."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import micros

#: Seconds of a block of time.
BLOCK_S = 7 * 86400


def time_block(time: Column, seconds: int = BLOCK_S) -> Column:
    return F.floor(micros(time) / (seconds * 1_000_000)).cast("long")


def running(df: DataFrame, keys: tuple[str, ...], block: Column, order: tuple[str, ...], sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None) -> DataFrame:
    """df with a column for each of `sums` and `most`: the sum and the greatest value of all rows of the key up to each, its own
    included, in the order of `order`. A later row never has a smaller block; rows without an order come first."""
    made = {k: (F.sum, c) for k, c in (sums or {}).items()} | {k: (F.max, c) for k, c in (most or {}).items()}
    b = df.withColumn("_block", F.coalesce(block.cast("long"), F.lit(-(1 << 63)))).select("*", *(c.alias(f"_x{i}") for i, (_, c) in enumerate(made.values())))
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = b.groupBy(*keys, "_block").agg(*(f(f"_x{i}").alias(f"_e{i}") for i, (f, _) in enumerate(made.values())))
    ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), *(f(f"_e{i}").over(before).alias(f"_p{i}") for i, (f, _) in enumerate(made.values())))
    rows = b.select(*df.columns, "_block", *(f(f"_x{i}").over(within).alias(f"_w{i}") for i, (f, _) in enumerate(made.values())))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.col("_block") == F.col("_b"))
    both = lambda i, f: F.greatest(f"_w{i}", f"_p{i}") if f is F.max else F.when(F.col(f"_w{i}").isNull(), F.col(f"_p{i}")).otherwise(F.col(f"_w{i}") + F.coalesce(f"_p{i}", F.lit(0)))
    return rows.join(ends, same).select(*df.columns, *(both(i, f).alias(name) for i, (name, (f, _)) in enumerate(made.items())))


def with_totals(df: DataFrame, keys: tuple[str, ...], **aggregates: Column) -> DataFrame:
    """df with aggregates of its key: a join with a row for each key, not a window that holds a key's rows."""
    rows = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(*(c.alias(name) for name, c in aggregates.items()))
    # without keys it is one row, which goes beside each
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.lit(True))
    return df.join(rows, same).select(*df.columns, *aggregates)
