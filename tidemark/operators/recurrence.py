"""Linear recurrences y = a * y_before + u over long series, in blocks, by window functions alone.

Within a block y is a running sum: with L the running sum of ln a, y = exp(L) * (sum of u * exp(-L)), which needs
nothing of other blocks and stays within the range of doubles as blocks are short. What a block does to the value that
enters it is one pair of numbers, y and p with the value that leaves it p * entering + y, and these pairs, one for
`BLOCK_ROWS` rows, are summed the same way. So a series of any length is spread over tasks, and only block ends meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a block: factors a above 0.005, or 0, are safe.
BLOCK_ROWS = 128
#: Block ends are summed in stretches over which the factors together fall by no more than exp(-REACH).
REACH = 300.0


def indexed(df: DataFrame, keys: tuple[str, ...], time: str, name: str = "i", block_s: int = 86400 * 7) -> DataFrame:
    """df with each row's number in its series, from 0: the rows of earlier time blocks and those before it in its own."""
    from ..functions.timegrid import micros

    b = df.withColumn("_b", F.floor(micros(F.col(time)) / (block_s * 1_000_000)).cast("long"))
    within = b.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(time)) - 1)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = b.groupBy(*keys, "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return within.join(counts, [*keys, "_b"]).withColumn(name, (F.col("_before") + F.col("_r")).cast("long")).drop("_b", "_r", "_before")


def _before(keys: tuple[str, ...], *more: str, order: str):
    return Window.partitionBy(*keys, *more).orderBy(order)


def _entering(ends: DataFrame, keys: tuple[str, ...], n: range) -> DataFrame:
    """The values `_fin{k}` that enter each block, from each block's pairs `_fp` and `_fy{k}`.

    A stretch takes over what the one before it leaves; what comes from farther back has shrunk by exp(-REACH), which is
    less than doubles can tell."""
    c, nan = F.col, F.lit(float("nan"))
    running = lambda *by: _before(keys, *by, order="_fblock").rowsBetween(Window.unboundedPreceding, 0)
    e = ends.withColumn("_fseg", F.sum(F.when(c("_fp") == 0, 1).otherwise(0)).over(running()))
    e = e.withColumn("_fl", F.sum(F.when(c("_fp") == 0, 0.0).otherwise(F.ln("_fp"))).over(running("_fseg")))
    e = e.withColumn("_fstretch", F.floor(-c("_fl") / REACH)).withColumn("_fnear", c("_fl") + REACH * c("_fstretch"))
    sums = [(F.exp("_fnear") * F.sum(c(f"_fy{k}") * F.exp(-c("_fnear"))).over(running("_fseg", "_fstretch"))).alias(f"_fs{k}") for k in n]
    e = e.select(*keys, "_fblock", "_fseg", "_fl", "_fstretch", *sums)
    left = F.lag(F.struct("_fstretch", "_fl", *(f"_fs{k}" for k in n))).over(_before(keys, "_fseg", order="_fblock"))
    e = e.withColumn("_fleft", left).withColumn("_fleft", F.first("_fleft").over(running("_fseg", "_fstretch")))
    whole = [F.when(c("_fseg") == 0, nan).otherwise(c(f"_fs{k}") + F.coalesce(F.exp(c("_fl") - c("_fleft._fl")) * c(f"_fleft._fs{k}"), F.lit(0.0))).alias(f"_fw{k}") for k in n]
    e = e.select(*keys, "_fblock", *whole)
    return e.select(*keys, "_fblock", *(F.coalesce(F.lag(f"_fw{k}").over(_before(keys, order="_fblock")), nan).alias(f"_fin{k}") for k in n))


def folded(df: DataFrame, keys: tuple[str, ...], order: str, a: Column, series: list[tuple[Column, str]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with a column y for each (u, name), all in one pass. order: the row number, as from `indexed`. A row
    with a = 0 starts anew with y = u; before the first such row, and where u is null, y is null."""
    c, n, nan = F.col, range(len(series)), F.lit(float("nan"))
    rows = df.withColumn("_fblock", F.floor(c(order) / block_rows).cast("long")).withColumn("_fa", F.coalesce(a.cast("double"), nan))
    rows = rows.select("*", *(F.coalesce(u.cast("double"), nan).alias(f"_fu{k}") for k, (u, _) in enumerate(series)))
    running = lambda *by: _before(keys, "_fblock", *by, order=order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_fseg", F.sum(F.when(c("_fa") == 0, 1).otherwise(0)).over(running()))
    rows = rows.withColumn("_fl", F.sum(F.when(c("_fa") == 0, 0.0).otherwise(F.ln("_fa"))).over(running("_fseg")))
    rows = rows.withColumn("_fp", F.when(c("_fseg") == 0, F.exp("_fl")).otherwise(0.0))
    rows = rows.select(*df.columns, "_fblock", "_fp", *((F.exp("_fl") * F.sum(c(f"_fu{k}") * F.exp(-c("_fl"))).over(running("_fseg"))).alias(f"_fy{k}") for k in n))
    rows = written(rows, "folded")  # both the block ends and the rows are read from it
    ends = rows.groupBy(*keys, "_fblock").agg(F.max_by(F.struct("_fp", *(f"_fy{k}" for k in n)), order).alias("_fe")).select(*keys, "_fblock", "_fe.*")
    met = rows.join(_entering(ends, keys, n), [*keys, "_fblock"])
    value = lambda k: F.when(c("_fp") == 0, c(f"_fy{k}")).otherwise(c("_fp") * c(f"_fin{k}") + c(f"_fy{k}"))
    return met.select(*df.columns, *(F.when(~F.isnan(value(k)), value(k)).alias(name) for k, (_, name) in enumerate(series)))
