"""Indicators over bars. Each value depends on its own bar and earlier ones alone; it is null until defined."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .recurrence import folded, indexed


def trailing(order: WindowSpec, n: int) -> WindowSpec:
    return order.rowsBetween(-(n - 1), 0)


def full(order: WindowSpec, n: int, value: Column) -> Column:
    """value once there are n rows."""
    return F.when(F.count(F.lit(1)).over(trailing(order, n)) == n, value)


def sma(x: Column, n: int, order: WindowSpec) -> Column:
    return full(order, n, F.avg(x).over(trailing(order, n)))


def rolling_sum(x: Column, n: int, order: WindowSpec) -> Column:
    return full(order, n, F.sum(x).over(trailing(order, n)))


def rolling_std(x: Column, n: int, order: WindowSpec) -> Column:
    """The standard deviation of the n values as a population."""
    return full(order, n, F.stddev_pop(x).over(trailing(order, n)))


def bb_position(close: Column, n: int, order: WindowSpec, mult: float = 2.0) -> Column:
    """Where the close lies in its band, 0 at the lower edge and 1 at the upper; 0.5 in a band without width."""
    mid, half = sma(close, n, order), mult * rolling_std(close, n, order)
    return F.when(half == 0, F.lit(0.5)).otherwise((close - (mid - half)) / (2 * half))


def log_return(close: Column, order: WindowSpec) -> Column:
    """0 for the first bar and where either price isn't positive."""
    before = F.lag(close).over(order)
    return F.when((before > 0) & (close > 0), F.ln(close / before)).otherwise(F.lit(0.0))


def realized_vol(returns: Column, n: int, order: WindowSpec, periods: float = 525_600.0) -> Column:
    """Percent a year, from a column of log returns."""
    return rolling_std(returns, n, order) * math.sqrt(periods) * 100


def pct_change(x: Column, n: int, order: WindowSpec) -> Column:
    before = F.lag(x, n).over(order)
    return F.when(before != 0, (x - before) / F.abs(before) * 100)


def true_range(order: WindowSpec) -> Column:
    high, low, before = F.col("high"), F.col("low"), F.lag("close").over(order)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def with_zscore(df: DataFrame, value: str, n: int, keys: tuple[str, ...], time: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """A null value starts the window anew, and a window without variance has no score."""
    order = Window.partitionBy(*keys).orderBy(time, *ties)
    runs = df.withColumn("_run", F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*keys, "_run").orderBy(time, *ties).rowsBetween(-(n - 1), 0)
    some, mean, std = F.count(value).over(w) == n, F.avg(value).over(w), F.stddev_pop(value).over(w)
    return runs.withColumn(name, F.when(F.col(value).isNotNull() & some & (std > 0), (F.col(value) - mean) / std)).drop("_run")


def with_vwap_dist(bars: DataFrame, keys: tuple[str, ...], name: str = "vwap_dist", time: str = "close_time") -> DataFrame:
    """Percent from the running volume-weighted price of the day to the typical price."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    w = Window.partitionBy(*keys, F.to_date(time)).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    volume, value = F.sum("volume").over(w), F.sum(typical * F.col("volume")).over(w)
    return bars.withColumn(name, F.when(volume > 0, (typical - value / volume) / (value / volume) * 100))


def _smoothed(df: DataFrame, keys: tuple[str, ...], series: dict[str, str], seed_from: int, n: int, k: float, gain: float) -> DataFrame:
    """For each column and name: y = (1 - k) y + gain x after a seed, the mean of the n values from row seed_from on,
    or with gain 1 their sum. df has the row number i."""
    first, last = seed_from, seed_from + n - 1
    size = F.sum if gain == 1 and n > 1 else F.avg
    rows = df.filter((F.col("i") >= first) & (F.col("i") <= last))
    seeds = rows.groupBy(*keys).agg(*(F.when(F.count(x) == n, size(x)).alias(f"_seed_{y}") for x, y in series.items()))
    met = df.join(seeds, list(keys), "left")
    i = F.col("i")
    steps = [(F.when(i == last, F.col(f"_seed_{y}")).when(i > last, gain * F.col(x)).otherwise(F.lit(float("nan"))), y) for x, y in series.items()]
    return folded(met, keys, "i", F.when(i <= last, 0.0).otherwise(1 - k), steps).drop(*(f"_seed_{y}" for y in series.values()))


def with_ema(df: DataFrame, value: str, n: int, keys: tuple[str, ...], time: str, name: str = "ema") -> DataFrame:
    """Seeded with the mean of the first n values."""
    k = 2.0 / (n + 1)
    return _smoothed(indexed(df, keys, time), keys, {value: name}, 0, n, k, k).drop("i")


def with_atr(bars: DataFrame, n: int, keys: tuple[str, ...], time: str = "close_time", name: str = "atr") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(time)
    return _smoothed(indexed(bars.withColumn("_tr", true_range(order)), keys, time), keys, {"_tr": name}, 0, n, 1 / n, 1 / n).drop("i", "_tr")


def with_rsi(df: DataFrame, value: str, n: int, keys: tuple[str, ...], time: str, name: str = "rsi") -> DataFrame:
    """100 where no loss is in the average."""
    change = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    d = indexed(df.withColumn("_d", change).withColumn("_up", F.greatest("_d", F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_d"), F.lit(0.0))), keys, time)
    d = _smoothed(d, keys, {"_up": "_g", "_down": "_l"}, 1, n, 1 / n, 1 / n)
    rsi = F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    return d.withColumn(name, F.when(F.col("_l").isNotNull(), rsi)).drop("i", "_d", "_up", "_down", "_g", "_l")


def with_adx(bars: DataFrame, n: int, keys: tuple[str, ...], time: str = "close_time", name: str = "adx") -> DataFrame:
    """Null in a series of fewer than 2n + 1 bars."""
    order = Window.partitionBy(*keys).orderBy(time)
    up, down = F.col("high") - F.lag("high").over(order), F.lag("low").over(order) - F.col("low")
    d = bars.withColumn("_tr", true_range(order)).withColumn("_u", F.coalesce(up, F.lit(0.0))).withColumn("_d", F.coalesce(down, F.lit(0.0)))
    d = d.withColumn("_p", F.when((F.col("_u") > F.col("_d")) & (F.col("_u") > 0), F.col("_u")).otherwise(0.0)).withColumn("_m", F.when((F.col("_d") > F.col("_u")) & (F.col("_d") > 0), F.col("_d")).otherwise(0.0))
    d = _smoothed(indexed(d, keys, time), keys, {"_tr": "_trs", "_p": "_ps", "_m": "_ms"}, 1, n, 1 / n, 1)
    plus, minus = 100 * F.col("_ps") / F.col("_trs"), 100 * F.col("_ms") / F.col("_trs")
    dx = F.when(F.col("_trs") == 0, 0.0).when(F.col("_ps") + F.col("_ms") == 0, 0.0).otherwise(100 * F.abs(plus - minus) / (plus + minus))
    d = _smoothed(d.withColumn("_dx", F.when(F.col("_trs").isNotNull(), dx)), keys, {"_dx": "_y"}, n, n, 1 / n, 1 / n)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return d.withColumn(name, F.when(size >= 2 * n + 1, F.col("_y"))).drop("i", "_tr", "_u", "_d", "_p", "_m", "_trs", "_ps", "_ms", "_dx", "_y")


def export_atr(bars: DataFrame, n: int, keys: tuple[str, ...], time: str = "close_time", name: str = "atr") -> DataFrame:
    """The export file's variant: seeded with the ranges of bars 1 to n, at bar n."""
    order = Window.partitionBy(*keys).orderBy(time)
    return _smoothed(indexed(bars.withColumn("_tr", true_range(order)), keys, time), keys, {"_tr": name}, 1, n, 1 / n, 1 / n).drop("i", "_tr")


def export_volatility(close: Column, returns: Column, n: int, order: WindowSpec) -> Column:
    """The export file's variant, of simple returns, not annualised; first defined at bar n."""
    return F.when(F.count(returns).over(trailing(order, n)) == n, F.stddev_pop(returns).over(trailing(order, n)))
