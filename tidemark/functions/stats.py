"""Statistics of return series: moments in Spark, the normal distribution on one-row results."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, sample standard deviation, adjusted skewness and non-excess kurtosis of each group.

    Powers are centred by the group's mean, found in a first pass, so that they don't cancel."""
    v = F.col(value).cast("double")
    first = df.groupBy(*keys).agg(F.avg(v).alias("_m"))
    joined = df.join(first, list(keys)) if keys else df.withColumn("_m", F.lit(first.first()["_m"]).cast("double"))
    d = v - F.col("_m")
    sums = joined.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.sum(d * d * d).alias("_3"), F.sum(d * d * d * d).alias("_4"))
    n, s = F.col("n").cast("double"), F.col("std")
    skew = F.when((n >= 3) & (s > 0), n / ((n - 1) * (n - 2)) * F.col("_3") / F.pow(s, 3)).otherwise(F.lit(0.0))
    kurtosis = F.when((n >= 4) & (s > 0), F.col("_4") / F.pow(s, 4) / n).otherwise(F.lit(3.0))
    return sums.select(*keys, "n", "mean", "std", skew.alias("skew"), kurtosis.alias("kurtosis"), F.when((n >= 2) & (s > 0), F.col("mean") / s).otherwise(F.lit(0.0)).alias("sharpe"))


def probabilistic_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, benchmark: float = 0.0) -> float:
    """The probability that the true Sharpe ratio is above the benchmark; 0 for fewer than three returns."""
    if n < 3:
        return 0.0
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    return NormalDist().cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(max(spread, 1e-12)))


def expected_max_sharpe(n_trials: int, trial_std: float) -> float:
    """What the best of so many worthless trials is expected to reach."""
    if n_trials <= 1 or trial_std <= 0:
        return 0.0
    euler, z = 0.5772156649015329, NormalDist().inv_cdf
    return trial_std * ((1 - euler) * z(1 - 1 / n_trials) + euler * z(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurtosis: float, n_trials: int, trial_std: float | None = None) -> float:
    spread = abs(sharpe) / 2 if trial_std is None else trial_std
    return probabilistic_sharpe(sharpe, n, skew, kurtosis, expected_max_sharpe(n_trials, spread))


def normal_cdf(x: Column) -> Column:
    """The normal distribution's cumulative probability, by the series around 0; 0 or 1 beyond eight deviations."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), x.cast("double")))
    start = F.struct(z.alias("term"), z.alias("sum"))
    step = lambda a, k: F.struct((a["term"] * z * z / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * z * z / (2 * k + 1)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, step, lambda a: a["sum"])
    near = 0.5 + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * total
    return F.when(x >= 8, 1.0).when(x <= -8, 0.0).otherwise(near)


def with_deflated_sharpe(of: DataFrame, n_trials: int) -> DataFrame:
    """`deflated_sharpe` of each row of moments, the spread of trials taken as half its ratio."""
    c, one = F.col, expected_max_sharpe(n_trials, 1.0)
    spread = 1 - c("skew") * c("sharpe") + (c("kurtosis") - 1) / 4 * c("sharpe") * c("sharpe")
    z = (c("sharpe") - one * F.abs("sharpe") / 2) * F.sqrt(c("n") - 1) / F.sqrt(F.greatest(spread, F.lit(1e-12)))
    return of.withColumn("deflated_sharpe", F.when(c("n") < 3, 0.0).otherwise(normal_cdf(z)))


def nearest_rank(values: Column, percent: float) -> Column:
    """The percentile of an array by rounded index, halves to even."""
    ordered = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    at = F.bround(F.lit(percent / 100) * (F.size(ordered) - 1), 0).cast("int")
    return F.when(F.size(ordered) > 0, F.get(ordered, at))


def truncated_rank(values: Column, percent: int) -> Column:
    """The percentile of an array by truncated index."""
    ordered = F.sort_array(values)
    return F.get(ordered, F.least(F.floor(F.size(ordered) * percent / 100).cast("int"), F.size(ordered) - 1))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)
