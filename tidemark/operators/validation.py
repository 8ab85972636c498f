"""Judging a strategy by its trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import deflated_sharpe, moments
from .running import running, time_block, with_totals

#: What a strategy must reach.
FOLDS, LEAST_TRADES, MOST_DRAWDOWN, POSITIVE_REGIMES, CONFIDENCE = 4, 200, 25.0, 2, 0.95


def walk_forward(trades: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, folds: int = FOLDS) -> DataFrame:
    """Sequential folds of equal size, the rest in the last; how many sum above zero, and whether most do."""
    numbered = with_totals(running(trades, keys, time_block(F.col(order[0])), order, sums={"_i": F.lit(1)}), keys, _n=F.count("*"))
    rn, n = F.col("_i") - 1, F.col("_n")
    cut = numbered.withColumn("_fold", F.least(F.floor(rn / F.greatest(F.floor(n / folds), F.lit(1))), F.lit(folds - 1)))
    sums = cut.groupBy(*keys, "_fold").agg(F.sum(value).alias("_s"), F.max("_n").alias("_n"))
    out = sums.groupBy(*keys).agg(F.count_if((F.col("_s") > 0) & (F.col("_n") >= folds)).alias("positive_folds"))
    return out.withColumn("folds", F.lit(folds)).withColumn("consistent", F.col("positive_folds") >= folds // 2 + 1)


def drawdown(curve: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], equity: str) -> DataFrame:
    """The deepest fall from a running peak, in percent of the peak. The first column of the order is a time."""
    peak = F.col("_peak")
    fall = F.when(peak > 0, (peak - F.col(equity)) / peak * 100).otherwise(0.0)
    return running(curve, keys, time_block(F.col(order[0])), order, most={"_peak": F.col(equity)}).withColumn("_d", fall).groupBy(*keys).agg(F.max("_d").alias("max_drawdown_pct"))


def by_regime(trades: DataFrame, labels: DataFrame, trade_time: str, label_time: str, value: str) -> DataFrame:
    """The summed result of each regime, by the label at entry; trades without one count as range."""
    j = trades.join(labels.select(F.col(label_time).alias(trade_time), "regime"), trade_time, "left")
    return j.groupBy(F.coalesce("regime", F.lit("range")).alias("regime")).agg(F.sum(value).alias("expectancy"), F.count("*").alias("trades"))


def kept_for_training(rows: DataFrame, index: str, start: int, end: int, purge: int, embargo: int) -> DataFrame:
    """The rows that may be trained on when [start, end) is tested: none within the purge on either side or the
    embargo after."""
    i = F.col(index)
    return rows.filter(~((i >= start - purge) & (i < start)) & ~((i >= start) & (i < end)) & ~((i >= end) & (i < end + purge + embargo)))


def verdict(trades: DataFrame, regimes: DataFrame, equity: float, n_trials: int) -> dict:
    """Whether a strategy passes, and every reason why not; from aggregates of one row each."""
    m = moments(trades.withColumn("_r", F.col("net_pnl") / equity), "_r").first()
    n = m["n"] if m else 0
    net = trades.agg(F.sum("net_pnl")).first()[0] or 0.0
    dsr = deflated_sharpe(m["sharpe"], n, m["skew"], m["kurtosis"], n_trials) if n >= 3 else 0.0
    deep = drawdown(trades, (), ("exit_time",), "equity").first()
    folds = walk_forward(trades, (), ("exit_time",), "net_pnl").first()
    positive = regimes.filter("expectancy > 0").count()
    checks = {"insufficient_trades": n < LEAST_TRADES, "nonpositive_net_expectancy": net <= 0, "deflated_sharpe_below_threshold": dsr < CONFIDENCE, "drawdown_exceeds_ceiling": (deep[0] or 0.0) > MOST_DRAWDOWN, "unstable_across_regimes": positive < POSITIVE_REGIMES, "walkforward_inconsistent": not (folds and folds["consistent"])}
    reasons = [k for k, failed in checks.items() if failed]
    return {"passed": not reasons, "reasons": reasons, "trades": n, "net_pnl": net, "deflated_sharpe": dsr}
