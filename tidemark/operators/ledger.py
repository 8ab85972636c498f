"""Predicted against realised execution of order legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.timegrid import micros
from .running import with_totals

LEG = ("trade_id", "leg")


def buying(direction: Column, leg: Column) -> Column:
    return ((direction == "LONG") & (leg == "entry")) | ((direction == "SHORT") & (leg == "exit"))


def adverse_bps(reference: Column, fill: Column, direction: Column, leg: Column) -> Column:
    """How far a fill is from its reference price, positive where against us."""
    raw = (fill - reference) / reference * 10_000
    return F.when(reference <= 0, 0.0).otherwise(F.when(buying(direction, leg), raw).otherwise(-raw))


def with_status(predictions: DataFrame, realizations: DataFrame) -> DataFrame:
    """Every prediction with its realisation; a leg without one is pending."""
    return predictions.join(realizations, list(LEG), "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def drift(predictions: DataFrame, realizations: DataFrame) -> DataFrame:
    """Both sides of the legs that have both; every drift is positive where worse than predicted."""
    j = predictions.join(realizations, list(LEG))
    c = F.col
    worse = F.when(buying(c("direction"), c("leg")), c("realized_fill") - c("predicted_fill")).otherwise(c("predicted_fill") - c("realized_fill"))
    slip = adverse_bps(c("reference_price"), c("realized_fill"), c("direction"), c("leg"))
    fee, funding = c("realized_fee") - c("predicted_fee"), c("realized_funding") - c("predicted_funding")
    return j.select(
        *LEG,
        "strategy_id",
        slip.alias("slippage_bps_realized"),
        (slip - c("predicted_slippage_bps")).alias("slippage_bps_drift"),
        fee.alias("fee_drift"),
        funding.alias("funding_drift"),
        ((micros(c("fill_time")) - micros(c("decision_time"))) / 1000 - c("predicted_latency_ms")).alias("latency_ms_drift"),
        F.greatest(F.lit(0.0), c("qty") - c("realized_qty")).alias("qty_shortfall"),
        (worse * c("realized_qty") + fee + funding).alias("cost_drift_usd"),
        (c("realized_qty") < c("qty")).alias("partial"),
    )


def calibration(drifts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median, mean and worst drifts of the realised legs."""
    d = F.col("slippage_bps_drift")
    return drifts.groupBy(*keys).agg(F.count("*").alias("realized_legs"), F.median(d).alias("drift_median"), F.avg(d).alias("drift_mean"), F.max(d).alias("drift_worst"), F.count_if("partial").alias("partials"), F.sum("cost_drift_usd").alias("cost_drift_usd_total"), F.avg("cost_drift_usd").alias("cost_drift_usd_per_leg")).withColumn("status", F.when(F.col("realized_legs") == 0, "no_realized_fills").when(F.col("cost_drift_usd_total") > 0, "underpredicting").otherwise("conservative"))


def cost_ratio(legs: DataFrame, keys: tuple[str, ...], last: int = 10) -> DataFrame:
    """Realised over predicted cost of each strategy's last legs; null for fewer legs or no predicted cost.
    legs: decision_time, predicted_fee, cost_drift_usd and a tie-breaker trade_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("decision_time"), F.desc("trade_id"))
    some = legs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    sums = some.groupBy(*keys).agg(F.count("*").alias("legs"), F.sum(F.abs(F.coalesce("predicted_fee", F.lit(0.0)))).alias("predicted"), F.sum("cost_drift_usd").alias("_drift"))
    r = F.when((F.col("legs") >= last) & (F.col("predicted") > 0), (F.col("predicted") + F.col("_drift")) / F.col("predicted"))
    return sums.select(*keys, "legs", "predicted", (F.col("predicted") + F.col("_drift")).alias("realized"), r.alias("ratio"))


def losing_runs(pnl: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """How many of the last trades in a row lost, with count and mean."""
    lost = F.coalesce(F.col(value) < 0, F.lit(False))
    # those after the last trade that didn't lose
    known = with_totals(pnl, keys, _last=F.max(F.when(~lost, F.struct(*order))))
    after = F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))
    return known.groupBy(*keys).agg(F.count_if(after).alias("losing_run"), F.count("*").alias("trades"), F.avg(value).alias("expectancy"))


def decay(runs: DataFrame, win_rate: Column, drift_ratio: Column, least: int = 50, alpha: float = 0.01, multiple: float = 1.5) -> DataFrame:
    """The first cause that applies: too few trades, cost drift, an unlikely losing run, negative expectancy."""
    loss = F.greatest(F.lit(1e-9), F.least(1 - win_rate, F.lit(1 - 1e-9)))
    p = F.pow(loss, F.col("losing_run"))
    cause = F.when(F.col("trades") < least, "insufficient_trades").when(drift_ratio >= multiple, "cost_drift").when(p < alpha, "alpha_decay").when((F.col("expectancy") < 0) & (F.col("trades") >= 2 * least), "negative_expectancy").otherwise("healthy")
    return runs.withColumn("p_value", p).withColumn("cause", cause).withColumn("decayed", ~F.col("cause").isin("insufficient_trades", "healthy"))


def precision_recall(cases: DataFrame, said: Column, was: Column) -> DataFrame:
    """How often a verdict was right, and how much of what was bad it caught."""
    hit, flagged, bad = F.count_if(said & was), F.count_if(said), F.count_if(was)
    return cases.agg(F.count("*").alias("n"), flagged.alias("flagged"), hit.alias("caught"), ratio(hit.cast("double"), flagged).alias("precision"), ratio(hit.cast("double"), bad).alias("recall"))


def consistency(cases: DataFrame, key: str, verdict: str) -> DataFrame:
    """Of keys that occur several times, the share that always got one verdict."""
    k = cases.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(verdict).alias("v")).filter("n > 1")
    return k.agg(F.count("*").alias("repeated"), ratio(F.count_if(F.col("v") == 1).cast("double"), F.count("*")).alias("consistency"))
