"""Replay of signals through a cost model.

How a signal's trade would end depends on bars, stop distance and policy, never on equity. So every signal is
simulated on its own, over an array of the few bars that it may stay open; only which trades are taken and their
size depend on what came before, and that is one pass over a strategy's signals, not over its bars."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """The taker's fee and slippage."""

    fee: float = 0.00055
    slippage_bps: float = 1.0

    @property
    def slip(self) -> float:
        return self.slippage_bps / 10_000


@dataclass(frozen=True)
class Policy:
    """When a position ends. time_exit: bars after entry; target_r: reward over risk, None for no target."""

    direction: str = "LONG"
    target_r: float | None = 1.0
    time_exit: int = 5
    latency: int = 1
    trailing: bool = False
    confirm: int = 1

    @property
    def sign(self) -> int:
        return 1 if self.direction == "LONG" else -1


@dataclass(frozen=True)
class Sizing:
    """Shares of equity at risk, and what an order must satisfy."""

    equity: float = 10_000.0
    risk: float = 0.0025
    step: float = 0.001
    least_qty: float = 0.001
    least_notional: float = 5.0
    leverage: float = 3.0


def candidates(bars: DataFrame, keys: tuple[str, ...], policy: Policy, costs: Costs, time: str = "close_time") -> DataFrame:
    """Bars with a `signal` and a positive `stop_distance`, each with its exit.

    bars: open, high, low, close, and where used `trail` (distance) and `regime_ok`. A signal fills at the open of a
    later bar; stop comes before target, target before regime, and the last bar ends a position whatever else it does.
    """
    order = Window.partitionBy(*keys).orderBy(time)
    has = set(bars.columns)
    ok = F.col("regime_ok") if "regime_ok" in has else F.lit(True)
    if policy.confirm > 1:
        w = order.rowsBetween(-(policy.confirm - 1), 0)
        ok = (F.count(F.lit(1)).over(w) < policy.confirm) | F.max(ok).over(w)
    trail = F.col("trail") if policy.trailing and "trail" in has else F.lit(None).cast("double")
    s = policy.sign
    b = bars.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    b = b.withColumn("_bar", F.struct(F.col(time).alias("t"), "open", "high", "low", "close", trail.alias("trail"), ok.alias("ok")))
    ahead = F.collect_list("_bar").over(order.rowsBetween(policy.latency, policy.latency + policy.time_exit))
    b = b.withColumn("_ahead", ahead).filter(F.col("signal") & (F.col("stop_distance") > 0) & (F.col("i") < F.col("n") - policy.latency - 1))
    b = b.withColumn("stop_price", F.col("close") - s * F.col("stop_distance")).filter("stop_price > 0")
    b = b.withColumn("entry_time", F.col("_ahead")[0]["t"]).withColumn("entry_price", F.col("_ahead")[0]["open"] * (1 + s * costs.slip))
    reward = F.abs(F.col("entry_price") - F.col("stop_price")) * (policy.target_r or 0.0)
    target = F.col("entry_price") + s * reward if policy.target_r is not None else F.lit(None).cast("double")
    start = F.struct(F.lit(0).alias("j"), F.col("stop_price").alias("stop"), F.col("entry_price").alias("best"), F.lit(False).alias("trailed"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("mid"), F.lit(0).alias("at"), target.alias("target"), F.size("_ahead").alias("last"))

    def step(a, x):
        lost = x["low"] <= a["stop"] if s > 0 else x["high"] >= a["stop"]
        won = F.coalesce(x["high"] >= a["target"] if s > 0 else x["low"] <= a["target"], F.lit(False))
        reason = F.when(a["j"] == a["last"] - 1, "time").when(lost, F.when(a["trailed"], "trail").otherwise("stop")).when(won, "target").when(~x["ok"], "regime")
        mid = F.when((reason == "time") | (reason == "regime"), x["close"]).when(reason == "target", a["target"]).otherwise(a["stop"])
        best = F.greatest(a["best"], x["high"]) if s > 0 else F.least(a["best"], x["low"])
        moved = best - s * x["trail"]
        tighter = F.coalesce(moved > a["stop"] if s > 0 else moved < a["stop"], F.lit(False))
        going = F.struct((a["j"] + 1).alias("j"), F.when(tighter, moved).otherwise(a["stop"]).alias("stop"), best.alias("best"), (a["trailed"] | tighter).alias("trailed"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("mid"), F.lit(0).alias("at"), a["target"].alias("target"), a["last"].alias("last"))
        over = F.struct((a["j"] + 1).alias("j"), a["stop"].alias("stop"), a["best"].alias("best"), a["trailed"].alias("trailed"), reason.alias("reason"), mid.alias("mid"), a["j"].alias("at"), a["target"].alias("target"), a["last"].alias("last"))
        return F.when(a["reason"].isNotNull(), a).when(reason.isNotNull(), over).otherwise(going)

    b = b.withColumn("_end", F.aggregate("_ahead", start, step))
    return b.select(*keys, F.col(time).alias("signal_time"), "i", (F.col("i") + policy.latency + F.col("_end.at")).alias("exit_i"), "close", "stop_price", "entry_time", F.get("_ahead", F.col("_end.at"))["t"].alias("exit_time"), "entry_price", (F.col("_end.mid") * (1 - s * costs.slip)).alias("exit_price"), F.col("_end.reason").alias("reason"))


def sized(equity: float, price: float, stop: float, z: Sizing) -> float:
    """The quantity that risks the allowed share of equity, or 0 where an order of it isn't allowed."""
    gap = abs(price - stop)
    if equity <= 0 or gap <= 0 or price <= 0:
        return 0.0
    qty = math.floor(equity * z.risk / gap / z.step + 1e-9) * z.step
    if qty < z.least_qty or qty * price < z.least_notional or qty * price > equity * z.leverage:
        return 0.0
    return qty


TRADE = "signal_time timestamp_ntz, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, qty double, reason string, gross_pnl double, fees double, funding double, net_pnl double, equity double"


def trades(signals: DataFrame, keys: tuple[str, ...], policy: Policy, costs: Costs, sizing: Sizing = Sizing(), warmup: int = 60) -> DataFrame:
    """The trades that are taken, one at a time, each sized by the equity that the earlier ones left.

    signals: as from `candidates`, with `funding_rate`, the rates settled in the position, where they count. A group
    holds a strategy's signals, not its bars."""
    kinds = ", ".join(f"`{k}` {signals.schema[k].dataType.simpleString()}" for k in keys)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        equity, free, rows = sizing.equity, warmup, []
        rates = f["funding_rate"].fillna(0.0) if "funding_rate" in f else pd.Series(0.0, f.index)
        for r, rate in sorted(zip(f.itertuples(index=False), rates, strict=True), key=lambda x: x[0].i):
            if r.i < free:
                continue
            qty = sized(equity, r.close, r.stop_price, sizing)
            if not qty:
                continue
            gross = policy.sign * (r.exit_price - r.entry_price) * qty
            fees = (abs(qty * r.entry_price) + abs(qty * r.exit_price)) * costs.fee
            funding = policy.sign * rate * qty * r.entry_price
            equity += gross - fees - funding
            free = r.exit_i + 1
            rows.append((*(getattr(r, k) for k in keys), r.signal_time, r.entry_time, r.exit_time, r.entry_price, r.exit_price, qty, r.reason, gross, fees, funding, gross - fees - funding, equity))
        return pd.DataFrame(rows, columns=[*keys, *(c.split()[0] for c in TRADE.split(", "))])

    wanted = [*keys, "signal_time", "i", "exit_i", "close", "stop_price", "entry_time", "exit_time", "entry_price", "exit_price", "reason", *(["funding_rate"] if "funding_rate" in signals.columns else [])]
    return signals.select(*wanted).groupBy(*keys).applyInPandas(fold, f"{kinds}, {TRADE}")


def equity_curve(taken: DataFrame, start: float, keys: tuple[str, ...]) -> DataFrame:
    """Equity after each trade with its running peak and the fall from it in percent."""
    order = Window.partitionBy(*keys).orderBy("exit_time").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(start), F.max("equity").over(order))
    return taken.select(*keys, "exit_time", "equity", peak.alias("peak"), ((peak - F.col("equity")) / peak * 100).alias("drawdown_pct"))


def downsampled(curve: DataFrame, keys: tuple[str, ...], time: str, most: int = 5000) -> DataFrame:
    """Every so many points that at most about `most` stay, and the last one."""
    order = Window.partitionBy(*keys).orderBy(time)
    c = curve.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return c.filter((F.col("_i") % F.ceil(F.col("_n") / most) == 0) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")
