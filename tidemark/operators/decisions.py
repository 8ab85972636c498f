"""From signals to at most one order: choosing, scrutiny by similar past states, risk rules and kill switches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import micros
from ..sources.shared import written
from .running import running, time_block

#: Shares of equity in percent, leverage, the stop's buffer and the edge's margin over cost.
RISK_PCT, OPEN_RISK_PCT, DAY_LOSS_PCT, DRAWDOWN_PCT, LEVERAGE, STOP_BUFFER_PCT, EDGE_MARGIN = 0.25, 1.0, 3.0, 15.0, 3.0, 20.0, 1.5
#: Funding that vetoes, analogs needed, the share that may go against, the spread's percentile.
FUNDING_VETO, ANALOGS, ADVERSE_SHARE, SPREAD_PERCENTILE = 0.0005, 20, 0.75, 90


def chosen(signals: DataFrame, keys: tuple[str, ...], tie: str) -> DataFrame:
    """For each decision the signal of most score, the first in order of ties, or why there is none: no signal
    with a score above zero, or signals of both directions. signals: strategy_id, direction, weight, confidence,
    sharpe, regime_scope (array, empty for all) and regime (null if unknown)."""
    c = F.col
    fit = F.when(F.size("regime_scope") == 0, 1.0).when(c("regime").isNull(), None).when(F.array_contains("regime_scope", c("regime")), 1.0).otherwise(0.0)
    score = c("weight") * c("confidence") * F.greatest(c("sharpe"), F.lit(0.0)) * fit
    scored = signals.withColumn("score", score).withColumn("dropped", F.when(fit.isNull(), "regime_unknown").when(fit == 0, "out_of_regime_scope").when(score <= 0, "nonpositive_score"))
    live = c("dropped").isNull()
    best = F.max_by(F.when(live, c("strategy_id")), F.when(live, F.struct(c("score"), -c(tie))))
    out = scored.groupBy(*keys).agg(F.count_if(live).alias("live"), F.count_distinct(F.when(live, c("direction"))).alias("directions"), best.alias("best"), F.max(F.when(live, c("score"))).alias("score"))
    reason = F.when(c("live") == 0, "all_stale").when(c("directions") > 1, "conflict").otherwise("ok")
    return out.select(*keys, reason.alias("reason"), F.when(reason == "ok", c("best")).alias("strategy_id"), F.when(reason == "ok", c("score")).alias("score"))


def cooled(entries: DataFrame, keys: tuple[str, ...], time: str, tie: str, seconds: float) -> DataFrame:
    """Entries with `cooldown`, true for those within so many seconds of the last that was let through.

    Which go through depends on those before, so a key's entries are read in order, once; a task holds a batch and
    the last entry of the key that it is at."""
    names = entries.columns

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, None
        for f in frames:
            waits = []
            for *k, t in f[[*keys, time]].itertuples(index=False, name=None):
                if k != at:
                    at, last = k, None
                waits.append(last is not None and (t - last).total_seconds() < seconds)
                last = last if waits[-1] else t
            yield f[names].assign(cooldown=waits)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.repartition(*keys).sortWithinPartitions(*keys, time, tie).mapInPandas(walk, f"{kinds}, cooldown boolean")


def vol_bucket(v: Column) -> Column:
    return F.when(v.isNull(), "unknown").when(v < 0.0005, "vol_low").when(v < 0.0015, "vol_mid").otherwise("vol_high")


def spread_bucket(s: Column) -> Column:
    return F.when(s.isNull(), "unknown").when(s < 0.005, "spr_tight").when(s < 0.02, "spr_mid").otherwise("spr_wide")


def funding_bucket(f: Column) -> Column:
    return F.when(f.isNull(), "unknown").when(F.abs(f) < 0.0001, "fund_flat").when(f > 0, "fund_pos").otherwise("fund_neg")


def state_key(regime: Column, vol: Column, spread: Column, funding: Column, direction: Column) -> Column:
    parts = F.concat_ws("|", F.coalesce(regime, F.lit("unknown")), vol_bucket(vol), spread_bucket(spread), funding_bucket(funding), direction)
    return F.substring(F.sha2(parts, 256), 1, 12)


#: Rows of the smallest and how many times larger the next blocks of `smaller_before` are, and how many sizes there are:
#: the largest has RADIX ** (SIZES - 1) rows.
RADIX, SIZES = 4, 7
#: Seconds of a block of time within which rows are counted in order.
BLOCK_S = 30 * 86400


def _running(marks: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """marks with the sum of each column over all rows of the key up to each, in the order of `_us` and `_ord`: the sum
    within the row's block of time, and those of the blocks before."""
    block = F.floor(F.col("_us") / (BLOCK_S * 1_000_000))
    m = marks.withColumn("_block", block)
    within = Window.partitionBy("key", "_block").orderBy("_us", "_ord").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = m.groupBy("key", "_block").agg(*(F.sum(c).alias(f"_b{c}") for c in sums))
    whole = whole.select("key", "_block", *(F.coalesce(F.sum(f"_b{c}").over(before), F.lit(0)).alias(f"_p{c}") for c in sums))
    m = m.select("*", *(F.sum(c).over(within).alias(f"_w{c}") for c in sums)).join(whole, ["key", "_block"])
    return m.select(*marks.columns, *((F.col(f"_w{c}") + F.col(f"_p{c}")).alias(f"{c}_so_far") for c in sums))


def smaller_before(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each range the number of rows of its key at positions from `lo` up to, without, `hi` whose `_s` is smaller than
    `x`: id, below. rows: key, `_at` (the position, from 0), `_s`; ranges: id (not null), key, lo, hi, x.

    Positions are cut into blocks of `RADIX` sizes, and a range into a few blocks of each size. In each block rows and
    ranges are sorted by value once and counted on the way: rows meet no range, and a block has a bounded number of rows."""
    size = lambda k: RADIX**k
    spread = rows.select("key", "_s", F.explode(F.array(*(_named_block(F.floor(F.col("_at") / size(k)), k) for k in range(SIZES)))).alias("_n"))
    up = lambda x, k: F.ceil(x / size(k))
    down = lambda x, k: F.floor(x / size(k))
    parts = []
    for k in range(SIZES):
        first, last = up(F.col("lo"), k), down(F.col("hi"), k)
        if k == SIZES - 1:
            runs = [(first, last)]
        else:
            # what larger blocks cover of it is left to them
            inner_first, inner_last = up(F.col("lo"), k + 1) * RADIX, down(F.col("hi"), k + 1) * RADIX
            none = inner_first >= inner_last
            runs = [(first, F.when(none, last).otherwise(inner_first)), (F.when(none, last).otherwise(inner_last), last)]
        for a, b in runs:
            blocks = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
            parts.append(_numbered_blocks(blocks, k))
    asked = ranges.select("id", "key", F.col("x").alias("_s"), F.explode(F.concat(*parts)).alias("_n"))
    both = spread.select("key", "_s", "_n", F.lit(None).cast(ranges.schema["id"].dataType).alias("id")).unionByName(asked.select("key", "_s", "_n", "id"))
    # of equal values a range, which alone has an id, comes first: it counts smaller ones
    row = F.col("id").isNull()
    order = Window.partitionBy("key", "_n").orderBy("_s", row).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_c", F.count_if(row).over(order)).filter(~row)
    return counted.groupBy("id").agg(F.sum("_c").alias("below"))


def _numbered_blocks(blocks: Column, k: int) -> Column:
    return F.transform(blocks, lambda v: _named_block(v, k))


def _named_block(number: Column, k: int) -> Column:
    """A block of the k-th size as one number, since each row goes to several."""
    return (number * SIZES + k).cast("long")


def scrutinised(cases: DataFrame, history: DataFrame, embargo_days: int = 1, back_days: int = 730, adverse_pct: float = 1.0) -> DataFrame:
    """Each case with its verdict, from past rows of equal state within the time span. cases: case_id, time, key,
    direction, funding_rate, spread_pct; history: time, key, adverse_pct, spread_pct.

    Counts within a span are differences of running counts at its ends. The spread's rank among its analogs, which is
    how many of them are below or equal, comes from `smaller_before`, for cases that nothing before it decides. No case meets a row."""
    c = F.col
    day = 86_400_000_000
    us = micros(c("time"))
    h = history.filter(c("key").isNotNull() & c("time").isNotNull())
    rows = h.select("key", us.alias("_us"), F.lit(0).alias("_ord"), F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), F.lit(1).alias("_n"), F.coalesce((c("adverse_pct") >= adverse_pct).cast("int"), F.lit(0)).alias("_a"), c("spread_pct").isNotNull().cast("int").alias("_k"), c("spread_pct").alias("_s"))
    # before the rows of its instant where the span begins, after them where it ends
    ends = F.explode(F.array(F.struct((us - back_days * day).alias("_us"), F.lit(-1).alias("_ord")), F.struct((us - embargo_days * day).alias("_us"), F.lit(1).alias("_ord")))).alias("_e")
    marks = cases.filter(c("key").isNotNull() & c("time").isNotNull()).select("key", "case_id", ends).select("key", "_e._us", "_e._ord", "case_id", *(F.lit(0).alias(n) for n in ("_n", "_a", "_k")), F.lit(None).cast(h.schema["spread_pct"].dataType).alias("_s"))
    ran = written(_running(rows.unionByName(marks), ("_n", "_a", "_k")), "analog-counts")
    at = lambda n, o: F.max(F.when(c("_ord") == o, c(f"{n}_so_far")))
    spans = ran.filter("_ord <> 0").groupBy("case_id", "key").agg((at("_n", 1) - at("_n", -1)).alias("analogs"), (at("_a", 1) - at("_a", -1)).alias("adverse"), at("_k", -1).alias("lo"), at("_k", 1).alias("hi"))
    paying = ((c("funding_rate") > 0) & (c("direction") == "LONG")) | ((c("funding_rate") < 0) & (c("direction") == "SHORT"))
    decided = ((F.abs("funding_rate") >= FUNDING_VETO) & paying, c("analogs") < ANALOGS, c("adverse") >= ADVERSE_SHARE * c("analogs"))
    of_cases = cases.select("case_id", c("spread_pct").alias("x"), F.coalesce(decided[0], F.lit(False)).alias("_vetoed"))
    spans = written(spans.join(of_cases, "case_id"), "analog-spans")
    known = ran.filter("_ord = 0 and _k = 1").select("key", (c("_k_so_far") - 1).alias("_at"), "_s")
    below = smaller_before(known, spans.filter("hi > lo and x is not null and not _vetoed").filter(~decided[1] & ~decided[2]).select(c("case_id").alias("id"), "key", "lo", "hi", "x"))
    met = spans.select("case_id", "analogs", "adverse", (c("hi") - c("lo")).alias("_n")).join(below.select(c("id").alias("case_id"), c("below").alias("_below")), "case_id", "left").withColumn("_below", F.coalesce("_below", F.lit(0)))
    j = cases.join(met, "case_id", "left").withColumn("analogs", F.coalesce("analogs", F.lit(0))).withColumn("adverse", F.coalesce("adverse", F.lit(0)))
    # above the value at the truncated index means that all values up to it are below
    rank = F.least(F.floor(c("_n") * SPREAD_PERCENTILE / 100), c("_n") - 1)
    reason = F.when(decided[0], "funding_against_position").when(decided[1], "insufficient_analogs").when(decided[2], "analogs_adverse").when((c("_n") > 0) & (c("_below") > rank), "spread_above_percentile").otherwise("analogs_ok")
    return j.select("case_id", F.when(reason == "analogs_ok", "APPROVE").otherwise("VETO").alias("verdict"), reason.alias("reason"), "analogs", "adverse")


def refusals(equity: Column, risk_usd: Column, open_risk_usd: Column, notional: Column, open_margin: Column, entry: Column, stop: Column, liquidation: Column, direction: Column, edge_pct: Column, cost_pct: Column, blocked: Column) -> Column:
    """Every rule that an order breaks, in order. The names are fixed values."""
    gap = F.when(direction == "LONG", stop - liquidation).otherwise(liquidation - stop)
    rules = [
        ("trading_blocked", blocked),
        ("per_trade_risk_exceeds_cap", risk_usd > equity * RISK_PCT / 100 * 1.001),
        ("total_open_risk_exceeds_cap", open_risk_usd + risk_usd > equity * OPEN_RISK_PCT / 100),
        ("leverage_exceeds_cap", notional / equity > LEVERAGE),
        ("insufficient_free_margin", open_margin + notional / LEVERAGE > equity),
        ("stop_beyond_liquidation_buffer", (gap <= 0) | (gap < F.abs(entry - stop) * STOP_BUFFER_PCT / 100)),
        ("edge_below_cost_margin", edge_pct < cost_pct * EDGE_MARGIN),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules)))


def liquidation_price(entry: Column, direction: Column, maintenance: float, leverage: float = LEVERAGE) -> Column:
    return F.when(direction == "LONG", entry * (1 - 1 / leverage + maintenance)).otherwise(entry * (1 + 1 / leverage - maintenance))


def kills(curve: DataFrame, keys: tuple[str, ...], time: str, equity: str) -> DataFrame:
    """The equity curve with the level that each point would set off: 3 for the drawdown, 2 for the day's loss."""
    curve = running(curve, keys, time_block(F.col(time)), (time,), most={"_peak": F.col(equity)})
    day = Window.partitionBy(*keys, F.to_date(time)).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    e, peak, opened = F.col(equity), F.col("_peak"), F.first(equity).over(day)
    fall, lost = (peak - e) / peak * 100, (e - opened) / opened * 100
    return curve.withColumn("kill_level", F.when(fall >= DRAWDOWN_PCT, 3).when(lost <= -DAY_LOSS_PCT, 2).otherwise(0)).drop("_peak")


def depth(bids: Column, asks: Column, levels: int = 20) -> tuple[Column, Column, Column]:
    """Volumes of the best levels of both sides and their imbalance; sides are arrays of (price, qty)."""
    volume = lambda side: F.aggregate(F.slice(side, 1, levels), F.lit(0.0), lambda a, x: a + x["qty"])
    b, a = volume(bids), volume(asks)
    return b, a, F.when(a + b > 0, (b - a) / (b + a)).otherwise(0.0)


def bar_outcome(enabled: Column, halted: Column, in_window: Column, signals: Column, arbiter: Column, refused: Column, verdict: Column) -> Column:
    """What became of a bar's close, by the first stage that it didn't pass, in the fixed order of the stages: status, reason
    and stage. halted: why trading is halted, or null; arbiter: `ok` or its reason; refused: `refusals`; verdict: APPROVE or
    its reason. The names are fixed values."""
    out = lambda status, reason, stage: F.struct(F.lit(status).alias("status"), reason.alias("reason"), F.lit(stage).alias("stage"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~sure(enabled), out("DISABLED", F.lit("trade_loop_disabled"), "preconditions"))
        .when(halted.isNotNull(), out("SKIPPED", F.concat(F.lit("risk_halted:"), halted), "preconditions"))
        .when(~sure(in_window), out("SKIPPED", F.lit("outside_window"), "preconditions"))
        .when(~sure(signals > 0), out("SKIPPED", F.lit("no_signals"), "signals"))
        .when(~sure(arbiter == "ok"), out("SKIPPED", F.concat(F.lit("arbiter:"), F.coalesce(arbiter, F.lit("none"))), "arbiter"))
        .when(F.size(F.coalesce(refused, F.array())) > 0, out("BLOCKED", F.get(refused, F.lit(0)), "risk_pre"))
        .when(~sure(verdict == "APPROVE"), out("BLOCKED", F.concat(F.lit("scrutiny:"), F.coalesce(verdict, F.lit("none"))), "scrutiny"))
        .otherwise(out("PASSED", F.lit("ok"), "execution"))
    )
