"""A strategy's way from candidate to retirement, its one look at the sealed holdout, and the deployment gates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states in the order of promotion; retired is terminal.
RUNGS, RETIRED = ("candidate", "paper", "micro", "full"), "retired"
#: Days of history of each feed, 0 for those that are only collected forward, None without a limit.
HISTORY_DAYS = {"ohlcv": None, "funding": None, "oi": 30, "orderbook": 0, "liquidations": 0}
#: The newest days that search may not read, and what the gates ask for.
HOLDOUT_DAYS, PROPOSALS, PASS_RATE, ROUND_TRIPS, LEAST_SHARPE, LEGS, FLATTEN_MS = 90, 200, 0.05, 200, 2.0, 100, 2000


def moved(requests: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Requests with the state that each finds, the state that it leads to and why it is refused, if it is.

    requests: action (promote, retire, reject), passed (the verdict, null without one) and reason. All start as
    candidates; a refused request changes nothing. A candidate leaves by a passing verdict and goes up a rung with each
    further promotion, so counts of what came before give the state and no request waits for another's result."""
    c = F.col
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    promote, passed = c("action") == "promote", F.coalesce("passed", F.lit(False))
    failed, named = F.coalesce(~c("passed"), F.lit(False)), F.coalesce(F.length("reason") > 0, F.lit(False))
    left = F.coalesce(F.max(promote & passed).over(before), F.lit(False))
    r = requests.withColumn("_left", left).withColumn("_up", (promote & (c("_left") | passed)).cast("int"))
    ends = ((c("action") == "retire") & named) | ((c("action") == "reject") & failed & ~c("_left"))
    r = r.withColumn("_ends", F.coalesce(ends, F.lit(False)))
    gone, steps = F.coalesce(F.max("_ends").over(before), F.lit(False)), F.coalesce(F.sum("_up").over(before), F.lit(0))
    rung = F.least(steps, F.lit(len(RUNGS) - 1)).cast("int")
    r = r.withColumn("from_state", F.when(gone, RETIRED).otherwise(F.get(F.array(*map(F.lit, RUNGS)), rung)))
    state = c("from_state")
    of_promotion = F.when(state == RETIRED, "retired_is_terminal").when(state == RUNGS[-1], "no_promotion_from:full").when((state == "candidate") & c("passed").isNull(), "promotion_requires_validation_verdict").when((state == "candidate") & ~c("passed"), "promotion_requires_passing_verdict")
    of_retirement = F.when(state == RETIRED, "already_retired").when(~named, "retirement_requires_reason")
    of_rejection = F.when(state == RETIRED, "already_retired").when(~failed, "cannot_reject_a_passing_verdict").when(state != "candidate", "only_candidates_are_rejected")
    refusal = F.when(promote, of_promotion).when(c("action") == "retire", of_retirement).when(c("action") == "reject", of_rejection).otherwise(F.concat(F.lit("unknown_action:"), F.coalesce("action", F.lit(""))))
    up = F.get(F.array(*map(F.lit, RUNGS)), F.array_position(F.array(*map(F.lit, RUNGS)), state).cast("int"))
    r = r.withColumn("refused", refusal)
    return r.withColumn("to_state", F.when(c("refused").isNotNull(), state).when(promote, up).otherwise(RETIRED)).drop("_left", "_up", "_ends")


def sealed_from(now: datetime, days: int = HOLDOUT_DAYS) -> datetime:
    return now - timedelta(days=days)


def looked(runs: DataFrame, edge, keys: tuple[str, ...] = ("strategy_id",), order: tuple[str, ...] = ("at",)) -> DataFrame:
    """Runs with why each is refused: search that reaches into the sealed days, or a second look at them.
    runs: keys, order, end and holdout (whether the run means to spend its look)."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.max("holdout").over(before), F.lit(False))
    inside = F.col("end") > F.lit(edge).cast("timestamp_ntz")
    return runs.withColumn("refused", F.when(F.col("holdout") & spent, "holdout_already_spent").when(~F.col("holdout") & inside, "reaches_into_holdout"))


def window_days(feeds: tuple[str, ...], days: int) -> int:
    """The days that may be evaluated: no more than the shortest history of any feed, short of its edge by one."""
    for feed in feeds:
        most = HISTORY_DAYS.get(feed)
        if most == 0:
            days = min(days, 7)
        elif most is not None and most < days:
            days = most - 1
    return days


def _gate(evidence: DataFrame, name: str, there: Column, ok: Column, figure: Column) -> DataFrame:
    status = F.when(~F.coalesce(there, F.lit(False)), "NO_DATA").when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    return evidence.select(F.lit(name).alias("gate"), status.alias("status"), F.coalesce(figure.cast("double"), F.lit(0.0)).alias("figure"))


def gates(slots: DataFrame, proposals: DataFrame, legs: DataFrame, runs: DataFrame, drills: DataFrame, since) -> DataFrame:
    """The five deployment gates, each PASS, FAIL or NO_DATA, where no evidence is never a pass, and the figure that
    decides. slots: slot, state; proposals: passed, leaked; legs: cost_drift_usd of reconciled legs; runs: passed,
    deflated_sharpe, holdout; drills: at, flat, elapsed_ms, unverified."""
    c = F.col
    day = slots.filter(c("slot") >= F.lit(since).cast("timestamp_ntz")).agg(F.count_if(c("state") == "complete").alias("ok"), F.count_if(c("state") != "complete").alias("bad"))
    made = proposals.agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if("leaked").alias("leaked"))
    cost = legs.agg(F.count("*").alias("n"), F.sum("cost_drift_usd").alias("usd"))
    best = runs.agg(F.max(F.when(c("passed"), c("deflated_sharpe"))).alias("dsr"), F.count_if("holdout").alias("burns"))
    # both sides are one row
    best = best.crossJoin(cost.select("n"))
    last = drills.agg(F.max_by(F.struct("flat", "elapsed_ms"), "at").alias("d"), F.count("*").alias("n"), F.count_if("unverified").alias("unverified"))
    report = [
        _gate(day, "collector_24h", c("ok") > 0, (c("bad") == 0) & (c("ok") >= 1440 * 0.999), c("ok")),
        _gate(made, "generator_honesty", c("n") >= PROPOSALS, (c("passed") / c("n") < PASS_RATE) & (c("leaked") == 0), c("passed") / F.greatest(c("n"), F.lit(1))),
        _gate(best, "validated_strategy", c("n") >= 2 * ROUND_TRIPS, (c("dsr") >= LEAST_SHARPE) & (c("burns") >= 1), c("dsr")),
        _gate(cost, "cost_model_honest", c("n") >= LEGS, c("usd") <= 0, c("usd")),
        _gate(last, "kill_flattens", c("n") > 0, c("d.flat") & (c("d.elapsed_ms") < FLATTEN_MS) & (c("unverified") == 0), c("d.elapsed_ms")),
    ]
    out = report[0]
    for g in report[1:]:
        out = out.unionByName(g)
    return out
