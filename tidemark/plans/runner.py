"""A strategy from its definition to its verdict: checks, coverage, signals, replay, the trial's record, judgement."""

from __future__ import annotations

import hashlib
import json
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timegrid import TIMEFRAMES
from ..operators import asof, bars, coverage, lifecycle, regimes, replay, validation
from ..sources import commits, runs
from ..sources.shared import written
from . import definition, strategy

TRIALS = "run_id string, strategy_id string, signature string, config_hash string, holdout boolean"


class HoldoutViolation(Exception):
    """A search that reaches into the sealed days, or a second look at them."""


def _trials(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(TRIALS).parquet(f"{path}/trials")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TRIALS)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def signals(b: DataFrame, d: dict, feeds: dict[str, DataFrame]) -> DataFrame:
    """Bars of a minute as replay takes them, by a definition that has passed its checks."""
    stop, trailing, scope, c = d["exit"]["stop"], d["exit"]["trailing"], d["regime_scope"], F.col
    atr = lambda x: {"feature": "atr", "timeframe": x["timeframe"], "args": {"n": x["n"]}}
    ranges = [atr(x) for x in (stop if stop["kind"] == "atr" else None, trailing) if x]
    terms = strategy.features(d["entry"]) | {strategy.key(t): t for t in ranges}
    made = strategy.with_features(regimes.with_labels(b, strategy.KEYS), terms, feeds)
    if stop["kind"] == "atr":
        distance = c(f"`{strategy.key(atr(stop))}`") * stop["mult"]
    elif stop["kind"] == "percent":
        distance = c("close") * stop["mult"] / 100
    else:
        minutes, side = TIMEFRAMES[stop["timeframe"]], d["direction"].upper()
        frame = b if minutes == 1 else bars.resampled(b, minutes, strategy.KEYS)
        order = strategy.Window.partitionBy(*strategy.KEYS).orderBy("close_time")
        made = asof.asof(made, frame.select(*strategy.KEYS, c("close_time").alias("_t"), regimes.structural_extreme(side, stop["n"], order).alias("_extreme")), strategy.KEYS, "close_time", "_t", ("_extreme",))
        distance = (c("close") - c("_extreme")) * (stop["mult"] if side == "LONG" else -stop["mult"])
    ok = c("regime").isin(*scope)
    made = made.withColumn("signal", strategy.condition(d["entry"], {k: p["value"] for k, p in d["params"].items()}) & F.coalesce(ok, F.lit(False))).withColumn("stop_distance", distance)
    made = made.withColumn("regime_ok", F.coalesce(ok, F.lit(False)) if d["exit"]["regime_invalidation"] else F.lit(True))
    return made.withColumn("trail", c(f"`{strategy.key(atr(trailing))}`") * trailing["mult"]) if trailing else made


def backtest(b: DataFrame, payload: dict, path: str, start, end, as_of, now, feeds: dict[str, DataFrame] | None = None, allow_gaps: bool = False, warmup: int = 200, holdout: bool = False, sizing: replay.Sizing = replay.Sizing(), population: dict[str, frozenset[str]] | None = None) -> dict:
    """One strategy over the bars of one symbol that close in [start, end]; its run, trial and verdict go to `path`.

    A definition that breaks a rule raises with every reason. Search may not reach into the sealed days, and a strategy
    may look at them once; the look and the trial are recorded before there are results. A trial is a signature with a
    configuration: the same again is a replay and doesn't count."""
    spark, feeds = b.sparkSession, feeds or {}
    wrong = definition.reasons(payload, population)
    if wrong:
        raise strategy.Rejected("; ".join(wrong))
    d = definition.filled(payload)
    past = _trials(spark, path)
    if not holdout and end > lifecycle.sealed_from(now):
        raise HoldoutViolation(f"{end} is inside the days sealed from {lifecycle.sealed_from(now)}")
    if holdout and not past.filter(F.col("holdout") & (F.col("strategy_id") == d["id"])).isEmpty():
        raise HoldoutViolation(f"{d['id']} has had its look")
    # read by every step that follows
    b = written(b.filter(F.col("close_time").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))), "bars")
    bounds = spark.createDataFrame([(start, end)], "first timestamp_ntz, last timestamp_ntz")
    covered = coverage.summary(bounds, "first", "last", coverage.covered_slots(b, "open_time", 60), 60)
    if not allow_gaps:
        coverage.assert_complete(covered)
    if b.count() <= warmup:
        raise coverage.CoverageError(f"no more bars than the warm-up of {warmup}")
    config = {"definition": d, "window": [str(start), str(end)], "warmup": warmup, "holdout": holdout}
    run_id, sign, digest = uuid.uuid4().hex, _digest("|".join(sorted(definition.signature(d)))), _digest(json.dumps(config, sort_keys=True))
    # of several at once one has the look, whatever the trials held when they read them
    if holdout and not commits.claim(spark, f"{path}/looks/{quote(d['id'], safe='')}", run_id):
        raise HoldoutViolation(f"{d['id']} has had its look")
    spark.createDataFrame([(run_id, d["id"], sign, digest, holdout)], TRIALS).write.mode("append").parquet(f"{path}/trials")
    n_trials = _trials(spark, path).select("signature", "config_hash").distinct().count()
    x = d["exit"]
    policy = replay.Policy(d["direction"].upper(), x["target"] and x["target"]["r"], x["time_exit"] or definition.MOST_BARS, trailing=bool(x["trailing"]))
    found = replay.candidates(signals(b, d, feeds), strategy.KEYS, policy, replay.Costs())
    if "funding" in feeds:
        found = asof.interval_sum(found, feeds["funding"], strategy.KEYS, "entry_time", "exit_time", "time", "rate", "funding_rate")
    taken = written(replay.trades(found, strategy.KEYS, policy, replay.Costs(), sizing, warmup), "trades")
    labels = regimes.with_labels(b, strategy.KEYS).select("close_time", F.col("direction").alias("regime"))
    said = validation.verdict(taken, validation.by_regime(taken, labels, "entry_time", "close_time", "net_pnl"), sizing.equity, n_trials)
    exits = {r["reason"]: r["n"] for r in taken.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    run = {"run_id": run_id, "strategy_id": d["id"], "config_hash": digest, "as_of": as_of, "n_trials": n_trials, "holdout": holdout, "verdict": json.dumps(said, sort_keys=True)}
    runs.save_run(run, taken, replay.equity_curve(taken, sizing.equity, strategy.KEYS), path)
    return {"run_id": run_id, "config_hash": digest, "verdict": said, "exit_reasons": exits, "n_trials": n_trials, "holdout": holdout}
