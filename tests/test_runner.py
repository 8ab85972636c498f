"""Definitions, their checks and whole runs."""

from datetime import datetime, timedelta

import pytest
from test_operators import SCHEMA, T0, series

from tidemark.operators import coverage, lifecycle, replay
from tidemark.plans import definition, runner, strategy

GOOD = {
    "id": "above",
    "rationale": "closes above their mean tend to go on for a while",
    "direction": "long",
    "timeframes": ["1m"],
    "required_feeds": ["ohlcv"],
    "regime_scope": list(definition.REGIMES),
    "entry": {"left": {"feature": "close", "timeframe": "1m"}, "op": "gt", "right": {"feature": "sma", "timeframe": "1m", "args": {"n": 10}}},
    "exit": {"stop": {"kind": "percent", "mult": 1.0}, "target": {"r": 1.0}, "time_exit": 5},
}


def test_definitions():
    assert definition.reasons(GOOD) == []
    assert definition.reasons(definition.filled(GOOD)) == []
    changed = lambda **k: definition.reasons(GOOD | k)
    assert changed(size=1) == ["parse:strategy:unknown_keys"]
    assert changed(exit={"target": {"r": 1.0}})[0].startswith("parse:exit")
    assert changed(rationale="short", regime_scope=["calm"]) == ["rationale_missing_or_trivial", "unknown_regime_bucket:calm"]
    assert changed(required_feeds=["ohlcv", "oi"], timeframes=["5m"]) == ["declared_unused_feed:oi", "undeclared_timeframe:1m"]
    assert changed(params={"a": {"value": 3, "lo": 0, "hi": 2}}) == ["param_out_of_bounds:a", "unused_param:a"]
    assert changed(exit={"stop": {"kind": "atr", "mult": 0}, "time_exit": 61}) == ["stop_mult_nonpositive:0", "time_exit_exceeds_cap:61>60"]
    near = GOOD | {"id": "other", "entry": GOOD["entry"] | {"right": {"feature": "sma", "timeframe": "1m", "args": {"n": 11}}}}
    assert definition.reasons(near, {"above": definition.signature(GOOD)})[0].startswith("near_duplicate_of:above")


def test_windows_and_states():
    assert lifecycle.window_days(("ohlcv", "oi"), 365) == 29 and lifecycle.window_days(("orderbook",), 365) == 7 and lifecycle.window_days(("ohlcv",), 365) == 365
    assert lifecycle.sealed_from(datetime(2025, 4, 1)) == datetime(2025, 1, 1)


def test_runs(spark, tmp_path):
    b, path, sizing = spark.createDataFrame(series(400), SCHEMA), str(tmp_path), replay.Sizing()
    start, end, now = T0, T0 + timedelta(minutes=399, seconds=59, milliseconds=999), T0 + timedelta(days=200)
    run = lambda d=GOOD, **k: runner.backtest(b, d, path, start, end, now, **{"now": now} | k)
    first = run()
    taken = spark.read.parquet(f"{path}/trades/run={first['run_id']}").orderBy("exit_time").collect()
    assert sum(first["exit_reasons"].values()) == len(taken) > 10 and set(first["exit_reasons"]) <= {"time", "stop", "target"}
    assert abs(taken[-1]["equity"] - sizing.equity - sum(t["net_pnl"] for t in taken)) < 1e-6
    assert "insufficient_trades" in first["verdict"]["reasons"] and not first["verdict"]["passed"] and first["verdict"]["trades"] == len(taken)
    again, other = run(), run(GOOD | {"direction": "short"})
    assert (first["n_trials"], again["n_trials"], other["n_trials"]) == (1, 1, 2) and again["config_hash"] == first["config_hash"]
    for stop in ({"kind": "structural", "n": 5, "timeframe": "5m"}, {"kind": "atr", "mult": 2.0, "n": 5}):
        d = GOOD | {"timeframes": ["1m", "5m"], "exit": {"stop": stop, "trailing": {"mult": 2.0, "n": 5}}}
        assert sum(run(d)["exit_reasons"].values()) > 0
    with pytest.raises(strategy.Rejected):
        run(GOOD | {"size": 1})
    with pytest.raises(runner.HoldoutViolation):
        run(now=T0 + timedelta(days=30))
    assert run(now=T0 + timedelta(days=30), holdout=True)["holdout"]
    with pytest.raises(runner.HoldoutViolation):
        run(now=T0 + timedelta(days=30), holdout=True)
    holed = b.filter("minute(open_time) <> 7")
    with pytest.raises(coverage.CoverageError):
        runner.backtest(holed, GOOD, path, start, end, now, now)
    assert spark.read.parquet(f"{path}/runs").count() == 6
