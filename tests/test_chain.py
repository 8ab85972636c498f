"""Signals bar by bar against those of the whole series."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_state import run
from tidemark.operators import decisions
from tidemark.plans import strategy
from tidemark.streaming import chain

T0 = datetime(2025, 1, 1)
TREES = [
    {"and": [{"left": {"feature": "close"}, "op": "cross_above", "right": {"feature": "sma", "args": {"n": 5}}}, {"not": {"left": {"feature": "rsi", "timeframe": "1h", "args": {"n": 3}}, "op": "gt", "right": {"param": "hot"}}}]},
    {"or": [{"left": {"feature": "ema", "timeframe": "15m", "args": {"n": 4}}, "op": "cross_below", "right": {"feature": "close", "timeframe": "5m"}}, {"left": {"feature": "bb_position", "args": {"n": 6}}, "op": "between", "right": 0.9, "right2": {"const": 1.4}}]},
    {"and": [{"left": {"feature": "ret_pct", "args": {"n": 7}}, "op": "gt", "right": 0.1}, {"left": {"feature": "atr_pct", "timeframe": "5m", "args": {"n": 3}}, "op": "gte", "right": 0.2}, {"left": {"feature": "vwap_dist"}, "op": "lt", "right": 0.5}, {"left": {"feature": "realized_vol", "timeframe": "5m", "args": {"n": 5}}, "op": "gt", "right": {"feature": "low"}}]},
]


@pytest.fixture(scope="module")
def minutes():
    r = random.Random(7)
    rows, price = [], 100.0
    for i in range(900):
        price *= math.exp(r.gauss(0, 0.002))
        if r.random() < 0.15:  # minutes without a bar
            continue
        lo, hi = price * (1 - r.random() * 0.001), price * (1 + r.random() * 0.001)
        t = T0 + timedelta(minutes=i)
        rows.append(("s", t, t + timedelta(seconds=59, milliseconds=999), price, hi, lo, price, r.random()))
    return rows


SCHEMA = "symbol string, open_time timestamp, close_time timestamp, open double, high double, low double, close double, volume double"


@pytest.mark.parametrize("k", range(len(TREES)))
def test_stream_equals_the_whole_series(spark, tmp_path, minutes, k):
    params = {"hot": 60.0}
    got = run(spark, minutes, SCHEMA, lambda s: chain.signals(s, ("symbol",), TREES[k], params), tmp_path, f"chain_{k}", files=3)
    bars = spark.createDataFrame(minutes, SCHEMA).withColumn("open_time", F.col("open_time").cast("timestamp_ntz")).withColumn("close_time", F.col("close_time").cast("timestamp_ntz"))
    want = strategy.signals(bars, TREES[k], params).collect()
    plain = lambda rows: sorted((x["close_time"], x["signal"], x["regime"], None if x["stop_distance"] is None else round(x["stop_distance"], 9)) for x in rows)
    assert plain(got) == plain(want) and 0 < sum(x["signal"] for x in got) < len(got)


def test_what_needs_a_whole_series_is_refused():
    for name in ("adx", "funding_zscore"):
        with pytest.raises(strategy.Rejected, match=name):
            chain.Chain({"left": {"feature": name, "args": {"n": 14}}, "op": "gt", "right": 1})


def test_outcomes_by_stage(spark):
    rows = [
        (False, None, True, 1, "ok", [], "APPROVE"), (True, "kill_3", True, 1, "ok", [], "APPROVE"), (True, None, False, 1, "ok", [], "APPROVE"), (True, None, True, 0, "ok", [], "APPROVE"),
        (True, None, True, 2, "conflict", [], "APPROVE"), (True, None, True, 1, "ok", ["leverage_exceeds_cap", "x"], "APPROVE"), (True, None, True, 1, "ok", [], "analogs_adverse"), (True, None, True, 1, "ok", None, "APPROVE"), (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "e boolean, h string, w boolean, n int, a string, r array<string>, v string")
    c = F.col
    got = [tuple(x["o"]) for x in df.select(decisions.bar_outcome(c("e"), c("h"), c("w"), c("n"), c("a"), c("r"), c("v")).alias("o")).collect()]
    assert [g[:2] for g in got] == [("DISABLED", "trade_loop_disabled"), ("SKIPPED", "risk_halted:kill_3"), ("SKIPPED", "outside_window"), ("SKIPPED", "no_signals"), ("SKIPPED", "arbiter:conflict"), ("BLOCKED", "leverage_exceeds_cap"), ("BLOCKED", "scrutiny:analogs_adverse"), ("PASSED", "ok"), ("DISABLED", "trade_loop_disabled")]
