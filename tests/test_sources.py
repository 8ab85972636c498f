"""Venue messages, windows, blobs, digests."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import parsers, runs

T0 = datetime(2025, 1, 1)
MS = 1735689600000

MESSAGES = [
    ("btc_price_tick", "bybit_v5_ws", {"T": MS, "s": "BTCUSDT", "S": "Sell", "v": "0.5", "p": "100.5", "i": "x1"}, {"price": 100.5, "qty": 0.5, "trade_id": "x1", "buyer_is_maker": True}),
    ("btc_price_tick", "binance_futures_ws", {"T": MS, "p": "100.5", "q": "0.5", "a": 7, "m": False}, {"price": 100.5, "qty": 0.5, "trade_id": "7", "buyer_is_maker": False}),
    ("btc_ohlcv_1m", "bybit_v5_ws", {"start": MS, "end": MS + 59999, "open": "1", "high": "2", "low": "0.5", "close": "1.5", "volume": "3", "turnover": "4"}, {"open": 1.0, "close": 1.5, "quote_volume": 4.0, "trades": None, "open_time": T0, "close_time": T0 + timedelta(milliseconds=59999)}),
    ("btc_ohlcv_1m", "binance_futures_ws", {"k": {"t": MS, "T": MS + 59999, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "3", "q": "4", "n": 9}}, {"trades": 9, "volume": 3.0}),
    ("btc_liquidation", "binance_futures_ws", {"o": {"T": MS, "S": "SELL", "q": "2", "p": "9", "ap": "10"}}, {"side": "SELL", "price": 10.0, "notional_usd": 20.0}),
    ("btc_liquidation", "bybit_v5_ws", {"T": MS, "S": "Buy", "v": "2", "p": "9"}, {"price": 9.0, "notional_usd": 18.0}),
    ("btc_orderbook", "bybit_v5_ws", {"E": MS, "b": [["10", "1"], ["9", "3"]], "a": [["11", "1"]]}, {"best_bid": 10.0, "best_ask": 11.0, "spread": 1.0, "bid_volume": 4.0, "ask_volume": 1.0, "imbalance": 0.6}),
    ("btc_funding", "bybit_v5_ws", {"_ts": MS, "markPrice": "1", "indexPrice": "2", "fundingRate": "0.0001", "nextFundingTime": str(MS)}, {"funding_rate": 0.0001, "next_funding_time": T0}),
    ("btc_oi_5m", "bybit_v5_ws", {"timestamp": str(MS), "openInterest": "5"}, {"open_interest": 5.0, "open_interest_value_usd": None}),
    ("btc_funding_8h", "binance_futures_ws", {"fundingTime": MS, "fundingRate": "0.0002"}, {"funding_rate": 0.0002}),
    ("btc_open_interest", "binance_futures_ws", {"time": MS, "openInterest": "6"}, {"open_interest": 6.0}),
]


@pytest.mark.parametrize("dataset,source,raw,want", MESSAGES)
def test_messages(spark, dataset, source, raw, want):
    items = spark.createDataFrame([(dataset, source, json.dumps(raw)), (dataset, source, '{"T": "x"}')], "dataset_id string, source string, raw string")
    good, bad = parsers.parsed(items, source.split("_")[0], dataset).collect()
    assert not good["parse_failed"] and bad["parse_failed"]
    assert good["event_time"] == (T0 if dataset != "btc_ohlcv_1m" else T0 + timedelta(milliseconds=59999))
    assert {k: good["payload"][k] for k in want} == pytest.approx(want) if all(isinstance(v, float) for v in want.values()) else {k: good["payload"][k] for k in want} == want


def test_candle(spark):
    raw = spark.createDataFrame([([str(MS), "1", "2", "0.5", "1.5", "3", "4"],)], "r array<string>").select(parsers.bybit_candle(F.col("r")).alias("raw"))
    got = parsers.parsed(raw.withColumn("dataset_id", F.lit("btc_ohlcv_1m")).withColumn("source", F.lit("bybit_rest")), "bybit", "btc_ohlcv_1m").first()
    assert got["payload"]["close"] == 1.5 and got["event_time"] == T0 + timedelta(milliseconds=59999)


def test_blob_and_views(spark, tmp_path):
    runs.write_blob(spark, str(tmp_path / "b"), {"prompt": "x", "answer": "y"})
    assert runs.read_blob(spark, str(tmp_path / "b")) == {"prompt": "x", "answer": "y"}
    e = spark.createDataFrame([("s", 1, "born", "a"), ("s", 2, "later", "b")], "k string, t int, origin string, state string")
    assert tuple(runs.first_kept(e, ("k",), F.col("t"), ("origin",), ("state",)).first()) == ("s", "born", "b")
    assert tuple(runs.counted(e, ("k",), "t").first()) == ("s", 2, 1, 2)
    runs.snapshot(spark.createDataFrame([(T0, 1), (T0 + timedelta(days=1), 2)], "t timestamp_ntz, v int"), str(tmp_path / "s"), "2025-01-01", "t")
    assert [json.loads(r["row"])["v"] for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [1]
    with pytest.raises(ValueError):
        runs.save_run({"run_id": "r"}, e, e, str(tmp_path / "r"))
    runs.save_run({"run_id": "r", "as_of": T0}, e, e, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r/runs")).first()["meta"]["as_of"] == str(T0)


def test_digests(spark):
    v = spark.createDataFrame([(1, "APPROVE", True, True), (2, "VETO", True, True), (3, "VETO", False, True), (4, "VETO", False, False)], "at int, verdict string, realized_adverse boolean, realized_known boolean")
    assert tuple(runs.outcomes(v).first()) == (3, 1, 1, 2, 1)
    s = spark.createDataFrame([("f", i, float(i)) for i in range(1000)], "k string, t int, ms double")
    assert tuple(runs.latencies(s, ("k",), "t", "ms").first()) == ("f", 750.0, 974.0, 500)
    assert [r["name"] for r in runs.reason_names(spark.createDataFrame([("b:1",), ("a",), ("b:2",)], "r string"), "r").collect()] == ["a", "b"]
    p = spark.createDataFrame([("2025-01-01", "a"), ("2025-01-01", "b"), ("2025-01-05", "a")], "event_date string, dataset_id string").withColumn("event_date", F.to_date("event_date"))
    assert [str(r["event_date"]) for r in runs.due_for_tier_out(p, {"a": 24, "b": 48}, datetime(2025, 1, 4)).collect()] == ["2025-01-01"]


def test_export_variants(spark):
    import random

    r, x, rows = random.Random(1), 100.0, []
    for i in range(90):
        x *= 1 + r.gauss(0, 0.01)
        rows.append(("s", T0 + timedelta(minutes=i + 1) - timedelta(milliseconds=1), x, x * 1.01, x * 0.99, x, 1.0))
    bars = spark.createDataFrame(rows, "symbol string, close_time timestamp_ntz, open double, high double, low double, close double, volume double")
    books = spark.createDataFrame([("s", T0 + timedelta(seconds=k), float(k), 0.1) for k in (5, 50)], "symbol string, time timestamp_ntz, spread double, imbalance double")
    got = runs.export(bars, books).orderBy("timestamp").collect()
    assert got[0]["spread"] == 50.0 and got[1]["spread"] is None and got[13]["atr"] is None and got[59]["volatility"] is None
    tr = [rows[0][3] - rows[0][4]] + [max(b[3] - b[4], abs(b[3] - a[5]), abs(b[4] - a[5])) for a, b in zip(rows, rows[1:], strict=False)]
    atr = sum(tr[1:15]) / 14
    assert got[14]["atr"] == pytest.approx(atr) and got[15]["atr"] == pytest.approx((atr * 13 + tr[15]) / 14)
    rets = [b[5] / a[5] - 1 for a, b in zip(rows, rows[1:], strict=False)][:60]
    mean = sum(rets) / 60
    assert got[60]["volatility"] == pytest.approx((sum((y - mean) ** 2 for y in rets) / 60) ** 0.5)
