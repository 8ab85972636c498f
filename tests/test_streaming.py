"""Streaming operators over files, run until nothing is left, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import records
from tidemark.streaming import live, state

T0 = datetime(2025, 1, 1)


def run(spark, rows, schema, build, tmp_path, name, files=3):
    """So many files, one micro-batch each."""
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_throttle(spark, tmp_path):
    r = random.Random(1)
    t, rows = T0, []
    for i in range(60):
        t += timedelta(milliseconds=r.randint(100, 900))
        rows.append(("s", t, i))
    got = run(spark, rows, "k string, t timestamp, i int", lambda s: live.throttled(s, ("k",), "t", 2.0), tmp_path, "throttled")
    last, want = None, []
    for k, t, i in rows:
        if last is None or (t - last).total_seconds() >= 2:
            want.append(i)
            last = t
    assert sorted(x[2] for x in got) == want


def test_merge(spark, tmp_path):
    rows = [("s", T0, "delta", 9.0, None), ("s", T0 + timedelta(seconds=1), "snapshot", 1.0, 2.0), ("s", T0 + timedelta(seconds=2), "delta", None, 3.0), ("s", T0 + timedelta(seconds=3), "delta", 4.0, None), ("s", T0 + timedelta(seconds=4), "snapshot", 5.0, None), ("s", T0 + timedelta(seconds=5), "delta", None, 6.0)]
    got = run(spark, rows, "k string, t timestamp, kind string, a double, b double", lambda s: live.merged(s, ("k",), "t", ("a", "b")), tmp_path, "merged")
    assert [x[2:] for x in sorted(got, key=lambda x: x[1])] == [(1.0, 2.0), (1.0, 3.0), (4.0, 3.0), (5.0, None), (5.0, 6.0)]


def test_books(spark, tmp_path):
    level = lambda *x: [{"price": p, "qty": q} for p, q in x]
    rows = [("s", T0, "delta", level((1.0, 1.0)), []), ("s", T0 + timedelta(seconds=1), "snapshot", level((10.0, 1.0), (9.0, 2.0)), level((11.0, 3.0))), ("s", T0 + timedelta(seconds=2), "delta", level((10.0, 0.0)), level((10.5, 1.0)))]
    schema = "k string, t timestamp, kind string, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"
    got = run(spark, rows, schema, lambda s: state.books(s, ("k",), "t"), tmp_path, "books")
    assert [x[2:] for x in sorted(got, key=lambda x: x[1])] == [(10.0, 11.0, 3.0, 3.0), (9.0, 10.5, 2.0, 4.0)]


def test_routes(spark, tmp_path):
    seen = {"clean": 0, "bad": 0}
    add = lambda name: lambda df, epoch: seen.__setitem__(name, seen[name] + df.count())
    live.routed(F.col("f"), add("clean"), add("bad"))(spark.createDataFrame([(["x"],), ([],), ([],)], "f array<string>"), 0)
    assert seen == {"clean": 2, "bad": 1}


def record(i, flags=(), second=0):
    t = T0 + timedelta(seconds=second)
    return (f"r{i}", "btc_oi_5m", "bybit_v5_ws", "bybit", "BTCUSDT", t, t, t, t, None, None, "p", "c", 1, "h", list(flags), not flags, "g", [], {"parse": 1.0}, '{"open_interest": 5.0}')


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    incoming = spark.createDataFrame([record(1), record(2), record(3, ["stale", "x"], 1), record(4, (), 2)], records.ENVELOPE)
    records.write_records(incoming, path)
    stored = spark.read.parquet(f"{path}/archive")
    assert sorted(r["record_id"] for r in stored.collect()) == ["r1", "r4"]
    records.write_records(spark.createDataFrame([record(5), record(6, (), 9)], records.ENVELOPE), path, stored)
    assert sorted(r["record_id"] for r in spark.read.parquet(f"{path}/archive").collect()) == ["r1", "r4", "r6"]
    assert sorted(r["failing_check"] for r in spark.read.parquet(f"{path}/quality_events").collect()) == ["stale", "x"]
    assert [r["open_interest"] for r in records.typed(stored, "btc_oi_5m").collect()] == [5.0, 5.0]
    before = records.manifest(spark, f"{path}/archive").cache()
    assert before.agg(F.sum("rows")).first()[0] == 3 and records.unverified(before, records.manifest(spark, f"{path}/archive")).count() == 0
    changed = before.withColumn("sha256", F.when(F.col("rows") == 2, "x").otherwise(F.col("sha256")))
    assert records.unverified(changed, before).count() == changed.filter("sha256 = 'x'").count()


def test_bar_files(spark, tmp_path):
    path = str(tmp_path / "bars.parquet")
    rows = [(T0 + timedelta(seconds=60 * i + 59, milliseconds=999), 1.0, 1.0, 1.0, 1.0, None) for i in range(5)]
    spark.createDataFrame(rows, records.BARS).write.parquet(path)
    got = records.load_bars(spark, path, T0, T0 + timedelta(minutes=3)).collect()
    assert len(got) == 3 and got[0]["volume"] == 0.0 and (got[0]["close_time"] - got[0]["open_time"]).total_seconds() == 59.999
    spark.createDataFrame([(T0, 0.1)], "timestamp timestamp_ntz, funding_rate double").write.parquet(str(tmp_path / "bars_funding.parquet"))
    assert records.load_funding(spark, path, T0, T0 + timedelta(minutes=3)).first()["rate"] == 0.1
    with pytest.raises(records.MissingData):
        records.load_funding(spark, path, T0 + timedelta(days=1), T0 + timedelta(days=2))
    assert [r["v"] for r in spark.createDataFrame([("bybit_v5_ws",), ("kraken_ws",)], "s string").select(records.venue_of(F.col("s")).alias("v")).collect()] == ["bybit", None]


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    batch = spark.createDataFrame([(["x"],), ([],), ([],)], "f array<string>")
    write = live.routed(F.col("f"), live.appended_once(str(tmp_path / "clean")), live.appended_once(str(tmp_path / "bad")))
    for epoch in (0, 1, 1):
        write(batch, epoch)
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 4 and spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_state_goes_when_a_key_is_silent(spark, tmp_path):
    """The key a comes again after a batch that had passed its time without it, or, with state kept for longer, in time."""
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("a", at(0), "snapshot", 1.0, 2.0), ("b", at(0), "snapshot", 5.0, 6.0), *(("b", at(s), "delta", None, 7.0) for s in (400, 800, 801, 802)), ("a", at(803), "delta", 3.0, None), ("b", at(804), "delta", 8.0, None)]
    schema = "k string, t timestamp, kind string, a double, b double"
    for idle_s, wanted in ((60.0, [(1.0, 2.0)]), (3600.0, [(1.0, 2.0), (3.0, 2.0)])):
        path = tmp_path / f"{idle_s}"
        path.mkdir()
        got = run(spark, rows, schema, lambda s: live.merged(s, ("k",), "t", ("a", "b"), idle_s=idle_s), path, f"idle_{int(idle_s)}", files=4)  # noqa: B023
        assert sorted(x[2:] for x in got if x[0] == "a") == wanted and len([x for x in got if x[0] == "b"]) == 6


def test_confirmed(spark):
    bars = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, confirm boolean")
    assert [r["i"] for r in live.confirmed(bars).collect()] == [1]
