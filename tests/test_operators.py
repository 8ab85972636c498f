"""Operators on literal inputs, against hand-computed values or plain loops."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import predicates as p
from tidemark.functions import scalars, stats
from tidemark.operators import asof, audit, bars, bitemporal, coverage, gate, indicators, ledger, recurrence, regimes, replay, similarity, validation
from tidemark.streaming import chain

T0 = datetime(2025, 1, 1)


def series(n, seed=1):
    r = random.Random(seed)
    x = 100.0
    out = []
    for i in range(n):
        o = x
        x = max(1.0, x * (1 + r.gauss(0, 0.004)))
        hi, lo = max(o, x) * (1 + abs(r.gauss(0, 0.001))), min(o, x) * (1 - abs(r.gauss(0, 0.001)))
        out.append(("s", T0 + timedelta(minutes=i), T0 + timedelta(minutes=i + 1) - timedelta(milliseconds=1), o, hi, lo, x, 10.0 + i % 7))
    return out


SCHEMA = "symbol string, open_time timestamp_ntz, close_time timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(series(400), SCHEMA).cache()


def column(df, name):
    return [r[name] for r in df.orderBy("close_time").collect()]


def ema(x, n):
    out, y = [None] * len(x), sum(x[:n]) / n
    out[n - 1] = y
    for i in range(n, len(x)):
        y = x[i] * 2 / (n + 1) + y * (1 - 2 / (n + 1))
        out[i] = y
    return out


def test_ema_needs_no_whole_series(frame):
    x = column(frame, "close")
    for block in (7, 128):
        old, recurrence.BLOCK_ROWS = recurrence.BLOCK_ROWS, block
        recurrence.folded.__defaults__ = (block,)
        got = column(indicators.with_ema(frame, "close", 14, ("symbol",), "close_time"), "ema")
        recurrence.BLOCK_ROWS, recurrence.folded.__defaults__ = old, (old,)
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12)) for a, b in zip(got, ema(x, 14), strict=True))


def test_short_series_has_no_ema(spark):
    assert column(indicators.with_ema(spark.createDataFrame(series(5), SCHEMA), "close", 14, ("symbol",), "close_time"), "ema") == [None] * 5


CAUSAL = {
    "sma": lambda b, o: b.withColumn("y", indicators.sma(F.col("close"), 10, o)),
    "std": lambda b, o: b.withColumn("y", indicators.rolling_std(F.col("close"), 10, o)),
    "bb": lambda b, o: b.withColumn("y", indicators.bb_position(F.col("close"), 10, o)),
    "tr": lambda b, o: b.withColumn("y", indicators.true_range(o)),
    "rsi": lambda b, o: indicators.with_rsi(b, "close", 14, ("symbol",), "close_time", "y"),
    "atr": lambda b, o: indicators.with_atr(b, 14, ("symbol",), "close_time", "y"),
    "adx": lambda b, o: indicators.with_adx(b, 14, ("symbol",), "close_time", "y"),
    "vwap": lambda b, o: indicators.with_vwap_dist(b, ("symbol",), "y"),
    "zscore": lambda b, o: indicators.with_zscore(b, "close", 10, ("symbol",), "close_time", "y"),
    "regime": lambda b, o: regimes.with_labels(b, ("symbol",)).withColumnRenamed("regime", "y"),
}


@pytest.mark.parametrize("name", CAUSAL)
def test_the_future_changes_nothing(spark, name):
    rows = series(200)
    tampered = [(*r[:3], 9e5, 9e5, 9e5, 9e5, 9e5) if i >= 120 else r for i, r in enumerate(rows)]
    order = Window.partitionBy("symbol").orderBy("close_time")
    a, b = (column(CAUSAL[name](spark.createDataFrame(x, SCHEMA), order), "y") for x in (rows, tampered))
    assert a[:120] == b[:120] and any(y is not None for y in a[:120])


def test_direction_from_a_price_of_zero(spark):
    """As SQL's division has it, be it of a whole series or bar by bar; this failed by an error."""
    closes = [0.0, 0.0, 5.0, 0.0, -1.0, -1.0, -0.9]
    bars_ = spark.createDataFrame([(i, x) for i, x in enumerate(closes)], "i int, close double")
    got = [r["d"] for r in bars_.select("i", regimes.direction(F.col("close"), Window.orderBy("i"), 1).alias("d")).orderBy("i").collect()]
    assert got == ["range", "bull", "bull", "bear", "bear", "range", "bear"]
    held = {}
    assert [chain._regime(held, {"close": x}, back=1).split("_")[0] for x in closes] == got


def test_predicates(spark):
    rows = [(1, 1.0, 2.0), (2, 3.0, 2.0), (3, None, 2.0), (4, 1.0, 2.0)]
    w = Window.orderBy("i")
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "i int, a double, b double")
    got = df.select("i", p.gt(a, b).alias("gt"), p.negated(p.gt(a, b)).alias("not"), p.cross_above(a, b, w).alias("up"), p.cross_below(a, b, w).alias("down"), p.between(a, F.lit(3.0), F.lit(1.0)).alias("in")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(False, True, False, False, True), (True, False, True, False, True), (False, True, False, False, False), (False, True, False, False, True)]


def test_asof_hands_values_over_blocks(spark):
    left = [("s", T0 + timedelta(hours=h)) for h in (0, 1, 30, 100)]
    right = [("s", T0 + timedelta(hours=1), 1.0, "x"), ("s", T0 + timedelta(hours=2), None, "y"), ("s", T0 + timedelta(hours=99, minutes=59), 3.0, "z")]
    got = asof.asof(spark.createDataFrame(left, "k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, at timestamp_ntz, v double, w string"), ("k",), "t", "at", ("v", "w"))
    assert [(r["v"], r["w"]) for r in got.orderBy("t").collect()] == [(None, None), (1.0, "x"), (None, "y"), (3.0, "z")]


def test_events_of_one_instant_are_in_the_order_of_their_ids(spark, tmp_path):
    """Against the SQL, which takes ties as they lie in the table; what a shuffle made of them came before."""
    import duckdb

    import __spark_entry__ as entry

    r = random.Random(3)
    at = sorted(r.randrange(400) for _ in range(900))
    rows = [(i, T0 + timedelta(seconds=t), i % 7, ("purchase", "signup", "view", "click")[r.randrange(4)], r.randrange(1, 5000) / 100, "") for i, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create table events as select * from '{tmp_path}/events.parquet/*.parquet' order by event_id")
    for name in ("oi_change", "funding_zscore", "asof_value"):
        got = {x["event_id"]: x[-1] for x in entry.queries()[name](spark, str(tmp_path)).collect()}
        assert got == pytest.approx({x[0]: x[-1] for x in con.execute(entry.oracle_sql()[name]).fetchall()}, nan_ok=True), name


def test_interval_sum_excludes_the_entry(spark):
    trades = spark.createDataFrame([("s", 1, T0, T0 + timedelta(hours=2)), ("s", 2, T0 + timedelta(hours=2), T0 + timedelta(hours=2))], "k string, id int, a timestamp_ntz, b timestamp_ntz")
    points = spark.createDataFrame([("s", T0 + timedelta(hours=h), 1.0 * h + 1) for h in range(4)], "k string, t timestamp_ntz, r double")
    got = asof.interval_sum(trades, points, ("k",), "a", "b", "t", "r", "x").orderBy("id").collect()
    assert [r["x"] for r in got] == [5.0, 0.0]


def test_trailing_range_sum_is_inclusive_and_null_without_feed(spark):
    b = spark.createDataFrame([("s", T0, 10.0), ("t", T0, 10.0), ("u", T0, 10.0)], "k string, t timestamp_ntz, close double")
    pts = [("s", T0 - timedelta(minutes=60), 11.0, 5.0), ("s", T0, 12.0, 7.0), ("s", T0 - timedelta(minutes=61), 11.0, 9.0), ("s", T0, 10.0, 1.0), ("t", T0 + timedelta(minutes=1), 11.0, 2.0)]
    got = asof.trailing_range_sum(b, spark.createDataFrame(pts, "k string, at timestamp_ntz, price double, n double"), ("k",), "t", "at", 60, "n", F.col("price") > F.col("close"), "x")
    assert {r["k"]: r["x"] for r in got.collect()} == {"s": 12.0, "t": 0.0, "u": None}


def test_frames_close_nominally(spark):
    rows = [r for i, r in enumerate(series(30)) if i != 4]
    five = bars.resampled(spark.createDataFrame(rows, SCHEMA), 5, ("symbol",)).orderBy("open_time").collect()
    assert five[0]["close_time"] == T0 + timedelta(minutes=5) - timedelta(milliseconds=1) and five[0]["close"] == rows[3][6] and len(five) == 6


def test_coverage(spark):
    slots = spark.createDataFrame([(T0 + timedelta(minutes=m),) for m in (0, 1, 3, 4)], "t timestamp_ntz")
    bounds = spark.createDataFrame([(T0, T0 + timedelta(minutes=4, seconds=9))], "a timestamp_ntz, b timestamp_ntz")
    covered = coverage.covered_slots(slots, "t", 60)
    got = coverage.summary(bounds, "a", "b", covered, 60)
    assert tuple(got.first()) == (5, 1, T0 + timedelta(minutes=2), 80.0)
    with pytest.raises(coverage.CoverageError):
        coverage.assert_complete(got)
    states = spark.createDataFrame([(1, "complete"), (1, "gap"), (2, "partial")], "k int, state string")
    assert {r["k"]: r["state"] for r in coverage.merged_states(states, ("k",)).collect()} == {1: "complete", 2: "partial"}


def test_corrections_at_three_instants(spark):
    key = ("bybit", "d", T0)
    rows = [(*key, "a", T0, 60000.0), (*key, "b", T0 + timedelta(hours=2), 60500.0)]
    r = bitemporal.with_intervals(spark.createDataFrame(rows, "venue string, dataset_id string, event_time timestamp_ntz, record_id string, valid_from_sys timestamp_ntz, price double"))
    at = lambda t: [x["price"] for x in bitemporal.read_as_of(r, "d", T0, T0, "bybit", t).collect()]
    assert at(T0 - timedelta(hours=1)) == [] and at(T0 + timedelta(hours=1)) == [60000.0] and at(T0 + timedelta(hours=2)) == [60500.0] and at(None) == [60500.0]
    assert bitemporal.read_as_of(r, "d", T0, T0, "binance").count() == 0


def plain_replay(rows, signal, policy, costs, z, warmup):
    equity, i, out, s = z.equity, warmup, [], policy.sign
    n = len(rows)
    while i < n - policy.latency - 1:
        close = rows[i][6]
        stop = close - s * close * 0.01
        qty = replay.sized(equity, close, stop, z) if signal[i] else 0.0
        if not qty:
            i += 1
            continue
        e = i + policy.latency
        fill = rows[e][3] * (1 + s * costs.slip)
        target = fill + s * abs(fill - stop) * policy.target_r
        last, best, trailed = min(n - 1, e + policy.time_exit), fill, False
        for j in range(e, last + 1):
            _, _, _, _, hi, lo, c, _ = rows[j]
            if j == last:
                mid, why = c, "time"
            elif (lo <= stop) if s > 0 else (hi >= stop):
                mid, why = stop, "trail" if trailed else "stop"
            elif (hi >= target) if s > 0 else (lo <= target):
                mid, why = target, "target"
            else:
                best = max(best, hi) if s > 0 else min(best, lo)
                moved = best - s * 0.3
                if policy.trailing and (moved > stop if s > 0 else moved < stop):
                    stop, trailed = moved, True
                continue
            break
        out_fill = mid * (1 - s * costs.slip)
        equity += s * (out_fill - fill) * qty - (qty * fill + qty * out_fill) * costs.fee
        out.append((why, round(equity, 6)))
        i = j + 1
    return out


@pytest.mark.parametrize("direction,trailing", [("LONG", False), ("LONG", True), ("SHORT", True)])
def test_replay_equals_a_loop(spark, direction, trailing):
    rows = series(600, 7)
    policy, costs, z = replay.Policy(direction, 1.5, 12, 1, trailing), replay.Costs(), replay.Sizing()
    signal = [i % 4 == 0 for i in range(len(rows))]
    b = spark.createDataFrame([(*r, x, r[6] * 0.01, 0.3) for r, x in zip(rows, signal, strict=True)], SCHEMA + ", signal boolean, stop_distance double, trail double")
    got = replay.trades(replay.candidates(b, ("symbol",), policy, costs), ("symbol",), policy, costs, z).orderBy("exit_time").collect()
    assert [(r["reason"], round(r["equity"], 6)) for r in got] == plain_replay(rows, signal, policy, costs, z, 60)
    assert len(got) > 20


def test_ledger_signs(spark):
    legs = [("LONG", "entry", 100_050.0, 5.0), ("LONG", "exit", 99_950.0, 5.0), ("SHORT", "entry", 99_950.0, 5.0), ("SHORT", "exit", 100_050.0, 5.0), ("LONG", "entry", 99_950.0, -5.0)]
    df = spark.createDataFrame(legs, "direction string, leg string, fill double, want double")
    for r in df.select("want", ledger.adverse_bps(F.lit(100_000.0), F.col("fill"), F.col("direction"), F.col("leg")).alias("got")).collect():
        assert math.isclose(r["got"], r["want"], rel_tol=1e-9)


def test_validation(spark):
    t = spark.createDataFrame([("s", i, 1.0 if i % 10 else -3.0) for i in range(50)], "k string, i int, net_pnl double")
    assert tuple(validation.walk_forward(t, ("k",), ("i",), "net_pnl").select("positive_folds", "consistent").first()) == (4, True)
    curve = spark.createDataFrame([("s", i, e) for i, e in enumerate((100.0, 120.0, 90.0, 110.0))], "k string, i int, equity double")
    assert validation.drawdown(curve, ("k",), ("i",), "equity").first()["max_drawdown_pct"] == 25.0
    kept = validation.kept_for_training(spark.range(20), "id", 8, 10, 2, 3)
    assert sorted(r["id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 15, 16, 17, 18, 19]


def test_stats(spark):
    x = [0.01, -0.02, 0.03, 0.04, -0.01, 0.02]
    m = stats.moments(spark.createDataFrame([(v,) for v in x], "v double"), "v").first()
    n, mean = len(x), sum(x) / len(x)
    std = math.sqrt(sum((v - mean) ** 2 for v in x) / (n - 1))
    assert math.isclose(m["skew"], n / ((n - 1) * (n - 2)) * sum(((v - mean) / std) ** 3 for v in x))
    assert math.isclose(m["kurtosis"], sum(((v - mean) / std) ** 4 for v in x) / n)
    assert 0 < stats.deflated_sharpe(m["sharpe"], n, m["skew"], m["kurtosis"], 20) < stats.probabilistic_sharpe(m["sharpe"], n, m["skew"], m["kurtosis"]) < 1
    from statistics import NormalDist

    z = [-9.0, -7.5, -2.0, -0.1, 0.0, 0.3, 1.0, 4.0, 7.9, 12.0]
    cdf = [x["c"] for x in spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.normal_cdf(F.col("z")).alias("c")).orderBy("z").collect()]
    assert all(abs(a - NormalDist().cdf(x)) < 1e-13 for a, x in zip(cdf, z, strict=True))
    assert stats.probabilistic_sharpe(1.0, 2, 0, 3) == 0 and stats.expected_max_sharpe(1, 1.0) == 0
    r = spark.createDataFrame([([5.0, 1.0, None, 3.0],)], "v array<double>").select(stats.nearest_rank(F.col("v"), 50).alias("x")).first()
    assert r["x"] == 3.0


def test_gate(spark):
    rows = [("btc_ohlcv_1m", 1.0, 2.0, 0.5, 1.5), ("btc_ohlcv_1m", 1.0, 0.9, 0.5, 1.5), ("btc_ohlcv_1m", 1.0, 2.0, 0.5, -1.0)]
    cols = "price mark_price index_price funding_rate open_interest qty best_bid best_ask".split()
    df = spark.createDataFrame(rows, "dataset_id string, open double, high double, low double, close double").withColumns({c: F.lit(None).cast("double") for c in cols} | {"side": F.lit(None).cast("string")})
    assert [r["f"] for r in df.select(gate.first_flag(*gate.sanity()).alias("f")).collect()] == [[], ["ohlc_incoherent"], ["nonpositive_price"]]
    ticks = spark.createDataFrame([("k", T0 + timedelta(seconds=20 * i), x) for i, x in enumerate((100.0, 125.0, -1.0, 126.0))], "k string, t timestamp_ntz, price double")
    g = gate.with_continuity(ticks, ("k",), "t", "price", F.col("price") > 0)
    got = g.orderBy("t").select(gate.flags(gate.phantom(F.col("price")), gate.tick_gap(F.col("t"))).alias("f")).collect()
    assert [r["f"] for r in got] == [[], ["phantom_suspect", "illiquid_window"], ["phantom_suspect", "illiquid_window"], ["illiquid_window"]]


def test_audit(spark):
    assert audit.is_select("SELECT 1;") and not audit.is_select("select 1; drop table x") and not audit.is_select("delete from x")
    spark.createDataFrame([(1234, 2.5)], "a int, b double").createOrReplaceTempView("facts")
    assert audit.cited(spark, "SELECT * FROM facts", ["1,234", "2.50"]) and not audit.cited(spark, "SELECT * FROM facts", ["7"])


def test_similar_pairs_misses_none(spark):
    r = random.Random(2)
    sets = [(i, sorted({r.choice("abcdefgh") for _ in range(r.randint(1, 6))})) for i in range(60)]
    got = {(x["a"], x["b"]) for x in similarity.similar_pairs(spark.createDataFrame(sets, "k int, t array<string>"), "k", "t", 0.7).collect()}
    assert got == {(i, j) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.7}


def test_similar_pairs_by_two_tokens(spark):
    """Sets that have to share two tokens, with tokens that a third of them hold."""
    r = random.Random(5)
    sets = [(i, sorted({*r.sample("abcdefghijklmnop", r.randint(4, 9)), *("z" if i % 3 else "")})) for i in range(120)]
    for least in (0.5, 0.6, 0.8):
        got = [(x["a"], x["b"]) for x in similarity.similar_pairs(spark.createDataFrame(sets, "k int, t array<string>"), "k", "t", least).collect()]
        want = {(i, j) for i, a in sets for j, b in sets if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= least}
        assert set(got) == want and len(got) == len(want)


def test_recurrence_over_stretches(spark):
    """Factors of every size, over many blocks and stretches, against a loop."""
    r = random.Random(3)
    rows, want, y = [], [], None
    for i in range(900):
        a = 0.0 if i in (5, 300, 301) else r.choice([0.01, 0.3, 0.9, 0.999, 1.0])
        u = None if i == 300 else r.uniform(-1, 1)
        y = u if a == 0 else None if y is None or u is None else a * y + u
        rows.append(("s", i, a, u)), want.append(y)
    d = spark.createDataFrame(rows, "k string, i long, a double, u double").repartition(3)
    for block in (16, 128):
        got = recurrence.folded(d, ("k",), "i", F.col("a"), [(F.col("u"), "y")], block).orderBy("i").collect()
        assert all((x["y"] is None) == (y is None) and (y is None or math.isclose(x["y"], y, rel_tol=1e-9, abs_tol=1e-12)) for x, y in zip(got, want, strict=True))


def test_ties_and_repeated_rows(spark):
    """Equal times and equal rows give the same whatever the partitions."""
    t0 = datetime(2025, 1, 1)
    points = spark.createDataFrame([("s", t0 + timedelta(minutes=i // 4), float((i * 7) % 11), i) for i in range(80)], "symbol string, t timestamp_ntz, price double, n int")
    seen = set()
    for parts in (1, 3, 7):
        p = points.repartition(parts, "n")
        b = bars.from_points(p, 5, "t", "price", "price", ("symbol",), ("n",)).orderBy("open_time").collect()
        left = spark.createDataFrame([("s", t0 + timedelta(minutes=3))], "symbol string, at timestamp_ntz")
        a = asof.asof(left, p.withColumnRenamed("t", "rt"), ("symbol",), "at", "rt", ("price",), tie=("n",)).first()["price"]
        m = bars.last_per_minute(p, "t", ("price", "n"), ("symbol",), ("n",)).orderBy("minute").collect()
        seen.add((tuple((x["open"], x["close"]) for x in b), a, tuple((x["price"], x["n"]) for x in m)))
    assert len(seen) == 1
    got = seen.pop()
    assert got[0][0] == (0.0, float(19 * 7 % 11)) and got[1] == float(15 * 7 % 11) and got[2][0] == (float(3 * 7 % 11), 3)
    twice = spark.createDataFrame([("s", t0 + timedelta(minutes=9), 1.0)] * 2 + [("s", t0 + timedelta(minutes=9), 2.0)], "symbol string, at timestamp_ntz, close double")
    some = spark.createDataFrame([("s", t0 + timedelta(minutes=8), 5.0), ("s", t0 + timedelta(minutes=8), 1.5)], "symbol string, t timestamp_ntz, liq double")
    sums = asof.trailing_range_sum(twice, some, ("symbol",), "at", "t", 180, "liq", F.col("liq") > F.col("close"), "above").collect()
    assert sorted((x["close"], x["above"]) for x in sums) == [(1.0, 6.5), (1.0, 6.5), (2.0, 5.0)]


def test_as_of_reads_only_its_days(spark, tmp_path):
    t0 = datetime(2026, 7, 23)
    rows = [(f"r{i}", "v", "d", t0 + timedelta(hours=i), t0 + timedelta(hours=i), (t0 + timedelta(hours=i)).date()) for i in range(96)]
    path = str(tmp_path / "records")
    spark.createDataFrame(rows, "record_id string, venue string, dataset_id string, event_time timestamp_ntz, valid_from_sys timestamp_ntz, event_date date").write.partitionBy("dataset_id", "event_date").parquet(path)
    read = bitemporal.read_as_of(bitemporal.with_intervals(spark.read.parquet(path)), "d", t0 + timedelta(days=1), t0 + timedelta(days=1, hours=5), "v")
    assert read.count() == 6
    plan = read._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "event_date" in scan and "dataset_id" in scan


def test_scalars(spark):
    r = spark.createDataFrame([("up 1,234.5% or -3 a: b",)], "t string").select(scalars.numbers_in(F.col("t")).alias("n"), scalars.before_colon(F.col("t")).alias("b"), scalars.word_count(F.col("t")).alias("w"), scalars.plain_number(F.lit("$1,234.5%")).alias("p"), scalars.jaccard(F.expr("array()"), F.expr("array()")).alias("j")).first()
    assert tuple(r) == (["1,234.5%", "-3"], "up 1,234.5% or -3 a", 6, 1234.5, 1.0)
    assert scalars.short_hash({"b": 1, "a": 2}) == scalars.short_hash({"a": 2, "b": 1})


def test_predicate_trees(spark, frame):
    from tidemark.plans import strategy

    tree = {"or": [{"left": {"feature": "close"}, "op": "gt", "right": {"feature": "sma", "args": {"n": 10}}}, {"not": {"left": {"feature": "close", "timeframe": "5m"}, "op": "between", "right": {"param": "hi"}, "right2": 1.0}}]}
    b = strategy.with_features(frame, strategy.features(tree))
    got = [r["x"] for r in b.withColumn("x", strategy.condition(tree, {"hi": 500.0})).orderBy("close_time").collect()]
    x = [r[6] for r in series(400)]
    want = [(i >= 9 and x[i] > sum(x[i - 9 : i + 1]) / 10) or i < 4 for i in range(400)]
    assert got == want
    for bad in ({"and": []}, {"left": 1, "op": "gt", "right": 2}, {"left": {"feature": "magic"}, "op": "gt", "right": 1}, {"left": {"feature": "sma", "args": {"n": 1}}, "op": "gt", "right": 1}, {"left": {"feature": "close"}, "op": "gt", "right": 1, "right2": 2}, {"left": {"feature": "close"}, "op": "eq", "right": 1}):
        with pytest.raises(strategy.Rejected):
            strategy.features(bad)
    with pytest.raises(strategy.Rejected):
        strategy.condition({"left": {"feature": "close"}, "op": "gt", "right": {"param": "none"}})


def test_feeds_in_predicates(spark, frame):
    """Features of feeds as of each bar's close, against loops over points."""
    from tidemark.plans import strategy

    b = frame.select("symbol", "open_time", "close_time", "open", "high", "low", "close", "volume")
    rows = b.orderBy("close_time").collect()
    t0 = rows[0]["open_time"]
    at = lambda m: t0 + timedelta(minutes=m)
    s = rows[0]["symbol"]
    r = random.Random(1)
    book = [(s, at(m), r.uniform(-1, 1)) for m in range(3, 60, 7)]
    oi = [(s, at(m), 1000.0 + m) for m in range(0, 200, 5)]
    funding = [(s, at(m), r.uniform(-1, 1)) for m in range(0, 200, 8)]
    liq = [(s, at(r.randint(0, 200)), r.uniform(90, 110), float(r.randint(1, 9))) for _ in range(40)]
    liq += liq[:2]
    feeds = {"book": spark.createDataFrame(book, "symbol string, time timestamp_ntz, imbalance double"), "open_interest": spark.createDataFrame(oi, "symbol string, time timestamp_ntz, open_interest double"), "funding": spark.createDataFrame(funding, "symbol string, time timestamp_ntz, rate double"), "liquidations": spark.createDataFrame(liq, "symbol string, time timestamp_ntz, price double, notional_usd double")}
    terms = [{"feature": "book_imbalance"}, {"feature": "oi_change", "args": {"n": 3}}, {"feature": "funding_zscore", "args": {"n": 5}}, {"feature": "funding_rate"}, {"feature": "liq_cluster_above", "args": {"n": 30}}, {"feature": "liq_cluster_below", "args": {"n": 30}}]
    got = strategy.with_features(b, {strategy.key(t): t for t in terms}, feeds).orderBy("close_time").collect()
    last = lambda points, t: next((x[2] for x in reversed(points) if x[1] <= t), None)
    change = [(s, x[1], (x[2] - y[2]) / abs(y[2]) * 100) for x, y in zip(oi[3:], oi, strict=False)]
    score = []
    for k in range(4, len(funding)):
        w = [x[2] for x in funding[k - 4 : k + 1]]
        m = sum(w) / 5
        score.append((s, funding[k][1], (w[-1] - m) / (sum((x - m) ** 2 for x in w) / 5) ** 0.5))
    for x in got[:300]:
        t = x["close_time"]
        near = [p for p in liq if t - timedelta(minutes=30) <= p[1] <= t]
        want = [last(book, t), last(change, t), last(score, t), last(funding, t), sum(p[3] for p in near if p[2] > x["close"]), sum(p[3] for p in near if p[2] < x["close"])]
        assert [x[strategy.key(t)] for t in terms] == [None if w is None else pytest.approx(w) for w in want]
    tree = {"and": [{"left": t, "op": "gt", "right": -100.0} for t in terms]}
    assert strategy.signals(b, tree, feeds=feeds).filter("signal").count() > 0 and strategy.signals(b, tree).filter("signal").count() == 0
    with pytest.raises(strategy.Rejected):
        strategy.features({"left": {"feature": "oi_change", "timeframe": "1h", "args": {"n": 3}}, "op": "gt", "right": 0.0})


def test_depth(spark):
    from tidemark.operators import decisions

    df = spark.createDataFrame([([(10.0, 1.0), (9.0, 3.0)], [(11.0, 1.0)])], "b array<struct<price:double,qty:double>>, a array<struct<price:double,qty:double>>")
    assert tuple(df.select(*decisions.depth(F.col("b"), F.col("a"))).first()) == (4.0, 1.0, 0.6)
    assert tuple(df.select(*decisions.depth(F.col("b"), F.col("a"), 1)).first()) == (1.0, 1.0, 0.0)


def test_only_undecided_cases_ask_for_the_spread_rank(spark, monkeypatch):
    """Cases with a veto by funding, few analogs or adverse ones had sent their ranges through the shuffle too."""
    from tidemark.operators import decisions

    asked, plain = [], decisions.smaller_before
    monkeypatch.setattr(decisions, "smaller_before", lambda rows, ranges: asked.extend(r["id"] for r in ranges.collect()) or plain(rows, ranges))
    history = spark.createDataFrame([(T0 - timedelta(days=2 + i), k, 2.0 if k == "b" else 0.1, i / 100) for k in "ab" for i in range(30)], "time timestamp_ntz, key string, adverse_pct double, spread_pct double")
    cases = [(1, T0, "a", "LONG", 0.001, 0.05), (2, T0, "a", "SHORT", 0.001, 0.5), (3, T0, "b", "LONG", None, 0.5), (4, T0 - timedelta(days=20), "a", "LONG", 0.0, 0.5), (5, T0, "a", "LONG", None, 0.05), (6, T0, "c", "LONG", 0.0, 0.5)]
    got = decisions.scrutinised(spark.createDataFrame(cases, "case_id int, time timestamp_ntz, key string, direction string, funding_rate double, spread_pct double"), history)
    want = [(1, "funding_against_position"), (2, "spread_above_percentile"), (3, "analogs_adverse"), (4, "insufficient_analogs"), (5, "analogs_ok"), (6, "insufficient_analogs")]
    assert [(r["case_id"], r["reason"]) for r in got.orderBy("case_id").collect()] == want and sorted(asked) == [2, 5]
