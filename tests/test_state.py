"""Typed state over several micro-batches against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gate
from tidemark.sources import runs
from tidemark.streaming import state

T0 = datetime(2025, 1, 1)
LEVELS = "array<struct<price:double,qty:double>>"


def run(spark, rows, schema, build, tmp_path, name, files=4):
    """So many files, one micro-batch each."""
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(240)
    return spark.table(name).collect()


def plain_books(rows, depth):
    held, out = {}, []
    for k, t, _, kind, bids, asks in rows:
        if kind == "snapshot":
            held[k] = [{}, {}]
        if k not in held:
            continue
        for side, levels in zip(held[k], (bids, asks), strict=True):
            for p, q in levels or []:
                side.pop(p, None)
                if q:
                    side[p] = q
        b, a = sorted(held[k][0], reverse=True)[:depth], sorted(held[k][1])[:depth]
        out.append((k, t, b[0] if b else None, a[0] if a else None, sum(held[k][0][p] for p in b), sum(held[k][1][p] for p in a)))
    return sorted(out, key=str)


def test_books_over_batches(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for i in range(120):
        side = lambda n: [(float(r.randint(1, 12)), float(r.randint(0, 3))) for _ in range(n)]
        kind = "snapshot" if r.random() < 0.06 else "delta"
        rows.append((r.choice("ab"), T0 + timedelta(seconds=i // 3), i, kind, side(r.randint(0, 4)) or None, side(r.randint(0, 4))))
    schema = f"k string, t timestamp, n int, kind string, bids {LEVELS}, asks {LEVELS}"
    for idle_s in (None, 3600.0):
        path = tmp_path / str(idle_s)
        path.mkdir()
        got = run(spark, rows, schema, lambda s: state.books(s, ("k",), "t", 3, ("n",), idle_s), path, f"books_{idle_s is None}")  # noqa: B023
        assert sorted(((x["k"], x["t"], x["best_bid"], x["best_ask"], x["bid_volume"], x["ask_volume"]) for x in got), key=str) == plain_books(rows, 3)


def test_a_silent_book_is_forgotten(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    one = [(5.0, 1.0)]
    rows = [("a", at(0), 0, "snapshot", one, one), ("b", at(0), 1, "snapshot", one, one), *(("b", at(s), s, "delta", one, None) for s in (400, 800, 801, 802)), ("a", at(803), 803, "delta", one, None), ("b", at(804), 804, "delta", one, None)]
    schema = f"k string, t timestamp, n int, kind string, bids {LEVELS}, asks {LEVELS}"
    for idle_s, n in ((60.0, 1), (3600.0, 2)):
        path = tmp_path / str(idle_s)
        path.mkdir()
        got = run(spark, rows, schema, lambda s: state.books(s, ("k",), "t", idle_s=idle_s), path, f"silent_{int(idle_s)}")  # noqa: B023
        assert len([x for x in got if x["k"] == "a"]) == n and len([x for x in got if x["k"] == "b"]) == 6


def test_gate_of_a_stream_equals_that_of_a_table(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice("ab"), T0 + timedelta(seconds=i // 2), i, None if i % 19 == 0 else float(r.choice([-1, 90, 100, 101, 120, 400]))) for i in range(160)]
    schema = "k string, t timestamp, n int, price double"
    good = (F.col("price") > 0) & (F.col("price") <= 300)
    whole = spark.createDataFrame(rows, schema)
    failed = gate.flags(gate.phantom(F.col("price")))
    want = gate.with_continuity(whole, ("k",), "t", "price", good, ("n",)).select("n", failed.alias("f"), "_prev_price", "_prev_time").filter("n >= 60")
    begun = state.last_accepted(whole.filter("n < 60"), ("k",), "t", "price", good, ("n",))
    got = run(spark, rows[60:], schema, lambda s: state.with_continuity(s, ("k",), "t", "price", good, ("n",), begun).select("n", failed.alias("f"), "_prev_price", "_prev_time"), tmp_path, "gated")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and any(x["f"] for x in got)


def test_a_store_begins_a_key_once_and_is_not_held_with_its_rows(spark, tmp_path):
    """Spark's own initial state is read to its end before a row passes, which had all of a key's rows held."""
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "k string, t timestamp, n int, price double"
    stored = spark.createDataFrame([("a", at(-5), 0, 7.0), ("c", at(-9), 0, 9.0), (None, at(-3), 0, 3.0)], schema)
    price = F.col("price")
    begun = state.last_accepted(stored, ("k",), "t", "price", price > 1)
    # b moves the watermark, by which a and d are forgotten; c comes late, and the bad price of d leaves no state
    rows = [("a", at(0), 0, 8.0), (None, at(0), 1, 0.5), ("d", at(0), 2, 0.5), *(("b", at(s), s, 5.0) for s in (400, 800, 801, 802)), ("a", at(803), 803, 6.0), ("c", at(803), 804, 6.0), ("d", at(804), 805, 4.0)]
    got = run(spark, rows, schema, lambda s: state.with_continuity(s, ("k",), "t", "price", price > 1, initial=begun, idle_s=60.0), tmp_path, "begun_once", files=10)
    before = {x["n"]: (x["_prev_price"], x["_prev_time"]) for x in got if x["n"] != 800}
    assert before == {0: (7.0, at(-5)), 1: (3.0, at(-3)), 2: (None, None), 400: (None, None), 801: (5.0, at(800)), 802: (5.0, at(801)), 803: (None, None), 804: (9.0, at(-9)), 805: (None, None)}
    assert "handleInitialState" not in vars(state._Continuity)


def test_newest_samples(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("ab"), T0 + timedelta(seconds=i), i ^ 3, None if i % 23 == 0 else float(r.randint(1, 50))) for i in range(200)]
    schema = "k string, t timestamp, n long, v double"
    got = run(spark, rows, schema, lambda s: state.latencies(s, ("k",), "t", "n", "v", 20), tmp_path, "newest")
    last = {k: max((x for x in got if x["k"] == k), key=lambda x: x["at"]) for k in "ab"}
    want = runs.latencies(spark.createDataFrame(rows, schema).filter("v is not null"), ("k",), "n", "v", 20).collect()
    assert {(k, x["p50"], x["p95"], x["samples"]) for k, x in last.items()} == {tuple(x) for x in want}


@pytest.mark.parametrize("side,best", [(-1, 9.0), (1, 2.0)])
def test_a_side_keeps_its_order(side, best):
    s = state._Side(side, {5.0: 1.0})
    for p, q in ((9.0, 2.0), (2.0, 1.0), (5.0, 0.0), (7.0, 0.0), (9.0, 3.0)):
        s.put(p, q)
    assert s.best(1)[0] == best and s.best(5)[1] == 4.0 and s.changed == {9.0, 2.0, 5.0, 7.0}


def test_rows_of_a_key_pass_through_a_task_that_holds_few():
    """Whole micro-batches of a key were lists of rows, about 1 kB each."""
    import tracemalloc

    from pyspark.sql import Row

    from tidemark.streaming import coverage

    r, row, n = random.Random(8), Row("k", "t", "n", "v", "state", "_us", "_ms"), 40_000
    made = [(None if i % 9_001 == 0 else r.randrange(9_000), i) for i in range(n)]
    rows = lambda: (row("a", t, i, float(i % 97), ("partial", "complete")[i % 2], (t or 0) // 100, t) for t, i in made)

    def held(walk):
        tracemalloc.start()
        out = walk()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak / n

    last, peak = held(lambda: [x for x in (x["n"] for x in state.in_order(rows(), ("t", "n"), 1_000)) if x % 4_000 == 0])
    assert last == [i for t, i in sorted(made, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) if i % 4_000 == 0] and peak < 100
    assert [x["n"] for x in state.in_order(rows(), ("t",), 1_000)] == [i for t, i in sorted(made, key=lambda x: (x[0] is not None, x[0] or 0))]
    newest, peak = held(lambda: state._Newest(("n",), None, ("k",), "v", 50, "long").few(rows()))
    assert {x["n"] for x in newest} == set(range(n - 50, n)) and peak < 100
    first, peak = held(lambda: coverage._Slots(("t",), None, ("k",), 0).few(rows()))
    assert len(first) == 180 and peak < 100 and all((x["t"] or 0) // 100 == x["_us"] for x in first)


def test_what_a_key_gives_leaves_a_task_in_parts(monkeypatch):
    """Whole micro-batches of a key were lists of dicts before they left."""
    import pickle
    import tracemalloc

    import pandas as pd
    import pyarrow as pa
    from pyspark.sql import Row

    class Held:
        """Stands for the handle of a state and for the state of a key that has none yet."""

        def __getattr__(self, name):
            return lambda *a: Held() if name.startswith("get") and name.endswith("State") else False if name in ("exists", "containsKey") else 0 if name.startswith("get") else ()

    whole = state.in_order
    monkeypatch.setattr(state, "in_order", lambda rows, order: whole(rows, order, 1_000))
    n, given = 40_000, Row("k", "t", "kind", "bids", "asks", "_ms")
    made = state._Books(("t",), 1000, ("k", "t"), 3)
    made.given, made.made = given, pa.schema([("k", pa.string()), ("t", pa.int64()), *((x, pa.float64()) for x in ("bid", "ask", "bids", "asks"))])
    made.init(Held())
    row = lambda i: pickle.dumps(("a", i, "delta" if i else "snapshot", [{"price": float(i % 7), "qty": float(i % 3)}], None, i))
    frames = (pd.DataFrame({"row": [row(i) for i in range(k, k + 1_000)]}) for k in reversed(range(0, n, 1_000)))
    tracemalloc.start()
    at, prices, sizes = 0, {}, []
    for f in made.handleInputRows(("a",), frames, Held()):
        batch = next(state.opened(iter([pa.record_batch({"part": pa.array(f["part"], pa.binary())})])))
        sizes.append(batch.num_rows)
        for r in batch.to_pylist():
            prices[at % 7] = at % 3
            assert r["t"] == at and r["bid"] == max((p for p, q in prices.items() if q), default=None)
            at += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and sizes == [state.PART] * (n // state.PART) and peak / n < 500, peak / n


def test_rows_pass_as_they_are(spark, tmp_path):
    """Nulls among longs, NaN beside null, keys that are null or numbers, and times that pandas has not."""
    nan, t = float("nan"), [T0, datetime(3000, 1, 1), None, T0 + timedelta(microseconds=1)]
    rows = [(1, t[3], 2**53 + 1, nan, [1, None]), (1, t[0], None, None, None), (None, t[1], 2**53 + 3, 5.0, []), (1, t[1], 7, 1.5, [2**53 + 1]), (None, t[3], None, nan, [3]), (2, t[2], 2**53 + 5, 0.5, [None])]
    schema = "k long, t timestamp, n long, price double, more array<long>"
    price = F.col("price")
    got = run(spark, rows, schema, lambda s: state.with_continuity(s, ("k",), "t", "price", price > 1), tmp_path, "as_they_are", files=1)
    last = {(1, t[3]): None, (1, t[0]): None, (None, t[1]): nan, (1, t[1]): nan, (None, t[3]): None, (2, t[2]): None}
    assert sorted((repr(tuple(x)[:6]) for x in got)) == sorted(repr((*r, last[r[0], r[1]])) for r in rows)
