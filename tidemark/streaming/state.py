"""Streaming operators on typed state: books by level, the gate's last accepted price, and the newest samples.

State is held for each key in typed variables of a RocksDB store (`typed` sets it for the session), so that a micro-batch
writes what has changed and not a key's whole state. Rows of a micro-batch are taken in the order of the columns that are
named, so that a replay gives what the live run gave; a micro-batch's rows of one key are held by one task.

A key that is silent for `idle_s` of event time is forgotten: a timer goes off when the watermark, which follows the newest
row by that much, has passed its last row by that much again. With idle_s None state stays for good and nothing is late.

A micro-batch may hold any number of a key's rows: they pass one by one. Where only some of them count, `Ordered.few` picks
them as they pass; where all do, they are sorted in runs that lie in the task's scratch folder (`in_order`). What comes out
leaves a task in parts of so many rows, since Spark holds all rows that a call of a row-wise processor gives. Rows are
packed into binaries on both ways: a pandas frame of their columns would take nulls for NaN and longs for doubles."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of event time after which a silent key is forgotten.
IDLE_S = 86_400.0
DEPTH, SAMPLES = 20, 500
#: Rows of a key that a task holds at once, those of a sorted run that it reads back at a time, and those of a part that it gives.
RUN, PIECE, PART = 20_000, 100, 5_000


def _typed(rows: DataFrame, names: Iterable[str]) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)


def in_order(rows: Iterable[Row], order: tuple[str, ...], run: int = RUN) -> Iterator[Row]:
    """rows by the columns of `order`, nulls first and equal ones as they came; only `run` of them are held at a time."""
    rows = iter(rows)
    held = list(islice(rows, run))
    if not held:
        return
    row = Row(*held[0].__fields__)
    at = [row.index(c) for c in order]  # a row looks a name up each time
    place = lambda r: [(r[k] is not None, r[k]) for k in at]
    held.sort(key=place)
    if len(held) < run:
        yield from held
        return
    with tempfile.TemporaryFile() as scratch:
        runs: list[list[int]] = []
        while held:
            runs.append([])
            for k in range(0, len(held), PIECE):
                runs[-1].append(scratch.tell())
                pickle.dump([tuple(r) for r in held[k : k + PIECE]], scratch)
            held = sorted(islice(rows, run), key=place)

        def read(pieces: list[int]) -> Iterator[Row]:
            for at in pieces:
                scratch.seek(at)
                for values in pickle.load(scratch):
                    yield row(*values)

        yield from heapq.merge(*map(read, runs), key=place)


class Ordered(StatefulProcessor):
    """Gives the rows of a key in order to `step`, and forgets the key when its timer goes off. `processed` tells it what
    columns a row has that comes in, and the Arrow schema of those that go out."""

    given: Row
    made: pa.Schema

    def __init__(self, order: tuple[str, ...], idle_ms: int | None):
        self.order, self.idle_ms = order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.declare(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, ms = None, self.given.index("_ms")
        head = next(rows)
        if "first" in head and head["first"].iloc[0] is not None:
            self.begin(pickle.loads(head["first"].iloc[0]))

        def seen() -> Iterator[Row]:
            nonlocal latest
            for frame in chain((head,), rows):
                for packed in frame["row"]:
                    values = pickle.loads(packed)
                    if values[ms] is not None and (latest is None or values[ms] > latest):
                        latest = values[ms]
                    yield self.given(*values)

        for part in parts(self.step(key, in_order(self.few(seen()), self.order)), self.made):
            yield pd.DataFrame({"part": [part]})
        if self.idle_ms is not None and latest is not None:
            due = latest + self.idle_ms
            for t in list(self.handle.listTimers()):
                due = max(due, t)
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))

    def begin(self, row: tuple) -> None:
        """Takes the values of a key's row of `initial`, which come with each micro-batch of the key."""

    def few(self, rows: Iterator[Row]) -> Iterable[Row]:
        """Those of a micro-batch's rows that matter to `step`, whatever their order."""
        return rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


def parts(rows: Iterable[Row], schema: pa.Schema, size: int = PART) -> Iterator[bytes]:
    """rows in Arrow streams of `size` rows; only those of one are held at a time."""
    rows = iter(rows)
    while some := list(islice(rows, size)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_batch(pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema))
        yield sink.getvalue().to_pybytes()


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.column(0):
            yield from pa.ipc.open_stream(part.as_buffer())


def _packed(rows: DataFrame, keys: tuple[str, ...], at: Column | None = None) -> DataFrame:
    """rows as binaries, with what tells their keys apart and `at`."""
    names = rows.columns
    key = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(zip(*(c.to_pylist() for c in batch.columns[: len(names)]), strict=True))
            made = {"key": pa.array([repr([v[k] for k in key]) for v in values], pa.string()), "row": pa.array([pickle.dumps(v, 5) for v in values], pa.binary())}
            yield pa.record_batch(made | {"at": c for c in batch.columns[len(names) :]})

    return rows.select("*", *([] if at is None else [at.alias("_at")])).mapInArrow(run, "key string, row binary" + ("" if at is None else ", at timestamp"))


def processed(rows: DataFrame, keys: tuple[str, ...], time: str, made: Ordered, schema: str, initial: DataFrame | None = None) -> DataFrame:
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = rows.withColumn("_ms", F.unix_millis(F.col(time).cast("timestamp")))
    made.given, made.made = Row(*timed.columns), spark.createDataFrame([], schema).toArrow().schema
    if made.idle_ms is None:
        packed = _packed(timed, keys)
    else:
        # pandas has no times before 1677 or after 2262
        at = F.least(F.greatest(F.col(time).cast("timestamp"), F.lit("1700-01-01").cast("timestamp")), F.lit("2200-01-01").cast("timestamp"))
        packed = _packed(timed, keys, F.when(F.col(time).isNotNull(), at)).withWatermark("at", f"{made.idle_ms} milliseconds")
    if initial is not None:
        # as Spark's own initial state it would have all of a key's rows held until it is read
        packed = packed.join(_packed(initial, keys).withColumnRenamed("row", "first"), "key", "left")
    given = packed.groupBy("key").transformWithStateInPandas(made, "part binary", "append", "none" if made.idle_ms is None else "eventtime")
    return given.mapInArrow(opened, schema)


def _idle(idle_s: float | None) -> int | None:
    return None if idle_s is None else int(idle_s * 1000)


class _Side:
    """One side of a book in a micro-batch: levels by price, best first, and which of them have changed."""

    def __init__(self, sign: int, levels: dict[float, float]):
        self.sign, self.levels, self.changed = sign, levels, set()
        self.prices = sorted(sign * p for p in levels)
        self.top: dict[int, tuple[float | None, float]] = {}

    def put(self, price: float, qty: float) -> None:
        self.changed.add(price)
        self.top.clear()
        at = bisect_left(self.prices, self.sign * price)
        held = price in self.levels
        if qty:
            if not held:
                insort(self.prices, self.sign * price)
            self.levels[price] = qty
        elif held:
            del self.prices[at], self.levels[price]

    def best(self, depth: int) -> tuple[float | None, float]:
        if depth not in self.top:
            some = [self.sign * p for p in self.prices[:depth]]
            self.top[depth] = (some[0] if some else None), sum(self.levels[p] for p in some)
        return self.top[depth]


class _Books(Ordered):
    def __init__(self, order, idle_ms, names: tuple[str, ...], depth: int):
        super().__init__(order, idle_ms)
        self.names, self.depth = names, depth
        self.row = Row(*names, "best_bid", "best_ask", "bid_volume", "ask_volume")

    def declare(self, handle) -> None:
        self.begun = handle.getValueState("begun", "yes boolean")
        self.stored = [handle.getMapState(n, "price double", "qty double") for n in ("bids", "asks")]

    def forget(self) -> None:
        self.begun.clear()
        for s in self.stored:
            s.clear()

    def step(self, key, batch: Iterator[Row]) -> Iterator[Row]:
        begun, fresh = self.begun.exists(), False
        sides = [_Side(sign, {p[0]: q[0] for p, q in s.iterator()} if begun else {}) for sign, s in zip((-1, 1), self.stored, strict=True)]
        kind, bids_at, asks_at, *kept = map(self.given.index, ("kind", "bids", "asks", *self.names))
        for r in batch:
            if r[kind] == "snapshot":
                begun, fresh = True, True
                sides = [_Side(-1, {}), _Side(1, {})]
            if not begun:
                continue
            for side, levels in zip(sides, (r[bids_at], r[asks_at]), strict=True):
                for level in levels or ():
                    side.put(float(level["price"]), float(level["qty"]))
            (bid, bids), (ask, asks) = (s.best(self.depth) for s in sides)
            yield self.row(*(r[k] for k in kept), bid, ask, float(bids), float(asks))
        if not begun:
            return
        self.begun.update((True,))
        for side, stored in zip(sides, self.stored, strict=True):
            if fresh:  # a snapshot left nothing of what was before
                stored.clear()
            for p in side.changed:
                if p in side.levels:
                    stored.updateValue((p,), (side.levels[p],))
                elif not fresh and stored.containsKey((p,)):
                    stored.removeKey((p,))


def books(rows: DataFrame, keys: tuple[str, ...], time: str, depth: int = DEPTH, ties: tuple[str, ...] = (), idle_s: float | None = IDLE_S) -> DataFrame:
    """Order books from snapshots and deltas, `bids` and `asks` as arrays of (price, qty): a snapshot replaces all
    levels, a quantity of 0 removes one, and a delta before a snapshot is dropped. A row with its keys, time and ties for each
    row that a book has seen, with its best prices and the volumes of `depth` levels. Levels are entries of a map, written as they change."""
    names = (*keys, time, *ties)
    made = _Books((time, *ties), _idle(idle_s), names, depth)
    return processed(rows, keys, time, made, f"{_typed(rows, names)}, best_bid double, best_ask double, bid_volume double, ask_volume double")


class _Continuity(Ordered):
    def __init__(self, order, idle_ms, names: list[str], price: str, time: str):
        super().__init__(order, idle_ms)
        self.names, self.price, self.time = names, price, time
        self.row = Row(*names, "_prev_price", "_prev_time")

    def declare(self, handle) -> None:
        self.last = handle.getValueState("last", "price double, time timestamp, stored boolean")

    def forget(self) -> None:
        if self.last.exists() and self.last.get()[2]:  # the store begins a key but once
            self.last.update((None, None, True))
        else:
            self.last.clear()

    def begin(self, row: tuple) -> None:
        if not self.last.exists():
            self.last.update((*row[-2:], True))

    def step(self, key, batch: Iterator[Row]) -> Iterator[Row]:
        price, time, stored = tuple(self.last.get()) if self.last.exists() else (None, None, False)
        for r in batch:
            yield self.row(*(r[n] for n in self.names), price, time)
            if r["_accepted"] and r[self.price] is not None:
                price, time = float(r[self.price]), r[self.time]
        if time is not None:
            self.last.update((price, time, stored))


def last_accepted(stored: DataFrame, keys: tuple[str, ...], time: str, price: str, accepted: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """The price and time of each key's newest accepted row of a store, to begin a stream's state with."""
    at = F.struct(F.col(time), *ties, F.col(price))
    newest = stored.filter(accepted & F.col(price).isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(F.col(price).cast("double").alias("p"), F.col(time).cast("timestamp").alias("t")), at).alias("_last"))
    return newest.select(*keys, F.col("_last.p").alias("_prev_price"), F.col("_last.t").alias("_prev_time"))


def with_continuity(rows: DataFrame, keys: tuple[str, ...], time: str, price: str, accepted: Column, ties: tuple[str, ...] = (), initial: DataFrame | None = None, idle_s: float | None = IDLE_S) -> DataFrame:
    """What `gate.with_continuity` gives, of a stream: rows with `_prev_price` and `_prev_time`, those of the last accepted
    row before, be it of the stream or, through `initial` (see `last_accepted`), of the store. The gate's rules
    are Columns over them."""
    names = rows.columns
    made = _Continuity((time, *ties, price), _idle(idle_s), names, price, time)
    marked = rows.withColumn("_accepted", F.coalesce(accepted, F.lit(False)))
    return processed(marked, keys, time, made, f"{_typed(rows, names)}, _prev_price double, _prev_time timestamp", initial)


class _Newest(Ordered):
    def __init__(self, order, idle_ms, keys: tuple[str, ...], value: str, last: int, kind: str):
        super().__init__(order, idle_ms)
        self.keys, self.value, self.most, self.kind = keys, value, last, kind
        self.row = Row(*keys, "at", "p50", "p95", "samples")

    def declare(self, handle) -> None:
        self.samples = handle.getListState("samples", f"at {self.kind}, value double")

    def forget(self) -> None:
        self.samples.clear()

    def few(self, rows: Iterator[Row]) -> Iterable[Row]:
        at = self.order[0]
        return heapq.nlargest(self.most, (r for r in rows if r[self.value] is not None), key=lambda r: (r[at], float(r[self.value])))

    def step(self, key, batch: Iterator[Row]) -> Iterator[Row]:
        batch = list(batch)
        new = [(r[self.order[0]], float(r[self.value])) for r in batch]
        if not new:
            return
        held = [tuple(x) for x in self.samples.get()] if self.samples.exists() else []
        # late rows find their place; only the newest stay
        held = sorted(held + new)[-self.most :]
        self.samples.put(held)
        values = sorted(v for _, v in held)
        rank = lambda p: values[round(p * (len(values) - 1))]
        yield self.row(*(batch[0][k] for k in self.keys), held[-1][0], rank(0.5), rank(0.95), len(held))


def latencies(rows: DataFrame, keys: tuple[str, ...], time: str, order: str, value: str, last: int = SAMPLES, idle_s: float | None = IDLE_S) -> DataFrame:
    """Nearest-rank median and 95th percentile of each key's newest `last` samples after each micro-batch, newest by
    `order`, which is `at` of the row that comes out. A ring buffer: what is older goes, however many come."""
    made = _Newest((order,), _idle(idle_s), keys, value, last, rows.schema[order].dataType.simpleString())
    return processed(rows, keys, time, made, f"{_typed(rows, keys)}, at {rows.schema[order].dataType.simpleString()}, p50 double, p95 double, samples long")
