"""Streaming semantics: throttling, delta merges, deduplication and the routed sink; books are in `state`.

State is held for each key, and a reconnect's epoch belongs to the key, so that a new connection starts from nothing.
Within a micro-batch rows are taken in event time, so that a replay gives what the live run gave."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .state import IDLE_S


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _by_key(rows: DataFrame, keys: tuple[str, ...], time: str, schema: str, step: Callable, idle_s: float | None) -> DataFrame:
    """step(what is held or None, a frame in event time) gives what is held next and the frame that goes on.

    A key's state goes once the watermark, which is idle_s behind the newest row, has passed its last row by that much
    again; rows behind the watermark are dropped. With idle_s None state stays for good."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames)).sort_values(time, kind="stable")
        held, out = step(state.get[0] if state.exists else None, f)
        if held is not None:
            state.update((held,))
            if idle_s is not None:
                state.setTimeoutTimestamp(max(int(f["_ms"].max() + idle_s * 1000), state.getCurrentWatermarkMs() + 1))
        yield out

    timed = rows.withColumn("_ms", F.unix_millis(F.col(time).cast("timestamp")))
    if idle_s is not None:
        timed = timed.withWatermark(time, f"{int(idle_s * 1000)} milliseconds")
    return timed.groupBy(*keys).applyInPandasWithState(run, schema, "held string", "append", "NoTimeout" if idle_s is None else "EventTimeTimeout")


def throttled(rows: DataFrame, keys: tuple[str, ...], time: str, every_s: float, idle_s: float | None = IDLE_S) -> DataFrame:
    """A row goes on only when so many seconds of event time have passed since the last that did."""
    names = rows.columns

    def step(held: str | None, f: pd.DataFrame):
        last = pd.Timestamp(held) if held else None
        kept = []
        for k, t in enumerate(f[time]):
            if last is None or (t - last).total_seconds() >= every_s:
                kept.append(k)
                last = t
        return str(last), f.iloc[kept][names]

    return _by_key(rows, keys, time, _kinds(rows, *names), step, idle_s)


def merged(rows: DataFrame, keys: tuple[str, ...], time: str, fields: tuple[str, ...], kind: str = "kind", idle_s: float | None = IDLE_S) -> DataFrame:
    """Snapshots and deltas as full rows: a snapshot sets all fields, a delta those that it has; a delta before
    any snapshot is dropped."""
    out = [*keys, time, *fields]

    def step(text: str | None, f: pd.DataFrame):
        held = json.loads(text) if text else None
        made = []
        for r in f.to_dict("records"):
            if r[kind] == "snapshot":
                held = {f: None if pd.isna(r[f]) else r[f] for f in fields}
            elif held is not None:
                held |= {f: r[f] for f in fields if not pd.isna(r[f])}
            if held is not None:
                made.append({k: r[k] for k in (*keys, time)} | held)
        return None if held is None else json.dumps(held), pd.DataFrame(made, columns=out)

    return _by_key(rows, keys, time, _kinds(rows, *out), step, idle_s)


def confirmed(bars: DataFrame) -> DataFrame:
    """Bars that are final; those in progress go."""
    return bars.filter(F.coalesce("confirm", F.lit(False)))


def deduplicated(rows: DataFrame, key: tuple[str, ...], time: str, late: str) -> DataFrame:
    """The first row of each key; state goes once the watermark has passed it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))


def appended_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes a micro-batch to a folder of its own, so that a retried one replaces what it had written."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")


def routed(failed: Column, clean: Callable[[DataFrame, int], None], quarantine: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows without a failed check go to one place, the others to another. Both are given the
    batch's number, since a batch may come again after a failure."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        clean(batch.filter(F.size(failed) == 0), epoch)
        quarantine(batch.filter(F.size(failed) > 0), epoch)
        batch.unpersist()

    return write
