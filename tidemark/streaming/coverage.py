"""Coverage and latency of feeds while they run: slots by heartbeats and records, feeds that are up but silent, and figures
of each micro-batch for a listener.

A slot of an event feed is complete while its connection is up, since no event may be all that there was; a slot of a record
feed is complete once a record of it came. Both are marks on slots, and a slot keeps the most it ever reached."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.timegrid import floored, micros
from ..operators.coverage import STATES
from .state import IDLE_S, Ordered, _idle, _typed, processed

#: Seconds of event time for which a key's slots are remembered: later marks are told apart only where they are merged.
RECONCILED_S = 15 * 60
SAMPLES = 500


def marks_of_beats(beats: DataFrame, keys: tuple[str, ...], time: str, up: Column, seconds: int) -> DataFrame:
    """keys, time, slot and state of heartbeats: complete while up, partial if not; a slot without any stays a gap."""
    return beats.select(*keys, time, floored(F.col(time), seconds).alias("slot"), F.when(up, "complete").otherwise("partial").alias("state"))


def marks_of_records(records: DataFrame, keys: tuple[str, ...], time: str, seconds: int) -> DataFrame:
    return records.select(*keys, time, floored(F.col(time), seconds).alias("slot"), F.lit("complete").alias("state"))


class _Slots(Ordered):
    def __init__(self, order, idle_ms, keys: tuple[str, ...], kept_us: int):
        super().__init__(order, idle_ms)
        self.keys, self.kept_us, self.row = keys, kept_us, Row(*keys, "slot", "state")

    def declare(self, handle) -> None:
        self.reached = handle.getMapState("reached", "slot_us long", "rank int")

    def forget(self) -> None:
        self.reached.clear()

    def few(self, rows: Iterator[Row]) -> Iterable[Row]:
        """The first row of each slot and state: a later one raises nothing."""
        first: dict[tuple, tuple] = {}
        for r in rows:
            if r["state"] in STATES and r["_us"] is not None:
                k, at = (r["_us"], r["state"]), [(r[c] is not None, r[c]) for c in self.order]
                if k not in first or at < first[k][0]:
                    first[k] = (at, r)
        return [r for _, r in first.values()]

    def step(self, key, batch: Iterator[Row]) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.reached.iterator()}
        changed = {}
        for r in batch:
            rank = STATES.index(r["state"])
            if rank > changed.get(r["_us"], held.get(r["_us"], -1)):
                changed[r["_us"]] = rank
                yield self.row(*(r[k] for k in self.keys), r["slot"], r["state"])
        newest = max([*held, *changed], default=0)
        for at, rank in changed.items():
            if at >= newest - self.kept_us:
                self.reached.updateValue((at,), (rank,))
        for at in held:
            if at < newest - self.kept_us:
                self.reached.removeKey((at,))


def raised(marks: DataFrame, keys: tuple[str, ...], time: str, kept_s: float = RECONCILED_S, idle_s: float | None = IDLE_S) -> DataFrame:
    """The marks of a stream that raise their slot's state, keys, slot and state, in the order of their times. State holds
    the slots of the last `kept_s` before a key's newest; an older one may be raised again, so that a table of what comes
    out is read through `operators.coverage.merged_states`."""
    made = _Slots((time,), _idle(idle_s), keys, int(kept_s * 1_000_000))
    return processed(marks.withColumn("_us", micros(F.col("slot"))), keys, time, made, f"{_typed(marks, (*keys, 'slot'))}, state string")


def silent(beats: DataFrame, records: DataFrame, keys: tuple[str, ...], time: str, seconds: int, late_s: float) -> DataFrame:
    """Heartbeats in whose slot no record of the feed came: a join of two streams, both with the times `late_s` allows. A row
    comes out once the watermark has passed its slot, so that it isn't taken back. records: keys and `time`."""
    late = f"{int(late_s * 1000)} milliseconds"
    b = beats.withWatermark(time, late).withColumn("_slot", floored(F.col(time), seconds))
    # one key name on both sides would be ambiguous
    r = records.withColumn("_at", F.col(time)).withWatermark("_at", late)
    r = r.select(*(F.col(k).alias(f"_r_{k}") for k in keys), "_at", floored(F.col("_at"), seconds).alias("_r_slot")).dropDuplicatesWithinWatermark([*(f"_r_{k}" for k in keys), "_r_slot"])
    near = (F.col("_at") >= F.col(time) - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col("_at") <= F.col(time) + F.expr(f"INTERVAL {seconds} SECONDS"))
    same = F.col("_slot") == F.col("_r_slot")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_r_{k}"))
    return b.join(r, same & near, "left_outer").filter(F.col("_at").isNull()).select(*beats.columns)


def observed(rows: DataFrame, name: str, event_time: str, ingest_time: str) -> DataFrame:
    """rows, of which each micro-batch tells its number, and the median and 95th percentile of their delay in milliseconds."""
    ms = (micros(F.col(ingest_time)) - micros(F.col(event_time))) / 1000
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.percentile_approx(ms, 0.5).alias("p50_ms"), F.percentile_approx(ms, 0.95).alias("p95_ms"))


class Figures(StreamingQueryListener):
    """What `observed` tells of the newest micro-batches, as dicts, oldest first; add it by `spark.streams.addListener`."""

    def __init__(self, name: str, most: int = SAMPLES):
        self.name, self.held = name, deque(maxlen=most)
        self.ended: list[str | None] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        figures = (event.progress.observedMetrics or {}).get(self.name)
        if figures is not None:
            self.held.append({"batch": event.progress.batchId} | figures.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(event.exception)
