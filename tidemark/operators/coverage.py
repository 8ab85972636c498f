"""Which time slots are covered, and refusal to compute over holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import floored, grid, micros

#: States of a slot, from least to most; none is lowered once reached.
STATES = ("gap", "partial", "complete")


class CoverageError(Exception):
    """A window has slots without data."""


def covered_slots(records: DataFrame, time: str, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return records.select(*keys, floored(F.col(time), seconds).alias("slot")).distinct()


def missing_slots(bounds: DataFrame, start: str, end: str, slots: DataFrame, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The slots of the grid that hold no record."""
    return grid(bounds, start, end, seconds, keys).join(slots, [*keys, "slot"], "left_anti")


def summary(bounds: DataFrame, start: str, end: str, slots: DataFrame, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Expected and missing slots, the covered percentage and the first gap; both counted on the snapped grid."""
    marked = grid(bounds, start, end, seconds, keys).join(slots.withColumn("_has", F.lit(True)), [*keys, "slot"], "left")
    gone = F.col("_has").isNull()
    out = marked.groupBy(*keys).agg(F.count("*").alias("expected"), F.count_if(gone).alias("missing"), F.min(F.when(gone, F.col("slot"))).alias("first_gap"))
    return out.withColumn("pct", (F.col("expected") - F.col("missing")) * 100.0 / F.col("expected"))


def gaps_by_step(records: DataFrame, time: str, seconds: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Missing records by steps between neighbours longer than the grid's, and the first such step."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    step = F.floor((micros(F.col(time)) - micros(before)) / 1_000_000)
    holes = records.withColumn("_before", before).withColumn("_step", step)
    hole = F.col("_step") > seconds
    return holes.groupBy(*keys).agg(F.sum(F.when(hole, F.floor(F.col("_step") / seconds) - 1).otherwise(0)).cast("long").alias("missing"), F.min(F.when(hole, F.col("_before"))).alias("first_gap_after"))


def assert_complete(summary_: DataFrame) -> None:
    """Raises if any row of a summary misses slots."""
    worst = summary_.filter("missing > 0").orderBy(F.desc("missing")).first()
    if worst is not None:
        raise CoverageError(f"{worst['missing']} of {worst['expected']} slots have no data, the first {worst['first_gap']}")


def merged_states(marks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One state for each key: the most that it ever reached, so that complete slots stay complete."""
    rank = F.coalesce(*(F.when(F.col("state") == s, k) for k, s in enumerate(STATES)))
    best = F.max(rank)
    return marks.groupBy(*keys).agg(F.get(F.array(*map(F.lit, STATES)), best.cast("int")).alias("state"))


def stale(age_s: Column, budget_s: Column) -> Column:
    """Older than its budget; never seen is stale, without a budget never."""
    return F.when(budget_s.isNull(), False).when(age_s.isNull(), True).otherwise(age_s > budget_s)
