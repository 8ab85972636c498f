"""Records with event time and system time: what was known when.

Tables are append-only. A correction adds a row with the same natural key; when a row stopped being the truth is
derived from the next row of its key and never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("venue", "dataset_id", "event_time")


def with_intervals(records: DataFrame, key: tuple[str, ...] = KEY, start: str = "valid_from_sys", tie: str = "record_id") -> DataFrame:
    """records with valid_to_sys, when the next row of the key took over. The day of a record follows from its key; it is
    named, so that filters on days go below the window to the scan."""
    day = [c for c in ("event_date",) if c in records.columns and "event_time" in key]
    order = Window.partitionBy(*key, *day).orderBy(start, tie)
    return records.withColumn("valid_to_sys", F.lead(start).over(order))


def visible(as_of: Column | None) -> Column:
    """Rows that were the truth at an instant, or without one those that are now."""
    if as_of is None:
        return F.col("valid_to_sys").isNull()
    return (F.col("valid_from_sys") <= as_of) & (F.col("valid_to_sys").isNull() | (F.col("valid_to_sys") > as_of))


def read_as_of(records: DataFrame, dataset_id: str, start, end, venue: str, as_of=None) -> DataFrame:
    """Event times from start to end, both included. A partition column event_date, where there is one, is
    filtered too, so that whole days are pruned."""
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = records.filter((F.col("dataset_id") == dataset_id) & (F.col("venue") == venue) & F.col("event_time").between(lit(start), lit(end)))
    if "event_date" in records.columns:
        rows = rows.filter(F.col("event_date").between(F.to_date(lit(start)), F.to_date(lit(end))))
    return rows.filter(visible(None if as_of is None else lit(as_of)))


def first_per_key(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key: what a batch keeps when keys repeat."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def new_rows(incoming: DataFrame, stored: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Incoming rows whose key isn't stored yet."""
    return incoming.join(stored.select(*key).distinct(), list(key), "left_anti")


def latest_version(rows: DataFrame, key: tuple[str, ...], version: tuple[Column, ...]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*version)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def corrected(original: DataFrame, changes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The rows to append for corrections: those that change a row that is still open. changes: key, payload,
    valid_from_sys, record_id, correction_reason."""
    open_ = original.filter(visible(None)).select(*key, F.col("record_id").alias("supersedes"))
    return changes.join(open_, list(key)).select(*changes.columns, "supersedes")
