"""Integrity checks as one report: a row for each check and dataset, whether it passed, what was seen and what that means.

Each check is an aggregation, an anti join or both; a report is their union. No evidence is not a failure of a check on
what there is: a check over nothing passes, with zero seen, as `observed` shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Newest rows that are looked at for their provenance.
NEWEST = 500


def _result(rows: DataFrame, check: str, dataset: Column, passed: Column, detail: str, **observed: Column) -> DataFrame:
    seen = F.map_from_arrays(F.array(*map(F.lit, observed)), F.array(*(c.cast("long") for c in observed.values())))
    return rows.select(F.lit(check).alias("check"), dataset.cast("string").alias("dataset_id"), passed.alias("passed"), seen.alias("observed"), F.when(~passed, F.lit(detail)).otherwise(F.lit("")).alias("detail"))


def row_count_parity(hot: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of each dataset in the store against those that the archive's manifest has. hot: dataset_id; manifest: dataset_id, rows."""
    stored = hot.groupBy("dataset_id").agg(F.count("*").alias("n"))
    held = manifest.groupBy("dataset_id").agg(F.sum("rows").alias("m"))
    both = stored.join(held, "dataset_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return _result(both, "row_count_parity", F.col("dataset_id"), F.col("n") == F.col("m"), "the store and the archive disagree", stored=F.col("n"), archived=F.col("m"))


def coverage_reconciles(ledger: DataFrame, slots: DataFrame) -> DataFrame:
    """Complete slots of the ledger may be more than those of the records, some of which are tiered out, never fewer. ledger:
    dataset_id, slot, state; slots: dataset_id, slot."""
    marked = ledger.groupBy("dataset_id").agg(F.count_if(F.col("state") == "complete").alias("marked"))
    actual = slots.distinct().groupBy("dataset_id").agg(F.count("*").alias("actual"))
    both = marked.join(actual, "dataset_id", "full").select("dataset_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("marked", "actual")))
    return _result(both, "coverage_reconciles", F.col("dataset_id"), F.col("marked") >= F.col("actual"), "the ledger has fewer complete slots than there are records", complete_slots=F.col("marked"), record_slots=F.col("actual"))


def none_without(rows: DataFrame, others: DataFrame, keys: tuple[str, ...], check: str, detail: str) -> DataFrame:
    """No row lacks a partner: orders have predictions, generated strategies have their generation."""
    same = rows.select(*keys).join(others.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("n"))
    return _result(same, check, F.lit(None), F.col("n") == 0, detail, without=F.col("n"))


def newest_have(rows: DataFrame, others: DataFrame, keys: tuple[str, ...], order: str, check: str, detail: str, newest: int = NEWEST) -> DataFrame:
    """The newest rows have a partner: verdicts have the text that they were made from."""
    some = rows.orderBy(F.desc(order), *keys).limit(newest)
    met = some.join(others.select(*keys).distinct().withColumn("_there", F.lit(True)), list(keys), "left")
    counted = met.agg(F.count("*").alias("n"), F.count_if(F.col("_there").isNull()).alias("missing"))
    return _result(counted, check, F.lit(None), F.col("missing") == 0, detail, checked=F.col("n"), missing=F.col("missing"))


def report(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def overall(report_: DataFrame) -> DataFrame:
    """One row: how many checks, how many failed, and their names."""
    failed = F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("check"))))
    return report_.agg(F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"), failed.alias("names"))
