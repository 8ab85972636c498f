"""Audit queries over the event tables. Time slices are half open: from start, before end."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ratio


def sliced(df: DataFrame, time: str, start, end) -> DataFrame:
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    return df.filter((F.col(time) >= lit(start)) & (F.col(time) < lit(end)))


def counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def trading_summary(predictions: DataFrame, realizations: DataFrame, drifts: DataFrame) -> DataFrame:
    """Legs, how many were filled, and what the fills cost more than predicted."""
    leg = ["trade_id", "leg"]
    p = predictions.select(*leg).join(realizations.select(*leg, "status"), leg, "left").join(drifts.select(*leg, "cost_drift_usd", "slippage_bps_drift"), leg, "left")
    filled = F.count_if(F.coalesce(F.col("status") == "reconciled", F.lit(False)))
    return p.agg(
        F.count("*").alias("legs"),
        filled.alias("reconciled"),
        F.count_if(F.coalesce(F.col("status") == "unfilled", F.lit(False))).alias("unfilled"),
        (F.count("*") - F.count("status")).alias("pending"),
        (100.0 * ratio(filled.cast("double"), F.count("*"))).alias("fill_rate_pct"),
        F.coalesce(F.sum("cost_drift_usd"), F.lit(0.0)).alias("cost_drift_usd"),
        F.coalesce(F.avg("slippage_bps_drift"), F.lit(0.0)).alias("avg_slippage_drift_bps"),
    )


def incomplete_by_feed(slots: DataFrame) -> DataFrame:
    return slots.groupBy("feed").agg(F.count_if(F.col("state") != "complete").alias("incomplete"), F.count("*").alias("slots"))


def verdicts(events: DataFrame) -> DataFrame:
    veto = F.count_if(F.col("verdict") == "VETO")
    return events.agg(F.count("*").alias("verdicts"), veto.alias("vetoes"), (100.0 * ratio(veto.cast("double"), F.count("*"))).alias("veto_rate_pct"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))


def without_partner(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows that the other table doesn't account for."""
    return rows.join(others.select(*key).distinct(), key, "left_anti")


def count_parity(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Counts of both tables by key, and whether they agree; keys of either are kept."""
    a = left.groupBy(*key).agg(F.count("*").alias("_a"))
    b = right.groupBy(*key).agg(F.sum("rows").alias("_b"))
    j = a.join(b, key, "full").select(*key, F.coalesce("_a", F.lit(0)).alias("stored"), F.coalesce("_b", F.lit(0)).alias("archived"))
    return j.withColumn("passed", F.col("stored") == F.col("archived"))


_BANNED = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|grant|merge|call|set|use|add|cache|refresh)\b", re.IGNORECASE)


def is_select(sql: str) -> bool:
    """Whether a statement is one plain SELECT."""
    text = sql.strip().rstrip(";").strip()
    return text.lower().startswith("select") and ";" not in text and not _BANNED.search(text)


def cited(spark: SparkSession, sql: str, numbers: list[str]) -> bool:
    """Whether a cited query, run again, still returns every number cited from it."""
    if not is_select(sql):
        raise ValueError("only a SELECT may be cited")
    plain = lambda x: f"{float(str(x).replace(',', '').strip('$%')):.10g}"
    found = {plain(v) for row in spark.sql(sql).collect() for v in row if isinstance(v, int | float) and not isinstance(v, bool)}
    return all(plain(x) in found for x in numbers)
