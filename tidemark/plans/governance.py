"""Queries over streams, lifecycles, the sealed holdout, the cooldown and the gates."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timegrid import floored
from ..operators import decisions, lifecycle
from ..sources.shared import shared_dir
from ..streaming import live
from .market import KEYS
from .registry import query, table

#: Each event with the first that comes at least an hour later, and the chain of them from a type's first.
_CHAIN = "WITH RECURSIVE e AS (SELECT event_type AS symbol, ts, event_id FROM events), n AS (SELECT symbol, ts, min(ts) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM e), r AS (SELECT symbol, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT n.symbol, n.after FROM r JOIN n ON n.symbol = r.symbol AND n.ts = r.ts WHERE n.after IS NOT NULL)"


def drained(spark: SparkSession, d: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming operator gives for all events, read as a stream until none is left."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # a stream takes a single file only by a pattern; this one matches the table alone, be it a file or a folder
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/{{events}}.parquet")
    made = build(events.withColumn("ts", F.col("ts").cast("timestamp")))
    made.writeStream.format("parquet").option("checkpointLocation", f"{path}-progress").outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(made.schema).parquet(path)


@query("throttled_stream", _CHAIN + " SELECT e.symbol, e.ts, e.event_id FROM e JOIN r USING (symbol, ts)")
def throttled_stream(spark, d):
    """Events of each type at least an hour apart, through the streaming operator."""
    got = drained(spark, d, "throttled", lambda s: live.throttled(s.select(F.col("event_type").alias("symbol"), "ts", "event_id"), KEYS, "ts", 3600.0))
    return got.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@query(
    "merged_stream",
    "WITH k AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, ts, last_value(CASE WHEN event_type IN ('purchase', 'view') THEN value END IGNORE NULLS) OVER v AS mark, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER v AS idx FROM k WHERE g > 0 WINDOW v AS (PARTITION BY user_id, g ORDER BY ts, event_id)",
)
def merged_stream(spark, d):
    """Users' events as snapshots (purchases, which have no idx) and deltas, through the streaming operator."""
    kind = F.col("event_type")

    def build(s: DataFrame) -> DataFrame:
        rows = s.select("user_id", "ts", F.when(kind == "purchase", "snapshot").otherwise("delta").alias("kind"), F.when(kind.isin("purchase", "view"), F.col("value")).alias("mark"), F.when(kind == "click", F.col("value")).alias("idx"))
        return live.merged(rows, ("user_id",), "ts", ("mark", "idx"))

    return drained(spark, d, "merged", build).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "mark", "idx")


@query("arbiter_cooldown", _CHAIN + " SELECT e.event_id, r.ts IS NULL AS cooldown FROM e LEFT JOIN r ON r.symbol = e.symbol AND r.ts = e.ts")
def arbiter_cooldown(spark, d):
    """Entries of each strategy within an hour of the last one that was let through wait."""
    entries = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return decisions.cooled(entries, KEYS, "ts", "event_id", 3600.0).select("event_id", "cooldown")


@query(
    "lifecycle_moves",
    """WITH RECURSIVE q AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE event_type WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'retire' ELSE 'promote' END AS action, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value > 60 END AS passed, CASE WHEN event_id % 3 = 0 THEN 'decay' ELSE '' END AS reason FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS from_state, 'candidate' AS to_state, CAST(NULL AS VARCHAR) AS refused FROM q
UNION ALL SELECT user_id, k, event_id, s, CASE WHEN why IS NOT NULL THEN s WHEN action = 'promote' THEN CASE s WHEN 'candidate' THEN 'paper' WHEN 'paper' THEN 'micro' ELSE 'full' END ELSE 'retired' END, why FROM (SELECT q.user_id, q.k, q.event_id, q.action, r.to_state AS s, CASE
WHEN action = 'promote' THEN CASE WHEN r.to_state = 'retired' THEN 'retired_is_terminal' WHEN r.to_state = 'full' THEN 'no_promotion_from:full' WHEN r.to_state = 'candidate' AND passed IS NULL THEN 'promotion_requires_validation_verdict' WHEN r.to_state = 'candidate' AND NOT passed THEN 'promotion_requires_passing_verdict' END
WHEN action = 'retire' THEN CASE WHEN r.to_state = 'retired' THEN 'already_retired' WHEN reason = '' THEN 'retirement_requires_reason' END
ELSE CASE WHEN r.to_state = 'retired' THEN 'already_retired' WHEN passed IS NULL OR passed THEN 'cannot_reject_a_passing_verdict' WHEN r.to_state <> 'candidate' THEN 'only_candidates_are_rejected' END END AS why FROM r JOIN q ON q.user_id = r.user_id AND q.k = r.k + 1))
SELECT event_id, from_state, to_state, refused FROM r WHERE k > 0""",
)
def lifecycle_moves(spark, d):
    """Events as requests of strategies to go up, to be rejected or to retire."""
    c = F.col
    action = F.when(c("event_type") == "error", "reject").when(c("event_type") == "signup", "retire").otherwise("promote")
    requests = table(spark, d, "events").select("user_id", "ts", "event_id", action.alias("action"), F.when(c("event_id") % 5 != 0, c("value") > 60).alias("passed"), F.when(c("event_id") % 3 == 0, "decay").otherwise("").alias("reason"))
    return lifecycle.moved(requests, ("user_id",), ("ts", "event_id")).select("event_id", "from_state", "to_state", "refused")


@query(
    "holdout_refusals",
    "WITH o AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS holdout, CAST(o_orderdate AS TIMESTAMP) > TIMESTAMP '1998-01-01 00:00:00' AS inside, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS looks FROM orders) SELECT o_orderkey, CASE WHEN holdout AND looks > 1 THEN 'holdout_already_spent' WHEN NOT holdout AND inside THEN 'reaches_into_holdout' END AS refused FROM o",
)
def holdout_refusals(spark, d):
    """Orders as runs: urgent ones mean to look at the sealed days, once for each customer."""
    runs = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("end"), (F.col("o_orderpriority") == "1-URGENT").alias("holdout"))
    return lifecycle.looked(runs, "1998-01-01 00:00:00", ("o_custkey",), ("end", "o_orderkey")).select("o_orderkey", "refused")


@query(
    "gate_report",
    """WITH g AS (SELECT date_trunc('minute', ts) AS slot FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1),
p AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_size = 1) AS passed FROM part), l AS (SELECT count(*) AS n, coalesce(sum(l_tax - l_discount), 0) AS usd FROM lineitem WHERE l_returnflag = 'R'),
d AS (SELECT count(*) AS n, arg_max(value < 400, ts) AS flat, arg_max(value * 5, ts) AS ms, count(*) FILTER (WHERE value < 0) AS unverified FROM events WHERE event_type = 'error'),
b AS (SELECT max(o_totalprice / 100000) FILTER (WHERE o_orderstatus = 'F') AS dsr, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS burns FROM orders)
SELECT 'collector_24h' AS gate, CASE WHEN count(*) = 0 THEN 'NO_DATA' WHEN count(*) >= 1440 * 0.999 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(count(*) AS DOUBLE) AS figure FROM g
UNION ALL SELECT 'generator_honesty', CASE WHEN n < 200 THEN 'NO_DATA' WHEN passed / n < 0.05 THEN 'PASS' ELSE 'FAIL' END, round(passed / greatest(n, 1), 6) FROM p
UNION ALL SELECT 'validated_strategy', CASE WHEN n < 400 THEN 'NO_DATA' WHEN dsr >= 2 AND burns >= 1 THEN 'PASS' ELSE 'FAIL' END, round(coalesce(dsr, 0), 6) FROM b, l
UNION ALL SELECT 'cost_model_honest', CASE WHEN n < 100 THEN 'NO_DATA' WHEN usd <= 0 THEN 'PASS' ELSE 'FAIL' END, round(CAST(usd AS DOUBLE), 6) FROM l
UNION ALL SELECT 'kill_flattens', CASE WHEN n = 0 THEN 'NO_DATA' WHEN flat AND ms < 2000 AND unverified = 0 THEN 'PASS' ELSE 'FAIL' END, round(coalesce(ms, 0), 6) FROM d""",
)
def gate_report(spark, d):
    """The gates over tables that stand for their evidence: errors for drills, values for times."""
    c = F.col
    slots = table(spark, d, "events").select(floored(c("ts").cast("timestamp_ntz"), 60).alias("slot"), F.lit("complete").alias("state")).distinct()
    proposals = table(spark, d, "part").select((c("p_size") == 1).alias("passed"), F.lit(False).alias("leaked"))
    legs = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select((c("l_tax") - c("l_discount")).alias("cost_drift_usd"))
    runs = table(spark, d, "orders").select((c("o_orderstatus") == "F").alias("passed"), (c("o_totalprice") / 100000).alias("deflated_sharpe"), (c("o_orderpriority") == "1-URGENT").alias("holdout"))
    drills = table(spark, d, "events").filter("event_type = 'error'").select(c("ts").cast("timestamp_ntz").alias("at"), (c("value") < 400).alias("flat"), (c("value") * 5).alias("elapsed_ms"), (c("value") < 0).alias("unverified"))
    return lifecycle.gates(slots, proposals, legs, runs, drills, "2024-01-30 00:00:00").withColumn("figure", F.round("figure", 6))
