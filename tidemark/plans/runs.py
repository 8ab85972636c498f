"""Queries over runs, feeds and books: staleness, corrections at several instants, outcomes, latencies, export columns,
appended upserts, tier-out and depth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitemporal, coverage, decisions, indicators, replay, validation
from ..sources import runs
from .market import KEYS, W, _numbered, hourly, last, order, sql_bars, ticks
from .records import _VERSIONS, versions
from .registry import query, r6, table

#: Instants at which corrections are read.
INSTANTS = ("1996-01-01 00:00:00", "1998-06-30 00:00:00", "2001-01-01 00:00:00")


@query(
    "stale_feeds",
    "WITH f AS (SELECT event_type AS feed, max(ts) AS newest FROM events GROUP BY 1), a AS (SELECT feed, floor((epoch_us(max(newest) OVER ()) - epoch_us(newest)) / 1e6) AS age_s, CASE feed WHEN 'view' THEN 3 WHEN 'purchase' THEN 75 WHEN 'click' THEN 7200 WHEN 'signup' THEN 120 END AS budget_s FROM f) SELECT feed, CAST(age_s AS BIGINT) AS age_s, budget_s IS NOT NULL AND age_s > budget_s AS stale FROM a",
)
def stale_feeds(spark, d):
    """Each feed's age at the newest record of all, against its budget; one feed has none."""
    c = F.col
    feeds = table(spark, d, "events").groupBy(c("event_type").alias("feed")).agg(F.max(c("ts").cast("timestamp")).alias("newest"))
    # one row for each feed
    micros = F.unix_micros("newest")
    aged = feeds.withColumn("age_s", F.floor((F.max(micros).over(Window.partitionBy()) - micros) / 1_000_000))
    budget = F.when(c("feed") == "view", 3).when(c("feed") == "purchase", 75).when(c("feed") == "click", 7200).when(c("feed") == "signup", 120)
    return aged.select("feed", "age_s", coverage.stale(c("age_s"), budget).alias("stale"))


@query("corrections_at_instants", f"WITH {_VERSIONS}, i AS (SELECT unnest([{', '.join(f"TIMESTAMP '{x}'" for x in INSTANTS)}]) AS instant) SELECT instant, count(*) AS n, round(sum(price), 2) AS total FROM v JOIN i ON valid_from_sys <= instant AND (valid_to_sys IS NULL OR valid_to_sys > instant) GROUP BY 1")
def corrections_at_instants(spark, d):
    """What was the truth at three instants, from one scan of the versions."""
    at = F.explode(F.array(*(F.lit(x).cast("timestamp_ntz") for x in INSTANTS)))
    read = versions(spark, d).withColumn("instant", at).filter(bitemporal.visible(F.col("instant")))
    return read.groupBy("instant").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("verdict_outcomes", "WITH s AS (SELECT * FROM labels WHERE toxic IS NOT NULL ORDER BY doc_id DESC LIMIT 100) SELECT count(*) AS sample, count(*) FILTER (WHERE quality = 1) AS approvals, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS approvals_that_went_adverse, count(*) FILTER (WHERE quality = 0) AS vetoes, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS vetoes_that_avoided_adverse FROM s")
def verdict_outcomes(spark, d):
    """How the newest hundred verdicts turned out: a digest of the latest."""
    c = F.col
    verdicts = table(spark, d, "labels").select(c("doc_id").alias("at"), F.when(c("quality") == 1, "APPROVE").when(c("quality") == 0, "VETO").alias("verdict"), (c("toxic") == 1).alias("realized_adverse"), c("toxic").isNotNull().alias("realized_known"))
    return runs.outcomes(verdicts)


@query(
    "latency_percentiles",
    "WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events), s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM n WHERE k <= 500) SELECT event_type, max(value) FILTER (WHERE i = round_even(0.5 * (c - 1), 0)) AS p50, max(value) FILTER (WHERE i = round_even(0.95 * (c - 1), 0)) AS p95, count(*) AS samples FROM s GROUP BY 1",
)
def latency_percentiles(spark, d):
    """Nearest-rank percentiles of each feed's newest 500 samples."""
    return runs.latencies(table(spark, d, "events"), ("event_type",), "event_id", "value")


@query("downsampled_curve", "WITH c AS (SELECT event_type AS symbol, event_id, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT symbol, event_id, price FROM c WHERE i % CAST(ceil(n / 50.0) AS BIGINT) = 0 OR i = n - 1")
def downsampled_curve(spark, d):
    """A curve for display: every so many points and the last."""
    return replay.downsampled(ticks(spark, d).select("symbol", "event_id", "price"), KEYS, "event_id", 50)


@query("training_rows", "SELECT event_type, count(*) AS n FROM events WHERE NOT (event_id >= 350 AND event_id < 675) GROUP BY 1")
def training_rows(spark, d):
    """Rows to train on where [400, 600) is tested, purged by 50 on both sides and 25 embargoed."""
    return validation.kept_for_training(table(spark, d, "events"), "event_id", 400, 600, 50, 25).groupBy("event_type").agg(F.count("*").alias("n"))


@query("first_kept_upserts", "SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def first_kept_upserts(spark, d):
    """Upserts as a view of appended events: the first type stays, the last value counts."""
    return runs.first_kept(table(spark, d, "events"), ("user_id",), F.col("event_id"), ("event_type",), ("value",))


@query("replay_counters", "SELECT user_id, event_type, count(*) AS replays, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2")
def replay_counters(spark, d):
    return runs.counted(table(spark, d, "events"), ("user_id", "event_type"), "ts")


@query(
    "due_for_tier_out",
    "WITH p AS (SELECT CAST(ts AS DATE) AS event_date, max(CASE event_type WHEN 'view' THEN 48 WHEN 'click' THEN 240 ELSE 240 END) AS hours FROM events GROUP BY 1) SELECT event_date, CAST(hours AS INTEGER) AS hours FROM p WHERE CAST(event_date AS TIMESTAMP) + INTERVAL 1 DAY + hours * INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25 00:00:00'",
)
def due_for_tier_out(spark, d):
    """Days older than the longest window of their datasets; datasets without a window have the longest."""
    parts = table(spark, d, "events").select(F.to_date("ts").alias("event_date"), F.col("event_type").alias("dataset_id")).distinct()
    return runs.due_for_tier_out(parts, {"view": 48, "click": 240}, "2024-01-25 00:00:00").select("event_date", "hours")


@query(
    "export_atr_14",
    f"WITH RECURSIVE {_numbered()}, r AS (SELECT symbol, CAST(14 AS BIGINT) AS i, avg(tr) AS a FROM y WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT y.symbol, y.i, (r.a * 13 + y.tr) / 14 FROM r JOIN y ON y.symbol = r.symbol AND y.i = r.i + 1) SELECT y.symbol, close_time, round(a, 6) AS atr FROM y LEFT JOIN r ON y.symbol = r.symbol AND y.i = r.i",
)
def export_atr_14(spark, d):
    return indicators.export_atr(hourly(spark, d), 14, KEYS).select("symbol", "close_time", r6("atr"))


@query("export_volatility_20", f"WITH {sql_bars()}, r AS (SELECT symbol, close_time, close / lag(close) OVER ({W}) - 1 AS r FROM b) SELECT symbol, close_time, round(CASE WHEN count(r) OVER {last(20)} = 20 THEN stddev_pop(r) OVER {last(20)} END, 6) AS volatility FROM r")
def export_volatility_20(spark, d):
    b = hourly(spark, d).withColumn("r", F.col("close") / F.lag("close").over(order()) - 1)
    return b.withColumn("volatility", indicators.export_volatility(F.col("close"), F.col("r"), 20, order())).select("symbol", "close_time", r6("volatility"))


@query(
    "book_depth",
    "WITH l AS (SELECT l_orderkey, l_returnflag = 'N' AS bid, l_quantity AS qty, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'N' ORDER BY l_extendedprice * (CASE WHEN l_returnflag = 'N' THEN -1 ELSE 1 END), l_quantity * (CASE WHEN l_returnflag = 'N' THEN -1 ELSE 1 END)) AS k FROM lineitem), s AS (SELECT l_orderkey, coalesce(sum(qty) FILTER (WHERE bid AND k <= 2), 0) AS b, coalesce(sum(qty) FILTER (WHERE NOT bid AND k <= 2), 0) AS a FROM l GROUP BY 1) SELECT l_orderkey, b AS bid_volume, a AS ask_volume, round(CASE WHEN a + b > 0 THEN (b - a) / (b + a) ELSE 0 END, 6) AS imbalance FROM s",
)
def book_depth(spark, d):
    """Two levels of each side of a book of an order's lines: those not returned bid, the others ask."""
    c, bid = F.col, F.col("l_returnflag") == "N"
    sign = F.when(bid, -1).otherwise(1)
    # the best levels are chosen before any are collected, so that an order of many lines is never held whole
    best = Window.partitionBy("l_orderkey", "bid").orderBy(c("l_extendedprice") * sign, c("l_quantity") * sign)
    levels = table(spark, d, "lineitem").withColumn("bid", bid).withColumn("k", F.row_number().over(best)).filter("k <= 2")
    side = lambda which: F.collect_list(F.when(which, F.struct(c("l_extendedprice").alias("price"), c("l_quantity").alias("qty"))))
    books = levels.groupBy("l_orderkey").agg(side(c("bid")).alias("bids"), side(~c("bid")).alias("asks"))
    b, a, imbalance = decisions.depth(F.col("bids"), F.col("asks"), 2)
    return books.select("l_orderkey", b.alias("bid_volume"), a.alias("ask_volume"), F.round(imbalance, 6).alias("imbalance"))
