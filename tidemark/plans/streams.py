"""Queries over streams with typed state and over paged history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timegrid import floored
from ..operators import coverage, gate
from ..sources import history
from ..streaming import coverage as live_coverage
from ..streaming import state
from .governance import drained
from .market import KEYS, ticks
from .registry import query, r6, table

#: Slots of a page of the recorded history, and the instant from which ticks come as a stream.
PAGE, LIVE_FROM = 2000, "2024-01-15 00:00:00"
_STORED = "(event_id // 2000) % 3 = 0 OR event_id % 7 = 0"


@query("history_sync", f"SELECT event_id, event_type AS symbol, round(value, 6) AS value FROM events WHERE NOT ({_STORED}) AND event_id >= 50")
def history_sync(spark, d):
    """Events as a venue's history: of a third of its pages all is stored, of the others a seventh. Pages that are
    whole aren't asked for, nor is what the filter leaves out."""
    events = table(spark, d, "events")
    first, last = events.agg(F.coalesce(F.min("event_id"), F.lit(0)), F.coalesce(F.max("event_id"), F.lit(0))).first()
    # pages begin at a multiple of their size
    first -= first % PAGE
    stored = events.filter((F.floor(F.col("event_id") / PAGE) % 3 == 0) | (F.col("event_id") % 7 == 0)).select("event_id")
    got = history.synced(spark, stored, "event_id", first, last, 1, PAGE, "tidemark.sources.history:recorded", path=f"{d}/events.parquet", columns="event_type,event_type,event_id,value")
    return got.filter("event_ms >= 50").select(F.col("event_ms").alias("event_id"), "symbol", F.round(F.col("payload").cast("double"), 6).alias("value"))


#: A deterministic book of each type of event: see books_stream.
_LEVELS = "l AS (SELECT event_type AS symbol, ts, event_id, event_id % 400 < 5 AS fresh, event_id % 2 = 0 AS bid, CASE WHEN event_id % 2 = 0 THEN 100 - user_id % 50 ELSE 101 + user_id % 50 END AS price, CASE WHEN event_id % 400 < 5 THEN 1 ELSE event_id % 3 END AS qty FROM events)"


@query(
    "books_stream",
    f"WITH {_LEVELS}, f AS (SELECT symbol, arg_max(event_id, (ts, event_id)) AS id, max((ts, event_id)) AS at FROM l WHERE fresh GROUP BY 1), s AS (SELECT l.*, row_number() OVER (PARTITION BY l.symbol, bid, price ORDER BY ts DESC, event_id DESC) AS k FROM l JOIN f ON l.symbol = f.symbol AND (l.ts, l.event_id) >= f.at), h AS (SELECT *, row_number() OVER (PARTITION BY symbol, bid ORDER BY CASE WHEN bid THEN -price ELSE price END) AS place FROM s WHERE k = 1 AND qty > 0) SELECT f.symbol, CAST(max(price) FILTER (WHERE bid AND place = 1) AS DOUBLE) AS best_bid, CAST(max(price) FILTER (WHERE NOT bid AND place = 1) AS DOUBLE) AS best_ask, CAST(coalesce(sum(qty) FILTER (WHERE bid AND place <= 20), 0) AS DOUBLE) AS bid_volume, CAST(coalesce(sum(qty) FILTER (WHERE NOT bid AND place <= 20), 0) AS DOUBLE) AS ask_volume FROM f LEFT JOIN h ON h.symbol = f.symbol GROUP BY f.symbol",
)
def books_stream(spark, d):
    """Each type's events as changes of a book, every now and then a snapshot: the last state of the books of a drained stream."""

    def build(s):
        c = F.col
        even, fresh = c("event_id") % 2 == 0, c("event_id") % 400 < 5
        price = F.when(even, 100 - c("user_id") % 50).otherwise(101 + c("user_id") % 50)
        level = F.array(F.struct(price.cast("double").alias("price"), F.when(fresh, 1).otherwise(c("event_id") % 3).cast("double").alias("qty")))
        rows = s.select(c("event_type").alias("symbol"), "ts", "event_id", F.when(fresh, "snapshot").otherwise("delta").alias("kind"), F.when(even, level).alias("bids"), F.when(~even, level).alias("asks"))
        return state.books(rows, KEYS, "ts", ties=("event_id",))

    got = drained(spark, d, "books", build)
    last = F.max_by(F.struct("best_bid", "best_ask", "bid_volume", "ask_volume"), F.struct("ts", "event_id"))
    return got.groupBy("symbol").agg(last.alias("b")).select("symbol", "b.*")


_STREAMED = "WITH p AS (SELECT *, last_value(CASE WHEN value > 0 AND value <= 300 THEN value END IGNORE NULLS) OVER w AS pp, last_value(CASE WHEN value > 0 AND value <= 300 THEN ts END IGNORE NULLS) OVER w AS pt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(
    "quality_flags_stream",
    f"{_STREAMED} SELECT event_id, concat_ws(',', CASE WHEN value <= 0 THEN 'nonpositive_price' END, CASE WHEN value > 300 THEN 'implausible_price' END, CASE WHEN pp > 0 AND abs(value - pp) / pp * 100 > 5 THEN 'phantom_suspect' END) AS failed, CASE WHEN epoch_us(ts) - epoch_us(pt) > 15000000 THEN 'illiquid_window' ELSE '' END AS noted FROM p WHERE ts >= TIMESTAMP '{LIVE_FROM}'",
)
def quality_flags_stream(spark, d):
    """Ticks before an instant are stored; those after it are gated as a stream, whose state begins with the store's."""
    live_from = F.lit(LIVE_FROM).cast("timestamp_ntz")
    good = (F.col("price") > 0) & (F.col("price") <= 300)
    stored = ticks(spark, d).filter(F.col("ts") < live_from)
    begun = state.last_accepted(stored, KEYS, "ts", "price", good, ("event_id",))

    def build(s):
        rows = s.filter(F.col("ts") >= live_from.cast("timestamp")).select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))
        made = state.with_continuity(rows, KEYS, "ts", "price", good, ("event_id",), begun)
        failed = gate.flags(("nonpositive_price", F.col("price") <= 0), ("implausible_price", F.col("price") > 300), gate.phantom(F.col("price")))
        return made.select("event_id", F.array_join(failed, ",").alias("failed"), F.array_join(gate.flags(gate.tick_gap(F.col("ts"))), ",").alias("noted"))

    return drained(spark, d, "gated", build)


@query(
    "latency_stream",
    "WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events WHERE value IS NOT NULL), s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM n WHERE k <= 500) SELECT event_type, round(max(value) FILTER (WHERE i = round_even(0.5 * (c - 1), 0)), 6) AS p50, round(max(value) FILTER (WHERE i = round_even(0.95 * (c - 1), 0)), 6) AS p95, count(*) AS samples FROM s GROUP BY 1",
)
def latency_stream(spark, d):
    """Percentiles of each type's newest 500 samples at the end of a drained stream; equal to latency_percentiles."""
    got = drained(spark, d, "latencies", lambda s: state.latencies(s.select("event_type", "ts", "event_id", "value"), ("event_type",), "ts", "event_id", "value"))
    last = got.groupBy("event_type").agg(F.max_by(F.struct("p50", "p95", "samples"), F.struct("at", "samples")).alias("x")).select("event_type", "x.*")
    return last.select("event_type", r6("p50"), r6("p95"), "samples")


@query("coverage_stream", "SELECT date_trunc('hour', ts) AS slot, CASE max(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) WHEN 0 THEN 'gap' WHEN 1 THEN 'partial' ELSE 'complete' END AS state FROM events GROUP BY 1")
def coverage_stream(spark, d):
    """The states of hours as a drained stream of marks has raised them; equal to slot_states."""

    def build(s):
        state_ = F.when(F.col("event_type") == "error", "gap").when(F.col("event_type") == "view", "partial").otherwise("complete")
        marks = s.select(F.lit("all").alias("feed"), "ts", floored(F.col("ts"), 3600).alias("slot"), state_.alias("state"))
        return live_coverage.raised(marks, ("feed",), "ts")

    return coverage.merged_states(drained(spark, d, "coverage", build), ("slot",))
