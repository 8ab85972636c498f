"""Queries over JSON contexts, texts of predicates, and partitions as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import guards
from ..functions.timegrid import floored
from ..operators import integrity
from ..sources import partitions
from ..sources.shared import shared_dir
from . import text
from .registry import query, table

#: Contexts of orders may hold nothing after this.
UNTIL = "1998-01-01 00:00:00"


@query(
    "json_guards",
    f"SELECT o_orderkey, 'context.legs[0].PnL' AS path, 'forbidden_key' AS reason FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'context.legs[0].at', 'time_ahead' FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderdate > TIMESTAMP '{UNTIL}' UNION ALL SELECT o_orderkey, 'context.env.keys.Api_Key', 'forbidden_key' FROM orders WHERE o_custkey % 5 = 0 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, 'context', 'not_json' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 3 <> 0",
)
def json_guards(spark, d):
    """What contexts made of orders may not hold, at any depth, by path."""
    c = F.col
    leg = F.concat(F.lit('{"legs":[{"'), F.when(c("o_orderkey") % 3 == 0, "PnL").otherwise("size"), F.lit('":1,"at":"'), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('"},7]'))
    env = F.concat(F.lit(',"env":{"keys":{"'), F.when(c("o_custkey") % 5 == 0, "Api_Key").otherwise("name"), F.lit('":null},"n":[[],{}]}}'))
    short = F.when(c("o_orderkey") % 3 == 0, '{"legs":[{"PnL":1}]}').otherwise('{"legs":[')
    rows = table(spark, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 11 == 0, short).otherwise(F.concat(leg, env)).alias("context"))
    return guards.violations(rows, ("o_orderkey",), "context", until=UNTIL)


@query(
    "predicate_signatures",
    """SELECT CASE WHEN p_partkey % 7 <> 0 THEN '{"left":{"args":{"n":' || p_size || '},"feature":"rsi"},"op":"gt","right":' || CASE WHEN p_partkey % 3 = 0 THEN '{"param":"hot"}' ELSE '30' END || '}' END AS canonical, CASE WHEN p_partkey % 7 = 0 THEN 'entry.and[0]: unknown_op:''is''' END AS error, count(*) AS n FROM part GROUP BY 1, 2""",
)
def predicate_signatures(spark, d):
    """Texts of predicates, written in several ways, by what they mean; and where and why the others are refused."""
    c = F.col
    size = c("p_size").cast("string")
    hot = F.when(c("p_partkey") % 3 == 0, '{"param":"hot"}')
    plain = F.concat(F.lit('{"left":{"feature":"rsi","timeframe":"1m","args":{"n":'), size, F.lit('}},"op":"gt","right":'), F.coalesce(hot, F.lit('{"const":30}')), F.lit("}"))
    other = F.concat(F.lit('{ "op": "gt",\n "right": '), F.coalesce(hot, F.lit("3e1")), F.lit(', "left": {"args": {"n": '), size, F.lit('.0}, "feature": "rsi", "timeframe": null}}'))
    wrong = F.concat(F.lit('{"and":[{"left":{"feature":"rsi","args":{"n":'), size, F.lit('}},"op":"is","right":1}]}'))
    texts = F.when(c("p_partkey") % 7 == 0, wrong).when(c("p_partkey") % 2 == 0, plain).otherwise(other)
    got = table(spark, d, "part").select(text.checked(texts).alias("x"))
    return got.groupBy("x.canonical", "x.error").agg(F.count("*").alias("n"))


@query("partition_catalog", "SELECT CAST(ts AS DATE) AS event_date, count(*) AS rows, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def partition_catalog(spark, d):
    """Events stored by day, and the days as a table, from the files' footers alone."""
    path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    table(spark, d, "events").withColumn("event_date", F.to_date("ts")).write.partitionBy("event_date").parquet(path)
    got = partitions.partitions(spark, path, ("event_date",), "event_id", "long")
    return got.select(F.col("event_date").cast("date").alias("event_date"), "rows", "first", "last")


@query(
    "integrity_report",
    """WITH p AS (SELECT l_returnflag AS d, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R' OR l_linenumber <> 7) AS m FROM lineitem GROUP BY 1),
c AS (SELECT event_type AS d, count(DISTINCT date_trunc('hour', ts)) FILTER (WHERE event_type <> 'view' OR user_id % 2 = 0) AS marked, count(DISTINCT date_trunc('hour', ts)) AS actual FROM events GROUP BY 1),
o AS (SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)),
v AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)) AS missing FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 500))
SELECT 'row_count_parity' AS "check", d AS dataset_id, n = m AS passed, n AS seen, m AS against, CASE WHEN n = m THEN '' ELSE 'the store and the archive disagree' END AS detail FROM p
UNION ALL SELECT 'coverage_reconciles', d, marked >= actual, marked, actual, CASE WHEN marked >= actual THEN '' ELSE 'the ledger has fewer complete slots than there are records' END FROM c
UNION ALL SELECT 'orders_have_predictions', NULL, n = 0, n, NULL, CASE WHEN n = 0 THEN '' ELSE 'an order that no prediction accounts for' END FROM o
UNION ALL SELECT 'scrutiny_provenance_present', NULL, missing = 0, n, missing, CASE WHEN missing = 0 THEN '' ELSE 'verdicts without their text' END FROM v""",
)
def integrity_report(spark, d):
    """One report of four checks over tables that stand for the store, its archive, its ledger and its verdicts."""
    c = F.col
    lines, events = table(spark, d, "lineitem"), table(spark, d, "events")
    hour = floored(c("ts"), 3600).alias("slot")
    archived = lines.filter((c("l_returnflag") != "R") | (c("l_linenumber") != 7)).select(c("l_returnflag").alias("dataset_id"), F.lit(1).alias("rows"))
    ledger = events.filter((c("event_type") != "view") | (c("user_id") % 2 == 0)).select(c("event_type").alias("dataset_id"), hour, F.lit("complete").alias("state")).distinct()
    got = integrity.report(
        integrity.row_count_parity(lines.select(c("l_returnflag").alias("dataset_id")), archived),
        integrity.coverage_reconciles(ledger, events.select(c("event_type").alias("dataset_id"), hour)),
        integrity.none_without(table(spark, d, "orders").select(c("o_orderkey").alias("trade_id")), lines.select(c("l_orderkey").alias("trade_id")), ("trade_id",), "orders_have_predictions", "an order that no prediction accounts for"),
        integrity.newest_have(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), ("doc_id",), "doc_id", "scrutiny_provenance_present", "verdicts without their text"),
    )
    seen = lambda *names: F.coalesce(*(F.try_element_at("observed", F.lit(n)) for n in names))
    return got.select("check", "dataset_id", "passed", seen("stored", "complete_slots", "without", "checked").alias("seen"), seen("archived", "record_slots", "missing").alias("against"), "detail")
