"""Queries over records, ledgers and event tables.

Orders stand for versions of records and for predictions, line items summed by order for their realisations, labels
for verdicts and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, stats
from ..operators import audit, bitemporal, ledger, similarity, validation
from ..operators.running import running, time_block
from .registry import query, r6, table

VERSION_KEY = ("venue", "dataset_id")
_VERSIONS = "v AS (SELECT o_custkey AS venue, o_orderpriority AS dataset_id, o_orderkey AS record_id, o_orderdate AS valid_from_sys, o_totalprice AS price, lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS valid_to_sys FROM orders)"


def versions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("venue"), F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from_sys"), F.col("o_totalprice").alias("price"))
    return bitemporal.with_intervals(rows, VERSION_KEY)


@query("as_of_read", f"WITH {_VERSIONS} SELECT venue, dataset_id, record_id, price FROM v WHERE valid_from_sys <= TIMESTAMP '1998-06-30 00:00:00' AND (valid_to_sys IS NULL OR valid_to_sys > TIMESTAMP '1998-06-30 00:00:00')")
def as_of_read(spark, d):
    return versions(spark, d).filter(bitemporal.visible(F.lit("1998-06-30 00:00:00").cast("timestamp_ntz"))).select("venue", "dataset_id", "record_id", "price")


@query("current_truth", f"WITH {_VERSIONS} SELECT venue, dataset_id, record_id, price FROM v WHERE valid_to_sys IS NULL")
def current_truth(spark, d):
    return versions(spark, d).filter(bitemporal.visible(None)).select("venue", "dataset_id", "record_id", "price")


@query("correction_chain", f"WITH {_VERSIONS} SELECT venue, dataset_id, count(*) AS versions, count(valid_to_sys) AS closed, max(valid_from_sys) AS newest FROM v GROUP BY ALL")
def correction_chain(spark, d):
    return versions(spark, d).groupBy("venue", "dataset_id").agg(F.count("*").alias("versions"), F.count("valid_to_sys").alias("closed"), F.max("valid_from_sys").alias("newest"))


@query("newest_event_time", "SELECT event_type AS dataset_id, max(ts) AS newest FROM events GROUP BY 1")
def newest_event_time(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("dataset_id")).agg(F.max("ts").alias("newest"))


_FIRST = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1"


@query("dedupe_natural_key", _FIRST)
def dedupe_natural_key(spark, d):
    rows = bitemporal.first_per_key(table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey", "l_extendedprice"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("new_rows_only", "SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def new_rows_only(spark, d):
    stored = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return bitemporal.new_rows(table(spark, d, "orders"), stored, ("o_orderkey",)).agg(F.count("*").alias("n"))


@query("latest_version", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_version(spark, d):
    return bitemporal.latest_version(table(spark, d, "orders"), ("o_custkey",), (F.desc("o_orderdate"), F.desc("o_orderkey"))).select("o_custkey", "o_orderkey", "o_totalprice")


_LEGS = """p AS (SELECT o_orderkey AS trade_id, o_orderpriority AS strategy_id, 'entry' AS leg, CASE WHEN o_orderstatus = 'F' THEN 'SHORT' ELSE 'LONG' END AS direction, 150.0 AS qty, o_orderdate AS decision_time, o_totalprice AS reference_price, o_totalprice * (CASE WHEN o_orderstatus = 'F' THEN 0.9999 ELSE 1.0001 END) AS predicted_fill, 10.0 AS predicted_fee, 1.0 AS predicted_slippage_bps, 60000.0 AS predicted_latency_ms, 0.0 AS predicted_funding FROM orders),
r AS (SELECT l_orderkey AS trade_id, 'entry' AS leg, min(l_shipdate) AS fill_time, avg(l_extendedprice) AS realized_fill, sum(l_tax) * 100 AS realized_fee, sum(l_quantity) AS realized_qty, sum(l_discount) AS realized_funding, CASE WHEN sum(l_quantity) < 20 THEN 'unfilled' ELSE 'reconciled' END AS status FROM lineitem GROUP BY l_orderkey),
j AS (SELECT p.*, fill_time, realized_fill, realized_fee, realized_qty, realized_funding, (direction = 'LONG') AS buys FROM p JOIN r ON p.trade_id = r.trade_id),
d AS (SELECT trade_id, leg, strategy_id, decision_time, predicted_fee, (CASE WHEN buys THEN 1 ELSE -1 END) * (realized_fill - reference_price) / reference_price * 10000 - 1.0 AS slippage_bps_drift, (CASE WHEN buys THEN 1 ELSE -1 END) * (realized_fill - predicted_fill) * realized_qty + realized_fee - predicted_fee + realized_funding AS cost_drift_usd, greatest(0, qty - realized_qty) AS qty_shortfall, realized_qty < qty AS partial FROM j)"""


def legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and realisations."""
    o, c = table(spark, d, "orders"), F.col
    short = c("o_orderstatus") == "F"
    p = o.select(
        c("o_orderkey").alias("trade_id"), c("o_orderpriority").alias("strategy_id"), F.lit("entry").alias("leg"), F.when(short, "SHORT").otherwise("LONG").alias("direction"), F.lit(150.0).alias("qty"), c("o_orderdate").cast("timestamp_ntz").alias("decision_time"), c("o_totalprice").alias("reference_price"),
        (c("o_totalprice") * F.when(short, 0.9999).otherwise(1.0001)).alias("predicted_fill"), F.lit(10.0).alias("predicted_fee"), F.lit(1.0).alias("predicted_slippage_bps"), F.lit(60000.0).alias("predicted_latency_ms"), F.lit(0.0).alias("predicted_funding"),
    )
    r = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("trade_id")).agg(F.min("l_shipdate").cast("timestamp_ntz").alias("fill_time"), F.avg("l_extendedprice").alias("realized_fill"), (F.sum("l_tax") * 100).alias("realized_fee"), F.sum("l_quantity").alias("realized_qty"), F.sum("l_discount").alias("realized_funding"))
    return p, r.withColumn("leg", F.lit("entry")).withColumn("status", F.when(c("realized_qty") < 20, "unfilled").otherwise("reconciled"))


def drifts(spark: SparkSession, d: str) -> DataFrame:
    p, r = legs(spark, d)
    return ledger.drift(p, r)


@query("ledger_status", f"WITH {_LEGS} SELECT coalesce(status, 'pending') AS status, count(*) AS n FROM p LEFT JOIN r ON p.trade_id = r.trade_id GROUP BY 1")
def ledger_status(spark, d):
    return ledger.with_status(*legs(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query("drift_reconcile", f"WITH {_LEGS} SELECT trade_id, round(slippage_bps_drift, 4) AS slippage_bps_drift, round(cost_drift_usd, 3) AS cost_drift_usd, qty_shortfall, partial FROM d")
def drift_reconcile(spark, d):
    return drifts(spark, d).select("trade_id", F.round("slippage_bps_drift", 4).alias("slippage_bps_drift"), F.round("cost_drift_usd", 3).alias("cost_drift_usd"), "qty_shortfall", "partial")


@query(
    "trading_summary",
    f"WITH {_LEGS} SELECT count(*) AS legs, count(*) FILTER (WHERE r.status = 'reconciled') AS reconciled, count(*) FILTER (WHERE r.status = 'unfilled') AS unfilled, count(*) - count(r.trade_id) AS pending, round(100.0 * count(*) FILTER (WHERE r.status = 'reconciled') / count(*), 4) AS fill_rate_pct, round(sum(d.cost_drift_usd) / 1e6, 2) AS cost_drift_musd, round(avg(d.slippage_bps_drift), 4) AS avg_slippage_drift_bps FROM p LEFT JOIN r ON p.trade_id = r.trade_id LEFT JOIN d ON p.trade_id = d.trade_id",
)
def trading_summary(spark, d):
    p, r = legs(spark, d)
    s = audit.trading_summary(p, r, ledger.drift(p, r))
    return s.select("legs", "reconciled", "unfilled", "pending", F.round("fill_rate_pct", 4).alias("fill_rate_pct"), F.round(F.col("cost_drift_usd") / 1e6, 2).alias("cost_drift_musd"), F.round("avg_slippage_drift_bps", 4).alias("avg_slippage_drift_bps"))


@query("calibration", f"WITH {_LEGS} SELECT strategy_id, count(*) AS realized_legs, round(median(slippage_bps_drift), 4) AS drift_median, round(avg(slippage_bps_drift), 4) AS drift_mean, round(max(slippage_bps_drift), 4) AS drift_worst, count(*) FILTER (WHERE partial) AS partials, CASE WHEN sum(cost_drift_usd) > 0 THEN 'underpredicting' ELSE 'conservative' END AS status FROM d GROUP BY 1")
def calibration(spark, d):
    c = ledger.calibration(drifts(spark, d), ("strategy_id",))
    return c.select("strategy_id", "realized_legs", *(F.round(x, 4).alias(x) for x in ("drift_median", "drift_mean", "drift_worst")), "partials", "status")


@query("cost_ratio", f"WITH {_LEGS}, n AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY decision_time DESC, trade_id DESC) AS n FROM d) SELECT strategy_id, count(*) AS legs, CAST(round(sum(predicted_fee), 4) AS DOUBLE) AS predicted, round((sum(CAST(predicted_fee AS DOUBLE)) + sum(cost_drift_usd)) / CAST(sum(predicted_fee) AS DOUBLE), 2) AS ratio FROM n WHERE n <= 10 GROUP BY 1")
def cost_ratio(spark, d):
    p, r = legs(spark, d)
    rows = ledger.drift(p, r).join(p.select("trade_id", "leg", "decision_time", "predicted_fee"), ["trade_id", "leg"])
    return ledger.cost_ratio(rows, ("strategy_id",)).select("strategy_id", "legs", F.round("predicted", 4).alias("predicted"), F.round("ratio", 2).alias("ratio"))


def pnl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("strategy_id"), "ts", "event_id", (F.col("value") - 50).alias("net_pnl"))


_PNL = "t AS (SELECT event_type AS strategy_id, ts, event_id, value - 50 AS net_pnl FROM events)"


@query(
    "decay_verdicts",
    f"WITH {_PNL}, l AS (SELECT *, min(CASE WHEN net_pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY strategy_id ORDER BY ts DESC, event_id DESC) AS losing FROM t), g AS (SELECT strategy_id, CAST(sum(losing) AS BIGINT) AS losing_run, count(*) AS trades, avg(net_pnl) AS expectancy FROM l GROUP BY 1) SELECT strategy_id, losing_run, trades, round(expectancy, 6) AS expectancy, CASE WHEN trades < 50 THEN 'insufficient_trades' WHEN pow(0.5, losing_run) < 0.01 THEN 'alpha_decay' WHEN expectancy < 0 AND trades >= 100 THEN 'negative_expectancy' ELSE 'healthy' END AS cause FROM g",
)
def decay_verdicts(spark, d):
    runs = ledger.losing_runs(pnl(spark, d), ("strategy_id",), ("ts", "event_id"), "net_pnl")
    return ledger.decay(runs, F.lit(0.5), F.lit(None).cast("double")).select("strategy_id", "losing_run", "trades", r6("expectancy"), "cause")


@query("walk_forward", f"WITH {_PNL}, n AS (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY strategy_id) AS n FROM t), f AS (SELECT strategy_id, least(i // (n // 4), 3) AS fold, sum(net_pnl) AS s FROM n GROUP BY 1, 2) SELECT strategy_id, count(*) FILTER (WHERE s > 0) AS positive_folds, count(*) FILTER (WHERE s > 0) >= 3 AS consistent FROM f GROUP BY 1")
def walk_forward(spark, d):
    return validation.walk_forward(pnl(spark, d), ("strategy_id",), ("ts", "event_id"), "net_pnl").select("strategy_id", "positive_folds", "consistent")


@query("max_drawdown", f"WITH {_PNL}, e AS (SELECT strategy_id, ts, event_id, 10000 + sum(net_pnl) OVER (PARTITION BY strategy_id ORDER BY ts, event_id) AS equity FROM t), k AS (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY ts, event_id) AS peak FROM e) SELECT strategy_id, round(max((peak - equity) / peak * 100), 6) AS max_drawdown_pct FROM k GROUP BY 1")
def max_drawdown(spark, d):
    curve = running(pnl(spark, d), ("strategy_id",), time_block(F.col("ts")), ("ts", "event_id"), sums={"_sum": F.col("net_pnl")}).withColumn("equity", 10000 + F.col("_sum")).drop("_sum")
    return validation.drawdown(curve, ("strategy_id",), ("ts", "event_id"), "equity").select("strategy_id", r6("max_drawdown_pct"))


@query("regime_expectancy", f"WITH {_PNL} SELECT CASE WHEN CAST(date_trunc('day', ts) AS DATE) IN (SELECT CAST(ts AS DATE) FROM events WHERE value > 330) THEN 'high' ELSE 'range' END AS regime, round(sum(net_pnl), 4) AS expectancy, count(*) AS trades FROM t GROUP BY 1")
def regime_expectancy(spark, d):
    e = table(spark, d, "events")
    labels = e.filter("value > 330").select(F.to_date("ts").alias("day"), F.lit("high").alias("regime")).distinct()
    out = validation.by_regime(pnl(spark, d).withColumn("day", F.to_date("ts")), labels, "day", "day", "net_pnl")
    return out.withColumn("expectancy", F.round("expectancy", 4))


@query(
    "sharpe_moments",
    f"WITH {_PNL}, m AS (SELECT strategy_id, avg(net_pnl) AS m, stddev_samp(net_pnl) AS s, count(*) AS n FROM t GROUP BY 1) SELECT strategy_id, any_value(n) AS n, round(any_value(m), 6) AS mean, round(any_value(s), 6) AS std, round(any_value(m.n * 1.0 / ((m.n - 1.0) * (m.n - 2.0)) / pow(s, 3)) * sum(pow(net_pnl - m, 3)), 6) AS skew, round(sum(pow(net_pnl - m, 4)) / any_value(pow(s, 4) * m.n), 6) AS kurtosis, round(any_value(m / s), 6) AS sharpe FROM t JOIN m USING (strategy_id) GROUP BY 1",
)
def sharpe_moments(spark, d):
    m = stats.moments(pnl(spark, d), "net_pnl", ("strategy_id",))
    return m.select("strategy_id", "n", *(r6(x) for x in ("mean", "std", "skew", "kurtosis", "sharpe")))


_ONE = stats.expected_max_sharpe(20, 1.0)


@query(
    "deflated_sharpe",
    f"""WITH {_PNL}, m AS (SELECT strategy_id, avg(net_pnl) AS m, stddev_samp(net_pnl) AS s, count(*) AS n FROM t GROUP BY 1),
k AS (SELECT strategy_id, any_value(n) AS n, any_value(m / s) AS sharpe, any_value(m.n * 1.0 / ((m.n - 1.0) * (m.n - 2.0)) / pow(s, 3)) * sum(pow(net_pnl - m, 3)) AS skew, sum(pow(net_pnl - m, 4)) / any_value(pow(s, 4) * m.n) AS kurtosis FROM t JOIN m USING (strategy_id) GROUP BY 1),
z AS (SELECT strategy_id, (sharpe - {_ONE!r} * abs(sharpe) / 2) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, 1e-12)) AS z FROM k)
SELECT strategy_id, round(CASE WHEN z >= 8 THEN 1.0 WHEN z <= -8 THEN 0.0 WHEN z = 0 THEN 0.5 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda i: exp((2 * i + 1) * ln(abs(z)) - (i + 1) * ln(2) - lgamma(i + 1.5) + ln(pi()) / 2))) END, 6) AS deflated_sharpe FROM z""",
)
def deflated_sharpe(spark, d):
    """The moments of each strategy, one row each, and the probability from them."""
    return stats.with_deflated_sharpe(stats.moments(pnl(spark, d), "net_pnl", ("strategy_id",)), 20).select("strategy_id", r6("deflated_sharpe"))


@query("nearest_rank_p95", "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1) SELECT event_type, v[1 + CAST(round_even(0.95 * (len(v) - 1), 0) AS BIGINT)] AS p95, v[1 + least(CAST(floor(len(v) * 90 / 100) AS BIGINT), len(v) - 1)] AS p90 FROM s")
def nearest_rank_p95(spark, d):
    """By rows in order, so that no group is collected: the rows at both ranks are picked."""
    e = table(spark, d, "events").select("event_type", "value")
    # blocks of values, so that no task has all of a type
    e = running(e, ("event_type",), F.floor("value"), ("value",), sums={"i": F.lit(1)}).withColumn("i", F.col("i") - 1)
    e = e.join(e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
    p95, p90 = F.bround(F.lit(0.95) * (F.col("n") - 1), 0), F.least(F.floor(F.col("n") * 90 / 100), F.col("n") - 1)
    return e.groupBy("event_type").agg(F.max(F.when(F.col("i") == p95, F.col("value"))).alias("p95"), F.max(F.when(F.col("i") == p90, F.col("value"))).alias("p90"))


@query("counts_by_key", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def counts_by_key(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("filtered_counts", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus <> 'F') AS incomplete, count(*) AS slots, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'P') / nullif(count(*), 0), 6) AS pct FROM orders GROUP BY 1")
def filtered_counts(spark, d):
    o = table(spark, d, "orders").withColumnsRenamed({"o_orderpriority": "feed"}).withColumn("state", F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial"))
    pct = o.groupBy("feed").agg(F.round(100.0 * stats.ratio(F.count_if(F.col("o_orderstatus") == "P").cast("double"), F.count("*")), 6).alias("pct"))
    return audit.incomplete_by_feed(o).join(pct, "feed").withColumnRenamed("feed", "o_orderpriority")


@query("distinct_counts", "SELECT count(*) AS proposed, count(DISTINCT o_custkey) AS distinct_ideas, count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders")
def distinct_counts(spark, d):
    month = F.date_format("o_orderdate", "yyyy-MM")
    return table(spark, d, "orders").agg(F.count("*").alias("proposed"), F.count_distinct("o_custkey").alias("distinct_ideas"), F.count_distinct(month).alias("months"))


@query("min_max_slots", "SELECT l_returnflag, min(l_shipdate) AS first, max(l_shipdate) AS last, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1")
def min_max_slots(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("slice_half_open", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY 1")
def slice_half_open(spark, d):
    return audit.counts(audit.sliced(table(spark, d, "orders"), "o_orderdate", "1997-01-01 00:00:00", "1998-01-01 00:00:00"), "o_orderstatus")


@query("orders_without_prediction", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_prediction(spark, d):
    fills = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return audit.without_partner(table(spark, d, "orders"), fills, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("exists_probe", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_probe(spark, d):
    held = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(held, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("row_count_parity", "WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, CAST(4 AS BIGINT) AS n FROM orders) SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS stored, coalesce(b.n, 0) AS archived, coalesce(a.n, 0) = coalesce(b.n, 0) AS passed FROM a FULL JOIN b ON a.k = b.k")
def row_count_parity(spark, d):
    stored = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    archived = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(4).alias("rows"))
    return audit.count_parity(stored, archived, ["k"])


@query("precision_recall", "SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS flagged, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS caught, round(count(*) FILTER (WHERE toxic = 1 AND quality = 0) * 1.0 / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS precision, round(count(*) FILTER (WHERE toxic = 1 AND quality = 0) * 1.0 / nullif(count(*) FILTER (WHERE quality = 0), 0), 6) AS recall FROM labels")
def precision_recall(spark, d):
    out = ledger.precision_recall(table(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0)
    return out.select("n", "flagged", "caught", r6("precision"), r6("recall"))


@query("verdict_consistency", "WITH k AS (SELECT source, count(*) AS n, count(DISTINCT quality) AS v FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS repeated, round(count(*) FILTER (WHERE v = 1) * 1.0 / nullif(count(*), 0), 6) AS consistency FROM k")
def verdict_consistency(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return ledger.consistency(j, "source", "quality").select("repeated", r6("consistency"))


@query("population_by_family", "SELECT family, count(*) AS n FROM (SELECT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS family FROM part) GROUP BY 1")
def population_by_family(spark, d):
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")
    return table(spark, d, "part").select(F.explode(words).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


_SETS = "s AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_name AS k, [p_brand, p_type] || string_split(p_name, ' ') AS t FROM part)"


@query("jaccard_pairs", f"WITH {_SETS} SELECT x.k AS a, y.k AS b, round(len(list_intersect(x.t, y.t)) * 1.0 / len(list_distinct(x.t || y.t)), 6) AS similarity FROM s AS x JOIN s AS y ON x.k < y.k WHERE len(list_intersect(x.t, y.t)) * 1.0 / len(list_distinct(x.t || y.t)) >= 0.6")
def jaccard_pairs(spark, d):
    k = F.concat_ws("/", "p_brand", "p_type", "p_name")
    sets = table(spark, d, "part").select(k.alias("k"), F.concat(F.array("p_brand", "p_type"), F.split("p_name", " ")).alias("t")).distinct()
    return similarity.similar_pairs(sets, "k", "t", 0.6).select("a", "b", r6("similarity"))


@query("top_n_latest", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def top_n_latest(spark, d):
    """The newest 200 orders: a top-k report."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200)


@query("topk_levels", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n <= 20")
def topk_levels(spark, d):
    """The 20 best levels of each side, as of a book: a top-k report."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("n", F.row_number().over(w)).filter("n <= 20").select("p_brand", "p_partkey", "p_retailprice")


@query("audit_queue", "SELECT c_custkey, v, written FROM (SELECT c_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS v, max(o_orderdate) AS written FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ORDER BY v NULLS FIRST, written NULLS FIRST, c_custkey LIMIT 200")
def audit_queue(spark, d):
    """What was verified longest ago, never verified first: a top-k report."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("v"), F.max("o_orderdate").alias("written"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").orderBy(F.asc_nulls_first("v"), F.asc_nulls_first("written"), "c_custkey").limit(200)


@query("best_of_ties", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_of_ties(spark, d):
    return bitemporal.latest_version(table(spark, d, "orders"), ("o_custkey",), (F.desc("o_orderpriority"), F.col("o_orderkey"))).select("o_custkey", "o_orderkey")


@query("numbers_in_text", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[-+]?[0-9][0-9,]*(?:\\.[0-9]+)?%?')) AS INTEGER) AS n_numbers, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM documents")
def numbers_in_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(scalars.numbers_in(F.col("text"))).alias("n_numbers"), scalars.word_count(F.col("text")).alias("n_words"))


@query("name_before_colon", "SELECT string_split(replace(role || ':' || conv_id, '::', ':'), ':')[1] AS name, count(*) AS n FROM conversations GROUP BY 1")
def name_before_colon(spark, d):
    tagged = F.concat_ws(":", "role", F.col("conv_id").cast("string"))
    return table(spark, d, "conversations").groupBy(scalars.before_colon(tagged).alias("name")).agg(F.count("*").alias("n"))


@query("json_path", "SELECT event_type, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS total, count(*) FILTER (WHERE CAST(props ->> '$.k' AS BIGINT) > 50) AS large FROM events GROUP BY 1")
def json_path(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k > 50).alias("large"))


@query("state_hashes", "SELECT o_orderkey, substr(sha256(concat_ws('|', o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR))), 1, 16) AS key FROM orders")
def state_hashes(spark, d):
    key = scalars.row_hash(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", key.alias("key"))


@query("day_parity", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def day_parity(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(n, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(
    "pretrade_refusals",
    "WITH o AS (SELECT o_orderkey, o_totalprice AS notional, o_totalprice * 0.0001 AS risk, CASE WHEN o_orderstatus = 'F' THEN 'SHORT' ELSE 'LONG' END AS direction FROM orders) SELECT o_orderkey, concat_ws(',', CASE WHEN risk > 10000 * 0.25 / 100 * 1.001 THEN 'per_trade_risk_exceeds_cap' END, CASE WHEN 80 + risk > 100 THEN 'total_open_risk_exceeds_cap' END, CASE WHEN notional / 10000 > 3 THEN 'leverage_exceeds_cap' END, CASE WHEN 100 + notional / 3 > 10000 THEN 'insufficient_free_margin' END, CASE WHEN direction = 'LONG' AND 95.0 - 96.0 <= 0 THEN 'stop_beyond_liquidation_buffer' WHEN direction = 'SHORT' AND 96.0 - 95.0 < abs(100.0 - 95.0) * 20 / 100 THEN 'stop_beyond_liquidation_buffer' END) AS reasons FROM o",
)
def pretrade_refusals(spark, d):
    from ..operators import decisions

    c, lit = F.col, F.lit
    o = table(spark, d, "orders")
    direction = F.when(c("o_orderstatus") == "F", "SHORT").otherwise("LONG")
    reasons = decisions.refusals(lit(10_000.0), c("o_totalprice") * 0.0001, lit(80.0), c("o_totalprice"), lit(100.0), lit(100.0), lit(95.0), lit(96.0), direction, lit(None).cast("double"), lit(None).cast("double"), lit(False))
    return o.select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


@query(
    "scrutiny_verdicts",
    """WITH c AS (SELECT o_orderkey AS case_id, o_orderdate AS time, o_orderpriority || o_custkey % 50 AS key, CASE WHEN o_orderstatus = 'F' THEN 'SHORT' ELSE 'LONG' END AS direction, (o_custkey % 21 - 10) / 10000.0 AS funding_rate, o_totalprice / 1e7 AS spread_pct FROM orders),
h AS (SELECT o_orderdate AS t, o_orderpriority || o_custkey % 50 AS key, o_totalprice / 2e5 AS a, o_totalprice / 1e7 AS s FROM orders),
m AS (SELECT case_id, count(*) AS analogs, count(*) FILTER (WHERE a >= 1.0) AS adverse, count(s) AS n, count(*) FILTER (WHERE s < spread_pct) AS below FROM c JOIN h USING (key) WHERE t >= time - INTERVAL 730 DAY AND t <= time - INTERVAL 1 DAY GROUP BY 1)
SELECT case_id, CASE WHEN reason = 'analogs_ok' THEN 'APPROVE' ELSE 'VETO' END AS verdict, reason, analogs, adverse FROM (SELECT case_id, coalesce(analogs, 0) AS analogs, coalesce(adverse, 0) AS adverse, CASE WHEN abs(funding_rate) >= 0.0005 AND (funding_rate > 0 AND direction = 'LONG' OR funding_rate < 0 AND direction = 'SHORT') THEN 'funding_against_position' WHEN coalesce(analogs, 0) < 20 THEN 'insufficient_analogs' WHEN adverse >= 0.75 * analogs THEN 'analogs_adverse' WHEN n > 0 AND below > least(n * 90 // 100, n - 1) THEN 'spread_above_percentile' ELSE 'analogs_ok' END AS reason FROM c LEFT JOIN m USING (case_id))""",
)
def scrutiny_verdicts(spark, d):
    from ..operators import decisions

    c = F.col
    key = F.concat("o_orderpriority", (c("o_custkey") % 50).cast("string"))
    o = table(spark, d, "orders").withColumn("key", key).withColumn("time", c("o_orderdate").cast("timestamp_ntz"))
    cases = o.select(c("o_orderkey").alias("case_id"), "time", "key", F.when(c("o_orderstatus") == "F", "SHORT").otherwise("LONG").alias("direction"), ((c("o_custkey") % 21 - 10) / 10000.0).alias("funding_rate"), (c("o_totalprice") / 1e7).alias("spread_pct"))
    history = o.select("time", "key", (c("o_totalprice") / 2e5).alias("adverse_pct"), (c("o_totalprice") / 1e7).alias("spread_pct"))
    return decisions.scrutinised(cases, history)


@query("kill_levels", f"WITH {_PNL}, e AS (SELECT strategy_id, ts, event_id, 10000 + sum(net_pnl * 5) OVER (PARTITION BY strategy_id ORDER BY ts, event_id) AS equity FROM t), k AS (SELECT *, max(equity) OVER (PARTITION BY strategy_id ORDER BY ts) AS peak, first_value(equity) OVER (PARTITION BY strategy_id, CAST(ts AS DATE) ORDER BY ts) AS opened FROM e) SELECT strategy_id, CAST(CASE WHEN (peak - equity) / peak * 100 >= 15 THEN 3 WHEN (equity - opened) / opened * 100 <= -3 THEN 2 ELSE 0 END AS INTEGER) AS kill_level, count(*) AS n FROM k GROUP BY 1, 2")
def kill_levels(spark, d):
    from ..operators import decisions

    curve = running(pnl(spark, d), ("strategy_id",), time_block(F.col("ts")), ("ts", "event_id"), sums={"_sum": F.col("net_pnl") * 5}).withColumn("equity", 10000 + F.col("_sum")).drop("_sum")
    return decisions.kills(curve, ("strategy_id",), "ts", "equity").groupBy("strategy_id", "kill_level").agg(F.count("*").alias("n"))
