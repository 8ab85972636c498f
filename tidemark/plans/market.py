"""Queries over bars and points: ticks are events, a symbol is an event type, a price its value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as p

from ..operators import asof, bars, coverage, gate, indicators, regimes, replay
from .registry import query, r6, table

KEYS = ("symbol",)


def order():
    return Window.partitionBy("symbol").orderBy("close_time")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("qty"), "event_id", "props")


def hourly(spark: SparkSession, d: str, minutes: int = 60) -> DataFrame:
    return bars.from_points(ticks(spark, d), minutes, "ts", "price", "price", KEYS, ("event_id",))


def sql_bars(minutes: int = 60, name: str = "b") -> str:
    return f"{name} AS (SELECT event_type AS symbol, time_bucket(INTERVAL {minutes} MINUTE, ts) AS open_time, time_bucket(INTERVAL {minutes} MINUTE, ts) + INTERVAL {minutes} MINUTE - INTERVAL 1 MILLISECOND AS close_time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume FROM events GROUP BY ALL)"


W = "PARTITION BY symbol ORDER BY close_time"


def last(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _bars_query(minutes: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return hourly(spark, d, minutes).select("symbol", "open_time", "close_time", "open", "high", "low", "close", r6("volume"))

    return run


for _m, _n in ((5, "ohlcv_5m"), (60, "ohlcv_1h"), (1440, "ohlcv_24h")):
    query(_n, f"WITH {sql_bars(_m)} SELECT symbol, open_time, close_time, open, high, low, close, round(volume, 6) AS volume FROM b")(_bars_query(_m))


@query("resample_4h", f"WITH {sql_bars(240)} SELECT symbol, open_time, close_time, open, high, low, close, round(volume, 4) AS volume FROM b")
def resample_4h(spark, d):
    return bars.resampled(hourly(spark, d), 240, KEYS).select("symbol", "open_time", "close_time", "open", "high", "low", "close", F.round("volume", 4).alias("volume"))


@query("last_per_minute", "SELECT event_type AS symbol, date_trunc('minute', ts) AS minute, arg_max(value, ts) AS price FROM events GROUP BY ALL")
def last_per_minute(spark, d):
    return bars.last_per_minute(ticks(spark, d), "ts", ("price",), KEYS)


def _window_query(name: str, sql: str, column):
    @query(name, f"WITH {sql_bars()} SELECT symbol, close_time, round({sql}, 6) AS {name} FROM b")
    def run(spark, d):
        return hourly(spark, d).select("symbol", "close_time", F.round(column(order()), 6).alias(name))


def _full(n: int, sql: str) -> str:
    return f"CASE WHEN count(*) OVER {last(n)} = {n} THEN {sql} END"


_window_query("sma_20", _full(20, f"avg(close) OVER {last(20)}"), lambda o: indicators.sma(F.col("close"), 20, o))
_window_query("rolling_sum_5", _full(5, f"sum(close) OVER {last(5)}"), lambda o: indicators.rolling_sum(F.col("close"), 5, o))
_window_query("rolling_std_20", _full(20, f"stddev_pop(close) OVER {last(20)}"), lambda o: indicators.rolling_std(F.col("close"), 20, o))
_window_query("bb_position_20", _full(20, f"CASE WHEN stddev_pop(close) OVER {last(20)} = 0 THEN 0.5 ELSE (close - (avg(close) OVER {last(20)} - 2 * stddev_pop(close) OVER {last(20)})) / (4 * stddev_pop(close) OVER {last(20)}) END"), lambda o: indicators.bb_position(F.col("close"), 20, o))
_window_query("true_range", f"greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0))", indicators.true_range)
_window_query("pct_change_5", f"CASE WHEN lag(close, 5) OVER ({W}) <> 0 THEN (close - lag(close, 5) OVER ({W})) / abs(lag(close, 5) OVER ({W})) * 100 END", lambda o: indicators.pct_change(F.col("close"), 5, o))
_window_query("structural_stop_10", f"min(low) OVER {last(10)}", lambda o: regimes.structural_extreme("LONG", 10, o))


@query(
    "realized_vol_24",
    f"WITH {sql_bars()}, r AS (SELECT *, CASE WHEN lag(close) OVER ({W}) > 0 AND close > 0 THEN ln(close / lag(close) OVER ({W})) ELSE 0 END AS ret FROM b) SELECT symbol, close_time, round(CASE WHEN count(*) OVER {last(24)} = 24 THEN stddev_pop(ret) OVER {last(24)} * sqrt(8760) * 100 END, 6) AS vol FROM r",
)
def realized_vol_24(spark, d):
    b = hourly(spark, d).withColumn("ret", indicators.log_return(F.col("close"), order()))
    return b.select("symbol", "close_time", F.round(indicators.realized_vol(F.col("ret"), 24, order(), 8760.0), 6).alias("vol"))


@query(
    "zscore_20",
    f"WITH {sql_bars()}, v AS (SELECT symbol, close_time, CASE WHEN close < 5 THEN NULL ELSE close END AS x FROM b), g AS (SELECT *, sum(CASE WHEN x IS NULL THEN 1 ELSE 0 END) OVER ({W}) AS run FROM v) SELECT symbol, close_time, round(CASE WHEN x IS NOT NULL AND count(x) OVER w = 20 AND stddev_pop(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w END, 6) AS z FROM g WINDOW w AS (PARTITION BY symbol, run ORDER BY close_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
)
def zscore_20(spark, d):
    b = hourly(spark, d).withColumn("x", F.when(F.col("close") >= 5, F.col("close")))
    return indicators.with_zscore(b, "x", 20, KEYS, "close_time", "z").select("symbol", "close_time", r6("z"))


@query(
    "vwap_dist",
    f"WITH {sql_bars()}, v AS (SELECT symbol, close_time, (high + low + close) / 3 AS t, sum((high + low + close) / 3 * volume) OVER w AS pv, sum(volume) OVER w AS v FROM b WINDOW w AS (PARTITION BY symbol, CAST(close_time AS DATE) ORDER BY close_time)) SELECT symbol, close_time, round(CASE WHEN v > 0 THEN (t - pv / v) / (pv / v) * 100 END, 6) + 0.0 AS vwap_dist FROM v",
)
def vwap_dist(spark, d):
    return indicators.with_vwap_dist(hourly(spark, d), KEYS).select("symbol", "close_time", (F.round("vwap_dist", 6) + 0.0).alias("vwap_dist"))


def _numbered() -> str:
    return f"{sql_bars()}, x AS (SELECT *, row_number() OVER ({W}) - 1 AS i, lag(close) OVER ({W}) AS before, lag(high) OVER ({W}) AS ph, lag(low) OVER ({W}) AS pl FROM b), y AS (SELECT *, greatest(high - low, coalesce(abs(high - before), 0), coalesce(abs(low - before), 0)) AS tr, greatest(close - before, 0) AS gain, greatest(before - close, 0) AS loss FROM x)"


@query(
    "ema_14",
    f"WITH RECURSIVE {_numbered()}, r AS (SELECT symbol, CAST(13 AS BIGINT) AS i, avg(close) AS e FROM y WHERE i < 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT y.symbol, y.i, y.close * (2.0 / 15) + r.e * (1 - 2.0 / 15) FROM r JOIN y ON y.symbol = r.symbol AND y.i = r.i + 1) SELECT y.symbol, close_time, round(e, 6) AS ema FROM y LEFT JOIN r ON y.symbol = r.symbol AND y.i = r.i",
)
def ema_14(spark, d):
    return indicators.with_ema(hourly(spark, d), "close", 14, KEYS, "close_time").select("symbol", "close_time", r6("ema"))


@query(
    "rsi_14",
    f"WITH RECURSIVE {_numbered()}, r AS (SELECT symbol, CAST(14 AS BIGINT) AS i, avg(gain) AS g, avg(loss) AS l FROM y WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT y.symbol, y.i, (r.g * 13 + y.gain) / 14, (r.l * 13 + y.loss) / 14 FROM r JOIN y ON y.symbol = r.symbol AND y.i = r.i + 1) SELECT y.symbol, close_time, round(CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi FROM y LEFT JOIN r ON y.symbol = r.symbol AND y.i = r.i",
)
def rsi_14(spark, d):
    return indicators.with_rsi(hourly(spark, d), "close", 14, KEYS, "close_time").select("symbol", "close_time", r6("rsi"))


@query(
    "atr_14",
    f"WITH RECURSIVE {_numbered()}, r AS (SELECT symbol, CAST(13 AS BIGINT) AS i, avg(tr) AS a FROM y WHERE i < 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT y.symbol, y.i, (r.a * 13 + y.tr) / 14 FROM r JOIN y ON y.symbol = r.symbol AND y.i = r.i + 1) SELECT y.symbol, close_time, round(a, 6) AS atr FROM y LEFT JOIN r ON y.symbol = r.symbol AND y.i = r.i",
)
def atr_14(spark, d):
    return indicators.with_atr(hourly(spark, d), 14, KEYS).select("symbol", "close_time", r6("atr"))


@query(
    "adx_14",
    f"""WITH RECURSIVE {_numbered()},
z AS (SELECT *, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END AS p, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END AS m FROM y),
r AS (SELECT symbol, CAST(14 AS BIGINT) AS i, sum(tr) AS s, sum(p) AS sp, sum(m) AS sm FROM z WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT z.symbol, z.i, r.s - r.s / 14 + z.tr, r.sp - r.sp / 14 + z.p, r.sm - r.sm / 14 + z.m FROM r JOIN z ON z.symbol = r.symbol AND z.i = r.i + 1),
x2 AS (SELECT symbol, i, CASE WHEN s = 0 OR sp + sm = 0 THEN 0.0 ELSE 100 * abs(100 * sp / s - 100 * sm / s) / (100 * sp / s + 100 * sm / s) END AS dx FROM r),
a AS (SELECT symbol, CAST(27 AS BIGINT) AS i, avg(dx) AS adx FROM x2 WHERE i BETWEEN 14 AND 27 GROUP BY symbol HAVING count(*) = 14 UNION ALL SELECT x2.symbol, x2.i, (a.adx * 13 + x2.dx) / 14 FROM a JOIN x2 ON x2.symbol = a.symbol AND x2.i = a.i + 1)
SELECT y.symbol, close_time, round(adx, 6) AS adx FROM y LEFT JOIN a ON y.symbol = a.symbol AND y.i = a.i""",
)
def adx_14(spark, d):
    return indicators.with_adx(hourly(spark, d), 14, KEYS).select("symbol", "close_time", r6("adx"))


@query("asof_value", "SELECT c.event_id, c.ts, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'click') AS c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') AS v ON v.ts <= c.ts")
def asof_value(spark, d):
    t = ticks(spark, d).withColumn("k", F.lit(1))
    views = t.filter("symbol = 'view'").select("k", F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("price").alias("seen"))
    return asof.asof(t.filter("symbol = 'click'").select("k", "event_id", "ts"), views, ("k",), "ts", "at", ("seen",), tie=("id",)).drop("k")


@query(
    "funding_zscore",
    "WITH f AS (SELECT ts, value, CASE WHEN count(*) OVER w = 20 AND stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM events WHERE event_type = 'signup' WINDOW w AS (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT c.event_id, round(z, 6) AS z FROM (SELECT * FROM events WHERE event_type = 'click') AS c ASOF LEFT JOIN (SELECT * FROM f WHERE z IS NOT NULL) AS f ON f.ts <= c.ts",
)
def funding_zscore(spark, d):
    t = ticks(spark, d)
    z = indicators.with_zscore(t.filter("symbol = 'signup'").select("symbol", "ts", "event_id", "price"), "price", 20, KEYS, "ts", "z", ("event_id",))
    z = z.filter("z is not null").select(F.lit(1).alias("k"), F.col("ts").alias("at"), F.col("event_id").alias("id"), "z")
    clicks = t.filter("symbol = 'click'").select(F.lit(1).alias("k"), "event_id", "ts")
    return asof.asof(clicks, z, ("k",), "ts", "at", ("z",), tie=("id",)).select("event_id", r6("z"))


@query(
    "oi_change",
    "WITH f AS (SELECT ts, CASE WHEN lag(value, 3) OVER (ORDER BY ts) <> 0 THEN (value - lag(value, 3) OVER (ORDER BY ts)) / abs(lag(value, 3) OVER (ORDER BY ts)) * 100 END AS change FROM events WHERE event_type = 'purchase') SELECT c.event_id, round(change, 6) AS change FROM (SELECT * FROM events WHERE event_type = 'click') AS c ASOF LEFT JOIN (SELECT * FROM f WHERE change IS NOT NULL) AS f ON f.ts <= c.ts",
)
def oi_change(spark, d):
    """Events of one instant are in the order of their ids, both where the change looks back and where a click looks."""
    t = ticks(spark, d)
    oi = t.filter("symbol = 'purchase'").select("symbol", "ts", "event_id", "price")
    changed = oi.withColumn("change", indicators.pct_change(F.col("price"), 3, Window.partitionBy("symbol").orderBy("ts", "event_id"))).filter("change is not null")
    changed = changed.select(F.lit(1).alias("k"), F.col("ts").alias("at"), F.col("event_id").alias("id"), "change")
    clicks = t.filter("symbol = 'click'").select(F.lit(1).alias("k"), "event_id", "ts")
    return asof.asof(clicks, changed, ("k",), "ts", "at", ("change",), tie=("id",)).select("event_id", r6("change"))


@query("frame_projection_1h_on_5m", f"WITH {sql_bars(5, 's')}, {sql_bars(60, 'l')} SELECT s.symbol, s.close_time, l.close AS frame_close FROM s ASOF LEFT JOIN l ON s.symbol = l.symbol AND l.close_time <= s.close_time")
def frame_projection(spark, d):
    small, large = hourly(spark, d, 5), hourly(spark, d, 60)
    right = large.select("symbol", F.col("close_time").alias("available_at"), F.col("close").alias("frame_close"))
    return asof.asof(small.select("symbol", "close_time"), right, KEYS, "close_time", "available_at", ("frame_close",))


@query(
    "liq_cluster_above",
    f"WITH {sql_bars()}, e AS (SELECT * FROM events WHERE event_type = 'error') SELECT b.symbol, b.close_time, round(coalesce((SELECT sum(e.value) FROM e WHERE e.ts >= b.close_time - INTERVAL 180 MINUTE AND e.ts <= b.close_time AND e.value > b.close), 0), 6) AS above FROM b WHERE b.symbol = 'click'",
)
def liq_cluster_above(spark, d):
    b = hourly(spark, d).filter("symbol = 'click'").select(F.lit(1).alias("k"), "symbol", "close_time", "close")
    e = ticks(spark, d).filter("symbol = 'error'").select(F.lit(1).alias("k"), "ts", F.col("price").alias("liq"))
    out = asof.trailing_range_sum(b, e, ("k",), "close_time", "ts", 180, "liq", F.col("liq") > F.col("close"), "above")
    return out.select("symbol", "close_time", r6("above"))


@query(
    "liq_cluster_below",
    f"WITH {sql_bars()}, e AS (SELECT * FROM events WHERE event_type = 'error') SELECT b.symbol, b.close_time, round(coalesce((SELECT sum(e.value) FROM e WHERE e.ts >= b.close_time - INTERVAL 180 MINUTE AND e.ts <= b.close_time AND e.value < b.close), 0), 6) AS below FROM b WHERE b.symbol = 'click'",
)
def liq_cluster_below(spark, d):
    from . import strategy

    b = hourly(spark, d).filter("symbol = 'click'")
    feeds = {"liquidations": ticks(spark, d).filter("symbol = 'error'").select(F.lit("click").alias("symbol"), F.col("ts").alias("time"), "price", F.col("price").alias("notional_usd"))}
    term = {"feature": "liq_cluster_below", "args": {"n": 180}}
    return strategy.with_features(b, {strategy.key(term): term}, feeds).select("symbol", "close_time", F.round(F.col(f"`{strategy.key(term)}`"), 6).alias("below"))


@query(
    "book_imbalance",
    f"WITH {sql_bars()}, k AS (SELECT ts, value / 500 - 0.5 AS imbalance FROM events WHERE event_type = 'view') SELECT b.symbol, b.close_time, round(imbalance, 6) AS imbalance FROM (SELECT * FROM b WHERE b.symbol = 'click') AS b ASOF LEFT JOIN k ON k.ts <= b.close_time",
)
def book_imbalance(spark, d):
    from . import strategy

    b = hourly(spark, d).filter("symbol = 'click'")
    feeds = {"book": ticks(spark, d).filter("symbol = 'view'").select(F.lit("click").alias("symbol"), F.col("ts").alias("time"), (F.col("price") / 500 - 0.5).alias("imbalance"))}
    term = {"feature": "book_imbalance"}
    return strategy.with_features(b, {strategy.key(term): term}, feeds).select("symbol", "close_time", F.round(F.col(f"`{strategy.key(term)}`"), 6).alias("imbalance"))


@query(
    "funding_cost_interval",
    "WITH f AS (SELECT o_orderdate AS t, sum(o_totalprice / 1e6) AS rate FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT o_orderkey, round(coalesce((SELECT sum(rate) FROM f WHERE f.t > o_orderdate AND f.t <= o_orderdate + INTERVAL 90 DAY), 0), 4) AS funding FROM orders",
)
def funding_cost_interval(spark, d):
    o = table(spark, d, "orders").select(F.lit(1).alias("k"), "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("entry"), "o_orderpriority", (F.col("o_totalprice") / 1e6).alias("rate"))
    trades = o.select("k", "o_orderkey", "entry", (F.col("entry") + F.expr("INTERVAL 90 DAYS")).alias("out"))
    points = o.filter("o_orderpriority = '1-URGENT'").select("k", F.col("entry").alias("t"), "rate")
    return asof.interval_sum(trades, points, ("k",), "entry", "out", "t", "rate", "funding").select("o_orderkey", F.round("funding", 4).alias("funding"))


def _sma5() -> str:
    return f"{sql_bars()}, s AS (SELECT *, {_full(5, f'avg(close) OVER {last(5)}')} AS sma FROM b)"


@query(
    "cross_and_predicates",
    f"WITH {_sma5()}, c AS (SELECT *, lag(close) OVER ({W}) AS pc, lag(sma) OVER ({W}) AS ps FROM s) SELECT symbol, close_time, coalesce(pc <= ps AND close > sma, false) AS up, coalesce(pc >= ps AND close < sma, false) AS down, coalesce(close BETWEEN least(high, low) AND greatest(high, low), false) AS inside, NOT coalesce(close > sma, false) AS not_above FROM c",
)
def cross_and_predicates(spark, d):
    b = hourly(spark, d).withColumn("sma", indicators.sma(F.col("close"), 5, order()))
    close, sma = F.col("close"), F.col("sma")
    return b.select("symbol", "close_time", p.cross_above(close, sma, order()).alias("up"), p.cross_below(close, sma, order()).alias("down"), p.between(close, F.col("high"), F.col("low")).alias("inside"), p.negated(p.gt(close, sma)).alias("not_above"))


@query("newest_crossings", f"WITH {_sma5()}, c AS (SELECT *, lag(close) OVER ({W}) AS pc, lag(sma) OVER ({W}) AS ps FROM s) SELECT symbol, close_time, close, round(sma, 6) AS sma FROM c WHERE pc <= ps AND close > sma ORDER BY close_time DESC, symbol LIMIT 100")
def newest_crossings(spark, d):
    """The newest hundred bars whose close crosses above its mean of five: a top-k report."""
    b = hourly(spark, d).withColumn("sma", indicators.sma(F.col("close"), 5, order()))
    b = b.withColumn("up", p.cross_above(F.col("close"), F.col("sma"), order())).filter("up")
    return b.select("symbol", "close_time", "close", r6("sma")).orderBy(F.desc("close_time"), "symbol").limit(100)


@query(
    "regime_labels",
    f"WITH {sql_bars()}, r AS (SELECT *, lag(close, 60) OVER ({W}) AS pc, CASE WHEN lag(close) OVER ({W}) > 0 AND close > 0 THEN ln(close / lag(close) OVER ({W})) ELSE 0 END AS ret FROM b), v AS (SELECT *, CASE WHEN count(*) OVER {last(60)} = 60 THEN stddev_pop(ret) OVER {last(60)} END AS vol FROM r), u AS (SELECT *, avg(vol) OVER {last(1440)} AS usual FROM v) SELECT symbol, close_time, CASE WHEN (close - pc) / pc > 0.002 THEN 'bull' WHEN (close - pc) / pc < -0.002 THEN 'bear' ELSE 'range' END AS direction, CASE WHEN round(vol - usual, 9) > 0 THEN 'high' ELSE 'low' END AS volatility FROM u",
)
def regime_labels(spark, d):
    return regimes.with_labels(hourly(spark, d), KEYS).select("symbol", "close_time", "direction", "volatility")


@query("regime_streak", f"WITH {sql_bars()}, o AS (SELECT symbol, close_time, close > open AS ok FROM b) SELECT symbol, close_time, count(*) OVER {last(5)} < 5 OR bool_or(ok) OVER {last(5)} AS valid FROM o")
def regime_streak(spark, d):
    b = hourly(spark, d).withColumn("ok", F.col("close") > F.col("open"))
    return b.select("symbol", "close_time", regimes.still_valid(F.col("ok"), 5, order()).alias("valid"))


_GRID = "g AS (SELECT symbol, unnest(generate_series(s, e, INTERVAL 1 HOUR)) AS slot FROM (SELECT event_type AS symbol, date_trunc('hour', min(ts)) AS s, date_trunc('hour', max(ts)) AS e FROM events GROUP BY 1)), h AS (SELECT DISTINCT event_type AS symbol, date_trunc('hour', ts) AS slot FROM events)"


def _bounds(spark, d):
    t = ticks(spark, d)
    return t.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last")), coverage.covered_slots(t, "ts", 3600, KEYS)


@query("coverage_gaps", f"WITH {_GRID} SELECT symbol, slot FROM g ANTI JOIN h USING (symbol, slot)")
def coverage_gaps(spark, d):
    bounds, slots = _bounds(spark, d)
    return coverage.missing_slots(bounds, "first", "last", slots, 3600, KEYS)


@query("coverage_summary", f"WITH {_GRID} SELECT g.symbol, count(*) AS expected, count(*) FILTER (WHERE h.slot IS NULL) AS missing, min(g.slot) FILTER (WHERE h.slot IS NULL) AS first_gap, round((count(*) - count(*) FILTER (WHERE h.slot IS NULL)) * 100.0 / count(*), 6) AS pct FROM g LEFT JOIN h ON g.symbol = h.symbol AND g.slot = h.slot GROUP BY g.symbol")
def coverage_summary(spark, d):
    bounds, slots = _bounds(spark, d)
    return coverage.summary(bounds, "first", "last", slots, 3600, KEYS).withColumn("pct", F.round("pct", 6))


@query("gaps_by_step", "WITH s AS (SELECT event_type AS symbol, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts))) // 1000000 AS step FROM events) SELECT symbol, CAST(sum(CASE WHEN step > 3600 THEN step // 3600 - 1 ELSE 0 END) AS BIGINT) AS missing, min(CASE WHEN step > 3600 THEN before END) AS first_gap_after FROM s GROUP BY symbol")
def gaps_by_step(spark, d):
    return coverage.gaps_by_step(ticks(spark, d), "ts", 3600, KEYS)


@query("reconciled_slots", "SELECT event_type AS symbol, count(DISTINCT date_trunc('hour', ts)) AS slots FROM events GROUP BY 1")
def reconciled_slots(spark, d):
    return coverage.covered_slots(ticks(spark, d), "ts", 3600, KEYS).groupBy("symbol").agg(F.count("*").alias("slots"))


@query("slot_states", "SELECT date_trunc('hour', ts) AS slot, CASE max(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) WHEN 0 THEN 'gap' WHEN 1 THEN 'partial' ELSE 'complete' END AS state FROM events GROUP BY 1")
def slot_states(spark, d):
    from ..functions.timegrid import floored

    marks = ticks(spark, d).select(floored(F.col("ts"), 3600).alias("slot"), F.when(F.col("symbol") == "error", "gap").when(F.col("symbol") == "view", "partial").otherwise("complete").alias("state"))
    return coverage.merged_states(marks, ("slot",))


_GATE = "WITH p AS (SELECT *, last_value(CASE WHEN value > 0 AND value <= 300 THEN value END IGNORE NULLS) OVER w AS pp, last_value(CASE WHEN value > 0 AND value <= 300 THEN ts END IGNORE NULLS) OVER w AS pt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


def _gated(spark, d):
    t = gate.with_continuity(ticks(spark, d), KEYS, "ts", "price", (F.col("price") > 0) & (F.col("price") <= 300), ("event_id",))
    failed = gate.flags(("nonpositive_price", F.col("price") <= 0), ("implausible_price", F.col("price") > 300), gate.phantom(F.col("price")))
    return t.withColumn("failed", failed).withColumn("noted", gate.flags(gate.tick_gap(F.col("ts"))))


@query("quality_flags", _GATE + " SELECT event_id, concat_ws(',', CASE WHEN value <= 0 THEN 'nonpositive_price' END, CASE WHEN value > 300 THEN 'implausible_price' END, CASE WHEN pp > 0 AND abs(value - pp) / pp * 100 > 5 THEN 'phantom_suspect' END) AS failed, CASE WHEN epoch_us(ts) - epoch_us(pt) > 15000000 THEN 'illiquid_window' ELSE '' END AS noted FROM p")
def quality_flags(spark, d):
    return _gated(spark, d).select("event_id", F.array_join("failed", ",").alias("failed"), F.array_join("noted", ",").alias("noted"))


@query("quarantine_counts", _GATE + ", f AS (SELECT unnest([CASE WHEN value <= 0 THEN 'nonpositive_price' END, CASE WHEN value > 300 THEN 'implausible_price' END, CASE WHEN pp > 0 AND abs(value - pp) / pp * 100 > 5 THEN 'phantom_suspect' END]) AS failing_check FROM p) SELECT failing_check, count(*) AS n FROM f WHERE failing_check IS NOT NULL GROUP BY 1")
def quarantine_counts(spark, d):
    _, bad = gate.split(_gated(spark, d), F.col("failed"))
    return gate.pointers(bad, "failed", "event_id").groupBy("failing_check").agg(F.count("*").alias("n"))


@query("throttle_aligned", "SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS slot, arg_max(value, ts) AS price FROM events GROUP BY 1, 2")
def throttle_aligned(spark, d):
    """The last tick of each aligned hour; the form by time since the last emission is a streaming operator."""
    from ..functions.timegrid import floored

    return ticks(spark, d).groupBy("symbol", floored(F.col("ts"), 3600).alias("slot")).agg(F.max_by("price", "ts").alias("price"))


@query("delta_merge", "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS mark, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS idx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def delta_merge(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    field = lambda kind: F.last(F.when(F.col("event_type") == kind, F.col("value")), ignorenulls=True).over(w)
    return table(spark, d, "events").select("event_id", field("view").alias("mark"), field("click").alias("idx"))


POLICY = replay.Policy(target_r=1.5, time_exit=12, trailing=False)


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Crossings above the mean of five hourly closes, with a stop of two percent."""
    b = hourly(spark, d).withColumn("sma", indicators.sma(F.col("close"), 5, order()))
    b = b.withColumn("signal", p.cross_above(F.col("close"), F.col("sma"), order())).withColumn("stop_distance", F.col("close") * 0.02)
    return replay.candidates(b, KEYS, POLICY, replay.Costs())


#: Signals with their exits, then the trades taken one after another: a row for each signal, k counting them.
_TRADES = f"""WITH RECURSIVE {sql_bars()},
m AS (SELECT *, CASE WHEN count(*) OVER {last(5)} = 5 THEN avg(close) OVER {last(5)} END AS sma, row_number() OVER ({W}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, lead(open) OVER ({W}) * 1.0001 AS entry, lead(close_time) OVER ({W}) AS entry_time FROM b),
c AS (SELECT *, close - close * 0.02 AS stop, entry + abs(entry - (close - close * 0.02)) * 1.5 AS target FROM (SELECT *, lag(close) OVER ({W}) <= lag(sma) OVER ({W}) AND close > sma AS signal FROM m) WHERE signal AND close > 0 AND i < n - 2),
x AS (SELECT c.symbol, c.i, c.close, c.stop, c.entry, c.entry_time, y.i AS exit_i, y.close_time AS exit_time, CASE WHEN y.i = least(c.i + 13, c.n - 1) THEN 'time' WHEN y.low <= c.stop THEN 'stop' ELSE 'target' END AS reason, y.close AS y_close, c.target FROM c JOIN m y ON y.symbol = c.symbol AND y.i BETWEEN c.i + 1 AND c.i + 13 WHERE y.i = least(c.i + 13, c.n - 1) OR y.low <= c.stop OR y.high >= c.target QUALIFY row_number() OVER (PARTITION BY c.symbol, c.i ORDER BY y.i) = 1),
s AS (SELECT *, CASE reason WHEN 'time' THEN y_close WHEN 'stop' THEN stop ELSE target END * 0.9999 AS exit, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM x WHERE i >= 60),
r AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS k, CAST(60 AS BIGINT) AS free, CAST(10000 AS DOUBLE) AS equity, CAST(0 AS DOUBLE) AS qty, CAST(0 AS DOUBLE) AS gross, CAST(0 AS DOUBLE) AS fees FROM s
UNION ALL SELECT symbol, k, CASE WHEN q > 0 THEN exit_i + 1 ELSE free END, equity + (exit - entry) * q - (entry + exit) * q * 0.00055, q, (exit - entry) * q, (entry + exit) * q * 0.00055 FROM (SELECT *, CASE WHEN i < free OR lot < 0.001 OR lot * close < 5 OR lot * close > equity * 3 THEN 0.0 ELSE lot END AS q FROM (SELECT s.*, r.free, r.equity, floor(r.equity * 0.0025 / abs(s.close - s.stop) / 0.001 + 1e-9) * 0.001 AS lot FROM r JOIN s ON s.symbol = r.symbol AND s.k = r.k + 1))),
t AS (SELECT s.symbol, entry_time, exit_time, reason, entry AS entry_price, exit AS exit_price, r.qty, r.gross AS gross_pnl, r.fees, r.gross - r.fees AS net_pnl, r.equity FROM r JOIN s ON s.symbol = r.symbol AND s.k = r.k WHERE r.qty > 0)
"""


@query("replay_trades", _TRADES + "SELECT symbol, entry_time, exit_time, reason, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("entry_price", "exit_price", "qty", "gross_pnl", "fees", "net_pnl", "equity")) + " FROM t")
def replay_trades(spark, d):
    t = replay.trades(signals(spark, d), KEYS, POLICY, replay.Costs())
    # prices of two decimals times rates end in a 5 often; what is added keeps them off the middle between two values
    return t.select("symbol", "entry_time", "exit_time", "reason", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("entry_price", "exit_price", "qty", "gross_pnl", "fees", "net_pnl", "equity")))


@query("equity_curve", _TRADES + "SELECT symbol, exit_time, round(equity, 6) AS equity, round(peak, 6) AS peak, round((peak - equity) / peak * 100, 6) AS drawdown_pct FROM (SELECT *, greatest(10000.0, max(equity) OVER (PARTITION BY symbol ORDER BY exit_time ROWS UNBOUNDED PRECEDING)) AS peak FROM t)")
def equity_curve(spark, d):
    c = replay.equity_curve(replay.trades(signals(spark, d), KEYS, POLICY, replay.Costs()), 10_000.0, KEYS)
    return c.select("symbol", "exit_time", *(F.round(x, 6).alias(x) for x in ("equity", "peak", "drawdown_pct")))


@query(
    "arbiter_choices",
    """WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS slot, event_id, event_type AS strategy_id, CASE WHEN user_id % 10 < 8 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN NULL WHEN event_type = 'error' THEN 0.0 ELSE value / 100 * 0.5 END AS score FROM events),
g AS (SELECT slot, count(*) FILTER (WHERE score > 0) AS live, count(DISTINCT direction) FILTER (WHERE score > 0) AS dirs, arg_max(strategy_id, struct_pack(s := score, t := -event_id)) FILTER (WHERE score > 0) AS best, max(score) FILTER (WHERE score > 0) AS score FROM s GROUP BY 1)
SELECT slot, CASE WHEN live = 0 THEN 'all_stale' WHEN dirs > 1 THEN 'conflict' ELSE 'ok' END AS reason, CASE WHEN live > 0 AND dirs = 1 THEN best END AS strategy_id, CASE WHEN live > 0 AND dirs = 1 THEN round(score, 6) END AS score FROM g""",
)
def arbiter_choices(spark, d):
    from ..functions.timegrid import floored
    from ..operators import decisions

    e = table(spark, d, "events")
    c = F.col
    scope = F.when(c("event_type") == "error", F.array(F.lit("bear"))).otherwise(F.expr("cast(array() as array<string>)"))
    regime = F.when(c("user_id") % 3 == 0, None).otherwise("bull")
    s = e.select(floored(c("ts"), 3600).alias("slot"), "event_id", c("event_type").alias("strategy_id"), F.when(c("user_id") % 10 < 8, "LONG").otherwise("SHORT").alias("direction"), (c("value") / 100).alias("weight"), F.lit(0.5).alias("confidence"), F.lit(1.0).alias("sharpe"), scope.alias("regime_scope"), regime.alias("regime"))
    return decisions.chosen(s, ("slot",), "event_id").withColumn("score", F.round("score", 6))


def _all_bars(minutes: int, name: str) -> str:
    start = f"time_bucket(INTERVAL {minutes} MINUTE, ts)"
    return f"{name} AS (SELECT {start} AS open_time, {start} + INTERVAL {minutes} MINUTE - INTERVAL 1 MILLISECOND AS close_time, max(value) AS high, min(value) AS low, arg_max(value, (ts, value)) AS close FROM events GROUP BY ALL)"


def _smoothed_sql(i: str, rows: str, x: str, seed: int, n: int = 14) -> str:
    """Wilder's average at row i as the sum of its weights, which are below 1e-20 farther back than 700 rows."""
    q = f"({n - 1} / {n}.0)"
    return f"(SELECT sum(CASE WHEN z.i > {seed} THEN z.{x} / {n} * pow({q}, {i} - z.i) ELSE z.{x} / {n} * pow({q}, {i} - {seed}) END) FROM {rows} AS z WHERE z.i > {seed} - {n} AND z.i <= {i} AND z.i > {i} - 700)"


@query(
    "strategy_signals",
    f"""WITH {_all_bars(1, "m")}, {_all_bars(60, "h")},
y AS (SELECT *, row_number() OVER w - 1 AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, lag(close, 60) OVER w AS pc, CASE WHEN lag(close) OVER w > 0 AND close > 0 THEN ln(close / lag(close) OVER w) ELSE 0 END AS ret, CASE WHEN row_number() OVER w >= 20 THEN avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sma FROM m WINDOW w AS (ORDER BY close_time)),
v AS (SELECT *, lag(close) OVER (ORDER BY i) <= lag(sma) OVER (ORDER BY i) AND close > sma AS crosses, CASE WHEN i >= 59 THEN stddev_pop(ret) OVER (ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END AS vol FROM y),
u AS (SELECT *, avg(vol) OVER (ORDER BY i ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW) AS usual FROM v),
k AS (SELECT close_time, row_number() OVER w - 1 AS i, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down FROM h WINDOW w AS (ORDER BY close_time)),
g AS (SELECT close_time, CASE WHEN k.i >= 14 THEN {_smoothed_sql("k.i", "k", "up", 14)} END AS up, CASE WHEN k.i >= 14 THEN {_smoothed_sql("k.i", "k", "down", 14)} END AS down FROM k),
s AS (SELECT u.*, CASE WHEN g.down = 0 THEN 100 ELSE 100 - 100 / (1 + g.up / g.down) END AS rsi FROM u ASOF LEFT JOIN g ON g.close_time <= u.close_time WHERE u.crosses)
SELECT close_time, close, CASE WHEN (close - pc) / pc > 0.002 THEN 'bull' WHEN (close - pc) / pc < -0.002 THEN 'bear' ELSE 'range' END || '_' || CASE WHEN round(vol - usual, 9) > 0 THEN 'high' ELSE 'low' END AS regime, round(CASE WHEN s.i >= 13 THEN 1.5 * {_smoothed_sql("s.i", "y", "tr", 13)} END, 6) AS stop_distance FROM s WHERE NOT coalesce(rsi > 70, false)""",
)
def strategy_signals(spark, d):
    """A predicate over two timeframes on bars of a minute of all events."""
    from . import strategy

    t = ticks(spark, d).withColumn("symbol", F.lit("all"))
    minute = bars.from_points(t, 1, "ts", "price", "price", KEYS)
    tree = {"and": [{"left": {"feature": "close"}, "op": "cross_above", "right": {"feature": "sma", "args": {"n": 20}}}, {"not": {"left": {"feature": "rsi", "timeframe": "1h", "args": {"n": 14}}, "op": "gt", "right": {"param": "hot"}}}]}
    return strategy.signals(minute, tree, {"hot": 70.0}).filter("signal").select("close_time", "close", "regime", r6("stop_distance"))
