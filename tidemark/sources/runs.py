"""Windows of several feeds, blobs, run records, snapshots, exports and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import before_colon
from ..operators import bitemporal, coverage, indicators
from .records import MissingData, load_bars, load_funding, typed

#: The dataset of each feed.
FEEDS = {"ohlcv": "btc_ohlcv_1m", "funding": "btc_funding_8h", "oi": "btc_oi_5m", "orderbook": "btc_orderbook", "liquidations": "btc_liquidation"}


def window(records: DataFrame, feeds: tuple[str, ...], start, end, venue: str, as_of) -> dict[str, DataFrame]:
    """A frame for each feed, bars and funding always, all as of one instant."""
    unknown = set(feeds) - set(FEEDS)
    if unknown:
        raise ValueError(f"unknown feeds {sorted(unknown)}")
    return {f: typed(bitemporal.read_as_of(records, d, start, end, venue, as_of), d) for f, d in FEEDS.items() if f in (*feeds, "ohlcv", "funding")}


def file_window(spark: SparkSession, path: str, start, end, allow_gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bars and funding of a file; a window without bars or, unless allowed, with gaps is refused."""
    bars = load_bars(spark, path, start, end)
    gaps = coverage.gaps_by_step(bars, "close_time", 60).first()
    if gaps is None:
        raise MissingData(f"{path} has no bars between {start} and {end}")
    if gaps["missing"] and not allow_gaps:
        raise coverage.CoverageError(f"{gaps['missing']} bars are missing, the first after {gaps['first_gap_after']}")
    return bars, load_funding(spark, path, start, end)


def write_blob(spark: SparkSession, path: str, fields: dict[str, str]) -> None:
    spark.createDataFrame(sorted(fields.items()), "field string, text string").coalesce(1).write.mode("errorifexists").parquet(path)


def read_blob(spark: SparkSession, path: str) -> dict[str, str]:
    return spark.read.schema("field string, text string").parquet(path).agg(F.map_from_entries(F.collect_list(F.struct("field", "text")))).first()[0]


def save_run(run: dict, trades: DataFrame, curve: DataFrame, path: str) -> None:
    """A run's trades and curve, then its row; a run that isn't pinned to an instant is refused."""
    if run.get("as_of") is None:
        raise ValueError("a run needs an as_of")
    trades.write.parquet(f"{path}/trades/run={run['run_id']}")
    curve.write.parquet(f"{path}/curve/run={run['run_id']}")
    row = {k: str(v) for k, v in sorted(run.items())}
    trades.sparkSession.createDataFrame([(row["run_id"], row)], "run_id string, meta map<string,string>").write.mode("append").parquet(f"{path}/runs")


def first_kept(events: DataFrame, key: tuple[str, ...], order: Column, once: tuple[str, ...], latest: tuple[str, ...]) -> DataFrame:
    """Upserts as a view of appended events: columns in `once` keep their first value, those in `latest` their last."""
    return events.groupBy(*key).agg(*(F.min_by(c, order).alias(c) for c in once), *(F.max_by(c, order).alias(c) for c in latest))


def counted(events: DataFrame, key: tuple[str, ...], time: str) -> DataFrame:
    """A counter for each key from appended events: how often, first and last."""
    return events.groupBy(*key).agg(F.count("*").alias("replays"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))


def snapshot(df: DataFrame, path: str, day: str, time: str | None = None) -> None:
    """A table's rows as JSON, those of the day if a time is named; a day's snapshot is written once."""
    rows = df if time is None else df.filter((F.col(time) >= F.lit(day).cast("timestamp_ntz")) & (F.col(time) < F.lit(day).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")))
    rows.select(F.to_json(F.struct("*")).alias("row")).write.mode("errorifexists").parquet(f"{path}/day={day}")


def export(bars: DataFrame, books: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The export file's eleven columns: bars without a null close, their indicators, and the last book of each
    minute. books: keys, time, spread, imbalance."""
    order = Window.partitionBy(*keys).orderBy("close_time")
    b = bars.filter("close is not null")
    b = indicators.export_atr(indicators.with_rsi(b, "close", 14, keys, "close_time"), 14, keys)
    before = F.lag("close").over(order)
    b = b.withColumn("_r", F.when(before != 0, F.col("close") / before - 1).otherwise(0.0)).withColumn("_n", F.row_number().over(order))
    vol = F.when(F.col("_n") > 60, indicators.export_volatility(F.col("close"), F.col("_r"), 60, order))
    minute = F.date_trunc("minute", "time").cast("timestamp_ntz")
    last = books.groupBy(*keys, minute.alias("_m")).agg(F.max_by("spread", "time").alias("spread"), F.max_by("imbalance", "time").alias("ofi"))
    b = b.withColumn("volatility", vol).withColumn("_m", F.date_trunc("minute", "close_time").cast("timestamp_ntz"))
    return b.join(last, [*keys, "_m"], "left").select(*keys, F.col("close_time").alias("timestamp"), "open", "high", "low", "close", "volume", "rsi", "atr", "volatility", "spread", "ofi")


def outcomes(verdicts: DataFrame, last: int = 100) -> DataFrame:
    """How the newest verdicts turned out; counts only. verdicts: at, verdict, realized_adverse, realized_known."""
    some = verdicts.filter("realized_known").orderBy(F.desc("at")).limit(last)
    yes, no, bad = F.col("verdict") == "APPROVE", F.col("verdict") == "VETO", F.col("realized_adverse")
    return some.agg(F.count("*").alias("sample"), F.count_if(yes).alias("approvals"), F.count_if(yes & bad).alias("approvals_that_went_adverse"), F.count_if(no).alias("vetoes"), F.count_if(no & bad).alias("vetoes_that_avoided_adverse"))


def reason_names(rows: DataFrame, reason: str) -> DataFrame:
    """The distinct names of reasons, without what follows the colon."""
    return rows.select(before_colon(F.col(reason)).alias("name")).distinct().orderBy("name")


def latencies(samples: DataFrame, keys: tuple[str, ...], time: str, value: str, last: int = 500) -> DataFrame:
    """Nearest-rank median and 95th percentile of each key's newest samples."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(time))
    some = samples.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= last)
    w = Window.partitionBy(*keys)
    some = some.withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    at = lambda p: F.max(F.when(F.col("_i") == F.bround(F.lit(p) * (F.col("_n") - 1), 0), F.col(value)))
    return some.groupBy(*keys).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.count("*").alias("samples"))


def due_for_tier_out(partitions: DataFrame, hours: dict[str, int], now) -> DataFrame:
    """Day partitions older than the longest window of any dataset in them. partitions: event_date, dataset_id."""
    keep = F.coalesce(*(F.when(F.col("dataset_id") == d, F.lit(h)) for d, h in hours.items()), F.lit(max(hours.values())))
    longest = partitions.groupBy("event_date").agg(F.max(keep).alias("hours"))
    ends = F.timestamp_seconds(F.unix_seconds(F.col("event_date").cast("timestamp")) + 86400 + F.col("hours") * 3600)
    return longest.filter(ends <= F.lit(now).cast("timestamp"))
