"""Reading and writing tables of records, bars and their sidecars as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timegrid import from_micros, micros
from ..operators.bitemporal import KEY, first_per_key, new_rows
from ..operators.gate import pointers, split

ENVELOPE = (
    "record_id string, dataset_id string, source string, venue string, symbol string, event_time timestamp_ntz, collection_time timestamp_ntz, ingest_time timestamp_ntz, valid_from_sys timestamp_ntz, supersedes string, correction_reason string, "
    "producer string, code_version string, schema_version int, config_hash string, quality_flags array<string>, quality_ok boolean, quality_gate_version string, annotations array<string>, stage_latency_ms map<string,double>, payload string"
)
#: The payload of each dataset.
PAYLOADS = {
    "btc_price_tick": "price double, qty double, trade_id string, buyer_is_maker boolean",
    "btc_ohlcv_1m": "open double, high double, low double, close double, volume double, quote_volume double, trades long, open_time timestamp_ntz, close_time timestamp_ntz",
    "btc_funding": "mark_price double, index_price double, funding_rate double, next_funding_time timestamp_ntz",
    "btc_open_interest": "open_interest double",
    "btc_liquidation": "side string, price double, qty double, notional_usd double",
    "btc_orderbook": "best_bid double, best_ask double, spread double, bid_volume double, ask_volume double, imbalance double, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>",
    "btc_funding_8h": "funding_rate double",
    "btc_oi_5m": "open_interest double, open_interest_value_usd double",
}
#: How the names of a venue's sources begin.
VENUES = {"binance": "binance", "bybit": "bybit"}
BARS = "timestamp timestamp_ntz, open double, high double, low double, close double, volume double"


class MissingData(Exception):
    """A file or window that must have rows has none."""


def venue_of(source):
    """The venue by the source's name; null for an unknown one."""
    return F.coalesce(*(F.when(source.startswith(prefix), F.lit(v)) for v, prefix in VENUES.items()))


def typed(records: DataFrame, dataset_id: str) -> DataFrame:
    """The records of a dataset with the fields of their payload as columns."""
    rows = records.filter(F.col("dataset_id") == dataset_id).withColumn("_p", F.from_json("payload", PAYLOADS[dataset_id]))
    return rows.select(*(c for c in records.columns if c != "payload"), "_p.*")


def write_records(incoming: DataFrame, path: str, stored: DataFrame | None = None) -> None:
    """Clean records, one for each natural key and none that is stored, are appended to the archive by event
    date and dataset; failed ones go to quarantine with a pointer row for each flag."""
    clean, failed = split(incoming, F.coalesce("quality_flags", F.expr("cast(array() as array<string>)")))
    clean = first_per_key(clean, KEY, ("collection_time", "record_id"))
    if stored is not None:
        clean = new_rows(clean, stored)
    dated = lambda df: df.withColumn("event_date", F.to_date("event_time"))
    dated(clean).write.mode("append").partitionBy("event_date", "dataset_id").option("compression", "zstd").parquet(f"{path}/archive")
    dated(failed).write.mode("append").partitionBy("event_date", "dataset_id").parquet(f"{path}/quarantine")
    pointers(failed, "quality_flags", "record_id", "dataset_id", "event_time").write.mode("append").parquet(f"{path}/quality_events")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Each archive file with its length, SHA-256 and rows, found where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    hashed = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
    return hashed.join(rows, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def unverified(manifest_: DataFrame, now: DataFrame) -> DataFrame:
    """Files of a manifest that are gone or differ; partitions may be dropped only where there are none."""
    later = now.select("path", F.col("sha256").alias("_s"), F.col("rows").alias("_r"))
    return manifest_.join(later, "path", "left").filter(~(F.col("sha256").eqNullSafe(F.col("_s")) & F.col("rows").eqNullSafe(F.col("_r")))).drop("_s", "_r")


def load_bars(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Bars of a file whose close lies in [start, end]; a bar opens 59.999 seconds before it closes."""
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = spark.read.schema(BARS).parquet(path).filter(F.col("timestamp").between(lit(start), lit(end)))
    return rows.select(from_micros(micros(F.col("timestamp")) - 59_999_000).alias("open_time"), F.col("timestamp").alias("close_time"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def load_funding(spark: SparkSession, bars_path: str, start, end) -> DataFrame:
    """The funding rates beside a bar file; a missing file or an empty window is an error."""
    path = f"{bars_path.removesuffix('.parquet')}_funding.parquet"
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = spark.read.schema("timestamp timestamp_ntz, funding_rate double").parquet(path).filter(F.col("timestamp").between(lit(start), lit(end)))
    if rows.isEmpty():
        raise MissingData(f"{path} has no funding between {start} and {end}")
    return rows.select(F.col("timestamp").alias("time"), F.col("funding_rate").alias("rate"))


def write_vectors(vectors: DataFrame, path: str, version: str, day: str) -> None:
    """Feature vectors of a version and day, which are never overwritten."""
    if vectors.isEmpty():
        raise MissingData("no vectors")
    vectors.write.mode("errorifexists").parquet(f"{path}/version={version}/day={day}")


def latest(records: DataFrame, dataset_id: str, limit: int, most: int = 500) -> DataFrame:
    rows = records.filter(F.col("dataset_id") == dataset_id)
    return rows.orderBy(F.desc("event_time"), "record_id").limit(min(limit, most))
