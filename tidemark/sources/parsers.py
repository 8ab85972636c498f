"""Raw venue messages as typed records: one rule for each venue and dataset, all with the same payload.

A message that can't be parsed keeps null fields and the flag `parse_failed`, so that it goes to quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import from_micros
from ..operators.decisions import depth
from .records import PAYLOADS, venue_of

#: Where each venue keeps the event time (milliseconds) and the fields of a payload. A path ending in
#: ! is a time in milliseconds; the others are cast to the payload's type.
FIELDS = {
    ("binance", "btc_price_tick"): ("T", {"price": "p", "qty": "q", "trade_id": "a", "buyer_is_maker": "m"}),
    ("binance", "btc_ohlcv_1m"): ("k.T", {"open": "k.o", "high": "k.h", "low": "k.l", "close": "k.c", "volume": "k.v", "quote_volume": "k.q", "trades": "k.n", "open_time": "k.t!", "close_time": "k.T!"}),
    ("binance", "btc_funding"): ("E", {"mark_price": "p", "index_price": "i", "funding_rate": "r", "next_funding_time": "T!"}),
    ("binance", "btc_liquidation"): ("o.T", {"side": "o.S", "price": "o.ap", "qty": "o.q"}),
    ("binance", "btc_orderbook"): ("E", {}),
    ("binance", "btc_open_interest"): ("time", {"open_interest": "openInterest"}),
    ("binance", "btc_funding_8h"): ("fundingTime", {"funding_rate": "fundingRate"}),
    ("binance", "btc_oi_5m"): ("timestamp", {"open_interest": "sumOpenInterest", "open_interest_value_usd": "sumOpenInterestValue"}),
    ("bybit", "btc_price_tick"): ("T", {"price": "p", "qty": "v", "trade_id": "i", "buyer_is_maker": "S"}),
    ("bybit", "btc_ohlcv_1m"): ("end", {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "quote_volume": "turnover", "open_time": "start!", "close_time": "end!"}),
    ("bybit", "btc_funding"): ("_ts", {"mark_price": "markPrice", "index_price": "indexPrice", "funding_rate": "fundingRate", "next_funding_time": "nextFundingTime!"}),
    ("bybit", "btc_liquidation"): ("T", {"side": "S", "price": "p", "qty": "v"}),
    ("bybit", "btc_orderbook"): ("E", {}),
    ("bybit", "btc_open_interest"): ("_ts", {"open_interest": "openInterest"}),
    ("bybit", "btc_funding_8h"): ("fundingRateTimestamp", {"funding_rate": "fundingRate"}),
    ("bybit", "btc_oi_5m"): ("timestamp", {"open_interest": "openInterest"}),
}
#: Fields that a venue doesn't publish; null, never zero.
OPTIONAL = {"trades", "open_interest_value_usd", "trade_id", "buyer_is_maker"}


def _at(raw: Column, path: str) -> Column:
    return F.get_json_object(raw, f"$.{path.rstrip('!')}")


def _millis(x: Column) -> Column:
    return from_micros(x.try_cast("long") * 1000)


def _book(raw: Column) -> dict[str, Column]:
    side = lambda name: F.transform(F.from_json(_at(raw, name), "array<array<string>>"), lambda x: F.struct(F.get(x, 0).try_cast("double").alias("price"), F.get(x, 1).try_cast("double").alias("qty")))
    bids, asks = side("b"), side("a")
    volume_b, volume_a, imbalance = depth(bids, asks, 1000)
    best_b, best_a = F.coalesce(F.get(bids, 0)["price"], F.lit(0.0)), F.coalesce(F.get(asks, 0)["price"], F.lit(0.0))
    return {"best_bid": best_b, "best_ask": best_a, "spread": F.round(best_a - best_b, 8), "bid_volume": volume_b, "ask_volume": volume_a, "imbalance": imbalance, "bids": bids, "asks": asks}


def payload(raw: Column, venue: str, dataset: str) -> Column:
    """The payload's fields as a struct."""
    kinds = dict(x.split(" ", 1) for x in PAYLOADS[dataset].split(", "))
    _, paths = FIELDS[venue, dataset]
    made = _book(raw) if dataset == "btc_orderbook" else {}
    for name, kind in kinds.items():
        if name in paths:
            value = _at(raw, paths[name])
            made[name] = _millis(value) if paths[name].endswith("!") else value.try_cast(kind)
    if (venue, dataset) == ("bybit", "btc_price_tick"):
        # this venue names the taker's side, the other whether the buyer made the order
        made["buyer_is_maker"] = _at(raw, "S") == "Sell"
    if (venue, dataset) == ("binance", "btc_liquidation"):
        made["price"] = F.coalesce(F.when(made["price"] != 0, made["price"]), _at(raw, "o.p").try_cast("double"))
    if dataset == "btc_liquidation":
        made["notional_usd"] = made["price"] * made["qty"]
    return F.struct(*(made.get(n, F.lit(None).cast(k)).cast(k).alias(n) for n, k in kinds.items()))


def parsed(items: DataFrame, venue: str, dataset: str) -> DataFrame:
    """The items of a venue and dataset with event_time, the payload's fields and `parse_failed`. items: dataset_id,
    source, raw (JSON text) and what else they carry."""
    some = items.filter((F.col("dataset_id") == dataset) & (venue_of(F.col("source")) == venue))
    time, _ = FIELDS[venue, dataset]
    made = some.withColumn("venue", F.lit(venue)).withColumn("event_time", _millis(_at(F.col("raw"), time))).withColumn("payload", payload(F.col("raw"), venue, dataset))
    needed = [n for n in made.schema["payload"].dataType.names if n not in OPTIONAL]
    failed = F.col("event_time").isNull()
    for n in needed:
        failed = failed | F.col("payload")[n].isNull()
    return made.withColumn("parse_failed", failed)


def bybit_candle(row: Column) -> Column:
    """A REST candle, an array of seven strings from the start time on, as a message like the socket's."""
    at = lambda k: F.get(row, k)
    return F.to_json(F.struct(at(0).alias("start"), (at(0).cast("long") + 59_999).cast("string").alias("end"), at(1).alias("open"), at(2).alias("high"), at(3).alias("low"), at(4).alias("close"), at(5).alias("volume"), at(6).alias("turnover")))
