"""The quality gate: flags that quarantine a record, and flags that only annotate it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import micros

#: Tolerated clock skew and tick gap in seconds, the largest move in percent, plausible funding.
SKEW_S, TICK_GAP_S, MOVE_PCT, FUNDING = 2, 15, 5.0, 0.02
#: Staleness budgets in seconds.
BUDGETS_S = {"btc_price_tick": 3, "btc_ohlcv_1m": 75, "btc_funding": 90, "btc_open_interest": 120, "btc_orderbook": 30}


def flags(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules)))


def first_flag(*rules: tuple[str, Column]) -> Column:
    """The first rule that holds, as an array of one; an empty array if none does."""
    hit = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules))
    return F.array_compact(F.array(hit))


def lookahead() -> tuple[str, Column]:
    return "lookahead_violation", micros(F.col("event_time")) > micros(F.col("collection_time")) + SKEW_S * 1_000_000


def sanity() -> list[tuple[str, Column]]:
    """Impossible values by dataset; only the first counts. Columns of other datasets may be null."""
    c = F.col
    price = F.when(c("dataset_id") == "btc_price_tick", c("price")).when(c("dataset_id") == "btc_ohlcv_1m", c("close")).when(c("dataset_id") == "btc_funding", c("mark_price"))
    is_ = lambda *names: c("dataset_id").isin(*names)
    return [
        ("nonpositive_price", price <= 0),
        ("ohlc_incoherent", is_("btc_ohlcv_1m") & ~((c("high") >= F.greatest("open", "close")) & (F.least("open", "close") >= c("low")) & (c("low") > 0))),
        ("nonpositive_price", is_("btc_funding") & (c("index_price") <= 0)),
        ("funding_rate_implausible", is_("btc_funding", "btc_funding_8h") & (F.abs("funding_rate") > FUNDING)),
        ("nonpositive_open_interest", is_("btc_open_interest", "btc_oi_5m") & (c("open_interest") <= 0)),
        ("liquidation_incoherent", is_("btc_liquidation") & ((c("price") <= 0) | (c("qty") <= 0) | ~c("side").isin("BUY", "SELL"))),
        ("nonpositive_price", is_("btc_orderbook") & ((c("best_bid") <= 0) | (c("best_ask") <= 0))),
        ("crossed_book", is_("btc_orderbook") & (c("best_bid") >= c("best_ask"))),
    ]


def with_continuity(rows: DataFrame, keys: tuple[str, ...], time: str, price: str, accepted: Column, tie: tuple[str, ...] = ()) -> DataFrame:
    """rows with _prev_price and _prev_time, those of the last accepted row before, at the same time by `tie`, then by
    price: rows that were quarantined don't count, rows that only look like phantoms do."""
    w = Window.partitionBy(*keys).orderBy(time, *tie, price).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda x: F.last(F.when(accepted, x), ignorenulls=True).over(w)
    return rows.withColumn("_prev_price", last(F.col(price))).withColumn("_prev_time", last(F.col(time)))


def phantom(price: Column) -> tuple[str, Column]:
    return "phantom_suspect", (F.col("_prev_price") > 0) & (F.abs(price - F.col("_prev_price")) / F.col("_prev_price") * 100 > MOVE_PCT)


def tick_gap(time: Column) -> tuple[str, Column]:
    return "illiquid_window", (micros(time) - micros(F.col("_prev_time"))) > TICK_GAP_S * 1_000_000


def stale() -> tuple[str, Column]:
    """By ingest time, so that a replay gives the same; backfilled rows are exempt."""
    budget = F.coalesce(*(F.when(F.col("dataset_id") == d, F.lit(s)) for d, s in BUDGETS_S.items()))
    return "stale", ~F.col("backfill") & (micros(F.col("ingest_time")) - micros(F.col("event_time")) > budget * 1_000_000)


def split(rows: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and quarantined ones."""
    bad = F.size(failed) > 0
    return rows.filter(~bad), rows.filter(bad)


def pointers(quarantined: DataFrame, failed: str, *keep: str) -> DataFrame:
    """A row for each flag of a quarantined record, `unspecified` if it has none."""
    return quarantined.select(*keep, F.explode_outer(failed).alias("failing_check")).withColumn("failing_check", F.coalesce("failing_check", F.lit("unspecified")))
