"""Predicates given as nested dicts, over features of bars, as Columns.

{"and": [...]}, {"or": [...]}, {"not": ...} or {"left": feature, "op": ..., "right": term}; between has a second
term, "right2". A term is a number, {"const": x}, {"param": name} or {"feature": name, "timeframe": "1h", "args":
{"n": 14}}. A feature of a larger timeframe is seen once its bar has nominally closed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions.timegrid import TIMEFRAMES
from ..operators import asof, bars, indicators, regimes

#: The features, and the bounds of their argument n, None for those without.
FEATURES = {"close": None, "high": None, "low": None, "ema": (2, 400), "sma": (2, 400), "rsi": (2, 100), "atr": (2, 200), "adx": (2, 100), "bb_position": (5, 200), "vwap_dist": None, "realized_vol": (5, 400), "atr_pct": (2, 200), "ret_pct": (1, 400), "funding_rate": None, "funding_zscore": (3, 200), "oi_change": (1, 288), "book_imbalance": None, "liq_cluster_above": (1, 1440), "liq_cluster_below": (1, 1440)}
#: Features that come from a feed of their own and have no timeframe: the feed and its value.
FEEDS = {"funding_rate": ("funding", "rate"), "funding_zscore": ("funding", "rate"), "oi_change": ("open_interest", "open_interest"), "book_imbalance": ("book", "imbalance"), "liq_cluster_above": ("liquidations", "notional_usd"), "liq_cluster_below": ("liquidations", "notional_usd")}
OPS = {"gt": p.gt, "lt": p.lt, "gte": p.gte, "lte": p.lte}
KEYS = ("symbol",)


class Rejected(ValueError):
    """A predicate that can't be compiled; the message says where and why."""


def key(term: dict) -> str:
    n = term.get("args", {}).get("n")
    return f"{term['feature']}({term.get('timeframe') or '1m'}{'' if n is None else f',n={int(n)}'})"


def _is_number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def features(tree: dict, path: str = "entry") -> dict[str, dict]:
    """The feature terms of a predicate by key; raises at the first thing that isn't allowed."""
    if not isinstance(tree, dict):
        raise Rejected(f"{path}: not an object")
    for name in ("and", "or"):
        if name in tree:
            if set(tree) != {name} or not isinstance(tree[name], list) or not tree[name]:
                raise Rejected(f"{path}: {name} needs children and nothing else")
            return {k: t for i, c in enumerate(tree[name]) for k, t in features(c, f"{path}.{name}[{i}]").items()}
    if "not" in tree:
        if set(tree) != {"not"}:
            raise Rejected(f"{path}: not needs one child and nothing else")
        return features(tree["not"], f"{path}.not")
    op = tree.get("op")
    wanted = {"left", "op", "right"} | ({"right2"} if op == "between" else set())
    if op not in (*OPS, "cross_above", "cross_below", "between") or set(tree) != wanted:
        raise Rejected(f"{path}: needs {sorted(wanted)} with a known op")
    if not isinstance(tree["left"], dict) or "feature" not in tree["left"]:
        raise Rejected(f"{path}.left: must be a feature")
    found = {}
    for side in sorted(wanted - {"op"}):
        t = tree[side]
        if _is_number(t):
            continue
        if not isinstance(t, dict):
            raise Rejected(f"{path}.{side}: not a term")
        if "feature" in t:
            args = t.get("args", {})
            if set(t) - {"feature", "timeframe", "args"} or t["feature"] not in FEATURES or t.get("timeframe") not in (None, *TIMEFRAMES) or not isinstance(args, dict):
                raise Rejected(f"{path}.{side}: unknown feature, timeframe or key")
            bounds = FEATURES[t["feature"]]
            if set(args) != ({"n"} if bounds else set()) or bounds and not (_is_number(args["n"]) and bounds[0] <= args["n"] <= bounds[1]):
                raise Rejected(f"{path}.{side}: arguments out of bounds")
            if t["feature"] in FEEDS and t.get("timeframe") not in (None, "1m"):
                raise Rejected(f"{path}.{side}: {t['feature']} has no timeframe")
            found[key(t)] = t
        elif not (set(t) == {"param"} and isinstance(t["param"], str)) and not (set(t) == {"const"} and _is_number(t["const"])):
            raise Rejected(f"{path}.{side}: not a term")
    return found


def _on_frame(frame: DataFrame, name: str, n: int, minutes: int, out: str) -> DataFrame:
    o, c = Window.partitionBy(*KEYS).orderBy("close_time"), F.col("close")
    if name in ("close", "high", "low"):
        return frame.withColumn(out, F.col(name))
    if name == "ema":
        return indicators.with_ema(frame, "close", n, KEYS, "close_time", out)
    if name == "rsi":
        return indicators.with_rsi(frame, "close", n, KEYS, "close_time", out)
    if name == "adx":
        return indicators.with_adx(frame, n, KEYS, name=out)
    if name in ("atr", "atr_pct"):
        made = indicators.with_atr(frame, n, KEYS, name=out)
        return made.withColumn(out, F.when(c > 0, F.col(out) / c * 100)) if name == "atr_pct" else made
    if name == "vwap_dist":
        return indicators.with_vwap_dist(frame, KEYS, out)
    if name == "realized_vol":
        returns = frame.withColumn("_r", indicators.log_return(c, o))
        return returns.withColumn(out, indicators.rolling_std(F.col("_r"), n, o) * math.sqrt(525_600 / minutes) * 100).drop("_r")
    return frame.withColumn(out, {"sma": indicators.sma, "bb_position": indicators.bb_position, "ret_pct": indicators.pct_change}[name](c, n, o))


def _from_feed(b: DataFrame, term: dict, feeds: dict[str, DataFrame], out: str) -> DataFrame:
    """Bars with a feature of a feed, as of their close; null where there is no such feed or nothing in it yet.

    feeds: funding (rate), open_interest (open_interest), book (imbalance), liquidations (price, notional_usd), each
    with the keys and `time`."""
    name, n = term["feature"], int(term.get("args", {}).get("n", 0))
    feed, value = FEEDS[name]
    if feed not in feeds:
        return b.withColumn(out, F.lit(None).cast("double"))
    points = feeds[feed]
    if feed == "liquidations":
        # liquidations at prices above or below the close within the last n minutes, in dollars
        p = points.select(*KEYS, "time", F.col("price").alias("_price"), F.col(value).alias("_usd"))
        there = F.col("_price") > F.col("close") if name == "liq_cluster_above" else F.col("_price") < F.col("close")
        return asof.trailing_range_sum(b, p, KEYS, "close_time", "time", n, "_usd", there, "_sum").withColumnRenamed("_sum", out)
    if name == "funding_zscore":
        points = indicators.with_zscore(points, value, n, KEYS, "time", "_v")
    elif name == "oi_change":
        points = points.withColumn("_v", indicators.pct_change(F.col(value), n, Window.partitionBy(*KEYS).orderBy("time")))
    else:
        points = points.withColumn("_v", F.col(value))
    known = points.filter("_v is not null").select(*KEYS, F.col("time").alias("_t"), "_v")
    return asof.asof(b, known, KEYS, "close_time", "_t", ("_v",)).withColumnRenamed("_v", out)


def with_features(b: DataFrame, terms: dict[str, dict], feeds: dict[str, DataFrame] | None = None) -> DataFrame:
    """Bars of a minute with a column for each feature; a frame is built once for all its features."""
    base = b
    of_feeds = {k: t for k, t in terms.items() if t["feature"] in FEEDS}
    for i, (k, t) in enumerate(of_feeds.items()):
        b = _from_feed(b, t, feeds or {}, f"_feed{i}")
    b = b.withColumnsRenamed({f"_feed{i}": k for i, k in enumerate(of_feeds)})
    terms = {k: t for k, t in terms.items() if k not in of_feeds}
    by_frame: dict[str, list[str]] = {}
    for k, t in terms.items():
        by_frame.setdefault(t.get("timeframe") or "1m", []).append(k)
    for frame, keys in by_frame.items():
        minutes = TIMEFRAMES[frame]
        made = b if minutes == 1 else bars.resampled(base, minutes, KEYS)
        for k in keys:
            made = _on_frame(made, terms[k]["feature"], int(terms[k].get("args", {}).get("n", 0)), minutes, k)
        if minutes == 1:
            b = made
        else:
            right = made.select(*KEYS, F.col("close_time").alias("_available_at"), *(F.col(f"`{k}`") for k in keys))
            b = _projected(b, right, keys)
    return b


def _projected(b: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    plain = {k: f"_f{i}" for i, k in enumerate(keys)}
    met = asof.asof(b, right.withColumnsRenamed(plain), KEYS, "close_time", "_available_at", tuple(plain.values()))
    return met.withColumnsRenamed({v: k for k, v in plain.items()})


def condition(tree: dict, params: dict[str, float] | None = None) -> Column:
    """The predicate as a Column over bars that have its features."""
    order = Window.partitionBy(*KEYS).orderBy("close_time")

    def term(t) -> Column:
        if _is_number(t):
            return F.lit(float(t))
        if "const" in t:
            return F.lit(float(t["const"]))
        if "param" in t:
            if t["param"] not in (params or {}):
                raise Rejected(f"no parameter {t['param']}")
            return F.lit(float(params[t["param"]]))
        return F.col(f"`{key(t)}`")

    if "and" in tree:
        return p.every(*(condition(c, params) for c in tree["and"]))
    if "or" in tree:
        return p.either(*(condition(c, params) for c in tree["or"]))
    if "not" in tree:
        return p.negated(condition(tree["not"], params))
    a, b = term(tree["left"]), term(tree["right"])
    if tree["op"] == "between":
        return p.between(a, b, term(tree["right2"]))
    if tree["op"] in OPS:
        return OPS[tree["op"]](a, b)
    return (p.cross_above if tree["op"] == "cross_above" else p.cross_below)(a, b, order)


def signals(b: DataFrame, tree: dict, params: dict[str, float] | None = None, scope: tuple[str, ...] = (), stop_n: int = 14, stop_mult: float = 1.5, feeds: dict[str, DataFrame] | None = None) -> DataFrame:
    """Bars with `signal`, in scope, and a stop distance of a multiple of the average range, as replay takes them."""
    atr = {"feature": "atr", "args": {"n": stop_n}}
    terms = features(tree) | {key(atr): atr}
    made = with_features(regimes.with_labels(b, KEYS), terms, feeds)
    ok = F.col("regime").isin(*scope) if scope else F.lit(True)
    return made.withColumn("signal", condition(tree, params) & ok).withColumn("stop_distance", F.col(f"`{key(atr)}`") * stop_mult).withColumn("regime_ok", ok)
