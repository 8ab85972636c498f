"""From a bar's close to a signal, bar by bar: the predicates of `plans.strategy` over a stream of bars of a minute.

Each indicator keeps what its next value needs and no more: a window of closes, or an average and how many values it has
seen. All of it is a map from the indicator's key to numbers, in typed state, so that a bar costs a few numbers however
long its series is. What comes out equals what `strategy.signals` gives for the whole series.

Bars of larger frames are made of the minutes as they come. One counts from the minute that ends at its nominal close,
or else from the first minute after that."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.timegrid import TIMEFRAMES, micros
from ..plans import strategy
from .state import Ordered, processed

Bar = dict[str, float]
NAN = float("nan")


def _window(held: list[float], x: float, n: int) -> list[float]:
    held.append(x)
    del held[:-n]
    return held


def _spread(v: list[float]) -> float:
    mean = math.fsum(v) / len(v)
    return math.sqrt(math.fsum((x - mean) ** 2 for x in v) / len(v))


def _averaged(held: list[float], x: float, n: int, gain: float) -> float | None:
    """held: how many values, and their sum or then the average; the first n values' mean, and from there a share of each."""
    count, y = held or (0.0, 0.0)
    if count < n:
        count, y = count + 1, y + x
        held[:] = [count, y / n if count == n else y]
    else:
        held[:] = [count, (1 - gain) * y + gain * x]
    return held[1] if held[0] >= n else None


def _sma(held, bar, n, minutes):
    v = _window(held, bar["close"], n)
    return math.fsum(v) / n if len(v) == n else None


def _ema(held, bar, n, minutes):
    return _averaged(held, bar["close"], n, 2.0 / (n + 1))


def _bb_position(held, bar, n, minutes):
    v = _window(held, bar["close"], n)
    if len(v) < n:
        return None
    mid, half = math.fsum(v) / n, 2.0 * _spread(v)
    return 0.5 if half == 0 else (bar["close"] - (mid - half)) / (2 * half)


def _ret_pct(held, bar, n, minutes):
    v = _window(held, bar["close"], n + 1)
    return (v[-1] - v[0]) / abs(v[0]) * 100 if len(v) == n + 1 and v[0] else None


def _realized_vol(held, bar, n, minutes):
    before, returns = (held[0], held[1:]) if held else (NAN, [])
    _window(returns, math.log(bar["close"] / before) if before > 0 and bar["close"] > 0 else 0.0, n)
    held[:] = [bar["close"], *returns]
    return _spread(returns) * math.sqrt(525_600 / minutes) * 100 if len(returns) == n else None


def _atr(held, bar, n, minutes):
    before, rest = (held[0], held[1:]) if held else (NAN, [])
    spread = bar["high"] - bar["low"]
    tr = spread if math.isnan(before) else max(spread, abs(bar["high"] - before), abs(bar["low"] - before))
    y = _averaged(rest, tr, n, 1 / n)
    held[:] = [bar["close"], *rest]
    return y


def _atr_pct(held, bar, n, minutes):
    y = _atr(held, bar, n, minutes)
    return y / bar["close"] * 100 if y is not None and bar["close"] > 0 else None


def _rsi(held, bar, n, minutes):
    before, up, down = (held[0], held[1:3], held[3:5]) if held else (NAN, [], [])
    if math.isnan(before):
        held[:] = [bar["close"]]
        return None
    change = bar["close"] - before
    g, l = _averaged(up, max(change, 0.0), n, 1 / n), _averaged(down, max(-change, 0.0), n, 1 / n)  # noqa: E741
    held[:] = [bar["close"], *up, *down]
    return None if l is None else 100.0 if l == 0 else 100 - 100 / (1 + g / l)


def _vwap_dist(held, bar, n, minutes):
    day = bar["close_us"] // 86_400_000_000
    volume, value = held[1:] if held and held[0] == day else (0.0, 0.0)
    typical = (bar["high"] + bar["low"] + bar["close"]) / 3
    volume, value = volume + bar["volume"], value + typical * bar["volume"]
    held[:] = [day, volume, value]
    return (typical - value / volume) / (value / volume) * 100 if volume > 0 and value else None


STEPS = {"sma": _sma, "ema": _ema, "bb_position": _bb_position, "ret_pct": _ret_pct, "realized_vol": _realized_vol, "atr": _atr, "atr_pct": _atr_pct, "rsi": _rsi, "vwap_dist": _vwap_dist} | {k: (lambda held, bar, n, minutes, k=k: bar[k]) for k in ("close", "high", "low")}


def _regime(held: dict[str, list[float]], bar: Bar, back: int = 60, vol_n: int = 60, vol_mean: int = 1440) -> str:
    """As `regimes.with_labels`."""
    closes = _window(held.setdefault("regime:closes", []), bar["close"], back + 1)
    before = closes[0] if len(closes) == back + 1 else NAN
    change = (bar["close"] - before) / before if before else -math.inf if bar["close"] < 0 else math.inf
    v = _realized_vol(held.setdefault("regime:returns", []), bar, vol_n, 1)
    usual = [x for x in _window(held.setdefault("regime:vols", []), NAN if v is None else v, vol_mean) if not math.isnan(x)]
    high = v is not None and v > math.fsum(usual) / len(usual)
    return f"{'bull' if change > 0.002 else 'bear' if change < -0.002 else 'range'}_{'high' if high else 'low'}"


class Frames:
    """The larger bars of a series of minutes; held: the open one of each frame."""

    def __init__(self, frames: set[str]):
        self.frames = {f: TIMEFRAMES[f] for f in frames if TIMEFRAMES[f] > 1}

    def closed(self, held: dict[str, list[float]], bar: Bar) -> Iterator[tuple[str, Bar]]:
        for frame, minutes in self.frames.items():
            wide = 60_000_000 * minutes
            start = float(bar["open_us"] // wide * wide)
            name = f"frame:{frame}"
            made = held.get(name)
            if made and made[0] != start:
                yield frame, self._bar(made, wide)
                made = None
            made = [start, bar["high"], bar["low"], bar["close"], bar["volume"]] if not made else [start, max(made[1], bar["high"]), min(made[2], bar["low"]), bar["close"], made[4] + bar["volume"]]
            held[name] = made
            if bar["close_us"] >= start + wide - 1000:
                yield frame, self._bar(made, wide)
                held[name] = []

    @staticmethod
    def _bar(made: list[float], wide: int) -> Bar:
        return dict(zip(("high", "low", "close", "volume"), made[1:], strict=True)) | {"close_us": made[0] + wide - 1000}


class Chain:
    """A predicate over one series: `step` takes what is held and a bar and gives signal, regime and stop distance."""

    def __init__(self, tree: dict, params: dict[str, float] | None = None, scope: tuple[str, ...] = (), stop_n: int = 14, stop_mult: float = 1.5):
        stop = {"feature": "atr", "args": {"n": stop_n}}
        self.terms = strategy.features(tree) | {strategy.key(stop): stop}
        for k, t in self.terms.items():
            if t["feature"] not in STEPS:
                raise strategy.Rejected(f"{k}: needs a whole series or a feed, and isn't made bar by bar")
        self.tree, self.params, self.scope, self.stop, self.stop_mult = tree, params or {}, scope, strategy.key(stop), stop_mult
        self.frames = Frames({t.get("timeframe") or "1m" for t in self.terms.values()})

    def _advance(self, held: dict, frame: str, bar: Bar) -> None:
        for k, t in self.terms.items():
            if (t.get("timeframe") or "1m") == frame:
                y = STEPS[t["feature"]](held.setdefault(k, []), bar, int(t.get("args", {}).get("n", 0)), TIMEFRAMES[frame])
                held[f"value:{k}"] = [NAN if y is None else y]

    def _holds(self, held: dict, tree: dict, path: str) -> bool:
        # every branch is gone through, since crossings remember their last sides
        if "and" in tree or "or" in tree:
            name = "and" if "and" in tree else "or"
            got = [self._holds(held, c, f"{path}.{i}") for i, c in enumerate(tree[name])]
            return all(got) if name == "and" else any(got)
        if "not" in tree:
            return not self._holds(held, tree["not"], f"{path}.n")

        def term(t) -> float:
            if isinstance(t, dict):
                return float(t["const"]) if "const" in t else self._param(t["param"]) if "param" in t else held.get(f"value:{strategy.key(t)}", [NAN])[0]
            return float(t)

        op, a, b = tree["op"], term(tree["left"]), term(tree["right"])
        if op == "between":
            c = term(tree["right2"])
            return min(b, c) <= a <= max(b, c) if not (math.isnan(b) or math.isnan(c)) else False
        if op in ("cross_above", "cross_below"):
            a0, b0 = held.get(f"cross:{path}") or (NAN, NAN)
            held[f"cross:{path}"] = [a, b]
            return a0 <= b0 and a > b if op == "cross_above" else a0 >= b0 and a < b
        return {"gt": a > b, "lt": a < b, "gte": a >= b, "lte": a <= b}[op]

    def _param(self, name: str) -> float:
        if name not in self.params:
            raise strategy.Rejected(f"no parameter {name}")
        return float(self.params[name])

    def step(self, held: dict[str, list[float]], bar: Bar) -> tuple[bool, str, float | None]:
        regime = _regime(held, bar)
        for frame, larger in self.frames.closed(held, bar):
            self._advance(held, frame, larger)
        self._advance(held, "1m", bar)
        signal = self._holds(held, self.tree, "t")
        atr = held[f"value:{self.stop}"][0]
        return signal and (not self.scope or regime in self.scope), regime, None if math.isnan(atr) else atr * self.stop_mult


class _Chains(Ordered):
    def __init__(self, order, idle_ms, chain: Chain, names: list[str]):
        super().__init__(order, idle_ms)
        self.chain, self.names = chain, names
        self.row = Row(*names, "signal", "regime", "stop_distance")

    def declare(self, handle) -> None:
        self.stored = handle.getMapState("indicators", "name string", "numbers array<double>")

    def forget(self) -> None:
        self.stored.clear()

    def step(self, key, batch: Iterator[Row]) -> Iterator[Row]:
        held = {k[0]: list(v[0]) for k, v in self.stored.iterator()}
        for r in batch:
            bar = {n: float(r[n]) for n in ("high", "low", "close", "volume")} | {"open_us": r["_open_us"], "close_us": r["_close_us"]}
            yield self.row(*(r[n] for n in self.names), *self.chain.step(held, bar))
        for name, numbers in held.items():
            self.stored.updateValue((name,), ([float(x) for x in numbers],))  # an int would be stored as null


def signals(bars: DataFrame, keys: tuple[str, ...], tree: dict, params: dict[str, float] | None = None, scope: tuple[str, ...] = (), stop_n: int = 14, stop_mult: float = 1.5, idle_s: float | None = None) -> DataFrame:
    """bars of a minute as they close, with signal, regime and stop_distance. A series' state stays unless idle_s is given:
    an average that begins anew isn't the series' average."""
    names = bars.columns
    made = _Chains(("close_time",), None if idle_s is None else int(idle_s * 1000), Chain(tree, params, scope, stop_n, stop_mult), names)
    kinds = ", ".join(f"`{n}` {bars.schema[n].dataType.simpleString()}" for n in names)
    timed = bars.withColumn("_open_us", micros(F.col("open_time"))).withColumn("_close_us", micros(F.col("close_time")))
    return processed(timed, keys, "close_time", made, f"{kinds}, signal boolean, regime string, stop_distance double")
