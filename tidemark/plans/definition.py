"""Strategy definitions as dicts: what one may hold, every reason why one is refused, and its structural signature."""

from __future__ import annotations

import math

from ..functions.timegrid import TIMEFRAMES
from . import strategy

#: The keys of a definition and of its exit, kinds of stops, feeds, regimes and limits.
KEYS = {"id", "version", "rationale", "direction", "timeframes", "required_feeds", "regime_scope", "entry", "exit", "params", "lifecycle_state", "origin"}
EXIT = {"stop": {"kind", "mult", "timeframe", "n"}, "target": {"kind", "r"}, "trailing": {"kind", "mult", "timeframe", "n"}, "time_exit": None, "regime_invalidation": None}
DIRECTIONS, STOPS, FEEDS = ("long", "short"), ("atr", "percent", "structural"), ("ohlcv", "funding", "oi", "orderbook", "liquidations", "ticks")
REGIMES = tuple(f"{d}_{v}" for d in ("bull", "bear", "range") for v in ("high", "low"))
MOST_BARS, ALIKE, LEAST_RATIONALE = 60, 0.85, 20
FEED_NAMES = {"funding": "funding", "open_interest": "oi", "book": "orderbook", "liquidations": "liquidations"}


def _malformed(d) -> str | None:
    if not isinstance(d, dict) or set(d) - KEYS:
        return "strategy:unknown_keys" if isinstance(d, dict) else "strategy:not_an_object"
    for k in ("id", "rationale", "direction"):
        if not isinstance(d.get(k), str) or not d[k].strip():
            return f"strategy:missing_or_empty:{k}"
    if d["direction"] not in DIRECTIONS:
        return "strategy:unknown_direction"
    if type(d.get("version", 1)) is not int or d.get("version", 1) < 1:
        return "strategy:version_invalid"
    for k in ("timeframes", "required_feeds", "regime_scope"):
        if not isinstance(d.get(k), list) or not d[k] or not all(isinstance(x, str) for x in d[k]):
            return f"strategy:missing_or_empty:{k}"
    for k, p in d.get("params", {}).items():
        if not isinstance(p, dict) or set(p) != {"value", "lo", "hi"} or not all(strategy._is_number(x) for x in p.values()) or p["lo"] > p["hi"]:
            return f"params.{k}:bounds"
    x = d.get("exit")
    if not isinstance(x, dict) or set(x) - set(EXIT) or not isinstance(x.get("stop"), dict):
        return "exit:missing_stop_or_unknown_keys"
    for k, allowed in EXIT.items():
        part = x.get(k)
        if allowed and part is not None and (not isinstance(part, dict) or set(part) - allowed or not all(strategy._is_number(part[n]) for n in ("mult", "n", "r") if n in part)):
            return f"exit.{k}:unknown_keys_or_numbers"
    if x["stop"].get("kind") not in STOPS or x.get("target") and x["target"].get("kind", "r_multiple") != "r_multiple" or x.get("trailing") and x["trailing"].get("kind", "atr") != "atr":
        return "exit:unknown_kind"
    if x.get("time_exit") is not None and type(x["time_exit"]) is not int or type(x.get("regime_invalidation", True)) is not bool:
        return "exit:time_exit_or_regime_invalidation"
    return None


def _leaves(tree: dict) -> list[dict]:
    """The comparisons of a predicate."""
    if "not" in tree:
        return _leaves(tree["not"])
    return [leaf for c in tree.get("and", tree.get("or", [])) for leaf in _leaves(c)] or ([tree] if "op" in tree else [])


def filled(d: dict) -> dict:
    """A definition with all that may be left out."""
    frame = {"mult": 1.5, "timeframe": "1m", "n": 14}
    x = d["exit"]
    exits = {"stop": frame | x["stop"], "target": x.get("target") and {"kind": "r_multiple", "r": 1.0} | x["target"], "trailing": x.get("trailing") and frame | {"kind": "atr", "mult": 2.0} | x["trailing"], "time_exit": x.get("time_exit"), "regime_invalidation": x.get("regime_invalidation", True)}
    lists = {k: list(dict.fromkeys(d[k])) for k in ("timeframes", "required_feeds", "regime_scope")}
    return {"version": 1, "params": {}, "lifecycle_state": "candidate", "origin": "seed"} | d | lists | {"id": d["id"].strip(), "rationale": d["rationale"].strip(), "exit": exits}


def signature(d: dict) -> frozenset[str]:
    """Which features, comparisons and kinds of exits it has; lengths only by their magnitude, parameters not at all,
    so that variants of an idea are alike."""
    size = lambda v: "0" if v <= 0 else str(round(math.log(v + 1) * 3))
    terms = strategy.features(d["entry"]).values()
    tokens = {f"f:{t['feature']}@{t.get('timeframe') or '-'}({','.join(f'{k}~{size(v)}' for k, v in t.get('args', {}).items())})" for t in terms}
    tokens |= {f"op:{leaf['left']['feature']}.{leaf['op']}" for leaf in _leaves(d["entry"])}
    return frozenset(tokens | {f"dir:{d['direction']}", f"stop:{d['exit']['stop']['kind']}", f"trail:{bool(d['exit'].get('trailing'))}"})


def reasons(d: dict, population: dict[str, frozenset[str]] | None = None) -> list[str]:
    """Every reason why a definition is refused; only the first where it can't be read at all. population: the
    signatures of others by id. Their names are fixed values."""
    wrong = _malformed(d)
    if wrong:
        return [f"parse:{wrong}"]
    try:
        terms = strategy.features(d.get("entry"))
    except strategy.Rejected as e:
        return [f"parse:{e}"]
    d = filled(d)
    stop, trailing, target, bars = (d["exit"][k] for k in ("stop", "trailing", "target", "time_exit"))
    named = {t["param"] for leaf in _leaves(d["entry"]) for t in leaf.values() if isinstance(t, dict) and "param" in t}
    feeds = {FEED_NAMES[strategy.FEEDS[t["feature"]][0]] if t["feature"] in strategy.FEEDS else "ohlcv" for t in terms.values()} | {"ohlcv"}
    frames = {t.get("timeframe") for t in terms.values()} - {None} | {x["timeframe"] for x in (stop, trailing) if x}
    declared, own = set(d["required_feeds"]), set(d["timeframes"])
    out = [f"param_out_of_bounds:{k}" for k, p in d["params"].items() if not p["lo"] <= p["value"] <= p["hi"]]
    out += [f"undefined_param_ref:{k}" for k in sorted(named - set(d["params"]))] + [f"unused_param:{k}" for k in sorted(set(d["params"]) - named)]
    out += [f"missing_timeframe:{t['feature']}" for t in terms.values() if t["feature"] not in strategy.FEEDS and not t.get("timeframe")]
    out += [f"unknown_feed:{f}" for f in sorted(declared - set(FEEDS))] + [f"undeclared_feed:{f}" for f in sorted(feeds - declared)] + [f"declared_unused_feed:{f}" for f in sorted(declared - feeds)]
    out += [f"undeclared_timeframe:{f}" for f in sorted(frames - own)] + [f"unknown_timeframe:{f}" for f in sorted((own | frames) - set(TIMEFRAMES))]
    checks = {
        f"stop_mult_nonpositive:{stop['mult']}": stop["kind"] == "atr" and stop["mult"] <= 0,
        f"stop_percent_out_of_bounds:{stop['mult']}": stop["kind"] == "percent" and not 0 < stop["mult"] < 50,
        f"stop_n_invalid:{stop['n']}": stop["n"] < 1,
        f"time_exit_nonpositive:{bars}": bars is not None and bars < 1,
        f"time_exit_exceeds_cap:{bars}>{MOST_BARS}": bars is not None and bars > MOST_BARS,
        "target_r_nonpositive": bool(target) and target["r"] <= 0,
        "trailing_mult_nonpositive": bool(trailing) and trailing["mult"] <= 0,
        "rationale_missing_or_trivial": len(d["rationale"]) < LEAST_RATIONALE,
    }
    out += [k for k, failed in checks.items() if failed] + [f"unknown_regime_bucket:{r}" for r in d["regime_scope"] if r not in REGIMES]
    mine = signature(d)
    shares = {k: len(mine & s) / len(mine | s) for k, s in (population or {}).items() if k != d["id"]}
    return out + [f"near_duplicate_of:{k}:{v:.2f}>={ALIKE}" for k, v in shares.items() if v >= ALIKE]
