"""Claims, partitions, guards, texts of predicates and analog counts."""

import json
import os
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import SCHEMA, T0, series
from test_runner import GOOD

from tidemark.functions import guards
from tidemark.operators import decisions
from tidemark.plans import runner, text
from tidemark.plans.strategy import Rejected
from tidemark.sources import commits, partitions, records


def test_of_many_claims_one_wins(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        for k in range(5):
            got = list(pool.map(lambda i: commits.claim(spark, f"{tmp_path}/claims/{k}", f"w{i}"), range(8)))  # noqa: B023
            assert sum(got) == 1 and (tmp_path / "claims" / str(k)).read_text() == f"w{got.index(True)}"
    assert sorted(x for x in os.listdir(tmp_path / "claims") if not x.endswith(".crc")) == list("01234")


def test_a_log_keeps_every_commit_once(spark, tmp_path):
    log = commits.Log(spark, f"{tmp_path}/log")
    assert log.entries() == [] and log.commit(lambda held: None) is None
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: log.commit(lambda held: {"writer": i, "n": len(held)}), range(8)))
    held = log.entries()
    assert [e["n"] for e in held] == list(range(8)) and sorted(e["writer"] for e in held) == list(range(8))
    # what another has decided is seen: nobody decides it again
    assert log.commit(lambda held: None if any(e["writer"] == 3 for e in held) else {"writer": 3}) is None


def test_of_concurrent_looks_one_wins(spark, tmp_path):
    b, start, now = spark.createDataFrame(series(260), SCHEMA), T0, T0 + timedelta(days=30)
    end = T0 + timedelta(minutes=259, seconds=59, milliseconds=999)

    def look(_):
        try:
            return runner.backtest(b, GOOD, str(tmp_path), start, end, now, now, holdout=True)["run_id"]
        except runner.HoldoutViolation:
            return None

    with ThreadPoolExecutor(3) as pool:
        got = [x for x in pool.map(look, range(3)) if x]
    assert len(got) == 1 and [r["run_id"] for r in spark.read.parquet(f"{tmp_path}/runs").collect()] == got


def test_a_partition_goes_only_with_proof(spark, tmp_path):
    source, archive = f"{tmp_path}/source", f"{tmp_path}/archive"
    rows = spark.range(100).select("id", (F.col("id") % 4).cast("string").alias("day"), (F.col("id") * 10).alias("t"))
    for path in (source, archive):
        rows.repartition(2, "id").write.partitionBy("day").parquet(path)
    found = {r["day"]: r for r in partitions.partitions(spark, archive, ("day",), "t", "long").collect()}
    assert {k: (r["rows"], r["first"], r["last"]) for k, r in found.items()} == {str(k): (25, 10 * k, 960 + 10 * k) for k in range(4)}
    assert all(r["files"] >= 1 and r["bytes"] > 0 and r["modified"] for r in found.values())
    whole = partitions.footers(spark, archive, "no_such").collect()
    assert sum(r["rows"] for r in whole) == 100 and {r["low"] for r in whole} == {None}
    manifest = records.manifest(spark, archive).cache()
    manifest.count()
    proof = lambda p, m=manifest: partitions.authorised(spark, source, archive, p, m)
    assert proof("day=1").verified and partitions.dropped(spark, source, proof("day=1"))
    assert not os.path.exists(f"{source}/day=1") and os.path.exists(f"{source}/day=2") and os.path.exists(f"{archive}/day=1")
    # one byte of day 2 changes, of the same length
    file = next(f"{archive}/day=2/{x}" for x in os.listdir(f"{archive}/day=2") if x.endswith(".parquet"))
    content = bytearray(open(file, "rb").read())
    content[len(content) // 2] ^= 1
    open(file, "wb").write(bytes(content))
    for x in os.listdir(f"{archive}/day=2"):
        if x.endswith(".crc"):
            os.remove(f"{archive}/day=2/{x}")
    # a file that the manifest doesn't know, rows that the archive lacks, a partition that it hasn't
    spark.range(3).select("id", "id").toDF("id", "t").write.mode("append").parquet(f"{archive}/day=3")
    for p in ("day=2", "day=3"):
        with pytest.raises(partitions.NotVerified):
            partitions.dropped(spark, source, proof(p))
        assert os.path.exists(f"{source}/{p}")
    spark.range(3).select("id", "id").toDF("id", "t").write.mode("append").parquet(f"{source}/day=0")
    with pytest.raises(partitions.NotVerified):
        partitions.dropped(spark, source, proof("day=0"))
    spark.range(3).write.parquet(f"{source}/day=9")
    assert not proof("day=9").verified
    for name in ("", "..", "day=1/../..", "/etc", "day"):
        with pytest.raises(ValueError):
            proof(name)


def plain_walk(x, path, until, out):
    if isinstance(x, dict):
        for k, v in x.items():
            if k.lower() in guards.PROMPT_KEYS:
                out.append((f"{path}.{k}", "forbidden_key"))
            plain_walk(v, f"{path}.{k}", until, out)
    elif isinstance(x, list):
        for i, v in enumerate(x):
            plain_walk(v, f"{path}[{i}]", until, out)
    elif isinstance(x, str):
        try:
            if datetime.fromisoformat(x) > until:
                out.append((path, "time_ahead"))
        except ValueError:
            pass
    return out


def test_guards_at_any_depth(spark):
    r = random.Random(1)

    def value(depth):
        kind = r.random()
        if depth > 5 or kind < 0.3:
            return r.choice([None, True, 3, 2.5, "text", "2024-12-31T00:00:00", "2025-03-01T10:00:00", ""])
        if kind < 0.6:
            return [value(depth + 1) for _ in range(r.randint(0, 3))]
        return {k: value(depth + 1) for k in r.sample(["a", "B", "Token", "net_pnl", "tokens", "KILLS", "é"], r.randint(0, 4))}

    values = [value(0) for _ in range(60)]
    deep = {"secret": 1}
    for _ in range(40):
        deep = {"x": [deep]}
    values.append(deep)
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(1000, "{"), (1001, None), (1002, "")]
    until = datetime(2025, 1, 1)
    got = guards.violations(spark.createDataFrame(rows, "id int, j string"), ("id",), "j", until="2025-01-01 00:00:00").collect()
    want = [(i, *x) for i, v in enumerate(values) for x in plain_walk(v, "context", until, [])] + [(1000, "context", "not_json"), (1002, "context", "not_json")]
    # a text at the root is no member of anything
    assert sorted(map(tuple, got)) == sorted(w for w in want if w[1:] != ("context", "time_ahead"))
    assert guards.violations(spark.createDataFrame([], "id int, j string"), ("id",), "j").collect() == []


_names = st.text(st.characters(codec="utf-8", exclude_categories=("Cs",)), min_size=1, max_size=6)
_numbers = st.one_of(st.integers(-(10**20), 10**20), st.floats(allow_nan=False, allow_infinity=False))
_features = st.fixed_dictionaries({"feature": _names}, optional={"timeframe": st.sampled_from([None, "1m", "5m", "1d"]), "args": st.dictionaries(_names, _numbers, max_size=2)})
_terms = st.one_of(_numbers, _features, st.builds(lambda x: {"const": x}, _numbers), st.builds(lambda x: {"param": x}, _names))
_leaves = st.one_of(
    st.fixed_dictionaries({"left": _features, "op": st.sampled_from(["gt", "lt", "gte", "lte", "cross_above", "cross_below"]), "right": _terms}),
    st.fixed_dictionaries({"left": _features, "op": st.just("between"), "right": _terms, "right2": _terms}),
)
_trees = st.recursive(_leaves, lambda x: st.one_of(st.builds(lambda c: {"and": c}, st.lists(x, min_size=1, max_size=3)), st.builds(lambda c: {"or": c}, st.lists(x, min_size=1, max_size=3)), st.builds(lambda c: {"not": c}, x)), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(_trees)
def test_texts_go_round(tree):
    canonical = text.canonical(tree)
    assert text.parsed(canonical) == text.normal(tree) and text.canonical(text.parsed(canonical)) == canonical
    # another writing of the same
    assert text.canonical(text.parsed(json.dumps(tree, indent=1, sort_keys=True))) == canonical and text.signature(tree) == text.signature(json.loads(canonical))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text(max_size=4)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["and", "or", "not", "left", "op", "right", "feature", "const", "args", "x"]), x, max_size=4)), max_leaves=12).map(json.dumps)))
def test_what_is_wrong_is_refused_and_nothing_else_raised(x):
    try:
        text.canonical(text.parsed(x))
    except Rejected as e:
        assert str(e).startswith("entry")


def test_errors_say_where():
    close = '{"feature":"close"}'
    leaf = f'{{"left":{close},"op":"gt","right":1}}'
    for x, said in {
        "[]": "entry: expected_object:list", "{": "entry: not_json", '{"and":[]}': "entry: and_needs_children", f'{{"or":[{leaf},{{"not":{{"op":"is"}}}}]}}': "entry.or[1].not: unknown_op:'is'",
        f'{{"left":1,"op":"gt","right":{close}}}': "entry.left: left_must_be_feature", f'{{"left":{close},"op":"between","right":1}}': "entry: comparison_missing_right2", f'{{"left":{close},"op":"gt","right":true}}': "entry.right: bool_not_a_term",
        f'{{"left":{close},"op":"gt","right":NaN}}': "entry: const_not_numeric", f'{{"left":{close},"op":"gt","right":1e999}}': "entry.right: const_not_numeric", f'{{"left":{{"feature":"sma","args":{{"n":"x"}}}},"op":"gt","right":1}}': "entry.left: arg_not_numeric:n",
        f'{{"op":"gt","op":"lt","left":{close},"right":1}}': "entry: repeated_key", '{"not":' * 70 + leaf + "}" * 70: "entry" + ".not" * 65 + ": deeper_than", "[" * 100_000: "entry: longer_than", '{"not":' * 9000: "entry: not_json", f'{{"left":{close},"op":"gt","right":{"9" * 5000}}}': "entry: const_not_numeric",
    }.items():
        with pytest.raises(Rejected) as e:
            text.parsed(x)
        assert str(e.value).startswith(said), (x[:80], str(e.value)[:80])


def test_analog_counts_equal_a_plain_count(spark):
    r = random.Random(2)
    at = lambda: datetime(2024, 1, 1) + timedelta(days=r.randint(0, 900), hours=r.choice([0, 0, 5]))
    maybe = lambda x, p=0.1: None if r.random() < p else x
    history = [(maybe(at(), 0.02), maybe(r.choice("xyyyyz"), 0.02), maybe(float(r.randint(0, 3))), maybe(float(r.randint(0, 9)))) for _ in range(900)]
    cases = [(i, maybe(at(), 0.02), maybe(r.choice("xyw"), 0.02), r.choice(["LONG", "SHORT"]), r.choice([0.0, 0.001, -0.001]), maybe(float(r.randint(0, 10)))) for i in range(150)]
    got = decisions.scrutinised(spark.createDataFrame(cases, "case_id int, time timestamp_ntz, key string, direction string, funding_rate double, spread_pct double"), spark.createDataFrame(history, "time timestamp_ntz, key string, adverse_pct double, spread_pct double")).collect()
    want = {}
    for i, t, k, d, f, s in cases:
        met = [h for h in history if t is not None and k is not None and h[0] is not None and h[1] == k and t - timedelta(days=730) <= h[0] <= t - timedelta(days=1)]
        spreads = sorted(h[3] for h in met if h[3] is not None)
        adverse = sum(h[2] is not None and h[2] >= 1.0 for h in met)
        paying = f > 0 and d == "LONG" or f < 0 and d == "SHORT"
        above = bool(spreads) and s is not None and s > spreads[min(len(spreads) * 90 // 100, len(spreads) - 1)]
        reason = "funding_against_position" if paying and abs(f) >= 0.0005 else "insufficient_analogs" if len(met) < 20 else "analogs_adverse" if adverse >= 0.75 * len(met) else "spread_above_percentile" if above else "analogs_ok"
        want[i] = (reason, len(met), adverse)
    assert {x["case_id"]: (x["reason"], x["analogs"], x["adverse"]) for x in got} == want
    assert len({v[0] for v in want.values()}) >= 4


def test_smaller_before(spark):
    r = random.Random(3)
    values = {k: [r.randint(0, 20) for _ in range(n)] for k, n in (("a", 5000), ("b", 3), ("c", 17))}
    rows = spark.createDataFrame([(k, i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "key string, _at long, _s double")
    asked = []
    for i in range(120):
        k = r.choice("aaabc")
        lo, hi = sorted(r.choices(range(len(values[k]) + 1), k=2))
        asked.append((i, k, lo, hi, float(r.randint(0, 21))))
    got = {x["id"]: x["below"] for x in decisions.smaller_before(rows, spark.createDataFrame(asked, "id int, key string, lo long, hi long, x double")).collect()}
    assert all(got.get(i, 0) == sum(v < x for v in values[k][lo:hi]) for i, k, lo, hi, x in asked)


def test_running_values_over_blocks(spark):
    from tidemark.operators import running

    r = random.Random(4)
    rows = [(r.choice(["a", "a", "b", None]), None if i % 50 == 0 else datetime(2025, 1, 1) + timedelta(hours=r.randint(0, 2000)), i, None if r.random() < 0.1 else r.randint(-9, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, v int")
    got = running.with_totals(running.running(df, ("k",), running.time_block(F.col("t")), ("t", "i"), {"s": F.col("v"), "n": F.lit(1)}, {"m": F.col("v")}), ("k",), total=F.count("v")).collect()
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        s, m, n = None, None, 0
        some = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1], x[2]) if x[1] else (False, datetime.min, x[2]))
        mine = {x["i"]: x for x in got if x["k"] == k}
        for _, _, i, v in some:
            n += 1
            if v is not None:
                s, m = (s or 0) + v, v if m is None else max(m, v)
            assert (mine[i]["s"], mine[i]["m"], mine[i]["n"], mine[i]["total"]) == (s, m, n, sum(x[3] is not None for x in some))


def test_integrity_report(spark):
    from tidemark.operators import integrity

    frame = spark.createDataFrame
    hot, manifest = frame([("a",), ("a",), ("b",)], "dataset_id string"), frame([("a", 2), ("c", 9)], "dataset_id string, rows long")
    ledger = frame([("a", 1, "complete"), ("a", 2, "partial"), ("b", 1, "complete"), ("b", 2, "complete")], "dataset_id string, slot int, state string")
    slots = frame([("a", 1), ("a", 1), ("a", 2), ("b", 1), ("c", 5)], "dataset_id string, slot int")
    keys = lambda *x: frame([(i,) for i in x], "id int")
    got = integrity.report(
        integrity.row_count_parity(hot, manifest), integrity.coverage_reconciles(ledger, slots), integrity.none_without(keys(1, 2, 3), keys(1, 1, 2), ("id",), "pairs", "alone"), integrity.none_without(keys(1), keys(1, 5), ("id",), "pairs", "alone"), integrity.newest_have(keys(1, 2, 3, 9), keys(1, 3, 9), ("id",), "id", "newest", "gone", 3)
    )
    of = lambda **x: tuple(sorted(x.items()))
    assert sorted((r["check"], r["dataset_id"] or "", r["passed"], of(**r["observed"]), bool(r["detail"])) for r in got.collect()) == [
        ("coverage_reconciles", "a", False, of(complete_slots=1, record_slots=2), True), ("coverage_reconciles", "b", True, of(complete_slots=2, record_slots=1), False), ("coverage_reconciles", "c", False, of(complete_slots=0, record_slots=1), True),
        ("newest", "", False, of(checked=3, missing=1), True), ("pairs", "", False, of(without=1), True), ("pairs", "", True, of(without=0), False), ("row_count_parity", "a", True, of(archived=2, stored=2), False), ("row_count_parity", "b", False, of(archived=0, stored=1), True),
    ]
    assert tuple(integrity.overall(got).first()) == (8, 5, ["coverage_reconciles", "newest", "pairs", "row_count_parity"])
