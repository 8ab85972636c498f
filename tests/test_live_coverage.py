"""Coverage of running feeds: slots that are raised, feeds that are up but silent, and figures of micro-batches."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_state import run
from tidemark.operators import coverage as merged
from tidemark.streaming import coverage

T0 = datetime(2025, 1, 1)


def test_slots_are_raised_and_never_lowered(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice("ab"), T0 + timedelta(seconds=10 * i + r.randint(-120, 0)), r.random() < 0.5) for i in range(200)]
    schema = "feed string, t timestamp, up boolean"
    for kept_s in (900.0, 60.0):
        path = tmp_path / str(kept_s)
        path.mkdir()
        got = run(spark, rows, schema, lambda s: coverage.raised(coverage.marks_of_beats(s, ("feed",), "t", F.col("up"), 60), ("feed",), "t", kept_s), path, f"raised_{int(kept_s)}")  # noqa: B023
        want = {}
        for feed, t, up in rows:
            k = (feed, t.replace(second=0, microsecond=0))
            want[k] = max(want.get(k, 0), 2 if up else 1)
        table = spark.createDataFrame([(x["feed"], x["slot"], x["state"]) for x in got], "feed string, slot timestamp_ntz, state string")
        assert {(x["feed"], x["slot"]): merged.STATES.index(x["state"]) for x in merged.merged_states(table, ("feed", "slot")).collect()} == want
        if kept_s == 900.0:  # nothing is said twice
            assert len({(x["feed"], x["slot"], x["state"]) for x in got}) == len(got)


def test_feeds_that_are_up_but_silent(spark, tmp_path):
    """Beats and records in one folder of files, split into two streams; a last row moves the watermark."""
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("beat", "a", at(10)), ("rec", "a", at(12)), ("rec", "a", at(50)), ("beat", "b", at(15)), ("rec", "b", at(70)), ("beat", "a", at(75)), ("beat", "b", at(80)), ("rec", "c", at(20)), ("beat", "a", at(4000)), ("rec", "a", at(4001)), ("beat", "z", at(8000)), ("rec", "z", at(8000)), ("beat", "z", at(12000)), ("rec", "z", at(12000))]
    schema = "kind string, feed string, t timestamp"

    def build(s):
        return coverage.silent(s.filter("kind = 'beat'").select("feed", "t"), s.filter("kind = 'rec'").select("feed", "t"), ("feed",), "t", 60, 60)

    got = run(spark, rows, schema, build, tmp_path, "silent_feeds", files=7)
    assert sorted((x["feed"], x["t"]) for x in got) == [("a", at(75)), ("b", at(15))]


def test_figures_of_batches(spark, tmp_path):
    figures = coverage.Figures("delays", most=3)
    spark.streams.addListener(figures)
    rows = [(T0 + timedelta(seconds=i), T0 + timedelta(seconds=i, milliseconds=10 * (i + 1))) for i in range(40)]
    got = run(spark, rows, "e timestamp, i timestamp", lambda s: coverage.observed(s, "delays", "e", "i"), tmp_path, "figures", files=4)
    for _ in range(100):
        if figures.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(figures)
    assert len(got) == 40 and [f["rows"] for f in figures.held if f["rows"]][-3:] == [10, 10, 10] and len(figures.held) == 3
    assert all(0 < f["p50_ms"] < f["p95_ms"] <= 400 for f in figures.held if f["rows"]) and figures.ended == [None]
