"""Paged history: pushed filters, skipped pages, rate limits, and rows against an anti join."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.sources import history

STEP, LIMIT = 10, 5


@pytest.fixture(scope="module")
def remote(spark, tmp_path_factory):
    """A venue's rows at every slot but some, in Parquet."""
    path = str(tmp_path_factory.mktemp("remote") / "rows")
    rows = [("bybit", "BTC", 1000 + STEP * i + i % 3, f'{{"i": {i}}}') for i in range(100) if i % 11]
    spark.createDataFrame(rows, history.SCHEMA).write.parquet(path)
    return path, rows


def read(spark, path, **more):
    history.registered(spark)
    options = {"fetch": "tidemark.sources.history:recorded", "path": path, "start_ms": 1000, "end_ms": 1999, "granularity_ms": STEP, "page_limit": LIMIT} | more
    return spark.read.format("paged_history").options(**options).load()


def test_pages_and_pushed_filters(spark, remote):
    path, rows = remote
    whole = read(spark, path)
    assert sorted(map(tuple, whole.collect())) == sorted(rows) and whole.rdd.getNumPartitions() == 20
    for condition, keep in (("event_ms >= 1234 and event_ms < 1400", lambda t: 1234 <= t < 1400), ("event_ms > 1234 and event_ms <= 1400", lambda t: 1234 < t <= 1400), ("event_ms = 1021", lambda t: t == 1021), ("event_ms > 5000", lambda t: False)):
        some = whole.filter(condition)
        assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if keep(r[2]))
        # the source itself has narrowed its pages
        assert some.rdd.getNumPartitions() <= 5
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"event_ms#\d+L [<>=]", plan), plan  # no comparison is left to Spark
    assert whole.filter("symbol = 'BTC' and event_ms <= 1049").count() == len([r for r in rows if r[2] <= 1049])


def test_sync_skips_whole_pages_and_stored_rows(spark, remote, monkeypatch):
    path, rows = remote
    slot = lambda t: (t - 1000) // STEP
    stored_rows = [(t,) for _, _, t, _ in rows if slot(t) < 30 or slot(t) % 4 == 0] + [(1000 + STEP * i,) for i in range(0, 30, 11)]
    stored = spark.createDataFrame(stored_rows, "t long")
    assert sorted(r["page"] for r in history.missing_pages(stored, "t", 1000, 1999, STEP, LIMIT).collect()) == list(range(6, 20))
    got = history.synced(spark, stored, "t", 1000, 1999, STEP, LIMIT, "tidemark.sources.history:recorded", path=path)
    held = {slot(t) for (t,) in stored_rows}
    assert sorted(r["event_ms"] for r in got.collect()) == sorted(t for _, _, t, _ in rows if slot(t) not in held)
    # what is stored then is whole but for the venue's own holes, and a second run finds nothing more
    after = stored.unionByName(got.select(F.col("event_ms").alias("t")))
    assert history.synced(spark, after, "t", 1000, 1999, STEP, LIMIT, "tidemark.sources.history:recorded", path=path).count() == 0
    every = stored.sparkSession.range(100).select((F.col("id") * STEP + 1000).alias("t"))
    assert history.missing_pages(every, "t", 1000, 1999, STEP, LIMIT).count() == 0
    # the last page is short
    assert history.missing_pages(every.filter("t <= 1970"), "t", 1000, 1970, STEP, LIMIT).count() == 0
    assert history.missing_pages(every.filter("t <= 1960"), "t", 1000, 1970, STEP, LIMIT).count() == 1
    assert (history.next_start_ms(every, "t", 5000, 700), history.next_start_ms(every.filter("false"), "t", 5000, 700)) == (1991, 4300)


def test_rest_waits_for_a_rate_limit(spark):
    asked = []

    class Venue(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            if len(asked) == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0.1")
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            # newest first, and one row beyond the window
            times = range(int(q["endTime"]) + 1, int(q["startTime"]) - 1, -1)
            self.wfile.write(json.dumps([{"fundingTime": str(t), "rate": "0.1"} for t in times]).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Venue)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    options = {"fetch": "tidemark.sources.history:rest", "url": f"http://127.0.0.1:{server.server_port}/x", "venue": "v", "symbol": "S", "time_key": "fundingTime", "start_ms": 100, "end_ms": 119, "granularity_ms": 1, "page_limit": 10}
    history.registered(spark)
    got = spark.read.format("paged_history").options(**options).load()
    assert sorted(r["event_ms"] for r in got.collect()) == list(range(100, 120))
    assert len(asked) == 3 and {q["limit"] for q in asked} == {"10"} and json.loads(got.first()["payload"])["rate"] == "0.1"
    server.shutdown()


def test_a_venue_that_never_answers_is_an_error_not_a_hole(spark):
    history.registered(spark)
    with pytest.raises(Exception, match="RateLimited"):
        spark.read.format("paged_history").options(fetch="tests.test_history:limited", start_ms=0, end_ms=9, granularity_ms=1, page_limit=10, wait_s=0).load().collect()


def limited(options, start_ms, end_ms):
    raise history.RateLimited
