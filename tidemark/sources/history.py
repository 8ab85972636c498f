"""History that a venue gives in pages: a data source with a partition for each page, and its sync with what is stored.

A page is a window of at most `page_limit` slots, so that whatever order the venue gives rows in, and whichever end it cuts,
a page holds all of its window. Filters on `event_ms` narrow the windows before any page is asked for; pages whose slots
are all stored are never asked for, so that a second run is cheap. Each page is a task of its own, tried again by
itself; a venue that limits its rate is waited for within the task.

    registered(spark)
    spark.read.format("paged_history").option("fetch", "module:function").option(...).load().filter("event_ms >= ...")

`fetch(options, start_ms, end_ms)` gives the rows of a closed window: (venue, symbol, event_ms, payload as JSON). It is named, not
passed, so that executors import it. `recorded` reads Parquet tables of such rows, `rest` asks a URL."""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "venue string, symbol string, event_ms long, payload string"
Row = tuple[str, str, int, str]
#: Answers that mean a rate limit, and how often a page is asked for.
LIMITED, ATTEMPTS = (429, 418), 6


class RateLimited(Exception):
    """The venue wants a pause, of so many seconds if it says."""

    def __init__(self, wait_s: float | None = None):
        super().__init__(wait_s)
        self.wait_s = wait_s


@dataclass
class Page(InputPartition):
    start_ms: int
    end_ms: int


class PagedHistory(DataSource):
    """Options: fetch; start_ms and end_ms, both inclusive; granularity_ms; page_limit; optionally pages, a JSON list of
    the numbers of the pages that are wanted, counted from start_ms; and what `fetch` takes."""

    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Pages(dict(self.options))


class _Pages(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.first, self.last = int(options["start_ms"]), int(options["end_ms"])
        self.low, self.high = self.first, self.last

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("event_ms",):
                yield f
            elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThanOrEqual | LessThan):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        wide = page_ms(self.options)
        wanted = json.loads(self.options["pages"]) if "pages" in self.options else range((self.high - self.first) // wide + 1)
        windows = ((max(self.low, self.first + k * wide), min(self.high, self.first + (k + 1) * wide - 1)) for k in wanted)
        # Spark wants a partition also where there is nothing to read
        return [Page(a, b) for a, b in windows if a <= b] or [Page(1, 0)]

    def read(self, partition: Page) -> Iterator[Row]:
        if partition.start_ms > partition.end_ms:
            return
        fetch, wait = fetcher(self.options["fetch"]), float(self.options.get("wait_s", 1))
        for attempt in range(ATTEMPTS):
            try:
                rows = fetch(self.options, partition.start_ms, partition.end_ms)
                break
            except RateLimited as limit:
                # not an empty page: that would look like a hole in the venue's history
                if attempt == ATTEMPTS - 1:
                    raise
                time.sleep(wait * 2**attempt if limit.wait_s is None else limit.wait_s)
        # a venue may give more than was asked for
        yield from (r for r in rows if partition.start_ms <= r[2] <= partition.end_ms)


def page_ms(options: dict) -> int:
    return int(options["page_limit"]) * int(options["granularity_ms"])


@cache
def fetcher(name: str) -> Callable[[dict, int, int], list[Row]]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def recorded(options: dict, start_ms: int, end_ms: int) -> list[Row]:
    """Rows of the Parquet table at `path`, of any file system that Arrow knows; of each column that `columns` names
    (venue, symbol, event_ms and payload, comma-separated), row groups outside the window are skipped."""
    import pyarrow.dataset as ds

    names = options.get("columns", "venue,symbol,event_ms,payload").split(",")
    at = ds.field(names[2])
    found = ds.dataset(options["path"].removeprefix("file://"), format="parquet").to_table(columns=sorted(set(names)), filter=(at >= start_ms) & (at <= end_ms))
    columns = [found.column(n).to_pylist() for n in names]
    return [(str(a), str(b), c, d if isinstance(d, str) else json.dumps(d)) for a, b, c, d in zip(*columns, strict=True)]


def rest(options: dict, start_ms: int, end_ms: int) -> list[Row]:
    """Rows of a JSON list at `url`, asked for with startTime, endTime and limit; `time_key` is the field of an item that holds
    its time, venue and symbol are options."""
    query = {"symbol": options["symbol"], "startTime": start_ms, "endTime": end_ms, "limit": options["page_limit"]}
    try:
        with urllib.request.urlopen(f"{options['url']}?{urllib.parse.urlencode(query)}", timeout=20) as answer:
            items = json.load(answer)
    except urllib.error.HTTPError as e:
        if e.code in LIMITED:
            after = e.headers.get("Retry-After")
            raise RateLimited(float(after) if after else None) from e
        raise
    return [(options["venue"], options["symbol"], int(x[options["time_key"]]), json.dumps(x)) for x in items]


def missing_pages(stored: DataFrame, time_ms: str, start_ms: int, end_ms: int, granularity_ms: int, page_limit: int) -> DataFrame:
    """The numbers of the pages that have a slot without a stored row, as `page`. A page is counted by an
    aggregation of its stored slots; pages without any row are added from the grid of pages, which is `page_limit` times
    smaller than that of slots."""
    wide = granularity_ms * page_limit
    inside = stored.filter(F.col(time_ms).between(start_ms, end_ms)).select(F.floor((F.col(time_ms) - start_ms) / granularity_ms).alias("_slot")).distinct()
    full = inside.groupBy(F.floor(F.col("_slot") / page_limit).alias("page")).agg(F.count("*").alias("_n"))
    last = (end_ms - start_ms) // wide
    pages = stored.sparkSession.range(last + 1).withColumnRenamed("id", "page")
    slots = F.when(F.col("page") == last, (end_ms - start_ms) // granularity_ms + 1 - last * page_limit).otherwise(page_limit)
    return pages.join(full, "page", "left").filter(F.coalesce("_n", F.lit(0)) < slots).select("page")


def registered(spark: SparkSession) -> None:
    """Makes `paged_history` known to a session, and lets Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedHistory)


def synced(spark: SparkSession, stored: DataFrame, time_ms: str, start_ms: int, end_ms: int, granularity_ms: int, page_limit: int, fetch: str, **options: str) -> DataFrame:
    """The rows of history that aren't stored, for the slots from start_ms to end_ms; `stored` has `time_ms` of one series.

    What comes to the driver is a number for each page that isn't whole: a partition each."""
    pages = [r["page"] for r in missing_pages(stored, time_ms, start_ms, end_ms, granularity_ms, page_limit).orderBy("page").toLocalIterator()]
    registered(spark)
    reader = spark.read.format("paged_history").options(fetch=fetch, start_ms=start_ms, end_ms=end_ms, granularity_ms=granularity_ms, page_limit=page_limit, pages=json.dumps(pages), **options)
    slot = lambda c: F.floor((c - start_ms) / granularity_ms)
    held = stored.select(slot(F.col(time_ms)).alias("_slot")).distinct()
    return reader.load().withColumn("_slot", slot(F.col("event_ms"))).join(held, "_slot", "left_anti").drop("_slot")


def next_start_ms(stored: DataFrame, time_ms: str, now_ms: int, lookback_ms: int) -> int:
    """Where a top-up begins: after the newest stored row, or so far back if there is none."""
    newest = stored.agg(F.max(time_ms)).first()[0]
    return now_ms - lookback_ms if newest is None else newest + 1
