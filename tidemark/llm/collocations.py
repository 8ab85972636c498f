"""Phrases of words that occur together more often than their parts let expect, for each language.

Texts are cut at punctuation into pieces, and identical pieces of a language become one with a multiplicity, so that
copies and repeated passages are counted once, with their weight. Distinct pieces are dealt to buckets by their hash, and
the words and phrases of each bucket, weighted, to buckets of their own, where they are summed. Each step runs in duckdb
inside the task of a bucket, which puts its rows into tables of limited memory and spills the rest to scratch that goes with
the task, as Spark's own sorts do. So a bucket is counted whatever its size, and a phrase has a row at most from each
bucket of pieces, however often it occurs.

Between the steps rows travel in sorted, compressed cells, a cell for each bucket that a task has rows for. A task writes to
at most `FAN` buckets, so that cells don't become tiny: beyond that, rows go to their bucket in several exchanges,
each of which sums what it has and deals it `FAN` times finer.

A phrase is scored by the counts of its parts, which are at least as frequent and so counted. Buckets of candidates ask for
them by lookup requests: each asks once for each distinct part, requests are shuffled to the counts, and answers go back to
the bucket. So a word that is in a third of all phrases is asked for once by each bucket.

Defined cases: a null text has no piece; a null lang is `UNKNOWN`; pieces without a word don't count; extra columns are
ignored; repeated rows and ties count as they are; a text is read whole, also if it is one long piece; an empty table
gives no row. Counts are exact, scores too up to counts of 10^16.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, union, written

LONGEST, LEAST, INSIDE, FIRST = 3, 10, 50, 2000
UNKNOWN = "und"
#: Text bytes of a bucket, buckets that a task writes to, bytes of text whose pieces are merged in memory, duckdb's memory.
BUCKET, FAN, MERGED, MEMORY = 8 << 20, 256, 4 << 20, "256MB"
#: Characters that end a piece: . , ; : ! ? and line feed to carriage return; A-Z become a-z.
ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + ENDS, bytes(range(97, 123)) + b"\n" * len(ENDS))
_CELL = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())])
CELLS = "slot long, data binary"
Batches = Iterator[pa.RecordBatch]


def split_pieces(text: bytes) -> list[bytes]:
    """The pieces with a word, in lower case, their words joined by one space."""
    return [b" ".join(w) for piece in text.translate(_PLAIN).split(b"\n") if (w := piece.split())]


class Counting:
    """A duckdb of limited memory for one task, with a table `g` of lang, gram and f; what it spills goes with it."""

    def __init__(self, memory: str = MEMORY):
        import duckdb

        self.scratch = tempfile.TemporaryDirectory(prefix="grams-")
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": memory, "temp_directory": self.scratch.name, "preserve_insertion_order": "false"})
        self.con.execute("CREATE TABLE g (lang VARCHAR, gram VARCHAR, f BIGINT)")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.con.close()
        self.scratch.cleanup()

    def put(self, rows: pa.Table) -> None:
        self.con.register("arrived", rows)
        self.con.execute("INSERT INTO g SELECT * FROM arrived")
        self.con.unregister("arrived")

    def put_cells(self, batches: Batches) -> None:
        for batch in batches:
            for cell in batch.column("data"):
                self.put(pa.ipc.open_stream(cell.as_buffer()).read_all())

    def cells(self, rows: str, slots: int) -> Batches:
        """The rows of a query, sorted and cut by the slot that their hash gives."""
        held: list[pa.RecordBatch] = []
        now = None
        reader = self.con.execute(f"SELECT CAST(hash(lang, gram) % {slots} AS BIGINT) AS slot, lang, gram, f FROM ({rows}) ORDER BY slot, lang, gram").to_arrow_reader(1 << 16)
        for batch in reader:
            slot, at = batch.column("slot").to_numpy(), 0
            batch = pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns[1:], _CELL.types, strict=True)], schema=_CELL)
            while at < len(slot):
                if slot[at] != now:
                    if held:
                        yield _cell(now, held)
                    now, held = int(slot[at]), []
                end = int(slot.searchsorted(now, "right"))
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield _cell(now, held)


def _cell(slot: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _CELL, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slot", "data"])


SUMS = "SELECT lang, gram, CAST(sum(f) AS BIGINT) AS f FROM g GROUP BY lang, gram"


def slots_of(buckets: int, fan: int = FAN) -> list[int]:
    """The slots of each exchange; the last has `buckets` or some more."""
    out = [1]
    while out[-1] < buckets:
        out.append(out[-1] * min(fan, -(-buckets // out[-1])))
    return out[1:] or [1]


def gathered(cells: DataFrame, slots: list[int]) -> DataFrame:
    """The cells of each bucket in a partition of its own; `cells` have the first of the slots."""

    def finer(to: int) -> callable:
        def run(batches: Batches) -> Batches:
            with Counting() as db:
                db.put_cells(lean(batches))
                yield from db.cells(SUMS, to)

        return run

    for now, to in zip(slots, slots[1:], strict=False):
        # a slot's cells in as many tasks as it gets finer ones
        part = F.col("slot") + now * F.pmod(F.crc32("data"), F.lit(to // now))
        cells = cells.repartitionById(to, part.cast("int")).mapInArrow(finer(to), CELLS)
    return cells.repartitionById(slots[-1], F.col("slot").cast("int"))


def pieces(docs: DataFrame, slots: int) -> DataFrame:
    """Cells of the distinct pieces of each task with their multiplicities."""

    def cut(batches: Batches) -> Batches:
        with Counting() as db:

            def put(counts: dict[str, Counter]) -> None:
                for lang, c in counts.items():
                    if c:
                        db.put(pa.table([pa.array([lang], pa.string()).take(pa.array([0] * len(c))), pa.array(c.keys(), pa.binary()).cast(pa.string()), pa.array(c.values(), pa.int64())], schema=_CELL))

            counts: dict[str, Counter] = {}
            held = 0
            for batch in lean(batches):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                    text = text.as_py() or b""
                    counts.setdefault(lang, Counter()).update(split_pieces(text))
                    held += len(text)
                    if held >= MERGED:
                        put(counts)
                        counts, held = {}, 0
            put(counts)
            yield from db.cells(SUMS, slots)

    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, CELLS)


def grams(found: DataFrame, longest: int, slots: int) -> DataFrame:
    """Cells of the words and phrases of each bucket of pieces, weighted; the empty gram has the number of words."""
    names = [f"w{i}" for i in range(longest)]
    side = ", ".join(f"unnest(w[{i + 1}:]) AS {name}" for i, name in enumerate(names))
    parts = [f"SELECT lang, {" || ' ' || ".join(names[: n + 1])} AS gram, CAST(sum(m) AS BIGINT) AS f FROM t WHERE {names[n]} IS NOT NULL GROUP BY lang, {', '.join(names[: n + 1])}" for n in range(longest)]
    parts.append("SELECT lang, '' AS gram, CAST(sum(m) AS BIGINT) AS f FROM t GROUP BY lang")

    def run(batches: Batches) -> Batches:
        with Counting() as db:
            db.put_cells(lean(batches))
            # lists that are unnested side by side: linear in a piece's words
            db.con.execute(f"CREATE TABLE t AS SELECT lang, m, {side} FROM (SELECT lang, string_split(gram, ' ') AS w, CAST(sum(f) AS BIGINT) AS m FROM g GROUP BY lang, gram)")
            db.con.execute("DROP TABLE g")
            yield from db.cells(" UNION ALL ".join(parts), slots)

    return found.mapInArrow(run, CELLS)


def gram_counts(docs: DataFrame, longest: int, least: int, buckets: int, fan: int = FAN) -> DataFrame:
    """n, lang, gram and f of every gram of up to `longest` words that occurs `least` times; n = 0 has each lang's words."""
    slots = slots_of(buckets, fan)
    sent = grams(gathered(pieces(docs, slots[0]), slots), longest, slots[0])

    def run(batches: Batches) -> Batches:
        with Counting() as db:
            db.put_cells(lean(batches))
            sums = db.con.execute(f"SELECT CASE WHEN gram = '' THEN 0 ELSE len(string_split(gram, ' ')) END, lang, gram, f FROM ({SUMS}) WHERE f >= {least} OR gram = ''")
            for batch in sums.to_arrow_reader(1 << 16):
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *(c.cast(t) for c, t in zip(batch.columns[1:], _CELL.types, strict=True))], names=["n", *_CELL.names])

    return written(gathered(sent, slots).mapInArrow(run, "n int, lang string, gram string, f long"), "gram-counts")


def _words(gram: Column) -> Column:
    return F.split(gram, " ")


def scored(counts: DataFrame, buckets: int) -> DataFrame:
    """The candidates of counts with a, and l, r and score of their lowest-scoring cut."""
    cuts = counts.filter("n > 1").withColumn("home", F.pmod(F.xxhash64("lang", "gram"), F.lit(buckets)).cast("int"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    part = lambda at, size: F.array_join(F.slice(_words(F.col("gram")), at, size), " ")
    cuts = written(cuts.select("lang", "gram", "n", F.col("f").alias("a"), "home", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n") - F.col("k")).alias("right")), "cuts")
    asked = cuts.select("lang", "home", F.explode(F.array("left", "right")).alias("part")).distinct()
    told = written(asked.join(counts.select("lang", F.col("gram").alias("part"), "f"), ["lang", "part"]), "answers")
    met = cuts.join(told.select("lang", "home", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "home", "left"])
    met = met.join(told.select("lang", "home", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "home", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  exact up to 38 digits: a below 10^16
    over = (wide("a") * wide("a")).cast("decimal(38,0)") * F.lit(1000000).cast("decimal(7,0)")
    met = met.withColumn("over", over.cast("decimal(38,0)")).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    lowest = met.groupBy("lang", "gram", "n", "a").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "gram", "n", "a", "cut.l", "cut.r", "cut.score")


def outermost(candidates: DataFrame, longest: int, inside: int) -> DataFrame:
    """Without those that lie inside a longer candidate with at least `inside` hundredths of their occurrences."""
    def inner(k: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.col("n") - k + 1)
        return candidates.filter(F.col("n") > k).select("lang", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(_words(F.col("gram")), i, k), " "))).alias("gram"), "a")

    parts = [inner(k) for k in range(2, longest)]
    if not parts:
        return candidates
    most = union(parts).groupBy("lang", "gram").agg(F.max("a").alias("_most"))
    met = candidates.join(most, ["lang", "gram"], "left")
    return met.filter(F.col("_most").isNull() | (100 * F.col("_most") < inside * F.col("a"))).drop("_most")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, first: int = FIRST, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each lang's `first` best phrases."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket))
    counts = gram_counts(docs, longest, least, buckets, fan)
    totals = counts.filter("n = 0").select("lang", F.col("f").alias("total"))
    candidates = written(scored(counts, buckets), "candidates")
    # each bucket's best, and of these each lang's
    ranked = outermost(candidates, longest, inside).withColumn("_b", F.pmod(F.xxhash64("lang", "gram"), F.lit(buckets)))
    for keys in (["lang", "_b"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "gram")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", F.col("total").cast("long").alias("n"), "score")
