"""Mixing sources to target weights by blocks.

The words of a source form one stream: its documents in a pseudorandom order, cut into blocks of equal length.
A source's target says how many block slots it fills. Output shards have a fixed number of slots, and each shard draws
its source counts multinomially, with the sources' slots as weights: every slot's hash is a place on a line on which
each source has as many places as slots. A source's slots are numbered through the shards; where it was drawn more often
than it has slots the last draws go, and where less, what lacks is put into further shards, so that totals are
exact. Slot k of a source is position k mod n of pass k div n, and a pseudorandom permutation of the source's n block
numbers maps it to a block; slots and blocks then join by number. The last slot of a source is trimmed, so a source's
words are its rounded target. No source is asked for more than two passes.

No task holds a whole source: draws meet the line by stretches of it, word offsets come from sums of bins of about
`DOCS_PER_BIN` documents, and rows that are equal in all columns are one row with a count until they are placed.

Defined cases: a null text has no words; null sources are one source, last in order; documents without words
take no part and get 0; repeated rows are documents of their own; rows that differ in any column stay apart, but for
columns of maps, which have no hash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import n_words, words, written

BLOCK_WORDS = 1024
SLOTS_PER_SHARD = 1024
DOCS_PER_BIN = 2000
#: Parts of the line that draws meet sources by, and equal rows that one row stands for when they are listed.
STRETCHES, COPIES = 4096, 10_000
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20


def _tie(docs: DataFrame):
    """The hash of a row's columns."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def sizes(docs: DataFrame) -> DataFrame:
    """What identifies a document, how many words it has and how many rows are equal to it."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _tie(docs).alias("tie"))
    return rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("copies"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """A row for each source: its size, its target and its number `s` in the order of names.

    Sharing by weight with ceilings ends at one level: a source gets its weight times the level, or its ceiling
    where that is less. With sources in order of ceiling over weight, the level is found by running sums. One
    task orders the sources; it reads one row for each."""
    by_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("s", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.col("s") % len(weights)).cast("double"))
    ranked = ranked.withColumn("most", (most * F.col("source_size")).cast("double"))
    before = Window.orderBy(F.col("most") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    levels = levels.withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level"))).over(every))
    return levels.select("source", "s", "source_size", "n_docs", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def _round_keys(s: np.ndarray, turn: np.ndarray, rounds: int = 6) -> list[np.ndarray]:
    key = (s.astype(np.uint64) * np.uint64(2) + turn.astype(np.uint64) + np.uint64(SEED) * np.uint64(1 << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return [_mixed(key + np.uint64(r + 1) * np.uint64(0xD1B54A32D192ED03)) for r in range(rounds)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(s: np.ndarray, turn: np.ndarray, n: np.ndarray, at: np.ndarray, back: bool = False) -> np.ndarray:
    """The block at a position of a pass over the n blocks of source s, or with `back` the position of a block:
    a Feistel network over the next power of four, walked until it falls below n."""
    with np.errstate(over="ignore"):
        s, turn, n, x = (np.asarray(v).astype(np.uint64) for v in (s, turn, n, at))
        half = np.maximum(1, (np.ceil(np.log2(np.maximum(n.astype(float), 2))) + 1) // 2).astype(np.uint64)
        low, keys, open_ = (np.uint64(1) << half) - np.uint64(1), _round_keys(s, turn), np.ones(len(x), bool)
        while open_.any():
            left, right = x[open_] >> half[open_], x[open_] & low[open_]
            for key in reversed(keys) if back else keys:
                if back:
                    left, right = right ^ (_mixed(left + key[open_]) & low[open_]), left
                else:
                    left, right = right, left ^ (_mixed(right + key[open_]) & low[open_])
            x[open_] = left << half[open_] | right
            open_ = x >= n
    return x.astype(np.int64)


@F.pandas_udf(LongType())
def block_at(s: pd.Series, turn: pd.Series, n: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series(permuted(s, turn, n, at))


@F.pandas_udf(LongType())
def place_of(s: pd.Series, turn: pd.Series, n: pd.Series, block: pd.Series) -> pd.Series:
    return pd.Series(permuted(s, turn, n, block, back=True))


def drawn(sized: DataFrame, slots_per_shard: int = SLOTS_PER_SHARD) -> tuple[DataFrame, int]:
    """How many slots each shard drew of each source, `s`, `shard` and `held`, and how many shards there are.

    sized: `s` and `slots`. Draws and sources meet by `STRETCHES` equal parts of the line, so that a large source is many
    keys."""
    c = F.col
    every = sized.agg(F.sum("slots")).first()[0] or 0
    step = max(1, -(-every // STRETCHES))
    start = F.coalesce(F.sum("slots").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = sized.select("s", "slots", start.alias("_from")).filter("slots > 0")
    line = line.select("s", "_from", (c("_from") + c("slots")).alias("_to"), F.explode(F.sequence(F.floor(c("_from") / step), F.floor((c("_from") + c("slots") - 1) / step))).alias("_part"))
    draws = sized.sparkSession.range(every).select(F.floor(c("id") / slots_per_shard).alias("shard"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, every))).alias("_u"))
    met = draws.withColumn("_part", F.floor(c("_u") / step)).join(line, "_part").filter((c("_u") >= c("_from")) & (c("_u") < c("_to")))
    return met.groupBy("s", "shard").agg(F.count("*").alias("held")), -(-every // slots_per_shard)


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """A row for each slot: shard, source, block, pass and how many of the block's first words it takes."""
    b = F.lit(block_words).cast("long")
    c = F.col
    up = lambda x: F.floor((x + b - 1) / b).cast("long")
    sized = sources.filter("source_size > 0").select("s", "source_size", up(c("source_size")).alias("n"), F.floor(c("target") + 0.5).cast("long").alias("wanted"))
    sized = sized.withColumn("short", c("n") * b - c("source_size")).withColumn("turn", F.when(c("wanted") > c("source_size"), 1).otherwise(0).cast("long"))
    # how many slots the last pass needs: its short block counts once it has passed
    sized = sized.withColumn("short_at", place_of("s", "turn", "n", c("n") - 1)).withColumn("rest", c("wanted") - c("turn") * c("source_size"))
    sized = sized.withColumn("last", F.when(c("rest") <= c("short_at") * b, up(c("rest"))).otherwise(up(c("rest") + c("short"))))
    sized = sized.withColumn("slots", c("turn") * c("n") + c("last"))
    sized = written(sized, "source-slots")
    counts, shards = drawn(sized, slots_per_shard)
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))), "draws")
    cut = counts.join(sized, "s").withColumn("held", F.least(c("held"), c("slots") - c("before"))).filter("held > 0")
    got = counts.groupBy("s").agg(F.sum("held").alias("before"))
    lacking = sized.join(got, "s", "left").withColumn("before", F.coalesce("before", F.lit(0))).withColumn("held", c("slots") - c("before")).filter("held > 0")
    lacking = lacking.withColumn("shard", F.lit(shards).cast("long"))
    each = cut.unionByName(lacking.select(cut.columns)).withColumn("k", F.explode(F.sequence(c("before"), c("before") + c("held") - 1)))
    each = each.withColumn("shard", F.when(c("shard") == shards, shards + F.floor((c("k") - c("before")) / slots_per_shard)).otherwise(c("shard")))
    each = each.withColumn("pass", F.floor(c("k") / c("n")).cast("long")).withColumn("at", c("k") % c("n"))
    each = each.withColumn("block", block_at("s", "pass", "n", "at"))
    length = F.when(c("block") == c("n") - 1, b - c("short")).otherwise(b)
    earlier = c("at") * b - F.when((c("short_at") < c("at")), c("short")).otherwise(0)
    taken = F.when(c("pass") < c("turn"), length).otherwise(F.greatest(F.lit(0), F.least(length, c("rest") - earlier)))
    return each.select("shard", "s", "block", "pass", taken.cast("long").alias("words"))


def offsets(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with the place of its first word in its source's stream."""
    c = F.col
    known = sources.select(c("source").alias("_source"), "s", "source_size", "n_docs", "target")
    joined = sized.join(known, c("source").eqNullSafe(c("_source"))).drop("_source")
    mixed = F.xxhash64("doc_id", "tie", F.lit(SEED))
    binned = joined.withColumn("bin", F.pmod(mixed, F.ceil(c("n_docs") / DOCS_PER_BIN))).withColumn("mixed", mixed).withColumn("whole", c("size") * c("copies"))
    within = Window.partitionBy("s", "bin").orderBy("mixed", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = binned.withColumn("within", F.coalesce(F.sum("whole").over(within), F.lit(0)))
    bins = binned.groupBy("s", "bin").agg(F.sum("whole").alias("held"))
    before = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("s", "bin", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("earlier"))
    placed = placed.join(bins, ["s", "bin"]).withColumn("start", c("earlier") + c("within")).drop("bin", "mixed", "whole", "within", "earlier", "n_docs")
    # equal rows follow each other; many of them are listed in parts
    one = placed.filter("copies = 1")
    many = placed.filter("copies > 1").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), c("copies") - 1, F.lit(COPIES).cast("long")))).repartition("s", "doc_id", "tie", "_c")
    many = many.withColumn("_c", F.explode(F.sequence(c("_c"), F.least(c("_c") + COPIES, c("copies")) - 1)))
    return one.unionByName(many.withColumn("start", c("start") + c("_c") * c("size")).drop("_c"))


def pieces(placed: DataFrame, slots_: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents cut at block borders, each piece with every slot that takes some of it; `held` of the words
    from `first` of the document on. A piece that no slot takes stays, with null slot columns."""
    c, b = F.col, F.lit(block_words).cast("long")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(c("start") / b).cast("long"), F.floor((c("start") + c("size") - 1) / b).cast("long"))))
    cut = cut.withColumn("first", F.greatest(F.lit(0), c("block") * b - c("start"))).withColumn("end", F.least(c("size"), (c("block") + 1) * b - c("start")))
    # slots come from exploded counts, whose size Spark can't foresee: without the hint it would broadcast them
    met = cut.join(slots_.hint("merge"), ["s", "block"], "left")
    within = c("start") + c("first") - c("block") * b
    return met.withColumn("held", F.greatest(F.lit(0), F.least(c("end") - c("first"), F.coalesce(c("words"), F.lit(0)) - within)))


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sized = written(sizes(docs), "sizes")
    return sized, written(targets(sized), "sources")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, for each document."""
    sized, sources = _prepared(docs)
    placed = offsets(sized, sources)
    key = ["doc_id", "source", "s", "start", "size", "source_size", "target"]
    taken = pieces(placed, slots(sources)).groupBy(*key).agg(F.sum("held").alias("taken"))
    rest = placed.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: for each document and pass a row with the words taken, the text
    as it was where all are. `n_chars`, where docs has it, follows the text."""
    c = F.col
    sized, sources = _prepared(docs)
    held = pieces(offsets(sized, sources), slots(sources)).filter("held > 0")
    passes = held.groupBy("doc_id", "source", "size", "tie", "copies", "start", "pass").agg(F.sum("held").alias("_all"), F.sort_array(F.collect_list(F.struct("first", "held"))).alias("_parts"))
    passes = passes.select(c("doc_id").alias("_id"), c("source").alias("_source"), c("size").alias("_size"), c("tie").alias("_tie"), "copies", "_all", "_parts")
    texts = docs.withColumn("_hash", _tie(docs))
    # equal rows are few keys: one of each gives the text of them all
    again = written(sized.filter("copies > 1").select(c("doc_id").alias("_i"), c("tie").alias("_t")), "equal-rows")
    equal = texts.join(again, c("doc_id").eqNullSafe(c("_i")) & (c("_hash") == c("_t")), "left_semi").dropDuplicates(["doc_id", "_hash"])
    with_ = lambda rows, some: rows.join(some, c("doc_id").eqNullSafe(c("_id")) & (c("_hash") == c("_tie")) & c("source").eqNullSafe(c("_source")))
    met = with_(texts, passes.filter("copies = 1")).unionByName(with_(equal, passes.filter("copies > 1")))
    met = met.withColumn("_words", F.when(c("_all") < c("_size"), words(c("text"))))
    some = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice("_words", (p["first"] + 1).cast("int"), p["held"].cast("int")))), " ")
    out = met.withColumn("text", F.when(c("_all") == c("_size"), c("text")).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
