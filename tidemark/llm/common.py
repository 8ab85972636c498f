"""What the text operators share: reading a table, words, cutting lineage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null or blank one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, SPACES_RE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; at their end Arrow gives back the memory that it keeps, since Python workers live on."""
    yield from batches
    pa.default_memory_pool().release_unused()


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tie(text: Column) -> Column:
    """A text's hash, 128 bits; null and blank texts have the same."""
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.when(F.btrim(text, F.lit(SPACES)) == "", F.lit("")).otherwise(text)))


def one_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of docs for each root: that with the smallest doc_id, a null one last, and of these with the least
    hash. rooted: `_id`, `_tie`, the number `_n` of their rows, and `root`, which is the same for equal texts."""
    c = F.col
    least = rooted.groupBy("root").agg(F.min(F.struct(c("_id").isNull().alias("no"), "_id", "_tie", "_n")).alias("k")).select("k._id", "k._tie", "k._n")
    least = written(least, "representatives")
    tied = docs.select(*docs.columns, c("doc_id").cast("long").alias("_i"), tie(c("text")).alias("_t"))
    met = lambda some: tied.join(some, c("_i").eqNullSafe(c("_id")) & (c("_t") == c("_tie")), "left_semi")
    # rows that share doc_id and text are few; written, so that Spark knows how few. Of these any one
    shared = written(least.filter("_n > 1"), "shared-rows")
    return met(least.filter("_n = 1")).select(*docs.columns).unionByName(met(shared).dropDuplicates(["_i", "_t"]).select(*docs.columns))


def least_ids(rows: DataFrame) -> DataFrame:
    """The smallest `_id` of each `_tie`, a null one last, and the number of rows that share both."""
    counts = rows.groupBy("_id", "_tie").agg(F.count("*").alias("_n"))
    return counts.groupBy("_tie").agg(F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_n")).alias("k")).select("k._id", "_tie", "k._n")


#: Bits of the bitmap of `may_hold` for each key, and the power of two that its bits never pass: 16 MB.
KEY_BITS, BITMAP = 16, 27


def may_hold(rows: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    """rows with `_may`, which is true for every row whose key is among keys, and for few others while these are fewer
    than the bits of the bitmap. So the other rows needn't be shuffled to keys.

    keys must be written, as it is read on its own. The bitmap has 2^`BITMAP` bits at most, so that it may be broadcast."""
    bits = min(BITMAP, (KEY_BITS * keys.count()).bit_length())
    slot = F.xxhash64(*names, F.lit(11)).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    held = keys.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    at = rows.withColumn("_slot", slot).withColumn("_bucket", F.bitmap_bucket_number("_slot")).withColumn("_slot", F.bitmap_bit_position("_slot"))
    met = at.join(F.broadcast(held), "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_slot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.select(*rows.columns, F.coalesce(F.getbit(byte, (F.col("_slot") % 8).cast("int")) == 1, F.lit(False)).alias("_may"))


__all__ = ["SPACES", "SPACES_RE", "lean", "least_ids", "may_hold", "n_words", "one_each", "shared_dir", "table", "tie", "union", "words", "written"]
