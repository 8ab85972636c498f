"""Bounded samples of labelled and other documents for the classifiers, and of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that no classifier learns from; a null doc_id is never among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(rows: DataFrame, key: list[str], n: int, most: int, seed: int = 7) -> DataFrame:
    """About `most` of n rows, at most twice as many: those whose hash of the key is below a threshold on a grid of 63
    bits, the least ones first. Equal keys have equal hashes."""
    h = F.xxhash64(*key, F.lit(seed)).bitwiseAND(F.lit((1 << 63) - 1))
    grid = (1 << 63) - 1
    below = min(grid, grid * most // max(1, n))
    return rows.withColumn("_h", h).filter(F.col("_h") <= below).orderBy("_h", *key).limit(2 * most).drop("_h")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None) -> DataFrame:
    """`text` and `y` of labelled documents, at most `most` doc_ids, those with the least hashes, and at most twice as
    many rows, the least texts first.

    A doc_id with several labels has the one that most of its rows give, of equally many the larger one. The sample is
    taken from the labels, which are narrow, and has at most `most` rows, so that it may be broadcast to the documents."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(-1)).alias("_s")).select("doc_id", (F.col("_s") >= 0).cast("int").alias(label))
    if where is not None:
        one = one.filter(where)
    some = one.select("doc_id", F.col(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return met.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "doc_id").limit(2 * most).select("text", "y")


def unlabelled(docs: DataFrame, most: int) -> DataFrame:
    """`text` of about `most` documents that may be learnt from, whatever their labels."""
    usable = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text")
    return sampled(usable, ["doc_id"], usable.select("doc_id").count(), most).select("text")
