"""Hard negatives for contrastive training: for each anchor and each of its positives, the best rows of other labels
whose score lies just below the positive's.

All rows are dealt to blocks of at most about `BLOCK_ROWS` vectors, anchors to blocks of about `BLOCK_ANCHORS`, and each
block of anchors meets each block of rows in one task of fixed size. There, for each anchor, the block's integer scores
are computed in one matrix product and sorted as a whole, by score and then id (lexsort). A first pass reads each anchor's
positives off these sorts; a second looks up each positive's upper limit in them by binary search and reads on over
rows of other labels down to the lower limit. What each block yields is at most `k` rows for an anchor and positive,
of which a window over all blocks keeps the first `k`: the sort of all scores, as runs that are merged. Every row is
scored for every anchor, and no label, cell or source has a task of its own, so that a hot label costs what others do.

Scores are exact: in floating point where all sums stay below 2^53, in 64 bits below 2^62, as whole numbers of any size beyond.

Defined cases: rows with a null label, with a null or empty vector, or with a component that is null, not finite or
not a long once quantised take no part; vectors meet only those of their own length; rows are told apart as rows, so
an anchor that is there twice is mined twice and each is the other's possible positive; a row without vec_id comes last among
ties and is nobody's anchor unless `is_anchor` says so; scores beyond a long are taken as the nearest long; an anchor
without positives, or a positive without negatives in its range (all of negative score), gives no row; an empty table
gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K, POSITIVES = 5, 5
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 80, 100
SCALE = 256
BLOCK_ROWS, BLOCK_BYTES, BLOCK_ANCHORS = 8192, 16 << 20, 2048
#: Scores that are held at once.
AT_ONCE = 1 << 21
MOST = (1 << 63) - 1
_CELL = ["dim", "_a", "_d"]
_PAIR = pa.schema([("row", pa.int64()), ("other", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_MINED = pa.schema([("row", pa.int64()), ("positive", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64()), ("other", pa.int64())])


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; beyond a long, the nearest one that has a negative."""
    norms = [float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max(initial=0))) for x in (a, b)]
    if norms[0] * norms[1] < 1 << 52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if norms[0] * norms[1] < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


class Sorted:
    """One anchor's scores in a block, highest first, ties to the smaller vec_id, those without one last."""

    def __init__(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, labels: np.ndarray, own: int):
        self.order = np.lexsort((ids, unnamed, -scores))
        self.down = -scores[self.order]
        same = labels[self.order] == own
        self.same, self.others = np.flatnonzero(same), np.flatnonzero(~same)

    def like(self, k: int) -> np.ndarray:
        """The block's rows of the anchor's label, the first k."""
        return self.order[self.same[:k]]

    def below(self, positive: int, k: int, low: int, high: int) -> np.ndarray:
        """The first k rows of other labels with low * positive <= 100 * score <= high * positive."""
        upper, lower = min(MOST, high * positive // 100), -(-low * positive // 100)
        if lower > upper:
            return self.order[:0]
        start = np.searchsorted(self.down, -upper, "left")
        stop = np.searchsorted(self.down, -lower, "right")
        first, last = np.searchsorted(self.others, (start, stop))
        return self.order[self.others[first : min(last, first + k)]]


def _pack(key, table):
    """A block as one row that holds its table."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "others": pa.array([key[2].as_py()], pa.int32()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpack(column) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in column]).combine_chunks()


def _vectors(table: pa.Table, rows: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _blocks(rows: DataFrame, number: str, others: str, name: str) -> DataFrame:
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(3)), F.col(number)).cast("int")).withColumn("others", F.col(others))
    return written(dealt.drop("n_rows", "n_anchors").groupBy("dim", "block", "others").applyInArrow(_pack, "dim int, block int, others int, data binary"), name)


def _met(anchors: DataFrame, rows: DataFrame, each, schema: str, names: pa.Schema) -> DataFrame:
    """Each block of anchors with each block of rows, a pair to a task: `each(anchor's table row, its Sorted, the block)`."""

    def meet(left, right):
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        asked, held = _unpack(left.column("data")), _unpack(right.column("data"))
        a, b = _vectors(asked, asked.num_rows), _vectors(held, held.num_rows)
        ids = held.column("vec_id").combine_chunks()
        unnamed, labels = ids.is_null().to_numpy(zero_copy_only=False), held.column("label").to_numpy()
        numbers = ids.fill_null(0).to_numpy()
        own = asked.drop_columns(["v"]).to_pylist()
        out, step = [], max(1, AT_ONCE // held.num_rows)
        for at in range(0, len(a), step):
            for anchor, scores in zip(own[at : at + step], inner_products(a[at : at + step], b), strict=True):
                out += each(anchor, Sorted(scores, numbers, unnamed, labels, anchor["label"]), scores, held)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), names.types, strict=True)], schema=names) if out else names.empty_table()

    spread = lambda blocks, own, other: blocks.withColumnRenamed("block", own).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    return spread(anchors, "_a", "_d").groupBy(*_CELL).cogroup(spread(rows, "_d", "_a").groupBy(*_CELL)).applyInArrow(meet, schema)


def usable(vectors: DataFrame, is_anchor: Column, label: str, vector: str, scale: int) -> DataFrame:
    """row, vec_id, dim, label, v and is_anchor of the rows that take part."""
    good = F.forall(F.col(vector), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < float(1 << 63)))
    some = vectors.filter(F.col(label).isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False)))
    v = F.transform(F.col(vector), lambda e: F.floor(e.cast("double") * scale)).cast("array<long>")
    return written(some.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.size(vector).alias("dim"), F.col(label).cast("long").alias("label"), v.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")), "mined-vectors")


def hard_negatives(vectors: DataFrame, is_anchor: Column, k: int = K, positives: int = POSITIVES, low: int = LOW, high: int = HIGH, label: str = "label", vector: str = "embedding", scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and `positive`, the positive's place from 1."""
    rows = usable(vectors, is_anchor, label, vector, scale)
    most = F.least(F.lit(block_rows), F.ceil(F.lit(BLOCK_BYTES) / (8 * F.col("dim"))))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / most).cast("int").alias("n_rows"), F.ceil(F.count_if("is_anchor") / block_anchors).cast("int").alias("n_anchors"))
    rows = rows.join(written(sizes.filter("n_anchors > 0"), "block-counts"), "dim")
    anchors = rows.filter("is_anchor").drop("is_anchor")
    held = _blocks(rows.drop("is_anchor"), "n_rows", "n_anchors", "row-blocks")

    def find(anchor: dict, runs: Sorted, scores: np.ndarray, held: pa.Table) -> list[tuple]:
        own, others, ids = anchor["row"], held.column("row"), held.column("vec_id")
        found = [(own, others[i].as_py(), ids[i].as_py(), int(scores[i])) for i in runs.like(positives + 1).tolist()]
        return [f for f in found if f[1] != own][:positives]

    asked = _blocks(anchors, "n_anchors", "n_rows", "anchor-blocks")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "other")
    liked = _met(asked, held, find, "row long, other long, vec_id long, score long", _PAIR)
    liked = liked.withColumn("positive", F.row_number().over(order)).filter(F.col("positive") <= positives)
    # at most `positives` of an anchor
    gathered = written(liked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("positive", "vec_id", "score"))).alias("likes")), "positives")

    def mine(anchor: dict, runs: Sorted, scores: np.ndarray, held: pa.Table) -> list[tuple]:
        others, ids = held.column("row"), held.column("vec_id")
        return [
            (anchor["row"], p["positive"], anchor["vec_id"], p["vec_id"], ids[i].as_py(), p["score"], int(scores[i]), others[i].as_py())
            for p in anchor["likes"]
            for i in runs.below(p["score"], k, low, high).tolist()
        ]

    liked = _blocks(anchors.join(gathered, "row"), "n_anchors", "n_rows", "liked-blocks")
    mined = _met(liked, held, mine, "row long, positive int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long, other long", _MINED)
    order = Window.partitionBy("row", "positive").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "other")
    best = mined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive")
