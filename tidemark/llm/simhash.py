"""SimHash near-duplicates by BK-trees over shards.

Fingerprints within `radius` bits of each other agree on all bits of at least `BANDS - radius` of `BANDS` bands, so
every link lies within a shard: the fingerprints that share the bits of one choice of bands. A shard's BK-tree
keeps its children by their integer distance to the parent, and a search follows only edges within the radius of
the searched distance. Spark's shuffle brings a shard's fingerprints to one task, where they are searched in and
then inserted into the tree: broadcasting the trees would take the fingerprints of all documents through the driver.
A shard emits each fingerprint with the least one that it reaches there, never its
pairs. A shard of more than `LARGEST` fingerprints isn't built but split by bands of its remaining bits, at most
twice; what then remains can't hold more than two to the power of the bits that no band has fixed, which after two
splits are 14 of 64, so at most 16,384 fingerprints.

Equal fingerprints are merged before, so that copies cost one row. The components of the links are found by
alternating star contraction on the distinct fingerprints.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a text of fewer than three
words is one shingle; repeated rows each get their row; a null doc_id is fingerprinted and linked but never the
smallest doc_id, unless its component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, least_ids, one_each, tie, union, written

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
BANDS = 5
LARGEST = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    tokens = (text or "").encode().translate(_LOWER).split()
    if not tokens:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(tokens) - SHINGLE + 1
    if n <= 1:
        return int(np.uint64(digest(b" ".join(tokens), SEED)).astype(np.int64))
    joined, ends = b" ".join(tokens), np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *(ends[: n - 1].tolist())]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and `fp`, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            fps = [fingerprint(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Nodes of a metric tree under Hamming distance; a node's children are keyed by their distance to it."""

    def __init__(self):
        self.root = None

    def insert(self, fp: int, value) -> None:
        if self.root is None:
            self.root = (fp, value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ fp).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (fp, value, {})
                return
            node = child

    def within(self, fp: int, radius: int) -> Iterator:
        """The values of the nodes within the radius."""
        open_ = [self.root] if self.root else []
        while open_:
            node = open_.pop()
            d = (node[0] ^ fp).bit_count()
            if d <= radius:
                yield node[1]
            children = node[2]
            if children:
                if len(children) <= 2 * radius + 1:
                    open_ += [c for e, c in children.items() if d - radius <= e <= d + radius]
                else:
                    open_ += [children[e] for e in range(d - radius, d + radius + 1) if e in children]


def star(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Each distinct fingerprint of a shard that isn't the least of its component there, with that least one."""
    if len(fps) < 2:
        return []
    parent = list(range(len(fps)))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    tree, mask = BKTree(), (1 << BITS) - 1
    for k, fp in enumerate(fps):
        for j in tree.within(fp & mask, radius):
            a, b = top(j), top(k)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.insert(fp & mask, k)
    return [(fps[k], fps[top(k)]) for k in range(len(fps)) if top(k) != k]  # fps are in order, so the first is the least


def band_masks(free: list[int], radius: int = RADIUS, bands: int = BANDS) -> list[int]:
    """Masks of the choices of bands of the free bits of which a pair within the radius shares one at least."""
    cut = [free[len(free) * k // bands : len(free) * (k + 1) // bands] for k in range(bands)]
    return [sum(1 << b for band in chosen for b in band) for chosen in combinations(cut, bands - radius)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame, radius: int = RADIUS, largest: int = LARGEST) -> DataFrame:
    """`a`, `b`: distinct fingerprints and a lesser one that they reach; linked together they give the components.
    fps: distinct values in column `fp`."""
    if not 0 <= radius < BANDS - 1:
        raise ValueError(f"the radius must be below {BANDS - 1}")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        at = None
        out: list[tuple[int, int]] = []
        for batch in lean(batches):
            for mask, key, fp in zip(*(batch.column(c).to_pylist() for c in ("mask", "key", "fp")), strict=True):
                if (mask, key) != at:
                    out += star(held, radius)
                    held, at = [], (mask, key)
                held.append(fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        if out := star(held, radius):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    # the masks of each level, by those they refine
    level = {0: band_masks(list(range(BITS)), radius)}
    rows, found = fps.select("fp", F.lit(0).cast("long").alias("mask")), []
    for last in (False, False, True):
        choices = F.coalesce(*(F.when(F.col("mask") == F.lit(_signed(old)), F.array(*(F.lit(_signed(m)) for m in new))) for old, new in level.items())) if len(level) <= 10 else None
        if choices is None:
            pairs = [(_signed(old), [_signed(m) for m in new]) for old, new in level.items()]
            finer = fps.sparkSession.createDataFrame(pairs, "mask long, _finer array<long>")
            rows = rows.join(F.broadcast(finer), "mask").select("fp", F.explode("_finer").alias("mask"))  # at most a hundred rows
        else:
            rows = rows.select("fp", F.explode(choices).alias("mask"))
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        build = keyed
        if not last:
            # counted by an aggregation, so that no task holds all of a large shard
            large = written(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > largest).select("mask", "key"), "large-shards")
            some = not large.isEmpty()
            build = keyed.join(large, ["mask", "key"], "left_anti") if some else keyed
        found.append(build.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").select("mask", "key", "fp").mapInArrow(linked, "a long, b long"))
        if last or not some:
            break
        rows = keyed.join(large, ["mask", "key"], "left_semi").select("fp", "mask")
        level = {m: [m | f for f in band_masks([b for b in range(BITS) if not m >> b & 1], radius)] for new in level.values() for m in new}
    return union(found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root`: for every node of the edges (a, b) the least one it reaches.

    Large and small stars by turns: each node's larger neighbours, then its lesser ones, are linked to the least
    neighbour, until nothing changes. Each round's edges are written, so that no round computes an earlier one
    again, and so are the least neighbours: a join whose one side comes straight from an aggregation on its key can't be
    split where a node has very many neighbours."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = written(small, "edges")
        now = mark(edges)
        if now == seen:
            roots = edges.select("b").distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
        seen = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), for each document."""
    c = F.col
    fps = written(fingerprints(docs), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    # written tables, so that a component or a fingerprint of very many rows can be split where it is joined
    found = components(links(classes.select("fp"), radius))
    linked = written(found.join(classes.withColumnRenamed("fp", "node"), "node"), "linked")
    least = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = written(linked.join(least, "root").select(c("node").alias("fp"), "component_id"), "named")
    # most fingerprints have no link, and their copies are all they reach
    met = fps.join(classes, "fp").join(named, "fp", "left")
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "least").alias("component_id"))


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with the columns of docs: that with the smallest doc_id, a null one last, and
    of rows that share it one with the least hash of its text. Rows are told apart by doc_id and text, so that one
    doc_id may stay for several components."""
    c = F.col
    rows = docs.select(c("doc_id").cast("long").alias("_id"), tie(c("text")).alias("_tie"))
    # each text once; as doc_id goes a number of the text, so that the component's name is a text of its own
    texts = docs.select(tie(c("text")).alias("_tie"), "text").dropDuplicates(["_tie"]).withColumn("doc_id", F.monotonically_increasing_id())
    texts = written(texts, "texts")
    roots = near_duplicates(texts.select("doc_id", "text"), radius).select("doc_id", c("component_id").alias("root"))
    roots = written(texts.select("_tie", "doc_id").join(roots, "doc_id").select("_tie", "root"), "roots")
    return one_each(docs, written(least_ids(rows), "least-ids").join(roots, "_tie"))
