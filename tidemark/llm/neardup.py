"""Near-duplicate documents by exact Jaccard similarity of their five-word shingles.

Candidates come from MinHash bands: of `BANDS` bands of `ROWS` minimal hashes each, two texts share a bucket where all
hashes of a band agree. Every link is confirmed on the whole shingle sets, never by its estimate. What can be missed is
a pair without a common bucket (at a similarity of 0.8, one in 1.6 million), or whose sketches, two bits of each of
`BITS` minima, differ in more than `APART` of them (154 are expected, with a deviation of 11.4).

A bucket's pairs aren't all listed: its members are compared with two of them first, and after that only members of
different components with each other, those of the bucket's largest component not among themselves. For that a bucket, cut
into shards if it is large, is a BK-tree of its members' sketches: the number of places in which two sketches differ is a
metric, and a search leaves out the branches that are too far from it. A pair is listed in the first bucket it shares.
Where many texts are like each other but not linked, the tree has little to leave out, and the comparisons grow with the
square of the group.

The trees aren't over fingerprints of 64 bits, as op1's are: similarity 0.8 is 7 to 8 bits there on average, and all bits of
at least one choice of bands agree for such a radius only if the bands are of a few bits. Hence buckets by minima and longer
sketches.

Defined cases: words are divided by ASCII white space and compared without ASCII case; a text of fewer than five words
is one shingle; null and blank texts are copies of each other; rows are told apart by doc_id, null or not, and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, least_ids, one_each, tie, written
from .simhash import _LOWER, BKTree, components
from .substrings import _Hashes, _word_hashes

SHINGLE = 5
BANDS, ROWS = 36, 5
BITS = 1024
APART = 217
#: Members of a BK-tree: larger buckets are cut into shards.
LARGEST = 4096
#: Members of a bucket with the least id after this exclusive or are compared with all others first.
_TURN = 0x2545F4914F6CDD1D
_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(0, 1 << 32, BITS, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BITS, dtype=np.uint32)
_POWERS = _RNG.integers(0, 1 << 64, max(SHINGLE, ROWS), dtype=np.uint64) | np.uint64(1)
_SALT = _RNG.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, known: _Hashes) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h, n = _word_hashes(words, known), max(1, len(words) - SHINGLE + 1)
    sums = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        sums += h[k : k + n] * _POWERS[k]
    return np.unique(_mixed(sums))


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the bits of its sketch."""
    low, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(BITS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 256):
        np.minimum(least, (low[k : k + 256, None] * _MUL + _ADD).min(axis=0), out=least)
    banded = (least[: BANDS * ROWS].astype(np.uint64) + np.uint64(1)).reshape(BANDS, ROWS)
    keys = _mixed((banded * _POWERS[:ROWS]).sum(axis=1, dtype=np.uint64) ^ _SALT)
    turned = least * np.uint32(0x9E3779B1)
    bits = [np.packbits(turned >> np.uint32(k) & np.uint32(1), bitorder="little").view("<i8") for k in (31, 30)]
    return keys.view(np.int64), np.concatenate(bits)


def code(bits: np.ndarray) -> int:
    """A sketch as bits of which two differ for each place whose two bits aren't the same: the tree's distance."""
    high, low = bits[: BITS // 64], bits[BITS // 64 :]
    return int.from_bytes(np.concatenate([high, low, high ^ low]).tobytes(), "little")


def _sketches(texts: DataFrame) -> DataFrame:
    """`node`, `n` shingles, `keys` of buckets and `bits`, for each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in lean(batches):
            rows = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                if len(hashes := shingles(text.as_py(), known)):
                    rows.append((node, len(hashes), *sketch(hashes)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["node", "n", "keys", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, keys array<long>, bits array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """`node` and its shingles' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in lean(batches):
            sets = [shingles(t.as_py(), known).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>")


def confirmed(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of distinct nodes whose texts have a similarity of 0.8 or more."""
    pairs = written(pairs.distinct(), "candidates")
    some = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidate-nodes")
    sets = written(_sets(texts.join(some, "node", "left_semi")), "shingle-sets")
    met = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "_a"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "_b"}), "b")
    # both / (all - both) >= 0.8, in whole numbers
    return met.filter(9 * F.size(F.array_intersect("_a", "_b")) >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b")


def searched(members: DataFrame, largest: int = LARGEST) -> DataFrame:
    """The pairs (a, b) of members of different parts of a bucket, one at least not of its `main` part, whose sketches differ in
    `APART` places or fewer and whose sizes allow a link: by a BK-tree in each shard of a bucket. A pair is listed in the first
    bucket that it shares. members: key, node, part, main, n, keys, bits."""
    c = F.col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, BKTree()
        for batch in lean(batches):
            out: list[tuple[int, int]] = []
            bits = batch.column("bits").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for k, (key, shard, asks, node, part, main, n, keys) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("key", "shard", "asks", "node", "part", "main", "n", "keys")), strict=True)):
                if (key, shard) != at:
                    at, tree = (key, shard), BKTree()
                if not asks:
                    tree.insert(code(bits[k]), (node, part, n, keys))
                    continue
                for other, its, size, its_keys in tree.within(code(bits[k]), 2 * APART):
                    if its != part and (its == main or other < node) and 5 * min(n, size) >= 4 * max(n, size) and next(x for x, y in zip(keys, its_keys, strict=True) if x == y) == key:
                        out.append((min(node, other), max(node, other)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    sizes = written(members.groupBy("key").agg(F.ceil(F.count("*") / largest).alias("_shards")), "bucket-shards")
    m = members.join(sizes, "key")
    held = m.withColumn("shard", F.pmod(F.xxhash64("node"), "_shards")).withColumn("asks", F.lit(False))
    asking = m.filter("part <> main").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), c("_shards") - 1))).withColumn("asks", F.lit(True))
    # a shard's tree comes before those that search it
    rows = held.unionByName(asking).drop("_shards").repartition("key", "shard").sortWithinPartitions("key", "shard", "asks", "node")
    return rows.mapInArrow(run, "a long, b long")


def links(texts: DataFrame) -> DataFrame:
    """`node`, `root` of every text that is linked to another. texts: `node` and `text`, each text once."""
    c = F.col
    sketches = written(_sketches(texts), "sketches")
    rows = sketches.select(F.explode("keys").alias("key"), "node")
    turned = F.min(c("node").bitwiseXOR(F.lit(_TURN)))
    heads = written(rows.groupBy("key").agg(F.count("*").alias("_n"), F.min("node").alias("h0"), turned.alias("_t")).filter("_n > 1").select("key", "h0", c("_t").bitwiseXOR(F.lit(_TURN)).alias("h1")), "buckets")
    kept = written(rows.join(heads, "key"), "bucket-members")
    pairs = kept.select("node", F.explode(F.array_distinct(F.array("h0", "h1"))).alias("h")).filter("node <> h")
    first = written(confirmed(texts, pairs.select(F.least("node", "h").alias("a"), F.greatest("node", "h").alias("b"))), "links")

    placed = written(kept.join(components(first), "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"), "placed")
    parts = written(placed.groupBy("key", "part").agg(F.count("*").alias("_n")), "bucket-parts")
    mixed = parts.groupBy("key").agg(F.count("*").alias("_k"), F.max(F.struct("_n", "part")).alias("_m")).filter("_k > 1")
    mixed = written(mixed.select("key", c("_m.part").alias("main")), "mixed-buckets")
    open_ = written(placed.join(mixed, "key").filter("node <> h0 and node <> h1").select("key", "node", "part", "main"), "open-members")
    wide = written(open_.join(sketches, "node"), "open-sketches")
    rest = confirmed(texts, searched(wide))
    return components(first.unionByName(written(rest, "links")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component of near-duplicates, with the columns of docs."""
    c = F.col
    rows = docs.select(c("doc_id").cast("long").alias("_id"), tie(c("text")).alias("_tie"))
    texts = docs.select(tie(c("text")).alias("_tie"), "text").dropDuplicates(["_tie"]).withColumn("node", F.monotonically_increasing_id())
    texts = written(texts, "texts")
    nodes = texts.select("_tie", "node").join(links(texts), "node", "left").select("_tie", F.coalesce("root", "node").alias("root"))
    nodes = written(nodes, "roots")
    return one_each(docs, written(least_ids(rows), "least-ids").join(nodes, "_tie"))
