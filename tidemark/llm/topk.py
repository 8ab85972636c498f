"""Exact top-k by inner product over an M-tree that Spark holds in shards.

Vectors are quantised to integers. The upper part of the tree is a tree of routing objects, fitted to a bounded
sample: each row goes down to the nearest object of each level, and the rows of one cell are a shard, cut by hash
where it has more than `SHARD_ROWS` rows or `SHARD_BYTES`. What all this yields is exact whatever the sample was.

Each shard is an M-tree of its own, stored as a row. A coordinate sqrt(M^2 - |x|^2) more, with M the shard's largest
norm, puts its vectors on a sphere, on which the largest inner product with a query is the least Euclidean distance.
A tree is paged: a leaf holds up to `PAGE` entries, each with its distance to the leaf's centre, an inner node up
to `PAGE` children, each with its centre, covering radius and distance to the parent's centre. A search is best
first: it opens the node of the least possible distance, drops children and entries by the triangle inequality on
the stored distances before it computes any of theirs, and stops when no open node can hold a better entry.
Bounds are loosened by more than their rounding error, and scores are integer products, so results are exact.

A shard's centre c and covering radius r bound what a query q can score in it: q.c + r|q|. Queries first search the
`FIRST` shards of the highest bounds, and then, with the k-th score so far, only those whose bound isn't below it. Blocks
of queries meet blocks of bounds and, at the shards that remain, trees: all are bounded, and a tree goes only to
blocks that ask for it. The k best over all shards are then ranked by Spark.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do those with a
component that isn't a long once quantised; queries meet only vectors of their own length; rows are told apart as
rows: each row that is a query has its own result, and all other rows are its candidates, also those that repeat its
vec_id or vector; a row without vec_id comes last among ties; scores beyond a long are given as the nearest
long; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, written
from .sampling import sampled

K = 5
PAGE = 64
SHARD_ROWS, SHARD_BYTES = 16384, 32 << 20
BLOCK_QUERIES, BLOCK_SHARDS = 4096, 1024
SCALE = 256
#: Shards that a query searches before the others are held against its k-th score.
FIRST = 2
#: Rows and bytes of the sample that routing objects come from, and how many objects a level has.
SAMPLE, SAMPLE_BYTES, FAN = 16384, 64 << 20, 16
#: Levels after which what is left becomes one leaf, however large.
DEEPEST = 64
#: Products whose bound is below this are exact in 64 bits.
EXACT = float(1 << 62)
SHARD = ["dim", "cell", "part"]


def quantised(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, `dim` and `v`, the integers floor(scale * x), for the rows that take part."""
    good = F.forall(F.col(vector), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < float(1 << 63)))
    usable = vectors.filter((F.size(vector) > 0) & F.coalesce(good, F.lit(False)))
    v = F.transform(F.col(vector), lambda e: F.floor(e.cast("double") * scale))
    return usable.select(F.col("vec_id").cast("long"), F.size(vector).alias("dim"), v.cast("array<long>").alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Squared distances up to a term of x alone."""
    return (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)


class Router:
    """Routing objects in levels; a row's cell is where it ends."""

    def __init__(self, sample: np.ndarray, most: float):
        self.cells = 0
        self.root = self._build(sample, most, 0)

    def _build(self, x: np.ndarray, most: float, depth: int):
        if len(x) <= most or depth >= 16 or (x == x[0]).all():
            self.cells += 1
            return self.cells - 1
        r = np.random.default_rng([depth, len(x)])
        fan = int(min(FAN, max(2, -(-len(x) // max(1, most)))))
        pivots = x[r.choice(len(x), fan, replace=False)]
        for _ in range(3):
            nearest = _apart(x, pivots).argmin(axis=1)
            pivots = np.array([x[nearest == k].mean(axis=0) for k in range(len(pivots)) if (nearest == k).any()])
        # the objects are vectors of the sample: those nearest to the means
        pivots = np.unique(x[((x**2).sum(axis=1)[:, None] + _apart(x, pivots)).argmin(axis=0)], axis=0)
        nearest = _apart(x, pivots).argmin(axis=1)
        if len(pivots) < 2 or (nearest == nearest[0]).all():
            self.cells += 1
            return self.cells - 1
        return pivots, [self._build(x[nearest == k], most, depth + 1) for k in range(len(pivots))]

    def place(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)

        def down(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
                return
            nearest = _apart(x[rows], node[0]).argmin(axis=1)
            for k, child in enumerate(node[1]):
                if len(some := rows[nearest == k]):
                    down(child, some)

        down(self.root, np.arange(len(x)))
        return out


class MTree:
    """Nodes in arrays: a node's entries are children[node]: rows of the leaf or numbers of its nodes."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, rows: np.ndarray | None = None, unnamed: np.ndarray | None = None):
        self.ids, self.v = ids, v
        self.rows = np.arange(len(ids)) if rows is None else rows
        self.unnamed = np.zeros(len(ids), bool) if unnamed is None else unnamed
        self._lift()
        self.members: list[np.ndarray] = []
        self.leaf: list[bool] = []
        self.middle: list[int] = []  # the row that is a node's centre
        self.radius: list[float] = []
        self.far: list[np.ndarray] = []  # distances of a node's members to its centre
        self.root = self._build(np.arange(len(ids)))
        self.centre = self.points[self.middle]

    def _lift(self) -> None:
        plain = self.v.astype(float)
        norms = (plain**2).sum(axis=1)
        self.top = float(norms.max())
        self.points = np.column_stack([plain, np.sqrt(np.maximum(self.top - norms, 0))])

    def _build(self, rows: np.ndarray, depth: int = 0) -> int:
        """Routing objects by farthest-first choice; members go to the nearest. All are members, so radii are exact."""
        points = self.points
        middle = int(rows[np.argmin(((points[rows] - points[rows].mean(axis=0)) ** 2).sum(axis=1))])
        far = np.sqrt(((points[rows] - points[middle]) ** 2).sum(axis=1))
        if len(rows) <= PAGE or not far.max() or depth >= DEEPEST:
            order = np.argsort(far, kind="stable")
            return self._node(rows[order], True, middle, far[order])
        fan = min(PAGE, -(-len(rows) // PAGE), 16)
        chosen, near = [int(np.argmax(far))], None
        distances = []
        for _ in range(fan):
            d = ((points[rows] - points[rows[chosen[-1]]]) ** 2).sum(axis=1)
            distances.append(d)
            near = d if near is None else np.minimum(near, d)
            if len(distances) < fan:
                if not near.max():
                    break
                chosen.append(int(np.argmax(near)))
        nearest = np.argmin(np.array(distances), axis=0)
        parts = [rows[nearest == k] for k in range(len(distances))]
        children = [self._build(p, depth + 1) for p in parts if len(p)]
        gaps = np.array([np.sqrt(((points[self.middle[c]] - points[middle]) ** 2).sum()) for c in children])
        return self._node(np.array(children), False, middle, gaps, float(far.max()))

    def _node(self, members, leaf, middle, far, radius=None) -> int:
        self.members.append(members), self.leaf.append(leaf), self.middle.append(middle), self.far.append(far)
        self.radius.append(float(far.max()) if radius is None else radius)
        return len(self.members) - 1

    def ball(self) -> tuple[np.ndarray, float]:
        """A centre and the radius around it that covers all vectors, without the added coordinate."""
        plain = self.points[:, :-1]
        centre = plain.mean(axis=0)
        return centre, float(np.sqrt(((plain - centre) ** 2).sum(axis=1).max()))

    def best(self, q: np.ndarray, k: int = K, own: int = -1, least: int | None = None) -> list[tuple[int, int, int | None]]:
        """The k (score, row, vec_id) of most score, ties to the smaller vec_id, without the row `own`; stops when
        what is open must be worse, or has less than the score `least`."""
        plain = q.astype(float)
        point, own_norm = np.append(plain, 0.0), float(plain @ plain)
        whole = own_norm + self.top
        slack = 1e-6 * (whole + 1) ** 0.5  # squares lose up to 1e-14 of `whole`, distances near zero the root of that
        wide = q.astype(np.int64) if own_norm**0.5 * self.top**0.5 < EXACT else q.astype(object)
        top: list[tuple] = []  # a heap of (score, whether it has a vec_id, -vec_id, row)
        reach = np.inf if least is None else max(0.0, whole - 2.0 * least) ** 0.5  # the distance of the k-th best so far
        to_root = float(np.sqrt(((point - self.centre[self.root]) ** 2).sum()))
        open_ = [(max(0.0, to_root - self.radius[self.root]), self.root, to_root)]
        while open_:
            nearest, node, d = heapq.heappop(open_)
            if nearest > reach + slack:
                break
            members, far = self.members[node], self.far[node]
            if self.leaf[node]:
                members = members[np.abs(d - far) <= reach + slack]
                members = members[self.rows[members] != own]
                if not len(members):
                    continue
                scores = self.v[members] @ wide
                if len(top) == k:
                    some = scores >= top[0][0]
                    members, scores = members[some], scores[some]
                if len(members) > k:  # only the best of the leaf can matter
                    order = np.lexsort((self.ids[members], self.unnamed[members], -scores))[:k]
                    members, scores = members[order], scores[order]
                for m, s in zip(members.tolist(), scores.tolist(), strict=True):
                    entry = (s, not self.unnamed[m], -int(self.ids[m]), int(self.rows[m]))
                    if len(top) < k:
                        heapq.heappush(top, entry)
                    elif entry > top[0]:
                        heapq.heapreplace(top, entry)
                if len(top) == k:
                    reach = min(reach, max(0.0, whole - 2.0 * top[0][0]) ** 0.5)
            else:
                radii = self.radius[members]
                some = np.flatnonzero(np.abs(d - far) - radii <= reach + slack)
                if len(some):
                    gaps = np.sqrt(((self.centre[members[some]] - point) ** 2).sum(axis=1))
                    for c, gap, r in zip(members[some].tolist(), gaps.tolist(), radii[some].tolist(), strict=True):
                        bound = max(0.0, gap - r)
                        if bound <= reach + slack:
                            heapq.heappush(open_, (bound, c, gap))
        return [(s, row, -i if named else None) for s, named, i, row in sorted(top, reverse=True)]

    def stored(self) -> bytes:
        """The pages of the tree: its vectors and, node by node, members, centre, radius and distances."""
        out = io.BytesIO()
        sizes = np.array([len(m) for m in self.members])
        v = self.v.astype(np.int32) if np.abs(self.v).max() < 1 << 31 else self.v
        np.savez(out, ids=self.ids, v=v, rows=self.rows, unnamed=self.unnamed, members=np.concatenate(self.members), far=np.concatenate(self.far), sizes=sizes, leaf=np.array(self.leaf), middle=np.array(self.middle), radius=np.array(self.radius), root=self.root)
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> MTree:
        with np.load(io.BytesIO(data)) as x:
            tree = cls.__new__(cls)
            cuts = np.cumsum(x["sizes"])[:-1]
            tree.ids, tree.v, tree.rows, tree.unnamed, tree.root = x["ids"], x["v"].astype(np.int64), x["rows"], x["unnamed"], int(x["root"])
            tree.members, tree.far = np.split(x["members"], cuts), np.split(x["far"], cuts)
            tree.leaf, tree.radius = x["leaf"].tolist(), x["radius"]
            tree._lift()
            tree.centre = tree.points[x["middle"]]
            del tree.points
        return tree


def _rows_of_shard(dim: int, most: int) -> int:
    return max(PAGE, min(most, SHARD_BYTES // (8 * dim)))


def placed(data: DataFrame, n: int, shard_rows: int) -> DataFrame:
    """data with the number of the `cell` that its vector is routed to, and of its `row`."""
    some = sampled(data, ["vec_id", "v"], n, SAMPLE).toArrow()
    routers: dict[int, Router] = {}
    dims = some.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = some.filter(pa.compute.equal(some.column("dim"), dim)).slice(0, SAMPLE_BYTES // (8 * dim) + 1)
        # a cell of so many sampled rows is expected to have less than a shard's
        most = 0.75 * _rows_of_shard(dim, shard_rows) * part.num_rows / max(1.0, n * (dims == dim).mean())
        routers[dim] = Router(_matrix(part.column("v"), part.num_rows).astype(float), max(1.0, most))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            cells, dim = np.zeros(batch.num_rows, np.int64), batch.column("dim").to_numpy()
            for d in np.unique(dim).tolist():
                if d in routers:
                    at = np.flatnonzero(dim == d)
                    cells[at] = routers[d].place(_matrix(batch.column("v").take(pa.array(at)), len(at)).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    found = data.mapInArrow(route, "vec_id long, dim int, v array<long>, cell long")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "vectors")


def trees(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A row for each shard with its tree, centre and covering radius."""

    def build(key, table):
        ids = table.column("vec_id").combine_chunks()
        tree = MTree(ids.fill_null(0).to_numpy(), _matrix(table.column("v"), len(ids)), table.column("row").to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        centre, radius = tree.ball()
        return pa.table({"dim": [key[0].as_py()], "cell": [key[1].as_py()], "part": [key[2].as_py()], "tree": [tree.stored()], "centre": [centre.tolist()], "radius": [radius]}, schema=pa.schema([("dim", pa.int32()), ("cell", pa.int64()), ("part", pa.int32()), ("tree", pa.binary()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    most = F.greatest(F.lit(PAGE), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    cells = written(rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / most).cast("long").alias("parts")), "cells")
    dealt = rows.join(cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    return dealt.groupBy(*SHARD).applyInArrow(build, "dim int, cell long, part int, tree binary, centre array<double>, radius double")


def _bounded(queries: DataFrame, built: DataFrame, first: int | None, block_queries: int) -> DataFrame:
    """Each query with shards: the `first` ones of the highest bounds, or all whose bound isn't below `least`."""
    shards, n_queries = built.count(), queries.count()
    wide, many = max(1, -(-n_queries // block_queries)), max(1, -(-shards // BLOCK_SHARDS))
    asked = queries.withColumn("_q", F.pmod(F.xxhash64("row"), F.lit(wide)).cast("int")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    held = built.drop("tree").withColumn("_s", F.pmod(F.xxhash64("cell", "part"), F.lit(many)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    schema = pa.schema([("row", pa.int64()), ("dim", pa.int32()), ("cell", pa.int64()), ("part", pa.int32()), ("bound", pa.float64())])

    def meet(left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, c = _matrix(left.column("v"), left.num_rows).astype(float), _matrix(right.column("centre"), right.num_rows)
        radius, size = right.column("radius").to_numpy(), np.sqrt((q**2).sum(axis=1))[:, None]
        bounds = q @ c.T + radius * size + 1e-9 * (size * (np.sqrt((c**2).sum(axis=1)) + radius) + 1)
        if first is None:
            some = bounds >= left.column("least").to_pandas().fillna(-np.inf).to_numpy(float)[:, None]
        else:
            some = np.zeros(bounds.shape, bool)
            np.put_along_axis(some, np.argsort(-bounds, axis=1, kind="stable")[:, :first], True, axis=1)
        a, b = np.nonzero(some)
        return pa.table([left.column("row").take(pa.array(a)), right.column("dim").take(pa.array(b)), right.column("cell").take(pa.array(b)), right.column("part").take(pa.array(b)), pa.array(bounds[a, b])], schema=schema)

    met = asked.groupBy("dim", "_q", "_s").cogroup(held.groupBy("dim", "_q", "_s")).applyInArrow(meet, "row long, dim int, cell long, part int, bound double")
    if first is None:
        return met.drop("bound")
    order = Window.partitionBy("row").orderBy(F.desc("bound"), "cell", "part")
    return met.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first).drop("_n", "bound")


def _searched(queries: DataFrame, pairs: DataFrame, built: DataFrame, k: int, block_queries: int) -> DataFrame:
    """The k best of each query in each shard that it is paired with: q (the query's row), row, vec_id, score."""
    blocks = written(pairs.groupBy(*SHARD).agg(F.ceil(F.count("*") / block_queries).cast("long").alias("_blocks")), "shard-blocks")
    asked = pairs.join(queries.drop("dim"), "row").join(blocks, SHARD).withColumn("_b", F.pmod(F.xxhash64("row", F.lit(1)), F.col("_blocks")))
    held = built.select(*SHARD, "tree").join(blocks.toDF(*SHARD, "_n"), SHARD).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    schema = pa.schema([("q", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    low, high = -(1 << 63), (1 << 63) - 1

    def search(left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        tree, out = MTree.loaded(right.column("tree")[0].as_py()), []
        for q, least, v in zip(left.column("row").to_pylist(), left.column("least").to_pylist(), _matrix(left.column("v"), left.num_rows), strict=True):
            out += [(q, row, i, min(high, max(low, s))) for s, row, i in tree.best(v, k, q, least)]
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    return asked.groupBy(*SHARD, "_b").cogroup(held.groupBy(*SHARD, "_b")).applyInArrow(search, "q long, row long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score for the rows where is_query holds, against all other rows."""
    data = quantised(vectors, vector)
    rows = placed(data, data.count(), shard_rows)
    built = written(trees(rows, shard_rows), "trees")
    queries = rows.filter(is_query).select("row", "vec_id", "dim", "v")
    asked = queries.select("row", "dim", "v", F.lit(None).cast("long").alias("least"))
    first = written(_bounded(asked, built, FIRST, block_queries), "first-shards")
    found = written(_searched(asked, first, built, k, block_queries), "first-found")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    # a score that was clamped says nothing about others; those of one query that has fewer than k aren't a bound
    ranked = found.withColumn("_n", F.row_number().over(order)).filter((F.col("_n") == k) & (F.abs(F.col("score").cast("double")) < float(1 << 62)))
    known = queries.join(ranked.select(F.col("q").alias("row"), F.col("score").alias("least")), "row", "left").select("row", "dim", "v", "least")
    known = written(known, "queries")
    rest = written(_bounded(known, built, None, block_queries).join(first, ["row", *SHARD], "left_anti"), "other-shards")
    every = found.unionByName(_searched(known, rest, built, k, block_queries))
    best = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(queries.select(F.col("row").alias("q"), F.col("vec_id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")
