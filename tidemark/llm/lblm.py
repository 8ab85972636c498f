"""Log-probabilities of texts by a log-bilinear neural model.

Counts of all words of the training documents are a Spark aggregation over the whole corpus and grow with it. The model
predicts units: the `HEAD` most frequent words have one each, the end of a text too, and all other words, seen or not,
share one for each of about `TAILS` most frequent endings of `ENDING` bytes, or the last one. A word's probability is that of
its unit after the `ORDER` units before it, times, within a shared unit, its share of the words seen there, plus one:
(c+1) / (N_u + V_u + 1). So the words of a unit and one unseen one have a sum of 1, whatever the size of the vocabulary.

The context vector is the sum of the vectors of the previous units, each weighted by its distance component by component.
Units are dealt to about as many classes as a class has units, and both the class and the unit within it are predicted
log-bilinearly: the score is the context's product with an output vector plus a bias. So a probability is exactly normalised
over all units by two small products, batched as matrices, instead of one over the whole vocabulary. Weights are learnt
by noise-contrastive estimation: true classes are told from noise classes and true units from noise units of their class,
both drawn by frequency. Every training document is learnt from once: in each of `ROUNDS` rounds each task goes through its
documents of that round from the shared weights, and the weights of all tasks are averaged, by the number of their tokens,
in a Spark aggregation.

The counts of at most `KNOWN` of the most frequent words go along with the model, whose size is bounded by these parameters. Any other word
meets its count in a join: a text's distinct rare words with their multiplicities go to the counts and only what
they add comes back, so no task and not the driver holds the vocabulary.

Defined cases: a null or empty text is the end alone; a null doc_id is not held out; repeated rows each get their row; texts are
scored whole; with no training document every word is unseen and N = V = 0; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, written

#: Words with a unit of their own, endings with a shared one, bytes of an ending, words whose counts go with the model.
HEAD, TAILS, ENDING, KNOWN = 1279, 255, 3, 65536
#: Units of context, components of a vector, noise classes of a batch, noise units of a position, positions of a batch, rounds,
#: and the descent's rate.
ORDER, DIM, CLASSES, NOISE, BATCH, ROUNDS, RATE = 3, 16, 64, 2, 4096, 4, 0.15
#: Distinct words that a task counts before it sends them; positions that are learnt from or scored at once.
DISTINCT, POSITIONS, ROWS = 1 << 18, 1 << 16, 1 << 15
END = b""  # no word is empty
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def held_out(doc_id: Column) -> Column:
    """True for the seventh of the documents that isn't learnt from; a null doc_id is never among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def word_counts(docs: DataFrame) -> DataFrame:
    """`word` (bytes) and `c` over all texts, one end for each."""

    def sent(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], names=["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for batch in lean(batches):
            for text in batch.column("text"):
                c.update(words(text.as_py()))
                if len(c) > DISTINCT:
                    yield sent(c)
                    c = Counter()
            c[END] += batch.num_rows
        if c:
            yield sent(c)

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The bounded part of the counts. Ranks are those of the `KNOWN` words, the end is unit 0."""

    rank: dict[bytes, int]
    count: np.ndarray  # of each rank
    unit: np.ndarray  # of each rank
    ending: dict[bytes, int]
    units: int
    total: int  # N
    distinct: int  # V
    share: np.ndarray  # of each unit: log10(N_u + V_u + 1) if shared, else 0
    frequency: np.ndarray  # of each unit, all above zero, with a sum of 1

    @property
    def shared(self) -> np.ndarray:
        return self.share > 0

    def unit_of(self, word: bytes) -> int:
        return self.ending.get(word[-ENDING:], self.units - 1)

    def encoded(self, text: bytes | None) -> tuple[np.ndarray, int, float, float, Counter]:
        """Units of the text's words and end; known tokens among those with a rank, the sum of their log10(c+1), the part
        of it in shared units; and the other words."""
        w = [*words(text), END]
        ranks = np.fromiter(map(self.rank.get, w, repeat(-1)), np.int64, len(w))
        units, seen = self.unit[ranks].astype(np.uint16), ranks >= 0
        rare = np.flatnonzero(~seen).tolist()
        units[rare] = [self.unit_of(w[i]) for i in rare]
        logs = np.log10(self.count[ranks[seen]] + 1.0)
        return units, int((logs > 0).sum()), float(logs.sum()), float(logs[self.shared[units[seen]]].sum()), Counter(w[i] for i in rare)


def most_frequent(counts: DataFrame, c: str, most: int) -> list:
    """At most `most` rows, those of the highest counts: all above a threshold on a grid of a 16th of an octave, which comes
    from a histogram, so that no more than these go to the driver. Highest first."""
    step = F.floor(16 * F.log2(F.col(c).cast("double")))
    steps = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    low, held = None, 0
    for at, n in steps:
        held += n
        if held > most:
            break
        low = at
    return [] if low is None else counts.filter(step >= low).collect()


def vocabulary(counts: DataFrame, head: int = HEAD, tails: int = TAILS, known: int = KNOWN) -> Vocabulary:
    """From written counts; what comes to the driver is bounded by the parameters."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    named = counts.filter(F.col("word") != F.lit(END))
    first = sorted(((bytes(r["word"]), r["c"]) for r in most_frequent(named, "c", known)), key=lambda x: (-x[1], x[0]))
    ends = counts.filter(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    own = [END] + [w for w, _ in first[:head]]
    own_counts = [ends] + [c for _, c in first[:head]]
    # words after the last of the head, in the same order
    rest = named
    if len(own) > 1:
        rest = rest.filter((F.col("c") < own_counts[-1]) | ((F.col("c") == own_counts[-1]) & (F.col("word") > F.lit(own[-1]))))
    # a suffix of bytes: a negative start beyond a word's length begins before it
    suffix = F.when(F.octet_length("word") <= ENDING, F.col("word")).otherwise(F.substring("word", -ENDING, ENDING))
    by = rest.groupBy(suffix.alias("e")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    top = sorted(most_frequent(by, "n", tails), key=lambda r: (-r["n"], bytes(r["e"])))
    n_rest, v_rest = rest.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    sizes = [(r["n"], r["v"]) for r in top]
    sizes.append((n_rest - sum(n for n, _ in sizes), v_rest - sum(v for _, v in sizes)))
    units = len(own) + len(sizes)
    ending = {bytes(r["e"]): len(own) + i for i, r in enumerate(top)}
    rank = {w: i for i, w in enumerate([*own, *(w for w, _ in first[head:])])}
    unit = np.array([*range(len(own)), *(ending.get(w[-ENDING:], units - 1) for w, _ in first[head:])])
    count = np.array([*own_counts, *(c for _, c in first[head:])], np.int64)
    share = np.array([0.0] * len(own) + [math.log10(n + v + 1) or 1e-300 for n, v in sizes])
    frequency = np.array([*own_counts, *(n for n, _ in sizes)], float) + 1
    return Vocabulary(rank, count, unit, ending, units, total, distinct, share, frequency / frequency.sum())


def laid(docs: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' units in a row, `order` ends before each, and the places of their own units."""
    lengths = np.array([len(d) for d in docs])
    at = np.arange(lengths.sum()) + np.repeat(np.arange(1, len(docs) + 1) * order, lengths)
    stream = np.zeros(lengths.sum() + order * len(docs), np.int64)
    stream[at] = np.concatenate(docs)
    return stream, at


def _summed(to: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows that go to each of n."""
    d = rows.shape[1]
    at = (to[:, None] * d + np.arange(d)).ravel()
    return np.bincount(at, weights=rows.ravel(), minlength=n * d).reshape(n, d).astype(np.float32)


def _alias(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables to draw a place of a row by its share, flat: a place that is drawn evenly is kept with a probability, or else
    another is taken (Walker's method)."""
    rows, n = shares.shape
    keep, other = np.ones(rows * n, np.float32), np.arange(rows * n)
    for r in range(rows):
        left = (shares[r] * n).tolist()
        small, large = [i for i, x in enumerate(left) if x < 1], [i for i, x in enumerate(left) if x >= 1]
        while small and large:
            i, k = small.pop(), large[-1]
            keep[r * n + i], other[r * n + i] = left[i], r * n + k
            left[k] -= 1 - left[i]
            if left[k] < 1:
                small.append(large.pop())
    return keep, other


class LogBilinear:
    """r: vectors of the context's units; near: weights of each distance; g, class_bias: of the classes; q, bias: of the
    units by class and place in it. Unit u is at place u // classes of class u % classes; some places of the last row are empty."""

    def __init__(self, frequency: np.ndarray, weights: np.ndarray | None = None, order: int = ORDER, dim: int = DIM):
        self.frequency, self.order, self.dim, u = frequency, order, dim, len(frequency)
        self.classes = max(1, math.isqrt(u))
        self.width = -(-u // self.classes)
        c, w = self.classes, self.width
        placed = np.zeros(c * w)
        placed[self.place(np.arange(u))] = frequency
        within = placed.reshape(c, w)
        self.of_class = within.sum(axis=1)
        self.within = within / self.of_class[:, None]
        self.keep, self.other = _alias(self.within)
        with np.errstate(divide="ignore"):
            logs = np.log(self.within)
        if weights is None:
            x = np.random.default_rng(5)
            weights = np.concatenate([x.normal(0, 0.1, u * dim), np.ones(order * dim) / order, x.normal(0, 0.1, c * dim), np.log(self.of_class), x.normal(0, 0.1, c * w * dim), np.where(within > 0, logs, -1e4).ravel()])
        self.weights = np.asarray(weights).astype(np.float32)
        self.r, self.near, self.g, self.class_bias, self.q, self.bias = self._parts(self.weights)  # views: a step on them is one on the weights
        self.log_class = np.log(self.of_class * CLASSES).astype(np.float32)
        self.log_unit = np.where(within > 0, logs + math.log(NOISE), 0).ravel().astype(np.float32)

    def place(self, units: np.ndarray) -> np.ndarray:
        return units % self.classes * self.width + units // self.classes

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        u, d, n, c, w = len(self.frequency), self.dim, self.order, self.classes, self.width
        r, near, g, class_bias, q, bias = np.split(x, np.cumsum([u * d, n * d, c * d, c, c * w * d]))
        return [r.reshape(u, d), near.reshape(n, d), g.reshape(c, d), class_bias, q.reshape(c * w, d), bias]

    def learn(self, docs: list[np.ndarray], random: np.random.Generator, squares: np.ndarray, rate: float = RATE) -> None:
        """One pass over the documents' positions in random order, steps scaled by the sums of squared slopes (`squares`)."""
        stream, at = laid(docs, self.order)
        at = random.permutation(at)
        sr, sn, sg, sc, sq, sb = self._parts(squares)
        d, u, c, w = self.dim, len(self.frequency), self.classes, self.width
        of_classes = np.cumsum(self.of_class)
        above = lambda over: 1 / (1 + np.exp(-np.clip(over, -30, 30)))  # noqa: E731  the chance of being true

        def step(weights, squares, slope):
            squares += slope**2
            weights -= rate * slope / np.sqrt(squares)

        for b in range(0, len(at), BATCH):
            places = at[b : b + BATCH]
            true, n = stream[places], len(places)
            context = stream[places - 1 - np.arange(self.order)[:, None]]
            vectors = self.r[context]
            h = np.einsum("jbd,jd->bd", vectors, self.near)
            # classes: true ones are to be above noise, noise below
            own = true % c
            noise = np.minimum(np.searchsorted(of_classes, random.random(CLASSES)), c - 1)
            g_own, g_noise = self.g[own], self.g[noise]
            below = above(np.einsum("bd,bd->b", h, g_own) + self.class_bias[own] - self.log_class[own]) - 1
            over = above(h @ g_noise.T + self.class_bias[noise] - self.log_class[noise])
            slope_h = below[:, None] * g_own + over @ g_noise
            slope = _summed(np.concatenate([own, noise]), np.column_stack([np.concatenate([below[:, None] * h, over.T @ h]), np.concatenate([below, over.sum(axis=0)])]), c)
            step(self.g, sg, slope[:, :d])
            step(self.class_bias, sc, slope[:, d])
            # units: the true one and noise of its class
            drawn = own[:, None] * w + random.integers(0, w, (n, NOISE))
            drawn = np.where(random.random((n, NOISE), np.float32) < self.keep[drawn], drawn, self.other[drawn])
            units = np.column_stack([self.place(true), drawn])
            q = self.q[units]
            chance = above(np.einsum("bd,bkd->bk", h, q) + self.bias[units] - self.log_unit[units])
            chance[:, 0] -= 1
            slope_h += np.einsum("bk,bkd->bd", chance, q)
            flat = units.ravel()
            step(self.q, sq, _summed(flat, (chance[:, :, None] * h[:, None]).reshape(-1, d), c * w))
            step(self.bias, sb, np.bincount(flat, weights=chance.ravel(), minlength=c * w).astype(np.float32))
            near = np.einsum("bd,jbd->jd", slope_h, vectors)
            slope = _summed(context.ravel(), (slope_h[None] * self.near[:, None]).reshape(-1, d), u)
            step(self.near, sn, near)
            step(self.r, sr, slope)

    def log10(self, docs: list[np.ndarray]) -> np.ndarray:
        """The normalised log10 probability of each document's units."""
        stream, at = laid(docs, self.order)
        weighted, out = [self.r * w for w in self.near], np.empty(len(at))
        groups, inner, biases = np.ascontiguousarray(self.g.T), self.q.reshape(self.classes, self.width, -1).transpose(0, 2, 1).copy(), self.bias.reshape(self.classes, -1)
        for b in range(0, len(at), ROWS):
            places = at[b : b + ROWS]
            # by class, so that the units of a class are one product
            true = stream[places]
            order = np.argsort((true % self.classes).astype(np.uint16), kind="stable")
            places, true = places[order], true[order]
            h = weighted[0][stream[places - 1]]
            for j in range(1, self.order):
                h += weighted[j][stream[places - 1 - j]]
            own, inside = true % self.classes, true // self.classes
            got = _log_share(h @ groups + self.class_bias, own)
            ends = np.searchsorted(own, np.arange(self.classes + 1))
            for c in range(self.classes):
                i, k = ends[c], ends[c + 1]
                if i < k:
                    got[i:k] += _log_share(h[i:k] @ inner[c] + biases[c], inside[i:k])
            out[b + order] = got
        return np.add.reduceat(out, np.cumsum([0, *map(len, docs[:-1])])) / math.log(10)


def _log_share(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log of each row's softmax at its own column."""
    scores -= scores.max(axis=1, keepdims=True)
    chosen = scores[np.arange(len(own)), own].astype(float)
    return chosen - np.log(np.exp(scores, out=scores).sum(axis=1))


def encoded(docs: DataFrame, told) -> DataFrame:
    """A row for each document, written: `row`, doc_id, held_out, its units as 16-bit numbers, what its words of known rank
    add, and its other words with their multiplicities. told: a broadcast `Vocabulary`."""
    names = ["row", "doc_id", "held_out", "units", "n_known", "logs", "shared_logs", "rare", "times"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = told.value
        for batch in lean(batches):
            made = []
            for text in batch.column("text"):
                units, known, logs, shared, rare = v.encoded(text.as_py())
                made.append((units.astype("<u2").tobytes(), known, logs, shared, list(rare.keys()), list(rare.values())))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names[:3]] + [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types[3:], strict=True)], names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(run, "row long, doc_id long, held_out boolean, units binary, n_known long, logs double, shared_logs double, rare array<binary>, times array<long>"), "encoded")


def trained(rows: DataFrame, frequency: np.ndarray, rounds: int = ROUNDS) -> LogBilinear:
    """A model that has gone through every training document of `encoded` once."""
    model = LogBilinear(frequency)
    size = len(model.weights)
    for k in range(rounds):
        told = rows.sparkSession.sparkContext.broadcast(model.weights)

        def learn(batches: Iterator[pa.RecordBatch], told=told, k=k) -> Iterator[pa.RecordBatch]:
            own, n = LogBilinear(frequency, told.value.copy()), 0
            random, squares = np.random.default_rng([k, TaskContext.get().partitionId()]), np.full(size, 1e-2, np.float32)
            held: list[np.ndarray] = []
            waiting = 0
            for batch in lean(batches):
                for units in batch.column("units"):
                    held.append(np.frombuffer(units.as_py(), "<u2").astype(np.int64))
                    waiting += len(held[-1])
                    if waiting >= POSITIONS:
                        own.learn(held, random, squares)
                        n, held, waiting = n + waiting, [], 0
            if held:
                own.learn(held, random, squares)
                n += waiting
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([own.weights.tolist()], pa.list_(pa.float32())), pa.array([n])], names=["w", "n"])

        some = rows.filter(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == k)).select("units")
        each = some.mapInArrow(learn, "w array<float>, n long").select("n", F.posexplode("w").alias("at", "w"))
        mean = each.groupBy("at").agg((F.sum(F.col("w").cast("double") * F.col("n")) / F.sum("n")).alias("w")).toArrow()
        if mean.num_rows:
            weights = np.empty(size)
            weights[mean.column("at").to_numpy()] = mean.column("w").to_numpy()
            model = LogBilinear(frequency, weights)
        told.unpersist()
    return model


def scored(docs: DataFrame, head: int = HEAD, tails: int = TAILS, known: int = KNOWN, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    counts = written(word_counts(docs.filter(~held_out(F.col("doc_id"))).select("text")), "word-counts")
    v = vocabulary(counts, head, tails, known)
    context = docs.sparkSession.sparkContext
    told = context.broadcast(v)
    rows = encoded(docs, told)
    model = context.broadcast(trained(rows, v.frequency, rounds))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, shared_logs double, units_score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, share = model.value, told.value.share * told.value.shared
        for batch in lean(batches):
            units = batch.column("units")
            lengths = pc.binary_length(units).to_numpy() // 2
            plain = np.empty(len(units))
            for part in np.split(np.arange(len(units)), np.flatnonzero(np.diff(np.cumsum(lengths) // (1 << 20))) + 1):
                docs = [np.frombuffer(units[i].as_py(), "<u2").astype(np.int64) for i in part.tolist()]
                plain[part] = m.log10(docs) - np.array([share[d].sum() for d in docs])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "doc_id", "held_out")), pa.array(lengths, pa.int64()), *(batch.column(n) for n in ("n_known", "logs", "shared_logs")), pa.array(plain)], names=[c.split()[0] for c in schema.split(", ")])

    whole = rows.select("row", "doc_id", "held_out", "units", "n_known", "logs", "shared_logs").mapInArrow(score, schema)
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    logs = F.col("times") * F.log10(F.col("c") + 1.0)
    null = lambda t: F.lit(None).cast(t)
    met = rare.join(counts, "word").select("row", null("long").alias("doc_id"), null("boolean").alias("held_out"), F.lit(0).cast("long").alias("n_tokens"), F.col("times").alias("n_known"), logs.alias("logs"), logs.alias("shared_logs"), F.lit(0.0).alias("units_score"))
    sums = whole.unionByName(met).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "shared_logs", "units_score")))
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(v.total + v.distinct + 1))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("units_score") + F.col("shared_logs")).alias("score"))
