"""Document quality by a linear-chain conditional random field over lines.

Each line with a word is good or bad. Its potentials come from its own features and from those of the lines before and
after it, the chain's from which label follows which. Lines learn the label of their document, from a bounded
sample of labelled ones. A document's score is the mean of its lines' forward-backward marginals of good, each
line weighted by its length in words.

Defined cases: a document without a word is one empty line; a null doc_id is scored, and counts as not held out;
repeated rows each get their row; labels of unknown documents are ignored, as are null ones; with no labels at
all every score is that of an untrained field, 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .sampling import held_out, labelled

#: At most so many labelled documents are learnt from.
SAMPLE = 6000
THRESHOLD = 0.7
STEPS, RATE, DECAY = 120, 0.1, 1e-3
#: Lines beyond which a document goes through its steps alone.
LONG = 4096

_CLASS = np.zeros((256, 5), np.float32)
for _k, _bytes in enumerate((b"#*$%&|<>", b"!", bytes(range(65, 91)), b"0123456789", bytes(set(range(33, 127)) - set(b"#*$%&|<>!.,0123456789") - set(range(65, 91)) - set(range(97, 123))))):
    _CLASS[list(_bytes), _k] = 1
N_OWN = 13


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Own features of each line with a word, and its words; one empty line if there is none."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").encode().split(b"\n"):
        w = line.split()
        n = len(w)
        if not n:
            continue
        c = np.bincount(np.frombuffer(line, np.uint8), minlength=256) @ _CLASS
        size = sum(map(len, w))
        trigrams = len(set(zip(w, islice(w, 1, None), islice(w, 2, None)))) / (n - 2) if n > 2 else 1.0
        rows.append((1.0, min(3.0, c[0] / n), min(3.0, c[1] / n), c[2] / size, c[3] / size, c[4] / size, 1 - len(set(w)) / n, (1 - len(set(w)) / n) * (n < 20), sum(map(eq, w, islice(w, 1, None))) / n, 1 - trigrams, min(2.0, size / n / 10), math.log1p(n) / 6, float(line in seen)))
        seen.add(line)
        lengths.append(n)
    if not rows:
        return np.zeros((1, N_OWN), np.float32), np.ones(1)
    return np.array(rows, np.float32), np.array(lengths, float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Features of the lines with those of the lines before and after; zeros beyond the ends."""
    zero = np.zeros((1, own.shape[1]), own.dtype)
    return np.concatenate([own, np.concatenate([zero, own[:-1]]), np.concatenate([own[1:], zero])], axis=1)


class Chains:
    """Documents of different lengths, longest first, so that at each step those that go on are the first ones. Those of
    more than `LONG` lines, which would soon go on alone, are `long`: their first lines and lengths."""

    def __init__(self, lengths: np.ndarray, most: int = LONG):
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
        self.long = [(int(starts[k]), int(lengths[k])) for k in np.flatnonzero(lengths > most)]
        self.order = np.argsort(-lengths, kind="stable")[len(self.long) :]
        lengths, self.starts = lengths[self.order], starts[self.order]
        self.steps = int(lengths.max(initial=0))
        self.alive = np.searchsorted(-lengths, -np.arange(self.steps), side="left")

    def rows(self, t: int) -> np.ndarray:
        return self.starts[: self.alive[t]] + t


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def long_marginals(gain: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`marginals` of one chain, by the log odds of good over bad, a number at each step."""
    (bb, bg), (gb, gg) = np.exp(move - move.max()).tolist()
    exp, log, plain = math.exp, math.log, np.clip(gain, -300, 300).tolist()
    forward, backward = [plain[0]], [0.0]
    for g in plain[1:]:
        odds = exp(forward[-1])
        forward.append(g + log((bg + odds * gg) / (bb + odds * gb)))
    for g in reversed(plain[1:]):
        odds = exp(backward[-1] + g)
        backward.append(log((gb + odds * gg) / (bb + odds * bg)))
    ahead, behind = np.array(forward), np.array(backward[::-1])
    last, now = ahead[:-1], np.array(plain[1:]) + behind[1:]
    logs = np.stack([move[i, j] + i * last + j * now for i in (0, 1) for j in (0, 1)])
    logs = np.exp(logs - logs.max(axis=0))
    return 1 / (1 + np.exp(-(ahead + behind))), (logs / logs.sum(axis=0)).sum(axis=1).reshape(2, 2)


def marginals(gain: np.ndarray, move: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """The probability that each line is good, and the sums over all steps of those of each pair of labels.

    gain: by how much a line favours good over bad; move[i, j]: how much label j is favoured after i."""
    n = len(gain)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[:, 1] = gain
    for t in range(1, chains.steps):
        now = chains.rows(t)
        f = forward[now - 1]
        for j in (0, 1):
            forward[now, j] += _add(f[:, 0] + move[0, j], f[:, 1] + move[1, j])
    for t in range(chains.steps - 1, 0, -1):
        now = chains.rows(t)
        good = backward[now, 1] + gain[now]
        for i in (0, 1):
            backward[now - 1, i] = _add(backward[now, 0] + move[i, 0], good + move[i, 1])
    both = forward + backward
    whole = _add(both[:, 0], both[:, 1])
    pairs = np.zeros((2, 2))
    for t in range(1, chains.steps):
        now = chains.rows(t)
        for i in (0, 1):
            for j in (0, 1):
                pairs[i, j] += np.exp(forward[now - 1, i] + move[i, j] + j * gain[now] + backward[now, j] - whole[now]).sum()
    probable = np.exp(both[:, 1] - whole)
    for start, n in chains.long:
        probable[start : start + n], own = long_marginals(gain[start : start + n], move)
        pairs += own
    return probable, pairs


class Field:
    def __init__(self, weights: np.ndarray | None = None, move: np.ndarray | None = None):
        self.weights = np.zeros(3 * N_OWN) if weights is None else weights
        self.move = np.zeros((2, 2)) if move is None else move

    def fit(self, documents: list[np.ndarray], good: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Field:
        """Ascends the likelihood of each document's lines all having its label, with a penalty on weights."""
        if not len(documents):
            return self
        x = np.concatenate([with_neighbours(d) for d in documents]).astype(float)
        lengths = np.array([len(d) for d in documents])
        y, chains = np.repeat(good.astype(float), lengths), Chains(lengths)
        # each document counts once, however many lines it has
        told = np.array([[((lengths - 1) * (1 - good)).sum(), 0], [0, ((lengths - 1) * good).sum()]], float)
        p = np.concatenate([self.weights, self.move.ravel()])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for k in range(1, steps + 1):
            probable, pairs = marginals(x @ p[:-4], p[-4:].reshape(2, 2), chains)
            slope = np.concatenate([x.T @ (y - probable), (told - pairs).ravel()]) / len(documents) - decay * p
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            p = p + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return Field(p[:-4], p[-4:].reshape(2, 2))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        made = [line_features(t) for t in texts]
        lengths = np.array([len(own) for own, _ in made])
        gain = np.concatenate([with_neighbours(own) @ self.weights for own, _ in made])
        probable, _ = marginals(gain, self.move, Chains(lengths))
        weight = np.concatenate([w for _, w in made])
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.clip(np.add.reduceat(probable * weight, at) / np.add.reduceat(weight, at), 0, 1)


def trained(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Field:
    """A field from at most `most` labelled documents; their features are made where the documents are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            made = [line_features(t.as_py())[0].tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(made, pa.binary())], names=["y", "x"])

    rows = labelled(docs, labels, "quality", most).mapInArrow(run, "y int, x binary").toPandas()
    return Field().fit([np.frombuffer(x, np.float32).reshape(-1, N_OWN) for x in rows["x"]], rows["y"].to_numpy())


def scored(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted, for each document."""
    field = trained(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            scores = field.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
