"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier learns from confirmed toxic documents and from unlabelled text, which holds toxic documents too; labels
of clean documents are used for nothing but the class prior, the share of toxic ones. The risk is that of the
positives as positive, plus that of the unlabelled as negative less what the positives among them would add, and
where that difference falls below zero it is held there, as the negative part of a true risk can't be.

A feature is a word in lower case, or the first three to seven letters of a longer one, found in at least one, two
or three distinct words of a document. Those that tell the two samples apart best are kept, and of a word's beginnings
the longest that says as much. Which kept features a word has is found once and remembered.

Defined cases: a null or blank text has the score of no words; a null doc_id is scored, and counts as not held out;
repeated rows each get their row; without any toxic label every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .sampling import held_out, labelled, unlabelled

#: At most so many confirmed toxic documents, and about so many unlabelled ones, are learnt from.
POSITIVES, UNLABELLED = 2500, 6000
#: So many features are kept at most, each from so many documents at least.
FEATURES, LEAST = 4000, 5
PREFIXES = range(3, 8)
#: Numbers of distinct words that a feature tells apart, and how much it must tell the samples apart.
WORDS, TOLD = 3, 8.0
THRESHOLD = 0.3
STEPS, RATE, SPARSE = 300, 0.05, 1e-2
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 1 << 17


def word_set(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if n < len(word))]


class Classifier:
    """Weights of each kept feature for its first, second and third word."""

    def __init__(self, weights: dict[str, tuple[float, ...]] | None = None, bias: float = -math.inf):
        self.weights, self.bias, self.known = weights or {}, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def score(self, text: str | None) -> float:
        if self.bias == -math.inf:
            return 0.0
        known, counts = self.known, Counter()
        if len(known) > _REMEMBERED:
            known.clear()
        for w in word_set(text):
            kept = known.get(w)
            if kept is None:
                known[w] = kept = tuple(f for f in features(w) if f in self.weights)
            if kept:
                counts.update(kept)
        total = self.bias + sum(sum(self.weights[f][:n]) for f, n in counts.items())
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def _frequencies(docs: list[str], among: set[str] | None = None) -> Counter:
    """In how many documents each feature occurs, of those named if any are."""
    out: Counter = Counter()
    for d in docs:
        found = {f for w in d.split() for f in features(w)}
        out.update(found if among is None else found & among)
    return out


def chosen(positive: list[str], other: list[str], most: int = FEATURES, least: int = LEAST, told: float = TOLD) -> list[str]:
    """The features whose document frequencies differ most between the samples, by the G statistic, and are
    higher among the positives; none whose longer form has nearly as many positives."""
    p = Counter({f: n for f, n in _frequencies(positive).items() if n >= least})
    u = _frequencies(other, set(p))
    np_, nu = len(positive), max(1, len(other))
    shorter = lambda f: f[:-1] if len(f) - 1 in PREFIXES else f[: PREFIXES[-1]]
    said = {shorter(f) for f, n in p.items() if f != shorter(f) and n >= 0.9 * p[shorter(f)]}

    def weight(f: str) -> float:
        a, b = p[f], u[f]
        rate = (a + b) / (np_ + nu)
        return a * math.log(a / (np_ * rate)) + (b * math.log(b / (nu * rate)) if b else 0.0)

    some = [(weight(f), f) for f, n in p.items() if f not in said and n / np_ > u[f] / nu]
    return [f for w, f in sorted(some, reverse=True)[:most] if w > told]


def _matrix(docs: list[str], at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ones: a column for each kept feature and number of words, up to `WORDS`."""
    rows, columns = [], []
    for k, d in enumerate(docs):
        for f, n in Counter(f for w in d.split() for f in features(w) if f in at).items():
            for j in range(min(n, WORDS)):
                rows.append(k), columns.append(WORDS * at[f] + j)
    return np.array(rows, int), np.array(columns, int)


def fit(p: list[str], u: list[str], prior: float, steps: int = STEPS, rate: float = RATE, sparse: float = SPARSE) -> Classifier:
    """Descends the non-negative risk under logistic loss; weights are shrunk towards zero, to exact zeros.
    p and u: the distinct words of each document, positive and unlabelled, joined by spaces."""
    if not p or not prior:
        return Classifier()
    prior = min(prior, 0.95)
    names = chosen(p, u)
    at = {f: k for k, f in enumerate(names)}
    (rp, cp), (ru, cu) = _matrix(p, at), _matrix(u, at)
    n = WORDS * len(names)
    w, bias, m, v = np.zeros(n), math.log(prior / (1 - prior)), np.zeros(n + 1), np.zeros(n + 1)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    loss = lambda z: np.logaddexp(0, z)  # noqa: E731  as negative; as positive it is loss(-z)
    for k in range(1, steps + 1):
        zp = np.bincount(rp, w[cp], minlength=len(p)) + bias
        zu = np.bincount(ru, w[cu], minlength=len(u)) + bias
        negative = loss(zu).mean() - prior * loss(zp).mean() if len(u) else 0.0
        # where the negative part is below zero its own slope is followed back up, and nothing else
        if negative >= 0:
            sp, su = np.full(len(p), -prior / len(p)), sigma(zu) / max(1, len(u))
        else:
            sp, su = prior * sigma(zp) / len(p), -sigma(zu) / max(1, len(u))
        slope = np.append(np.bincount(cp, sp[rp], minlength=n) + np.bincount(cu, su[ru], minlength=n), sp.sum() + su.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        w, bias = w - step[:-1], bias - step[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * sparse)
    kept = w.reshape(-1, WORDS)
    return Classifier({f: tuple(map(float, x)) for f, x in zip(names, kept, strict=True) if x.any()}, float(bias))


def trained(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, others: int = UNLABELLED) -> Classifier:
    """A classifier from bounded samples; distinct words are found where the documents are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(word_set(t.as_py()))) for t in batch.column("text")], pa.string())], names=["words"])

    bags = lambda df: df.select("text").mapInArrow(run, "words string").toArrow().column("words").to_pylist()
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    prior = usable.agg(F.avg("toxic")).first()[0] or 0.0
    return fit(bags(labelled(docs, labels, "toxic", positives, F.col("toxic") == 1)), bags(unlabelled(docs, others)), float(prior))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, for each document."""
    classifier = trained(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            scores = [classifier.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
