"""Hard negatives, the language model and collocations against plain versions, and their defined cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, lblm, negatives

TEXTS = "doc_id long, text string, lang string, n long, score string, rank int, src int, row int, word string"


def plain_negatives(rows, k=5, positives=5):
    """rows: (row, vec_id, label, integers)."""
    out = []
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for a in rows:
        if a[1] is None or a[1] % 100:
            continue
        every = [(max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(a[3], b[3], strict=True)))), b[1], b[2]) for b in rows if b[0] != a[0] and len(b[3]) == len(a[3])]
        for p in sorted((t for t in every if t[2] == a[2]), key=key)[:positives]:
            fit = sorted((t for t in every if t[2] != a[2] and 80 * p[0] <= 100 * t[0] <= 100 * p[0]), key=key)[:k]
            out += [(a[1], p[1], i + 1, t[1], p[0], t[0]) for i, t in enumerate(fit)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [7, 8192])
def test_negatives_equal_a_plain_search(spark, block):
    r = np.random.default_rng(1)
    middle = r.normal(0, 1, 6)
    data = [(i, int(i % 3), (middle + r.normal(0, 0.5, 6)).round(1).tolist()) for i in range(220)]
    data += [(200, 1, data[5][2]), (300, 2, [1.0, 2.0]), (301, 2, [1.0, 2.0]), (302, 0, [1.0, 1.0]), (None, 0, data[0][2]), (0, 0, data[0][2])]
    data += [(400 + i, 1, [x * 2.0**46 for x in data[i][2]]) for i in range(3)]
    bad = [(500, None, data[0][2]), (600, 1, None), (700, 1, []), (800, 1, [float("nan")] * 6), (900, 1, [None] * 6), (1000, 1, [1e300] * 6)]
    frame = spark.createDataFrame(data + bad, "vec_id long, label int, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("row", F.lit("y"))
    got = negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, block_rows=block, block_anchors=2)
    rows = [(n, i, label, [math.floor(256 * x) for x in v]) for n, (i, label, v) in enumerate(data)]
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=str) == plain_negatives(rows)
    assert negatives.hard_negatives(frame.filter("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_products_are_exact_at_any_size():
    a = np.array([[1 << 40, 3], [1 << 20, 1], [5, 7]], np.int64)
    for scale in (1, 1 << 18):
        for b in (a * scale, a[1:] * scale, a[2:] * scale):
            want = [[max(-negatives.MOST, min(negatives.MOST, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
            assert negatives.inner_products(a, b).tolist() == want


def plain_collocations(docs, longest=3, least=10, inside=50, first=2000):
    f, out = {}, []
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                f.setdefault(lang if lang is not None else "und", Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, c in f.items():
        total = sum(x for g, x in c.items() if len(g) == 1)
        good = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in good.items():
            if any(len(h) > len(g) and 100 * b >= inside * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in good.items()):
                continue
            score, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def test_collocations_equal_a_plain_count(spark):
    r = np.random.default_rng(2)
    common = ["the", "Of", "and", "a", "zu", "é"]
    docs = [(i, " ".join(r.choice(common, 40)) + (". New York city, " if i % 3 else "; new york\tcity!x") * 2 + "\x0bdeep  learning\r", ("en", "de", None)[i % 3]) for i in range(60)]
    docs += [(i, "same same same same. a b a b a b", "en") for i in range(50)]
    docs += [(1, None, "en"), (2, "", None), (3, " \t.,;", "fr"), (4, "one", ""), (None, "w " * 3000, "de")]
    frame = spark.createDataFrame([(*d, 1, "s", 2, 3, 4, "w") for d in docs], TEXTS)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for first, longest, fan in ((2000, 3, 256), (5, 3, 256), (2000, 2, 256), (2000, 4, 3)):  # the last deals in several exchanges
        got = collocations.collocations(frame, longest=longest, first=first, bucket=2000, fan=fan)
        assert sorted(tuple(r[c] for c in names) for r in got.collect()) == plain_collocations([d[1:] for d in docs], longest, first=first)
    assert collocations.collocations(frame.filter("false")).collect() == []
    assert collocations.collocations(frame.filter("doc_id = 4")).collect() == []


def test_collocations_are_exact_beyond_64_bits(spark):
    big = 3 * 10**9
    counts = spark.createDataFrame([(1, "en", "a", big + 1), (1, "en", "b", big + 7), (2, "en", "a b", big)], "n int, lang string, gram string, f long")
    assert [r["score"] for r in collocations.scored(counts, 3).collect()] == [1000000 * big * big // ((big + 1) * (big + 7))]


@pytest.fixture(scope="module")
def corpus():
    r = np.random.default_rng(3)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    docs = [(i, " ".join(r.choice((left, right)[i % 2], 120)).upper() + " Ünï 	x" + str(i), "en") for i in range(300)]
    return docs + [(1, docs[1][1], "en"), (400, None, None), (401, "", None), (402, " \n", None), (None, "l1 unseen", None), (403, "l1 " * 5000, "en")]


def test_language_model(spark, corpus):
    frame = spark.createDataFrame([(*d, 1, "s", 2, 3, 4, "w") for d in corpus], TEXTS)
    # few words of known rank, so that most counts come from the join
    for known in (10, 65536):
        got = lblm.scored(frame, head=30, tails=5, known=max(known, 30)).collect()
        assert len(got) == len(corpus)
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        tokens = lambda t: [*(t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split(), b""]
        c = Counter(w for i, t, _ in corpus if not held(i) for w in tokens(t))
        total, distinct = sum(c.values()), len(c)
        want = []
        for i, t, _ in corpus:
            w = tokens(t)
            want.append((i, held(i), len(w), sum(x in c for x in w), total, round(sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w), 6)))
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == sorted(want, key=str)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
        some = [r for r in got if r["held_out"] and r["n_tokens"] > 100]
        assert sum(r["score"] for r in some) > sum(r["base_score"] for r in some)
    assert lblm.scored(frame.filter("false")).collect() == []
    assert {(r["train_tokens"], r["base_score"], r["n_known"]) for r in lblm.scored(frame.filter(lblm.held_out(F.col("doc_id")))).collect()} == {(0, 0.0, 0)}


def test_probabilities_of_all_units_have_a_sum_of_one():
    r = np.random.default_rng(4)
    frequency = r.random(50) + 0.1
    model = lblm.LogBilinear(frequency / frequency.sum())
    docs = [r.integers(0, 50, 200) for _ in range(20)]
    model.learn(docs, r, np.full(len(model.weights), 1e-2, np.float32))
    start = [3, 17, 4]
    both = model.log10([np.array([*start, u]) for u in range(50)] + [np.array(start)])
    assert abs((10 ** (both[:-1] - both[-1])).sum() - 1) < 1e-5


def test_learning_raises_the_probability_of_what_follows():
    r = np.random.default_rng(6)
    docs = [np.array([1 + (k + i) % 9 for k in range(60)]) for i in range(200)]  # each unit tells the next
    model = lblm.LogBilinear(np.full(10, 0.1))
    before = model.log10(docs[:5]).sum()
    for _ in range(3):
        model.learn(docs, r, np.full(len(model.weights), 1e-2, np.float32))
    assert model.log10(docs[:5]).sum() > 0.3 * before


def test_bounded_vocabulary_and_shares(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc xyz wxyz"), (3, "aa bb dd")], "doc_id long, text string")
    v = lblm.vocabulary(lblm.word_counts(docs).cache(), head=2, tails=1, known=3)
    assert (v.total, v.distinct, v.units) == (11, 7, 5) and len(v.rank) == 3
    # the rest: cc, dd, wxyz and xyz, the last two of one ending
    assert v.unit_of(b"zzxyz") == 3 and v.unit_of(b"cc") == 4
    assert np.allclose(10 ** v.share[3:], [2 + 2 + 1, 2 + 2 + 1])


def test_most_frequent_is_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", c) for i, c in enumerate([100, 50, 50, 7, 7, 7, 1, 1])], "word string, c long")
    got = lambda most: sorted((r["c"] for r in lblm.most_frequent(counts, "c", most)), reverse=True)
    assert [got(n) for n in (0, 1, 2, 3, 5, 6, 8, 99)] == [[], [100], [100], [100, 50, 50], [100, 50, 50], [100, 50, 50, 7, 7, 7], [100, 50, 50, 7, 7, 7, 1, 1], [100, 50, 50, 7, 7, 7, 1, 1]]


def test_noise_is_drawn_by_its_share():
    r = np.random.default_rng(8)
    shares = r.random((3, 7)) * (r.random((3, 7)) > 0.2)
    shares /= shares.sum(axis=1, keepdims=True)
    keep, other = lblm._alias(shares)
    got = np.zeros(21)
    for place in range(21):
        got[place] += keep[place] / 7
        got[other[place]] += (1 - keep[place]) / 7
    assert np.allclose(got.reshape(3, 7), shares, atol=1e-6)
