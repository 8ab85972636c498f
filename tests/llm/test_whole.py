"""Whole queries and the pipeline against plain versions on small tables with planted cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import catalogue, simhash, toxicity

WORDS = [a + b for a in ("mar", "ten", "sil", "qua", "dro", "pel", "nim", "gor", "fas", "lud") for b in ("a", "en", "is", "o", "ta", "ul", "ver", "ym")]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """documents with copies, near copies, rejects and a passage that repeats."""
    r = random.Random(4)
    passage = " ".join(r.choices(WORDS, k=70))
    rows = []
    for i in range(90):
        t = r.choices(WORDS, k=r.randint(60, 260))
        if i % 9 == 1:
            t[20:20] = passage.split()
        rows.append((i, " ".join(t), "en", f"s{i % 5}", 0))
    for i in range(90, 110):  # exact and near copies
        t = rows[i - 80][1].split()
        if i % 2:
            t[len(t) // 2] = "changed"
        rows.append((i, " ".join(t), "en", f"s{i % 5}", 0))
    rows += [(200, "too short", "en", "s0", 0), (201, "again and again " * 60, "en", "s1", 0), (202, None, "en", None, 0), (203, "# $ % & " * 40, "en", "s1", 0)]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def joined(edges, nodes):
    label = {n: n for n in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_op1(spark, planted):
    folder, rows = planted
    fps = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t, *_ in rows}
    want = joined([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], fps)
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in catalogue.op1_simhash_bktree(spark, folder).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_pipeline(spark, planted):
    folder, rows = planted
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ruled = stage["quality rules"](spark, docs, folder)
    assert {x["doc_id"] for x in ruled.collect()} == {i for i, *_ in rows if i < 200}
    texts = {i: t for i, t, *_ in rows if i < 200}
    sets = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t in texts.items()}
    root = joined([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets)
    single = stage["near dedup"](spark, ruled, folder)
    assert {x["doc_id"] for x in single.collect()} == set(root.values()) and len(set(root.values())) <= 95
    left = {i: texts[i].split() for i in set(root.values())}
    every = Counter(tuple(w[k : k + 35]) for w in left.values() for k in range(len(w) - 34))
    for i, w in left.items():
        gone = {k + j for k in range(len(w) - 34) if every[tuple(w[k : k + 35])] > 1 for j in range(35)}
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    cut = stage["substring dedup"](spark, single, folder)
    assert {x["doc_id"]: x["text"].split() for x in cut.collect()} == left
    mixed = stage["mixing"](spark, cut, folder)
    got = mixed.collect()
    size = Counter()
    for i, w in left.items():
        size[f"s{i % 5}"] += len(w)
    held = Counter()
    for x in got:
        held[x["source"]] += len(x["text"].split())
    assert abs(sum(held.values()) - 1.5 * sum(size.values())) < 5 and all(held[s] <= 2 * size[s] + 1 for s in size)
    assert all(x["text"] in " ".join(left[x["doc_id"]]) for x in got if len(x["text"].split()) < 40)
    whole = corpus_pipeline.run(spark, folder).collect()
    sequences = Counter()
    for x in whole:
        sequences[x["sequence_id"]] += x["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in sequences.values())
    assert {x["doc_id"] for x in whole} == {x["doc_id"] for x in got}
    by_doc = Counter()
    for x in whole:
        by_doc[x["doc_id"]] += x["length"]
    assert all(by_doc[i] >= n for i, n in Counter(x["doc_id"] for x in got for _ in x["text"].split()).items())


def test_risk_and_slope():
    """The descent against a plain one that takes the risk's slope by differences."""
    r = random.Random(3)
    bad, usual = ["vile", "nasty", "foul"], WORDS
    p = [" ".join(sorted({*r.sample(bad, 2), *r.sample(usual, 6)})) for _ in range(30)]
    u = [" ".join(sorted({*(r.sample(bad, 1) if k % 5 == 0 else []), *r.sample(usual, 6)})) for k in range(60)]
    prior, steps, rate, sparse = 0.2, 12, 0.05, 1e-2
    got = toxicity.fit(p, u, prior, steps, rate, sparse)
    names = toxicity.chosen(p, u)
    column = {(f, j): toxicity.WORDS * k + j for k, f in enumerate(names) for j in range(toxicity.WORDS)}

    def row(words):
        x = np.zeros(len(column) + 1)
        x[-1] = 1
        for f in names:
            n = sum(f in toxicity.features(w) for w in words.split())
            for j in range(min(n, toxicity.WORDS)):
                x[column[f, j]] = 1
        return x

    xp, xu = np.array([row(d) for d in p]), np.array([row(d) for d in u])
    loss = lambda z: np.log1p(np.exp(z))

    def risk(w):
        negative = loss(xu @ w).mean() - prior * loss(xp @ w).mean()
        return prior * loss(-(xp @ w)).mean() + negative if negative >= 0 else -negative

    w, m, v = np.zeros(len(column) + 1), 0.0, 0.0
    w[-1] = np.log(prior / (1 - prior))
    for k in range(1, steps + 1):
        slope = np.array([(risk(w + e) - risk(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - rate * sparse)
    assert got.bias == pytest.approx(w[-1], abs=1e-3)
    for (f, j), at in column.items():
        assert got.weights.get(f, (0.0,) * toxicity.WORDS)[j] == pytest.approx(w[at], abs=2e-2)


def test_contradicting_labels(spark):
    from tidemark.llm import sampling

    docs = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (2, 1), (2, 0), (3, None), (3, 0)], "doc_id long, toxic int")
    usable = {i for i in (1, 2, 3) if zlib_crc(i) % 4 != 2}
    got = {x["text"]: x["y"] for x in sampling.labelled(docs, labels, "toxic", 10).collect()}
    assert got == {f"t{i}": {1: 0, 2: 1, 3: 0}[i] for i in usable}
    assert sampling.labelled(docs, labels.unionByName(labels).filter("toxic = 1"), "toxic", 10, F.col("toxic") == 1).count() == len(usable & {1, 2})
    assert sampling.sampled(docs, ["doc_id"], 40, 40).count() == 40 and sampling.sampled(docs, ["doc_id"], 1 << 40, 10).count() == 0


def zlib_crc(i):
    import zlib

    return zlib.crc32(str(i).encode())
