"""Operators against plain versions of what they compute."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm.common import may_hold
from tidemark.llm import mixing, packing, quality, rules, simhash, substrings, topk, toxicity

WORDS = [f"{a}{b}" for a in ("the", "of", "re", "sta", "no", "ing") for b in ("", "n", "tion", "ble", "er", "um")]


def corpus(n, seed, words=60):
    r = random.Random(seed)
    passage = " ".join(r.choices(WORDS, k=80))
    out = []
    for i in range(n):
        t = r.choices(WORDS, k=r.randint(0, words * 4))
        if i % 3 == 0:
            k = r.randint(0, len(t))
            t[k:k] = passage.split()[r.randint(0, 30) :]
        if i % 7 == 3:
            t = t[:2] * 50
        text = r.choice([" ", "\n", "  "]).join(t)
        out.append((i, out[-1][1] if i % 11 == 5 else text, f"s{i % 4}"))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus(120, 5)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def test_rules(rows, docs):
    got = {r["doc_id"]: r for r in rules.ledger(docs).collect()}
    for i, t, _ in rows:
        w = t.split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = set()
        for k, g in enumerate(grams):
            if grams.count(g) > 1:
                hit |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"], got[i]["n_dup_lines"]) == (len(w), len(hit), sum(map(len, w)), len(lines) - len(set(lines)))


def test_rules_ablations(docs):
    led = rules.ledger(docs)
    got = {r["rule"]: r for r in rules.ablations(led).collect()}
    masks = [r["fail_bits"] & rules.DEFAULT.mask for r in led.collect()]
    for name in rules.DEFAULT.counted:
        bit = rules.bits(name)
        assert (got[name]["n_failed"], got[name]["n_only_this"]) == (sum(bool(m & bit) for m in masks), sum(m == bit for m in masks))


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[k : k + 3]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in ("A b", "", " x ", "Ünï CÖDÉ x y Z", "a b c a b c a b", "one two three four five"):
        assert simhash.fingerprint(t) & (1 << 64) - 1 == slow_fingerprint(t)


def components(fps, radius):
    n, label = len(fps), list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(n):
                if (fps[a] ^ fps[b]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


@pytest.mark.parametrize("largest", [4096, 3])
def test_links(spark, largest):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(12)} | {r.getrandbits(64) for _ in range(40)})
    signed = [simhash._signed(f) for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, largest)
    roots = {x["node"]: x["root"] for x in simhash.components(links).collect()}
    want = components(fps, 3)
    got = [roots.get(f, f) for f in signed]
    assert len({(a, b) for a, b in zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_bk_tree():
    r = random.Random(9)
    fps = [r.getrandbits(12) for _ in range(300)]
    tree = simhash.BKTree()
    for k, f in enumerate(fps):
        tree.insert(f, k)
    for q in range(0, 4096, 37):
        assert sorted(tree.within(q, 2)) == [k for k, f in enumerate(fps) if (f ^ q).bit_count() <= 2]


@pytest.mark.parametrize("window,gram,anchor_bits", [(35, 8, 64), (6, 3, 64), (4, 4, 64), (6, 3, 3)])
def test_substrings(rows, docs, window, gram, anchor_bits):
    """With anchors of three bits nearly all of them collide, and only digests of words tell spans apart."""
    got = {r["doc_id"]: r for r in substrings.removed(docs.select("doc_id", "text"), window, gram, anchor_bits=anchor_bits).collect()}
    import hashlib

    every = Counter(tuple(w[k : k + window]) for _, t, _ in rows for w in [t.split()] for k in range(len(w) - window + 1))
    for i, t, _ in rows:
        w = t.split()
        gone = {k + j for k in range(len(w) - window + 1) if every[tuple(w[k : k + window])] > 1 for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i


def test_compaction(spark):
    """Nonbranching paths cover what their units cover, and a passage that only occurs as a whole is one path."""
    r = random.Random(2)
    shared = [(10 * k + 1, r.randint(1, 9)) for k in range(12)]
    listed, want = [], Counter()
    for doc in range(6):
        at = r.randint(0, 5)
        run = shared if doc < 4 else shared[3:9]
        for u, n in run + ([(777, 2)] * 3 if doc % 2 else []):
            listed.append((u, 0, doc, 5, at, n))
            want.update((doc, at + j) for j in range(n))
            at += n
        listed += listed[-1:] if doc == 2 else []  # equal rows
    got = substrings.compacted(spark.createDataFrame(listed, "u long, s int, _id long, _tie long, first int, n int")).collect()
    have = Counter((x["_id"], k) for x in got for k in range(x["first"], x["last"] + 1))
    assert have == want
    # the passage and its inner part are three paths in four texts and one in two; a loop breaks at its end
    assert Counter(x["_id"] for x in got) == {0: 3, 1: 6, 2: 3, 3: 6, 4: 1, 5: 4}


def test_may_hold(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b"))
    keys = rows.filter("a % 3 = 0 or a is null")
    got = may_hold(rows, keys, "a", "b").collect()
    assert all(x["_may"] for x in got if x["a"] is None or x["a"] % 3 == 0) and sum(x["_may"] for x in got) < 2200
    assert not may_hold(rows, keys.filter("false"), "a", "b").filter("_may").count()


def best_of(v, k=5):
    """Every row that is a query against all others, in whole numbers."""
    q = [[math.floor(256 * float(x)) for x in row] for row in v]
    out = []
    for i in range(0, len(q), 50):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in range(len(q)) if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return out


def found_of(spark, v, kind="float", **how):
    frame = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], f"vec_id long, embedding array<{kind}>")
    return sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(frame, F.col("vec_id") % 50 == 0, **how).collect())


def test_topk(spark):
    r = np.random.default_rng(4)
    v = np.concatenate([r.normal(size=(400, 8)), np.repeat(r.normal(size=(5, 8)), 30, axis=0), np.zeros((20, 8))]).astype(np.float32)
    assert found_of(spark, v, shard_rows=150, block_queries=4) == best_of(v)


def test_topk_of_large_components(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(220, 3)) * 10.0 ** r.integers(-3, 7, size=(220, 1))
    v[7], v[50] = (70_000.0, 0.0, 0.0), (1.0, 0.0, 0.0)
    assert found_of(spark, v, "double", shard_rows=64) == best_of(v)
    # products beyond 64 bits are compared as whole numbers and given as the nearest long
    huge = [[1.0, 0.0], [3e15, 0.0], [2e15, 0.0], [-3e15, 1.0], [float("1e300"), 0.0]] + [[float(k), 1.0] for k in range(46)]
    huge[50] = [3e15, 1.0]
    got = {(q, n): (i, s) for q, n, i, s in found_of(spark, huge, "double")}
    assert [got[50, n][0] for n in (1, 2)] == [1, 2] and got[50, 1][1] == (1 << 63) - 1
    assert [got[0, n] for n in (1, 2, 3)] == [(i, (1 << 63) - 1) for i in (1, 2, 50)] and got[0, 4] == (49, 256 * 256 * 44)


def test_topk_skips_shards(spark):
    """In clusters far apart most shards are never searched, and the result is the same."""
    r = np.random.default_rng(6)
    middle = r.normal(size=(20, 16)) * 5
    v = np.concatenate([middle[k] + 0.05 * r.normal(size=(120, 16)) for k in range(20)])
    r.shuffle(v)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    data = topk.quantised(frame)
    placed = topk.placed(data, len(v), 128)
    built = topk.trees(placed, 128).cache()
    queries = placed.filter("vec_id % 50 = 0").select("row", "dim", "v", F.lit(None).cast("long").alias("least"))
    first = topk._bounded(queries, built, topk.FIRST, 64).cache()
    fifth = Window.partitionBy("q").orderBy(F.desc("score"))
    known = topk._searched(queries, first, built, 5, 64).withColumn("n", F.row_number().over(fifth)).filter("n = 5").select(F.col("q").alias("row"), F.col("score").alias("least"))
    pairs = topk._bounded(queries.drop("least").join(known, "row"), built, None, 64).count()
    assert built.count() >= 20 and pairs < 0.3 * built.count() * queries.count()
    assert found_of(spark, v, "double", shard_rows=128) == best_of(v)


def test_permutation():
    for n in (1, 2, 3, 5, 17, 64, 1000):
        at = np.arange(n)
        block = mixing.permuted(np.full(n, 3), np.full(n, 1), np.full(n, n), at)
        assert sorted(block) == list(range(n))
        assert (mixing.permuted(np.full(n, 3), np.full(n, 1), np.full(n, n), block, back=True) == at).all()


def test_draws(spark):
    """Each shard draws as many slots as it has, of each source about its share."""
    sources = spark.createDataFrame([(0, 5000), (1, 3000), (2, 0), (3, 2000), (4, 17)], "s int, slots long")
    counts, shards = mixing.drawn(sources, 100)
    got = counts.collect()
    whole = {k: sum(x["held"] for x in got if x["shard"] == k) for k in range(shards)}
    assert shards == 101 and whole == {k: 100 if k < 100 else 17 for k in range(101)}
    for s, n in ((0, 5000), (1, 3000), (3, 2000)):
        each = np.array([sum(x["held"] for x in got if (x["shard"], x["s"]) == (k, s)) for k in range(100)])
        p = n / 10_017
        assert abs(each.sum() - 10_000 * p) < 5 * (10_000 * p * (1 - p)) ** 0.5 and 0.5 < each.var() / (100 * p * (1 - p)) < 2


def test_targets(spark):
    """Sharing by weight with ceilings, against doing it step by step."""
    r = random.Random(8)
    for n in (1, 4, 9):
        size = {f"s{k:02}": r.choice([0, 3, 50, 1000, 40_000]) for k in range(n)}
        sized = spark.createDataFrame([(s, x, 1) for s, x in size.items()], "source string, size long, copies long")
        got = {x["source"]: x["target"] for x in mixing.targets(sized).collect()}
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
        want, open_, left = {}, set(size), 1.5 * sum(size.values())
        while open_:
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if weight[s] * level > 2 * size[s]}
            for s in full or open_:
                want[s] = 2.0 * size[s] if full else weight[s] * level
            left, open_ = left - sum(want[s] for s in full), open_ - full if full else set()
        assert got == pytest.approx(want)


def test_mixing(spark, rows):
    """What is taken of each document, and the mixed texts, against counting word by word."""
    more = [*rows, *[(900, "same words in a row " * 30, "s1")] * 7, (900, "same words in a row " * 30, None)]
    docs = spark.createDataFrame([(*x, k % 2) for k, x in enumerate(more)], "doc_id long, text string, source string, odd int")
    sized, sources = mixing._prepared(docs)
    placed, slots_ = mixing.offsets(sized, sources), mixing.slots(sources)
    at = {(x["s"], x["start"], x["doc_id"], x["tie"]): x["size"] for x in placed.filter("size > 0").collect()}
    length = {x["s"]: x["source_size"] for x in sources.collect()}
    hits = {s: np.zeros(n, int) for s, n in length.items()}
    for x in slots_.collect():
        a = x["block"] * mixing.BLOCK_WORDS
        assert a + x["words"] <= min(a + mixing.BLOCK_WORDS, length[x["s"]])
        hits[x["s"]][a : a + x["words"]] += 1
    tiled = {s: np.zeros(n, int) for s, n in length.items()}
    for (s, start, _, _), size in at.items():
        tiled[s][start : start + size] += 1
    assert all((x == 1).all() for x in tiled.values())
    want = sorted((i, int(hits[s][start : start + size].sum())) for (s, start, i, _), size in at.items())
    got = mixing.mixed(docs).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in got if x["size"]) == want and len(got) == len(more)
    for x in sources.collect():
        assert sum(y["taken"] for y in got if y["source"] == x["source"]) == int(x["target"] + 0.5)
    texts = mixing.mixed_texts(docs).collect()
    words = lambda some: Counter((x["doc_id"], x["source"], x["odd"]) for x in some for _ in (x["text"] or "").split())
    held = Counter()
    for (s, start, i, tie), size in at.items():
        held[i, tie] += int(hits[s][start : start + size].sum())
    key = {(x["doc_id"], x["tie"]): (x["doc_id"], x["source"], x["odd"]) for x in docs.withColumn("tie", mixing._tie(docs)).collect()}
    assert words(texts) == Counter({key[k]: n for k, n in held.items() if n})


@pytest.mark.parametrize("block", [7, 64])
def test_slots(spark, block):
    """Each source's slots add up to its rounded target, and no block is taken more than twice."""
    sources = spark.createDataFrame([("a", 0, 1000, 10, 2000.0), ("b", 1, 333, 10, 100.4), ("c", 2, 5, 1, 7.5), ("d", 3, 0, 1, 0.0)], "source string, s int, source_size long, n_docs long, target double")
    got = mixing.slots(sources, block, 16).collect()
    words = {s: sum(x["words"] for x in got if x["s"] == s) for s in range(4)}
    assert words == {0: 2000, 1: 100, 2: 8, 3: 0}
    assert len({(x["s"], x["block"], x["pass"]) for x in got}) == len(got)


def test_mixing_reruns_agree(docs):
    key = lambda df: sorted((r["doc_id"], r["taken"]) for r in df.collect())
    assert key(mixing.mixed(docs)) == key(mixing.mixed(docs.repartition(2)))


def test_packing(rows, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary()[0])
    ids = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t, _ in rows}
    got = packing.packed(docs, open_windows=2, length=64).collect()
    for i, want in ids.items():
        at = 0
        for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    sequences = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert sequences.get(r["sequence_id"], 0) == r["offset"]
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 64 or n & (n - 1) == 0 for n in sequences.values()) and max(sequences.values()) <= 64


def test_token_ids_agree():
    files = packing.vocabulary()
    plain, fast, special = packing._plain(files[0]), packing._fast(files[1]), packing.special_tokens(files[0])
    usual = [chr(c) for c in range(0x250) if not packing._OTHER.search(chr(c))]
    for c in usual:
        for t in (f"a{c}b", f"{c}{c} {c}", f"1{c}2 \n{c} "):
            assert plain.encode(t, add_special_tokens=False).ids == fast.encode_ordinary(t)
    for t in ("a<|endoftext|>b", "中文 text \U0001f600", "\x1c \x85 \xa0"):
        assert packing.token_ids(t, files, special).tolist() == [*plain.encode(t, add_special_tokens=False).ids, 0]


def test_chain_marginals():
    """Forward-backward against all label sequences."""
    r = np.random.default_rng(1)
    gain, move, lengths = r.normal(size=7), r.normal(size=(2, 2)), np.array([3, 1, 3])
    got, pairs = quality.marginals(gain, move, quality.Chains(lengths))
    want, at, want_pairs = np.zeros(7), 0, np.zeros((2, 2))
    for n in lengths:
        total = 0.0
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(gain[at + k] * y[k] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(gain[at + k] * y[k] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1))) / total
            for k in range(n):
                want[at + k] += p * y[k]
            for k in range(n - 1):
                want_pairs[y[k], y[k + 1]] += p
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)
    for most in (0, 2):  # all alone, and only the longer ones
        got, pairs = quality.marginals(gain, move, quality.Chains(lengths, most))
        assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def plain_quality(field, text):
    """A document's score line by line, from the field's weights."""
    own, sizes = quality.line_features(text)
    zero = np.zeros(own.shape[1])
    gain = [float(np.concatenate([own[k], own[k - 1] if k else zero, own[k + 1] if k + 1 < len(own) else zero]) @ field.weights) for k in range(len(own))]
    ahead = [np.array([1.0, np.exp(gain[0])])]
    for g in gain[1:]:
        f = (ahead[-1] / ahead[-1].sum()) @ np.exp(field.move) * np.array([1.0, np.exp(g)])
        ahead.append(f)
    behind = [np.ones(2)]
    for g in gain[:0:-1]:
        b = np.exp(field.move) @ (np.array([1.0, np.exp(g)]) * behind[-1])
        behind.append(b / b.sum())
    good = [(a * b)[1] / (a * b).sum() for a, b in zip(ahead, reversed(behind), strict=True)]
    return float(np.average(good, weights=sizes))


def test_quality_scores_equal_a_plain_chain(spark):
    r = np.random.default_rng(9)
    line = lambda: " ".join(r.choice(["the", "Word", "$$", "12", "spam", "spam", "é"], r.integers(0, 9)))
    texts = [(i, "\n".join(line() for _ in range(int(r.integers(0, 12))))) for i in range(60)] + [(60, "\n".join(line() for _ in range(6000))), (61, None)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    field = quality.trained(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}
    assert all(abs(got[i] - plain_quality(field, t)) < 1e-5 for i, t in texts)


def test_a_document_of_many_lines_is_quick():
    began = time.time()
    quality.Field(np.full(3 * quality.N_OWN, 0.1), np.array([[0.5, -0.5], [-0.2, 0.3]])).scores(["a b c\n" * 300_000, "x"])
    assert time.time() - began < 20


def test_long_white_space_is_packed(spark):
    """Runs that tiktoken's pattern can't hold; ids are those of tokenizers."""
    from tokenizers import Tokenizer

    texts = ["x" + " " * 5_000_000 + "y", "\n" * 1_000_000, "a" + " \n\t\r" * 500_000 + "b", " " * 999 + "x", " " * 1000]
    got = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sizes = {r["doc_id"]: (r["n"], r["d"]) for r in got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()}
    plain = Tokenizer.from_file(packing.vocabulary()[0])
    for i, t in enumerate(texts):
        n = len(plain.encode(t, add_special_tokens=False).ids) + 1
        assert sizes[i] == (n, n)


def test_ids_of_a_whole_corpus_are_those_of_tokenizers(spark):
    files = packing.vocabulary()
    plain, special = packing._plain(files[0]), packing.special_tokens(files[0])
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert packing.token_ids(text, files, special).tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 0]


SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = module.scored(known, labels).join(labels, "doc_id").filter("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least, right
