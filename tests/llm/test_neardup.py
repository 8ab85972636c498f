"""The pipeline's near dedup against all pairs of shingle sets."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import neardup, simhash


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def plain(rows):
    """The smallest doc_id of each component of pairs with a similarity of 0.8 or more, by all pairs."""
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if x == old else x for k, x in root.items()}
    return sorted(set(root.values()))


@pytest.fixture(scope="module")
def rows():
    """Texts with copies of which 1 to 8 words are changed, so that their similarity is on both sides of 0.8."""
    r, out = random.Random(7), []
    for k in range(40):
        words = [f"w{r.randrange(3000)}" for _ in range(120)]
        out.append((10 * k, " ".join(words)))
        for j in range(1, 9):
            copy = list(words)
            for at in r.sample(range(120), j):
                copy[at] = f"x{r.randrange(3000)}"
            out.append((10 * k + j, " ".join(copy)))
    return out


def test_near_dedup_finds_all(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == plain(rows)


def test_similarity_is_exact(spark):
    words = [f"w{k}" for k in range(24)]  # 20 shingles
    texts = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:-4])), (2, " ".join(words[:-5])), (3, " ".join(words[:-4] + list("abcd")))], "node long, text string")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "a long, b long")
    assert [tuple(r) for r in neardup.confirmed(texts, pairs).collect()] == [(0, 1)]  # 16 of 20


@pytest.mark.parametrize("largest", [4096, 5])
def test_trees_of_buckets_find_what_all_pairs_do(spark, rows, largest):
    """By BK-trees, whole or in shards; a join of all members of a bucket came before."""
    made = [(i, *((len(h), *neardup.sketch(h)) for h in [neardup.shingles(t, neardup._Hashes())])) for i, t in rows[:90]]
    made = [(i, n, keys.tolist(), bits.tolist()) for i, (n, keys, bits) in made]
    members = [(7, i, i % 11, 3, n, [7, *keys[1:]], bits) for i, n, keys, bits in made]
    df = spark.createDataFrame(members, "key long, node long, part long, main long, n long, keys array<long>, bits array<long>")
    apart = lambda x, y: sum(((x[k] ^ y[k] | x[k + 16] ^ y[k + 16]) % 2**64).bit_count() for k in range(16))
    want = sorted((a[1], b[1]) for a in members for b in members if a[1] < b[1] and a[2] != b[2] and 5 * min(a[4], b[4]) >= 4 * max(a[4], b[4]) and apart(a[6], b[6]) <= neardup.APART)
    assert sorted(tuple(x) for x in neardup.searched(df, largest).distinct().collect()) == want and want


def test_rows_with_one_doc_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (2, b), (None, b), (None, "c d e")]
    got = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "c d e"), (1, a), (2, b)]


def test_simhash_keeps_a_component_of_a_shared_doc_id(spark):
    """Unrelated texts under one doc_id both stay, and a row goes whose text is a copy of another's."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (2, b), (None, b), (3, "c d e"), (3, "f g h i")]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (2, b), (3, "c d e"), (3, "f g h i")]
