"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import html, mixing, packing, quality, rules, simhash, substrings, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, fingerprint string, size int, taken string, score string, html int, start int"
LONG = " ".join(f"w{i % 997} x{i}" for i in range(20_000))
ROWS = [
    (1, "alpha beta gamma " * 30, "en", "a", 1, 7, "x", 0, "t", "s", 1, 1),
    (1, "alpha beta gamma " * 30, "en", "a", 1, 7, "x", 0, "t", "s", 1, 1),
    (2, None, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 0, "", 0, "", "", 0, 0),
    (4, " \t\n\x0b ", "en", "b", 5, 0, "", 0, "", "", 0, 0),
    (None, "one two three four five six", "en", None, 5, 0, "", 0, "", "", 0, 0),
    (None, None, None, "a", None, 0, "", 0, "", "", 0, 0),
    (5, LONG, "en", "c", 9, 0, "", 0, "", "", 0, 0),
    (6, LONG + " end", "en", "c", 9, 0, "", 0, "", "", 0, 0),
    (7, "Ünïcödé space \U0001f600 one two", "fr", "ä", 9, 0, "", 0, "", "", 0, 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def rows(df):
    return df.collect()


def test_rules(docs, none):
    got = rows(rules.apply_policy(rules.ledger(docs)))
    assert len(got) == len(ROWS)
    blank = [r for r in got if r["doc_id"] in (2, 3, 4)]
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in blank)
    assert rows(rules.ledger(none)) == []
    assert rules.filtered(docs).columns == docs.columns


def test_simhash(docs, none):
    got = rows(simhash.near_duplicates(docs))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[4]["fingerprint"] == "0" * 16
    assert {by[k]["component_id"] for k in (2, 3, 4)} == {2}
    assert by[6]["component_id"] == 5
    assert rows(simhash.near_duplicates(none)) == []
    kept = [r["doc_id"] for r in rows(simhash.deduplicated(docs))]
    assert sorted(k for k in kept if k is not None) == [1, 2, 5, 7] and kept.count(None) == 1


def test_substrings(docs, none):
    got = rows(substrings.removed(docs))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[2]["n_words"] == by[2]["n_removed"] == 0 and by[1]["n_removed"] == 90
    assert (by[5]["n_removed"], by[6]["n_removed"]) == (40_000, 40_000)
    assert by[7]["n_removed"] == 0
    assert rows(substrings.removed(none)) == []
    texts = {r["doc_id"]: r["text"] for r in rows(substrings.removed(docs, texts=True)) if r["doc_id"] is not None}
    assert texts[6] == "end" and texts[5] == "" and texts[2] is None and texts[7] == ROWS[9][1]


def test_mixing(docs, none):
    got = rows(mixing.mixed(docs))
    assert len(got) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert rows(mixing.mixed(none)) == []
    assert rows(mixing.mixed_texts(none)) == []
    whole = sum(r["taken"] for r in got)
    assert abs(whole - 1.5 * sum(r["size"] for r in got)) <= 5
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r["text"] or "").encode().split()) for r in rows(mixed)) == whole


def test_packing(docs, none):
    got = rows(packing.packed(docs))
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 1
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 1)
    sizes = {}
    for r in got:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in sizes.values())
    assert rows(packing.packed(none)) == []


def test_classifiers(docs, none, labels):
    for module in (quality, toxicity):
        got = rows(module.scored(docs, labels))
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert rows(module.scored(none, labels)) == []
        assert len(rows(module.scored(docs, labels.filter("false")))) == len(ROWS)


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None, 3), (2, None, "", 3), (None, "u", "<p>x", 3), (3, "u", "<<a <p class='", 3), (4, "u", "<article>" + "<p>word and word</p>" * 20_000, 3)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in rows(html.extracted(pages))}
    assert got[1]["text"] == got[2]["text"] == "" and got[4]["n_chars"] == 20_000 * 14 - 1
    assert rows(html.extracted(pages.filter("false"))) == []


def test_warc(spark):
    same, small = "ä" * 600, "tiny"
    pages = spark.createDataFrame([(1, "http://a/ b\n", same, 1), (2, None, same, 1), (2, "x", same, 1), (None, "y", same, 1), (3, "z", small, 1), (4, "z", small, 1), (5, "n", None, 1)], "page_id long, url string, html string, offset int")
    got = rows(warc.round_trip(pages))
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got) == [(0, "revisit", 2, 1200), (1, "revisit", 2, 1200), (2, "response", 0, 1200), (2, "response", 0, 1200), (3, "response", 0, 4), (4, "response", 0, 4), (5, "response", 0, 0)]
    assert rows(warc.round_trip(pages.filter("false"))) == []
    index = warc.write_archives(pages)
    assert [bytes(r["payload"]).decode() for r in rows(warc.read_records(index.filter("page_id = 3")))] == [small]


def test_topk(spark):
    v = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [float("inf"), 0.0])]
    frame = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(frame, F.col("vec_id") % 50 == 0))), key=str)
    # two rows are query 0, and each has the other as a candidate; the row without vec_id comes last among ties
    zero = [(0, k + 1, i, 65536) for k, i in enumerate((0, 1, 2, 50, None))]
    assert got == sorted([*zero, *zero, *((50, k + 1, i, 65536) for k, i in enumerate((0, 0, 1, 2, None)))], key=str)
    assert rows(topk.top_k(frame.filter("false"), F.col("vec_id") % 50 == 0)) == []


def test_stages(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, none):
            out = stage(spark, d, "")
            assert out.count() >= 0
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == d.columns
