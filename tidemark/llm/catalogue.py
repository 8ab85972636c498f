"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, html, lblm, mixing, negatives, packing, quality, rules, simhash, substrings, topk, toxicity, warc
from .common import table


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op3_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_score_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0).drop("positive")


def op12_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_bucketed_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT r, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, i, len(w) AS n, CASE WHEN i + 2 <= len(w) THEN count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2], i + 2 <= len(w)) ELSE 0 END AS c, coalesce(w[i] = w[i + 1], false) AS adjacent FROM p),
v AS (SELECT r, count(*) FILTER (WHERE most >= 2) AS n_repeat, count(*) FILTER (WHERE adjacent) AS n_adjacent FROM (SELECT r, adjacent, max(c) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS most FROM g) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_lines - n_distinct, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(n_adjacent, 0) AS n_adjacent FROM d LEFT JOIN l USING (r) LEFT JOIN v USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 60 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_adjacent > 30 * n_words) AS kept
FROM b
"""


_OP2 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS rank
  FROM (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v AS q JOIN v AS c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0))
WHERE rank <= 5
"""

_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS c FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
m AS (SELECT r, i, w[i] AS word, max(coalesce(c, 0)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 1 AS gone FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) LEFT JOIN s USING (r, i)),
k AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

_OP10 = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN refers THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN refers THEN keeper END AS refers_to
FROM (SELECT *, octet_length(encode(coalesce(html, ''))) >= 1000 AND page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL AS refers FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages))
"""

_OP11 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS q, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS alike, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v AS a JOIN v AS c ON c.r <> a.r AND len(c.v) = len(a.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s WHERE alike) WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.q, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM p JOIN s AS n ON n.q = p.q AND NOT n.alike AND 80 * p.score::HUGEINT <= 100 * n.score::HUGEINT AND n.score <= p.score)
WHERE rank <= 5
"""

_OP13 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
t AS (SELECT lang, unnest(w) AS a, unnest(list_concat(w[2:], [NULL])) AS b, unnest(list_concat(w[3:], [NULL, NULL])) AS c FROM w WHERE len(w) > 0),
f AS MATERIALIZED (SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM t WHERE a IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM t WHERE b IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM t WHERE b IS NOT NULL AND c IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
c AS (SELECT g.*, unnest(range(1, k)) AS cut FROM g),
s AS (SELECT c.lang, c.k, c.phrase, c.a, l.f AS l, r.f AS r, CAST((1000000 * c.a::HUGEINT * c.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score, row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000000 * c.a::HUGEINT * c.a) // (l.f::HUGEINT * r.f), c.cut) AS least
  FROM c JOIN f AS l ON l.lang || chr(9) || l.phrase = c.lang || chr(9) || array_to_string(c.w[1:c.cut], ' ') JOIN f AS r ON r.lang || chr(9) || r.phrase = c.lang || chr(9) || array_to_string(c.w[c.cut + 1:], ' ')),
o AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS most FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM g WHERE k = 3) GROUP BY ALL),
x AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM s LEFT JOIN o ON s.k = 2 AND o.lang = s.lang AND o.phrase = s.phrase WHERE least = 1 AND (o.most IS NULL OR 100 * o.most < 50 * s.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM x JOIN n USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mtree_topk": _OP2, "op6_rule_ledger": _OP6, "op8_substring_dedup": _OP8, "op10_indexed_warc": _OP10, "op11_score_sort_negatives": _OP11, "op13_bucketed_collocations": _OP13}
