"""Exact removal of repeated word spans, by a compacted de Bruijn graph.

The windows of `window` words are the edges of a de Bruijn graph over a corpus, and a repeated span is a path of
edges that occur more than once. Listing every edge would shuffle the whole corpus many times over, so edges leave a
task in groups: each window has an anchor, the least-hashed run of `gram` words in it, and consecutive windows with the
same anchor are one piece, given by its source coordinates and a digest of all its words there. Equal windows have
equal anchors, so only pieces whose anchor occurs again can hold a repeated edge.

Joins by anchor keep those. A piece that occurs again as a whole is repeated with all its edges; where an anchor has
several distinct pieces, which is where copies part or meet, the edges of one occurrence of each are listed one by
one, with digests of the words at their coordinates. That gives the graph of repeated edges alone. It is compacted by
joins: what follows each edge or piece is known from coordinates, and where all occurrences of one are followed by the
same other, which has no occurrence besides, nothing branches and the two are one path. Of a path only its head's
occurrences are joined back to the documents, with the whole path's length.

Equality rests on BLAKE2 digests of 96 bits of the words themselves, never on the rolling hashes, which only choose
anchors. Counts are aggregated before shuffles, and no step holds all occurrences of an anchor. Texts without a repeated
span are left out of the joins by a bitmap of fixed size, which never leaves out one with a span.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a window that overlaps its own
repetition counts as repeated; repeated rows are copies of each other; rows are told apart by doc_id, null or not,
and text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, may_hold, written

WINDOW = 35
GRAM = 8
#: The odd multiplier of the rolling hash.
_M1 = 0x9E3779B97F4A7C15
#: Bytes of the digests, and how they are stored.
DIGEST, _STORED = 12, np.dtype([("u", "<i8"), ("s", "<i4")])
_CACHED = 1 << 16
#: Rows of window hashes after which a batch goes to Spark.
WINDOWS_A_BATCH = 1 << 16
_SPLIT = re.compile(rb"([ \t\n\x0b\x0c\r]+)")


class _Hashes(dict):
    """Word hashes as they are met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _powers(m: int, n: int) -> np.ndarray:
    out = np.full(n, m, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Rolling hashes of word sequences: sums of word hashes times powers of a multiplier, modulo two to the 64."""

    def __init__(self, m: int):
        self.m, self.inverse, self.powers, self.back = m, pow(m, -1, 1 << 64), np.ones(0, np.uint64), np.ones(0, np.uint64)

    def sums(self, h: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(h):
            n = 2 * len(h) + 1
            self.powers, self.back = _powers(self.m, n), _powers(self.inverse, n)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.powers[: len(h)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, starts, ends) -> np.ndarray:
        """Hashes of the words from starts up to ends, mixed."""
        x = (sums[ends] - sums[starts]) * self.back[starts]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def pieces(h: np.ndarray, roller: Roller, window: int = WINDOW, gram: int = GRAM):
    """Anchor hash, first window and number of windows of each piece of a text with word hashes h."""
    n = len(h) - window + 1
    sums = roller.sums(h)
    at = np.arange(len(h) - gram + 1)
    grams = roller.of(sums, at, at + gram)
    wide = window - gram + 1
    places = np.concatenate([k + np.lib.stride_tricks.sliding_window_view(grams[k : k + (1 << 15) + wide - 1], wide).argmin(axis=1) + np.arange(min(1 << 15, n - k)) for k in range(0, n, 1 << 15)])
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return grams[places[first]].view(np.int64), first, np.diff(np.append(first, n))


def digests(words: list[bytes], first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of the words from each first up to each end, joined by spaces."""
    text, ends, blake = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)]), hashlib.blake2b
    made = [blake(text[a:b], digest_size=DIGEST).digest() for a, b in zip(ends[first].tolist(), (ends[end] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(made), _STORED)


def _word_hashes(words: list[bytes], known: _Hashes) -> np.ndarray:
    return np.array([known[w] for w in words], np.uint64)


def _tied(docs: DataFrame, *columns: str) -> DataFrame:
    """The text with what tells a row from others: doc_id and the text's hash."""
    return docs.select(*columns, F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_tie"), F.coalesce("text", F.lit("")).alias("_text"))


def _batch(columns: list[list], schema: pa.Schema, plain: int) -> pa.RecordBatch:
    """Arrays that came text by text as one batch; column `plain` came row by row."""
    return pa.RecordBatch.from_arrays([pa.array(x if k == plain else np.concatenate(x), schema.types[k]) for k, x in enumerate(columns)], schema=schema)


def all_pieces(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, anchor_bits: int = 64) -> DataFrame:
    """`anchor`, the digest (u, s), the row's key, `first` and `n` of each piece of each text."""
    schema = pa.schema([("anchor", pa.int64()), ("u", pa.int64()), ("s", pa.int32()), ("_id", pa.int64()), ("_tie", pa.int64()), ("first", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, known = Roller(_M1), _Hashes()
        for batch in lean(batches):
            out: list[list] = [[] for _ in schema]
            for id_, tie, text in zip(batch.column("_id").to_pylist(), batch.column("_tie").to_pylist(), batch.column("_text"), strict=True):
                words = text.as_py().encode().split()
                if len(words) >= window:
                    anchors, first, n = pieces(_word_hashes(words, known), roller, window, gram)
                    seal = digests(words, first, first + n + window - 1)
                    for k, x in zip((0, 1, 2, 4, 5, 6), (anchors >> (64 - anchor_bits), seal["u"], seal["s"], np.full(len(first), tie, np.int64), first, n), strict=True):
                        out[k].append(x)
                    out[3] += [id_] * len(first)
            if out[0]:
                yield _batch(out, schema, 3)

    return _tied(docs).mapInArrow(run, "anchor long, u long, s int, _id long, _tie long, first int, n int")


def _windows(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The digests of the windows of the given pieces, from the source text; `alone` as the piece says."""
    schema = pa.schema([("u", pa.int64()), ("s", pa.int32()), ("_id", pa.int64()), ("_tie", pa.int64()), ("first", pa.int32()), ("alone", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            out: list[list] = [[] for _ in schema]
            for id_, tie, text, spans_ in zip(batch.column("_id").to_pylist(), batch.column("_tie").to_pylist(), batch.column("_text"), batch.column("spans"), strict=True):
                words = text.as_py().encode().split()
                first, n, alone = (x.to_numpy(zero_copy_only=False) for x in spans_.values.flatten())
                at = np.repeat(first.astype(np.int64) - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                seal = digests(words, at, at + window)
                for k, x in zip((0, 1, 3, 4, 5), (seal["u"], seal["s"], np.full(len(at), tie), at.astype(np.int32), np.repeat(alone, n)), strict=True):
                    out[k].append(x)
                out[2] += [id_] * len(at)
                if len(out[2]) >= WINDOWS_A_BATCH:
                    yield _batch(out, schema, 2)
                    out = [[] for _ in schema]
            if out[0]:
                yield _batch(out, schema, 2)

    grouped = written(spans.groupBy("_id", "_tie").agg(F.collect_list(F.struct("first", "n", "alone")).alias("spans")), "open-spans")
    # a row that repeats another is read for each, and rightly: all its windows are repeated
    texts = may_hold(_tied(docs), grouped, "_id", "_tie").filter("_may")
    met = texts.join(grouped, texts["_id"].eqNullSafe(grouped["_id"]) & (texts["_tie"] == grouped["_tie"])).select(texts["_id"], texts["_tie"], "_text", "spans")
    return met.mapInArrow(run, "u long, s int, _id long, _tie long, first int, alone boolean")


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, anchor_bits: int = 64) -> DataFrame:
    """The occurrences of repeated pieces and edges: digest (u, s), the row's key, `first` and `n`."""
    every = written(all_pieces(docs, window, gram, anchor_bits), "pieces")
    # counts are written before they are joined: a join whose one side comes straight from an aggregation can't be
    # split where an anchor is very frequent
    again = written(every.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "repeated-anchors")
    kept = written(every.join(again, "anchor", "left_semi"), "kept-pieces")
    distinct = kept.groupBy("anchor", "u", "s").agg(F.count("*").alias("c"), F.min(F.struct("_id", "_tie", "first", "n")).alias("at"))
    distinct = written(distinct, "distinct-pieces")
    whole = kept.join(distinct.filter("c > 1").select("u", "s"), ["u", "s"], "left_semi").select("u", "s", "_id", "_tie", "first", "n")
    parting = written(distinct.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "parting-anchors")
    open_ = distinct.join(parting, "anchor", "left_semi").select("at.*", (F.col("c") == 1).alias("alone"))
    windows = written(_windows(docs, open_, window), "windows")
    twice = written(windows.groupBy("u", "s").agg(F.count("*").alias("c")).filter("c > 1").select("u", "s"), "repeated-windows")
    # edges of pieces that are repeated as a whole are there already
    edges = windows.filter("alone").join(twice, ["u", "s"], "left_semi").select("u", "s", "_id", "_tie", "first", F.lit(1).alias("n"))
    return whole.unionByName(edges)


def compacted(occurrences: DataFrame) -> DataFrame:
    """Occurrences as nonbranching paths: the row's key, `first` and `last` window. What `first` and `n` cover is
    what the given occurrences cover."""
    c = F.col
    by_place = Window.partitionBy("_id", "_tie").orderBy("first")
    # equal rows have equal occurrences, of which one says it all
    placed = occurrences.repartition("_id", "_tie").dropDuplicates(["_id", "_tie", "first"])
    follows = F.when(F.lead("first").over(by_place) == c("first") + c("n"), F.lead("u").over(by_place))
    placed = written(placed.withColumn("next", follows), "occurrences")
    units = placed.groupBy("u", "s").agg(F.count("*").alias("c"), F.count("next").alias("cn"), F.min("next").alias("next"), F.max("next").alias("most"), F.min(F.struct("_id", "_tie", "first", "n")).alias("at"))
    units = written(units.select("u", "s", "c", F.when((c("cn") == c("c")) & (c("next") == c("most")), c("next")).alias("next"), "at.*"), "units")
    # u is always followed by v, and v occurs no more often: so v is always preceded by u
    u = units.filter(c("next").isNotNull()).select(c("next").alias("u"), c("c").alias("_c"), c("_id").alias("_i"), c("_tie").alias("_t"), (c("first") + c("n")).alias("_f"))
    inner = written(units.join(u, "u").filter((c("c") == c("_c")) & c("_id").eqNullSafe(c("_i")) & (c("_tie") == c("_t")) & (c("first") == c("_f"))).select("u", "s", F.lit(0).alias("head")), "inner-units")
    # the first occurrences of a path's units lie side by side in one text
    flagged = units.join(inner, ["u", "s"], "left").withColumn("head", F.coalesce("head", F.lit(1)))
    runs = flagged.withColumn("path", F.sum("head").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    heads = runs.groupBy("_id", "_tie", "path").agg(F.min_by(F.struct("u", "s"), "first").alias("head"), F.sum("n").cast("int").alias("length"))
    heads = written(heads.select("head.*", "length"), "paths")
    return placed.join(heads, ["u", "s"]).select("_id", "_tie", "first", (c("first") + c("length") - 1).alias("last"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, anchor_bits: int = 64) -> DataFrame:
    """`_id`, `_tie` and `_spans`, the first words and last windows' first words of repeated stretches, for each
    row that has any."""
    found = compacted(repeated(docs, window, gram, anchor_bits))
    return found.groupBy("_id", "_tie").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))


def _covered(n: int, spans, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    if spans is not None:
        first, last = (x.to_numpy(zero_copy_only=False) for x in spans.flatten())
        np.add.at(edge, first, 1)
        np.add.at(edge, last + window, -1)
    return np.cumsum(edge[:n]) > 0


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False, anchor_bits: int = 64) -> DataFrame:
    """The columns of docs with n_words, n_removed and kept_sha256; with `texts`, instead of these, `text` as
    what is left of it: a text that loses nothing as it was, else without the removed words and the white space
    before them. `n_chars`, where docs has it, follows the text."""
    c = F.col
    spans = written(repeated_spans(docs, window, gram, anchor_bits), "spans")
    names = docs.columns
    tied = may_hold(_tied(docs, *names).drop(*([] if texts else ["text"])), spans, "_id", "_tie")
    some = tied.filter("_may").join(spans.withColumnsRenamed({"_id": "_i", "_tie": "_t"}), c("_id").eqNullSafe(c("_i")) & (c("_tie") == c("_t")), "left")
    met = some.select(*tied.columns, "_spans").unionByName(tied.filter("not _may").withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            rows = []
            for text, found in zip(batch.column("_text"), batch.column("_spans"), strict=True):
                words = text.as_py().encode().split()
                covered = _covered(len(words), found.values, window)
                left = b" ".join([w for w, x in zip(words, covered.tolist(), strict=True) if not x] if found.is_valid else words)
                rows.append((len(words), int(covered.sum()), hashlib.sha256(left).hexdigest()))
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=[*keep, "n_words", "n_removed", "kept_sha256"])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            out = []
            for text, found in zip(batch.column("text"), batch.column("_spans"), strict=True):
                if found.is_valid:
                    parts = _SPLIT.split(text.as_py().encode())
                    lead = 0 if parts[0] else 2
                    covered = _covered(len(parts[lead::2]) - (not parts[-1]), found.values, window)
                    kept = [(parts[lead + 2 * k - 1] if lead + 2 * k else b"", parts[lead + 2 * k]) for k, x in enumerate(covered.tolist()) if not x]
                    out.append(b"".join(x + w for x, w in kept).strip().decode())
                else:
                    out.append(text.as_py())
            arrays = {c: batch.column(c) for c in names} | {"text": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    if texts:
        made = met.select(*names, "_spans").mapInArrow(rest, docs.schema)
        return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else made
    keep = [c for c in names if c not in ("text", "n_words", "n_removed", "kept_sha256")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return met.select(*keep, "_text", "_spans").mapInArrow(digest, f"{kinds}, n_words long, n_removed long, kept_sha256 string")
