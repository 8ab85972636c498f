"""Packing token sequences with bounded space.

Each partition keeps at most `open_windows` windows. A document fills whole windows first; its rest goes to the
open window that it fits best. If it fits none and no further window may open, it is cut: its head fills the
fullest window, which is emitted, and its tail opens the next. What is open at the end of a partition is
stored with its ids and merged with that of neighbouring partitions: concatenated, cut at the window's length,
and the last tokens of a group cut into powers of two, which need no padding.

A text's ids come from a byte-level BPE vocabulary and end with `END`. They are those of tokenizers. Texts of plain
Latin letters without long runs of white space go through tiktoken, which gives the same ids from the same vocabulary
three to five times as fast; all others go through tokenizers itself.

Defined cases: a null or empty text is the one id `END`; a null doc_id is kept; repeated rows are packed each;
long texts are cut; an empty table gives no pieces. The pieces of a partition depend on its rows alone, so a
task that runs again gives the same.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written

LENGTH = 1024
OPEN_WINDOWS = 32
#: Partitions whose leftovers one task merges.
MERGED = 16
END = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = [pa.int64()] * 7
#: Characters on which both libraries' classes of letters, digits and spaces were compared one by one.
_OTHER = re.compile("[^\t\n\r -~¡-ɏ]")
#: A run of white space from which on tiktoken's pattern, which looks ahead, may need too deep a stack.
_RUN = re.compile("[\t\n\r ]{1000}")


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """The files of the vocabulary, for tokenizers and for tiktoken."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


@cache
def _plain(file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


@cache
def _fast(file: str):
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the published pattern of this kind of vocabulary
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def special_tokens(file: str) -> tuple[str, ...]:
    with open(file) as f:
        return tuple(x["content"] for x in json.load(f)["added_tokens"])


def token_ids(text: str | None, files: tuple[str, str], special: tuple[str, ...]) -> np.ndarray:
    """The ids of a text and `END`. A library is loaded by the first text that needs it."""
    text = text or ""
    if _OTHER.search(text) or _RUN.search(text) or any(x in text for x in special):
        ids = _plain(files[0]).encode(text, add_special_tokens=False).ids
    else:
        ids = _fast(files[1]).encode_ordinary(text)
    return np.array([*ids, END], "<u4")


class Packer:
    """Pieces of one partition: (doc_id, start, ids, doc_tokens), in sequences of at most `length` ids."""

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN_WINDOWS):
        self.length, self.most, self.windows, self.done = length, open_windows, [], []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n = len(ids)
        at = n - n % self.length
        self.done += [[(doc_id, k, ids[k : k + self.length], n)] for k in range(0, at, self.length)]
        if at == n:
            return
        rest = n - at
        fits = [w for w in self.windows if w[0] >= rest]  # w: [room, pieces]
        if fits:
            window = min(fits, key=lambda w: w[0])
        elif len(self.windows) < self.most:
            self.windows.append(window := [self.length, []])
        else:
            fullest = min(self.windows, key=lambda w: w[0])
            fullest[1].append((doc_id, at, ids[at : at + fullest[0]], n))
            self.done.append(fullest[1])
            at += fullest[0]
            fullest[:] = [self.length, []]
            window = fullest
        window[1].append((doc_id, at, ids[at:], n))
        window[0] -= n - at
        if not window[0]:
            self.done.append(window[1])
            self.windows.remove(window)

    def emitted(self) -> list:
        done, self.done = self.done, []
        return done


def _rows(sequences: list, first: int) -> list[tuple]:
    rows = []
    for k, pieces in enumerate(sequences):
        offset = 0
        for doc_id, start, ids, n in pieces:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, first + k, offset))
            offset += len(ids)
    return rows


def merged(pieces: list[tuple], length: int = LENGTH) -> list:
    """Leftover pieces as sequences: all full but the last, whose ids go to sequences of powers of two."""
    total = sum(len(p[2]) for p in pieces)
    rooms = [length] * (total // length) + [1 << k for k in range(total.bit_length(), -1, -1) if (total % length) >> k & 1]
    out: list = [[] for _ in rooms]
    k = 0
    for doc_id, start, ids, n in pieces:
        while len(ids):
            take = min(rooms[k], len(ids))
            out[k].append((doc_id, start, ids[:take], n))
            start, ids, rooms[k] = start + take, ids[take:], rooms[k] - take
            k += not rooms[k]
    return out


def packed(docs: DataFrame, files: tuple[str, str] | None = None, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, merge: int = MERGED) -> DataFrame:
    """A row for each piece. A sequence_id is the partition's number and a count; for merged leftovers, with the
    next bit set, the group's."""
    files = files or vocabulary()
    special = special_tokens(files[0])
    names = [c.split()[0] for c in PIECES.split(", ")]
    schema = pa.schema([*zip(names, _TYPES, strict=True), ("left", pa.int32()), ("ids", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, first = Packer(length, open_windows), part << 36
        for batch in lean(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                packer.add(doc_id, token_ids(text.as_py(), files, special))
            done = packer.emitted()
            rows, first = _rows(done, first), first + len(done)
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], schema=schema)
        left = [p for w in packer.windows for p in w[1]]
        if left:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (d, s, len(ids), None, n, part, k), strict=True)) | {"left": part // merge, "ids": ids.tobytes()} for k, (d, s, ids, n) in enumerate(left)], schema)

    def join(key, table):
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        pieces = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"]) for r in table.to_pylist()]
        rows = _rows(merged(pieces, length), 1 << 62 | key[0].as_py() << 36)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)

    made = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, PIECES + ", left int, ids binary"), "pieces")
    full = made.filter("left is null").select(*names)
    return full.unionByName(made.filter("left is not null").groupBy("left").applyInArrow(join, PIECES))
