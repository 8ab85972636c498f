"""Text, number and JSON helpers."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?%?"


def numbers_in(text: Column) -> Column:
    """The numeric tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def plain_number(token: Column) -> Column:
    """A token without currency, grouping and percent signs, as a double; null if it isn't a number."""
    return F.regexp_replace(token, r"[$,%\s]", "").try_cast("double")


def before_colon(text: Column) -> Column:
    return F.split_part(text, F.lit(":"), F.lit(1))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def short_hash(value, length: int = 16) -> str:
    """The first hex digits of the SHA-256 of a value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:length]


def row_hash(*columns: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, length)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 1 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def log_bucket(v: Column) -> Column:
    return F.bround(F.ln(F.abs(v) + 1) * 3, 0)


def floor_to_step(v: Column, step: float) -> Column:
    return F.floor(v / step + 1e-9) * step


def within_hours(ts: Column, start: str, end: str, zone: str = "UTC") -> Column:
    """Whether the local time of day lies in [start, end), which may cross midnight."""
    local = F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "HH:mm")
    return (local >= start) & (local < end) if start <= end else (local >= start) | (local < end)
