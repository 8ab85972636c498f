"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once for each document and stores the measurements and one bit for each rule
that the document fails. A policy is a version with a mask of the rules that count under it: applying another
version, or asking what one rule alone rejects, reads the ledger and never the text.

Defined cases: a null or blank text has no words, so every count is 0 and the rule `few_words` fails; a null
doc_id is kept as it is; repeated rows each get their row; an empty table gives an empty ledger; further columns
are carried by `filtered` and ignored by `ledger`. Names that begin with an underscore are reserved, as in all
modules of this subpackage.
Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: A position within a document takes the low bits of a sort key; longer texts skip the prefilter.
POSITION_BITS = 24


def _measured(docs: DataFrame) -> DataFrame:
    """Measurements of each text. Repeated windows are found by sorting within the row: keys of hash and
    position first, then the few windows whose key meets an equal one, by their words."""
    mask = (1 << POSITION_BITS) - 1
    w = docs.select("*", words(F.col("text")).alias("_w"), F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    gram = lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    n_grams = F.size("_w") - 2
    keyed = w.withColumn(
        "_keys",
        F.when(
            (n_grams > 0) & (n_grams <= mask),
            F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n_grams - 1, F.lit(0))), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))),
        ),
    )
    high = lambda x: F.shiftright(x, POSITION_BITS)
    near = lambda a, x, j, same: same(F.get(a, j - 1), x) | same(F.get(a, j + 1), x)
    suspects = keyed.withColumn(
        "_suspects",
        F.when(n_grams > mask, F.sequence(F.lit(0), n_grams - 1)).when(
            n_grams > 0,
            F.transform(F.filter("_keys", lambda x, j: near("_keys", x, j, lambda y, z: F.coalesce(high(y) == high(z), F.lit(False)))), lambda x: x.bitwiseAND(F.lit(mask)).cast("int")),
        ),
    )
    sorted_ = suspects.withColumn("_grams", F.sort_array(F.transform("_suspects", lambda i: F.struct(gram(i).alias("g"), i.alias("i")))))
    at = sorted_.withColumn("_at", F.sort_array(F.transform(F.filter("_grams", lambda x, j: near("_grams", x, j, lambda y, z: F.coalesce(y["g"] == z["g"], F.lit(False)))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return at.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda x, j: F.coalesce(F.get("_w", j + 1) == x, F.lit(False)))).cast("long").alias("n_adjacent"),
    ).drop("_w", "_lines", "_keys", "_suspects", "_grams", "_at")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_adjacent"]


def rules() -> list[tuple[str, Column]]:
    """Each rule is true where a document fails it; its place is its bit. Rules are only ever added at the end."""
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 100 * c("n_symbols") > 10 * c("n_words")),
        ("repeated_lines", 100 * c("n_dup_lines") > 60 * c("n_lines")),
        ("short_words", c("word_chars") < 2 * c("n_words")),
        ("long_words", c("word_chars") > 20 * c("n_words")),
        ("adjacent_words", 100 * c("n_adjacent") > 30 * c("n_words")),
    ]


@dataclass(frozen=True)
class Policy:
    """The rules that count under a version."""

    version: str
    counted: tuple[str, ...]

    @property
    def mask(self) -> int:
        return bits(*self.counted)


def bits(*names: str) -> int:
    places = {name: k for k, (name, _) in enumerate(rules())}
    return sum(1 << places[name] for name in names)


BASE = Policy("base", ("few_words", "repeated_windows"))
DEFAULT = Policy("v1", ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "adjacent_words"))


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each document: `keep` columns of docs, the measurements, and `fail_bits`."""
    keep = keep or ("doc_id",)
    measured = _measured(docs.select(*dict.fromkeys([*keep, "text"])))
    failed = sum((F.when(rule, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(rules())), F.lit(0).cast("long"))
    return measured.select(*keep, *MEASURES, failed.alias("fail_bits"))


def apply_policy(ledger_: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with `base_failed` and `kept` under the policy; what the base fails is never kept."""
    fails = lambda p: F.col("fail_bits").bitwiseAND(F.lit(p.mask).cast("long")) != 0
    return ledger_.withColumn("base_failed", fails(BASE)).withColumn("kept", ~(fails(BASE) | fails(policy)))


def ablations(ledger_: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each counted rule: documents that fail it, and those that would be kept without it.

    The bits meet in one aggregation: equal masks are counted first, so that its input is at most two to the
    power of the number of rules."""
    masks = ledger_.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    one = masks.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(rules()) if name in policy.counted))).alias("r"), "m", "n").select("r.*", "m", "n")
    return one.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.bit_or("m").alias("seen_bits"),
    ).select(F.lit(policy.version).alias("version"), "rule", "n_failed", "n_only_this", "seen_bits")


def filtered(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The documents that the policy keeps, with the columns they came with."""
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "text")
    # without the observation in between, the filter would move below the measurements and compute each of them
    # again for every rule that reads it
    known = ledger(whole, "_doc").observe("rule ledger", F.count(F.lit(1)).alias("documents"))
    return apply_policy(known, policy).filter("kept").select("_doc.*")
