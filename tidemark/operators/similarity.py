"""Similar pairs of token sets by prefix filtering: two sets that share enough must share one of their rarest tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Tokens of a prefix up to which pairs of them are keys.
MOST_PREFIX = 16


def similar_pairs(sets: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """Pairs (a, b) with a < b of distinct token sets whose Jaccard similarity is at least `least`, above 0.

    Tokens become their ranks by frequency, rarest first, and a set goes out under the ranks of its prefix. Where every
    set is so large that similar ones must share two tokens, and none has more than `MOST_PREFIX` in its prefix, it
    goes out under pairs of them, which are far rarer than the frequent tokens. Two sets meet only if sizes and what is
    left behind their places allow the similarity, and count only at the first tokens that they share: none comes twice,
    and as sets carry their ranks, none is joined back."""
    c = F.col
    s = sets.select(key, F.array_distinct(tokens).alias("_t")).filter(F.size("_t") > 0)
    words = s.select(key, F.explode("_t").alias("_w"))
    counts = words.groupBy("_w").agg(F.count("*").alias("_n"))
    # one row for each distinct token
    ranks = counts.select("_w", F.row_number().over(Window.orderBy("_n", "_w")).alias("_r"))
    ranked = words.join(ranks, "_w").groupBy(key).agg(F.sort_array(F.collect_list("_r")).alias("_t"))
    n = F.size("_t")
    shared = F.ceil(n * least - 1e-9)
    fewest, longest = s.agg(F.min(shared), F.max(n - shared + 2)).first()
    taken = 2 if fewest is not None and fewest >= 2 and longest <= MOST_PREFIX else 1
    out = ranked.withColumn("_pre", F.slice("_t", F.lit(1), (n - shared + taken).cast("int")))
    if taken == 2:
        after = lambda x, i: F.transform(F.slice("_pre", i + 2, F.size("_pre")), lambda y, j: F.struct((x.cast("long") * (1 << 32) + y).alias("_w"), (i + j + 1).alias("_at")))
        out = out.select(key, "_t", F.inline(F.flatten(F.transform("_pre", after))))
    else:
        out = out.select(key, "_t", F.posexplode("_pre").alias("_at", "_w"))
    one, two = out.select("_w", c(key).alias("a"), c("_t").alias("_ta"), c("_at").alias("_pa")), out.select("_w", c(key).alias("b"), c("_t").alias("_tb"), c("_at").alias("_pb"))
    na, nb = F.size("_ta"), F.size("_tb")
    wanted = least / (1 + least) * (na + nb) - 1e-9
    fits = (F.least(na, nb) >= least * F.greatest(na, nb) - 1e-9) & (taken - 1 + F.least(na - c("_pa"), nb - c("_pb")) >= wanted)
    met = one.join(two, "_w").filter((c("a") < c("b")) & fits).withColumn("_both", F.array_intersect("_ta", "_tb"))
    first = F.get("_both", F.lit(0)) if taken == 1 else F.get("_both", F.lit(0)).cast("long") * (1 << 32) + F.get("_both", F.lit(1))
    met = met.filter((first == c("_w")) & (F.size("_both") >= wanted))
    similarity = F.size("_both") / (na + nb - F.size("_both"))
    return met.withColumn("similarity", similarity).filter(c("similarity") >= least).select("a", "b", "similarity")
