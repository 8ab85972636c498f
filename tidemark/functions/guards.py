"""Guards on JSON of any depth: keys that must not be there, and times that lie ahead.

JSON becomes VARIANT, and a walk opens one level of all rows at once, for as long as there is a level. Only what holds
something goes on to the next, so the work is that of the values there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Keys that are withheld from prompts, and those that are from reports besides.
PROMPT_KEYS = frozenset("pnl net_pnl gross_pnl profit equity realized_pnl unrealized_pnl day_pnl drawdown drawdown_pct l1_suspended l2_halted l3_killed kill_state kills api_key api_secret secret token".split())
#: Levels beyond which JSON is refused and not walked: Spark's own parser stops before that.
DEEPEST = 1000
ROOT = "context"


def walked(rows: DataFrame, keys: tuple[str, ...], json: str) -> DataFrame:
    """Every value below the root of a JSON text: keys, path, key (null in an array) and value, a VARIANT. Text that is no JSON
    has one row with the path `context` and no value; a null text has none."""
    parsed = rows.filter(F.col(json).isNotNull()).select(*keys, F.try_parse_json(json).alias("value"))
    level = parsed.select(*keys, F.lit(ROOT).alias("path"), F.lit(None).cast("string").alias("key"), "value")
    out = [level.filter("value IS NULL")]
    spark = rows.sparkSession
    for _ in range(DEEPEST):
        held = level.filter(F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"))
        inner = held.select(*keys, F.col("path").alias("_path"), F.col("value").alias("_value")).lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        # an object's members have a key, an array's a position alone
        path = F.concat("_path", F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))))
        level = written(inner.select(*keys, path.alias("path"), "key", "value"), "json-level")
        if level.isEmpty():
            break
        out.append(level)
    else:
        raise ValueError(f"JSON of more than {DEEPEST} levels")
    made = out[0]
    for part in out[1:]:
        made = made.unionByName(part)
    return made


def violations(rows: DataFrame, keys: tuple[str, ...], json: str, forbidden: frozenset[str] = PROMPT_KEYS, until=None) -> DataFrame:
    """keys, path and reason of all that a context may not hold: `forbidden_key` whatever its case and depth, `time_ahead` for
    a text that is a time after `until`, `not_json`."""
    text = F.try_variant_get("value", "$", "string")
    ahead = F.lit(False) if until is None else F.try_to_timestamp(text) > F.lit(until).cast("timestamp")
    bad = F.lower("key").isin(sorted(forbidden))
    reasons = F.array_compact(F.array(F.when(F.col("path") == ROOT, F.lit("not_json")), F.when(bad, F.lit("forbidden_key")), F.when(F.schema_of_variant("value") == "STRING", F.when(ahead, F.lit("time_ahead")))))
    return walked(rows, keys, json).select(*keys, "path", F.explode(reasons).alias("reason"))
