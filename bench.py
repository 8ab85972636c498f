"""Times the headline queries; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans import catalogue

HEADLINE = ["ohlcv_1h", "ohlcv_5m", "sma_20", "realized_vol_24", "zscore_20", "vwap_dist", "ema_14", "adx_14", "asof_value", "frame_projection_1h_on_5m", "liq_cluster_above", "funding_cost_interval", "cross_and_predicates", "regime_labels", "coverage_summary", "quality_flags", "as_of_read", "dedupe_natural_key", "trading_summary", "drift_reconcile", "calibration", "walk_forward", "max_drawdown", "row_count_parity", "jaccard_pairs", "replay_trades"]


def main():
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    queries["ohlcv_1h"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
