"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with per-query wall seconds.

Every query is executed in full through the no-op sink (nothing collected).
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_dataset_summary",
    "q_baseline_rmse",
    "q_masked_halfstep",
    "q_zero_filled_als",
    "q_masked_als",
    "q_explicit_als",
    "q_implicit_als",
    "q_top_items",
    "q_recommend_als",
    "q_feature_table",
    "q_generate_pairs",
    "q_metric_learning",
    "q_metric_1nn",
    "q_sample_split_exact",
    "q_topk_per_user",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from factorlab.session import build_session
    from factorlab.plans import all_queries
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = all_queries()
    # warm up the JVM and the Python workers once, untimed
    qs["q_bucket_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 64, 1, int(cpus)).mapInPandas(lambda it: it, "id long").write.format(
        "noop").mode("overwrite").save()
    from factorlab.session import cut_lineage
    from pyspark.sql import functions as F
    cut_lineage(spark.range(0, 64, 1, int(cpus)).withColumn("b", F.col("id") % 4),
                partition_by=["b"]).count()
    times = {}
    for name in names:
        # untimed: each query starts without cached data left by the previous one
        spark.catalog.clearCache()
        gc.collect()
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_wall_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
