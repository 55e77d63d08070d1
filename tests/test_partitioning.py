"""Results must not depend on the number of shuffle partitions."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402

NAMES = ["q_sample_split_exact", "q_generate_pairs", "q_metric_1nn", "q_masked_halfstep",
         "q_zero_filled_halfstep", "q_topk_per_user", "q_top_items"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_4_16_partitions(spark, sf, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for p in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", p)
            df = E.queries()[name](spark, sf)
            seen.add(digest([tuple(r) for r in df.collect()], df.columns)[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 1
