"""Scoring sends no large factor table through the driver."""

import pytest

from factorlab.operators import factors as FA


def _score_plan(spark, rank, n_users, n_items):
    """Plan of scoring with factor tables that are said to have so many rows."""
    f = "array(" + ", ".join(["1.0D"] * rank) + ") as f"
    side = spark.range(4).selectExpr("id", f, "false as cold")
    pairs = spark.range(4).selectExpr("id as user_id", "3 - id as item_id")  # no hot key
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = FA.FactorModel(side, side, [], rank, n_users, n_items).score(pairs)
        assert {(r.user_id, r.item_id, r.prediction) for r in out.collect()} == {
            (i, 3 - i, float(rank)) for i in range(4)}
        return out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rank_32_at_900000_users_is_not_broadcast(spark):
    assert "broadcast" not in _score_plan(spark, 32, 900_000, 1_200_000).lower()


def test_small_factor_tables_are_broadcast(spark):
    assert _score_plan(spark, 4, 15_000, 20_000).lower().count("broadcast") == 2


def test_ranks_1_and_2_at_5400000_users_are_not_broadcast(spark):
    for rank in (1, 2):
        assert "broadcast" not in _score_plan(spark, rank, 5_400_000, 7_200_000).lower()
