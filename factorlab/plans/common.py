"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources import tables as T


def r6(c) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def r4(c) -> Column:
    return F.round(c if isinstance(c, Column) else F.col(c), 4)


def inter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.inter(spark, sf_dir)


FACT_COLS = ["user_id", "item_id", "rating", "bucket"]


def fact(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The fact join written once as a table, for queries that use it more than once: the four narrow
    columns, and ``more`` where a query shows them (the text row key costs as much as all others)."""
    return cut_lineage(T.inter(spark, sf_dir).select(*FACT_COLS, *more))


def item_mean_scored(i: DataFrame) -> DataFrame:
    """Test rows (bucket >= 8) of a written fact table scored by the item's mean training
    rating, the global training mean where the item has no training row. The global
    mean comes from the per-item sums, not from another pass over the rows (Spark reuses their exchange)."""
    per_item = (i.where(F.col("bucket") < 8).groupBy("item_id")
                .agg(F.sum("rating").alias("s"), F.count(F.lit(1)).alias("n")))
    global_mean = per_item.agg(F.sum("s") / F.sum("n")).scalar()  # scalar subquery
    item_mean = per_item.select("item_id", (F.col("s") / F.col("n")).alias("item_mean"))
    return (i.where(F.col("bucket") >= 8).join(item_mean, "item_id", "left")
            .withColumn("prediction", F.coalesce(F.col("item_mean"), global_mean)).drop("item_mean", "bucket"))


def shifted(scored: DataFrame) -> DataFrame:
    """Predictions moved by -3 .. +3 per user, so that they leave [0, 5] at both ends."""
    return scored.withColumn("prediction", F.col("prediction") + (F.pmod("user_id", F.lit(7)) - 3))


ITEM_MEAN_SCORED_SQL = """train AS (SELECT * FROM inter WHERE bucket < 8),
test AS (SELECT * FROM inter WHERE bucket >= 8),
item_mean AS (SELECT item_id, avg(rating) AS item_mean FROM train GROUP BY item_id),
gm AS (SELECT avg(rating) AS global_mean FROM train),
scored AS (
  SELECT t.row_key, t.user_id, t.item_id, t.rating, coalesce(m.item_mean, g.global_mean) AS prediction
  FROM test t LEFT JOIN item_mean m ON t.item_id = m.item_id CROSS JOIN gm g),
shifted AS (SELECT row_key, user_id, item_id, rating, prediction + (user_id % 7 - 3) AS prediction FROM scored)"""
