"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage_observed, drop_table, table_path


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id on an edge (columns ``u``, ``v``), component being
    the smallest id reachable.

    Each round links the larger neighbours of every node to its smallest
    neighbour, then the smaller ones; both are joins with a per-node minimum,
    so a node with very many neighbours is one row on one side of a join that
    Spark may split. Rounds are written as tables until the edges are stars.
    """
    spark = edges.sparkSession

    def write(e: DataFrame):
        stats = [F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
        out, got = cut_lineage_observed(e.where("u > v").distinct(), stats)
        return out, (got["n"], got["h"])

    e, state = write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))))
        new, now = write(small)
        old, same = table_path(e), now == state
        e, state = new, now
        drop_table(spark, old)
        if same:
            break
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
