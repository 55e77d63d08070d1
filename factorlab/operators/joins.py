"""Join helpers: a checked broadcast bound and a split join for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A factor side is broadcast only when rows x bytes-per-row is under this
# bound; above it the join becomes a split join (hot keys against a broadcast
# of their own rows, all other keys through a shuffle join). The driver builds a
# broadcast and holds it several times over (rows, table, blocks).
DEFAULT_BROADCAST_MAX_BYTES = 16 * 1024 * 1024


def factor_row_bytes(rank: int) -> int:
    # id (8) + array header (16) + rank doubles + row overhead
    return 8 + 16 + 8 * rank + 16


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys_from_counts(counts: DataFrame, key: str, count_col: str, total: int,
                         parts: int) -> list:
    """Keys whose row count exceeds total / (2 * parts): such a key alone would
    fill more than half a shuffle partition. There can be at most 2 * parts of
    them, so the list is a proven-small driver value. NULL is no key: it meets
    nothing in an equi-join."""
    thr = max(1, total // (2 * parts))
    rows = counts.where(F.col(key).isNotNull() & (F.col(count_col) > thr)).select(key).collect()
    return sorted(r[0] for r in rows)


def hot_keys(df: DataFrame, key: str, parts: int | None = None) -> list:
    """Hot keys of ``df`` (one aggregate job with map-side partial counts)."""
    parts = parts or shuffle_parts(df)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return hot_keys_from_counts(counts, key, "_n", total, parts)


def split_join(big: DataFrame, small: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Equi-join that keeps hot keys out of the shuffle.

    ``small`` must have at most one row per key. Rows of ``big`` with a hot key
    join a broadcast of ``small`` restricted to the hot keys (at most
    len(hot) rows: a proven bound); all other rows take a normal shuffle join,
    where no key exceeds the hot threshold.
    """
    if not hot:
        return big.join(small, key, how)
    # The hot keys are a small broadcast table, not an IN list in the plan.
    spark = big.sparkSession
    keys = F.broadcast(spark.createDataFrame([(k,) for k in hot],
                                             big.select(key).schema).withColumn("_hot", F.lit(True)))
    tagged = big.join(keys, key, "left")
    hot_small = F.broadcast(small.join(keys.drop("_hot"), key, "left_semi"))
    hot_part = tagged.where("_hot").drop("_hot").join(hot_small, key, how)
    # rows with a NULL key stay here, so a left join keeps them
    cold_part = tagged.where("_hot is null").drop("_hot").join(small, key, how)
    return hot_part.unionByName(cold_part)
