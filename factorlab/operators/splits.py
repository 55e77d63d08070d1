"""Time-bucket splits, exact and hashed sampling splits, duplicate policies,
and exact global row numbering without a single-task window."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash01
from ..session import cut_lineage, cut_lineage_observed


def with_bucket(df: DataFrame, ts_col: str = "ts", out: str = "bucket") -> DataFrame:
    """bucket = ts mod 10 (non-negative)."""
    return df.withColumn(out, F.pmod(F.col(ts_col), F.lit(10)).cast("int"))


def split_label(bucket: F.Column, edges: tuple[int, int] = (6, 8)) -> F.Column:
    """Bucket < 6 train, 6..7 validation, >= 8 test."""
    lo, hi = edges
    return (F.when(bucket < lo, "train").when(bucket < hi, "validation").otherwise("test"))


def split_by_bucket(df: DataFrame, edges: tuple[int, int] = (6, 8),
                    bucket_col: str = "bucket") -> DataFrame:
    """Adds a ``split`` column in one pass (no three separate scans)."""
    return df.withColumn("split", split_label(F.col(bucket_col), edges))


def train_test(df: DataFrame, edge: int = 8, bucket_col: str = "bucket"):
    """(bucket < edge, bucket >= edge)."""
    return df.where(F.col(bucket_col) < edge), df.where(F.col(bucket_col) >= edge)


def overlapping_split(df: DataFrame, bucket_col: str = "bucket"):
    """P4 (diagnostic): train = bucket < 8, validation = 6..7 (inside train)."""
    b = F.col(bucket_col)
    return df.where(b < 8), df.where((b >= 6) & (b < 8))


def dedupe(df: DataFrame, keys=("user_id", "item_id"), value: str = "rating",
           policy: str = "mean", order_cols=("day", "row_key")) -> DataFrame:
    """Collapse duplicate (user, item) rows: mean | sum | last (max_by on order)."""
    keys = list(keys)
    if policy == "mean":
        agg = F.avg(value)
    elif policy == "sum":
        agg = F.sum(value)
    elif policy == "last":
        agg = F.max_by(value, F.struct(*[F.col(c) for c in order_cols]))
    else:
        raise ValueError(f"unknown duplicate policy {policy!r}")
    return df.groupBy(*keys).agg(agg.cast("double").alias(value))


def index_rows_total(df: DataFrame, order_cols: list, pos_col: str = "pos"):
    """Exact 0-based position of every row under a total order, and the row
    count.

    A global range-partitioned sort written once as a table (which fixes the
    partition layout), then per-partition row counts: one number per
    partition reaches the driver, and the offsets enter the plan as a literal
    array indexed by partition id. No unpartitioned window and no join.
    """
    ordered = (df.orderBy(*order_cols)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = cut_lineage(ordered)
    counts = {r["_pid"]: r["_n"] for r in
              ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect()}
    rows, acc = [], 0
    for pid in sorted(counts):
        rows.append((pid, acc))
        acc += counts[pid]
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, "_pid int, _off bigint"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    out = (ordered.join(offsets, "_pid").withColumn(pos_col, (F.col("_off") + local).cast("bigint"))
           .select(*df.columns, pos_col))
    return out, acc


HEX_PER_PASS = 4  # 2^16 counts at most reach the driver in a pass


def rank_prefix(df: DataFrame, hcol: str, k: int) -> tuple[str, int, int]:
    """Where the k-th smallest (1-based) value of a lowercase hex hash column lies,
    found without sorting the rows: (prefix, rows below the prefix, rows under it).

    Each pass counts rows per next four hex digits under the prefix chosen so far
    and stops as soon as the prefix holds one row, or at the end of the hash.
    """
    width = 32
    prefix, below, inside = "", 0, None
    while len(prefix) < width and inside != 1:
        part = df.where(F.substring(F.col(hcol), 1, len(prefix)) == prefix) if prefix else df
        counts = sorted((r[0], r[1]) for r in part.groupBy(
            F.substring(F.col(hcol), len(prefix) + 1, HEX_PER_PASS).alias("_d"))
            .agg(F.count(F.lit(1))).collect())
        for digits, c in counts:
            if below + c >= k:
                prefix, inside = prefix + digits, c
                break
            below += c
        else:
            raise ValueError("k exceeds the number of rows")
    return prefix, below, inside


def sample_split_exact(df: DataFrame, key_col: str = "row_key", frac: float = 0.9,
                       seed: int = 1992):
    """P5 exact: the round(frac*N) rows with the smallest md5(seed:key) form
    the first part, the rest the second (the anti-join complement, J7).

    Rows that share the boundary key are ordered by a second hash over all their
    columns; rows equal in every column are told apart by count alone. The
    hash projection is written once (its row count observed during the
    write); the boundary is found by :func:`rank_prefix`, and the parts are
    filters on it: no sort and no shuffle of the rows.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key_col)))
    keyed, m = cut_lineage_observed(df.withColumn("_h", h), [F.count(F.lit(1)).alias("n")])
    n = m["n"]
    k = int(math.floor(frac * n + 0.5))
    columns = df.columns

    def parts(rows: DataFrame, hcol: str, k: int, total: int):
        """Filters (first, second) of ``rows`` at rank k, or frames where rows are equal."""
        if k <= 0 or k >= total:
            return rows if k > 0 else rows.where("false"), rows if k <= 0 else rows.where("false")
        prefix, below, inside = rank_prefix(rows, hcol, k)
        head = F.substring(F.col(hcol), 1, len(prefix))
        first, second = rows.where(head < prefix), rows.where(head > prefix)
        edge, rest = rows.where(head == prefix), k - below
        if rest == inside:
            return first.unionByName(edge), second
        if hcol == "_h":
            full = F.md5(F.to_json(F.struct(*[F.col(c) for c in columns])))
            a, b = parts(edge.withColumn("_h2", full), "_h2", rest, inside)
            a, b = a.drop("_h2"), b.drop("_h2")
        else:
            a, b = edge.limit(rest), edge.limit(inside - rest)  # equal in every column
        return first.unionByName(a), second.unionByName(b)

    first, second = parts(keyed, "_h", k, n)
    return first.select(*columns), second.select(*columns)


def complement(df: DataFrame, part: DataFrame, key_col: str = "row_key") -> DataFrame:
    """Rows of ``df`` whose key is not in ``part`` (left anti-join)."""
    return df.join(part.select(key_col), key_col, "left_anti")


def in_first(key_col: str, frac: float = 0.9, seed: int = 1992) -> F.Column:
    """P5 scale path: does a row's independent hash fall under the share ``frac``."""
    return hash01(F.concat_ws(":", F.lit(str(seed)), F.col(key_col))) < frac


def sample_split_hash(df: DataFrame, key_col: str = "row_key", frac: float = 0.9,
                      seed: int = 1992):
    """P5 scale path: independent per-row hash threshold (approximate sizes)."""
    first = in_first(key_col, frac, seed)
    return df.where(first), df.where(~first)
