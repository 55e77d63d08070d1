"""Top-N recommendation of unrated items for one user, and top n per user of scored pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import candidates

NON_ASCII = "[^\\x00-\\x7F]"


def ascii_fold(c: F.Column) -> F.Column:
    """Drop non-ASCII characters."""
    return F.regexp_replace(c, NON_ASCII, "")


def top_n(scored: DataFrame, n: int, pred_col: str = "prediction",
          user_col: str = "user_id", item_col: str = "item_id") -> DataFrame:
    """O1/O2: the n best items per user, 1-based rank, ties by item id.

    A row_number <= n filter over a per-user window is planned with a
    per-partition group limit before the shuffle, so at most n rows per user
    and map partition move.
    """
    w = Window.partitionBy(user_col).orderBy(F.col(pred_col).desc(), F.col(item_col))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def recommend(scorer: Callable[[DataFrame], DataFrame], seen: DataFrame, items: DataFrame,
              user_id: int, n: int = 50) -> DataFrame:
    """J6 candidates -> scorer -> top n -> J5 titles (ASCII folded).

    The n winners come from a top-k (no sort of all candidates); only they are
    numbered and meet the item table, as the broadcast side of an inner join.
    """
    best = [F.col("prediction").desc(), F.col("item_id")]
    top = scorer(candidates(items, seen, user_id)).orderBy(*best).limit(n)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*best)))  # n rows
    titles = items.select("item_id", ascii_fold(F.col("title")).alias("title"))
    return titles.join(F.broadcast(top), "item_id")
