"""The driver-table views must reach every behaviour that the queries are meant to show."""

import pytest
from pyspark.sql import functions as F

from factorlab.operators.features import GENRE_COLS, genre_flags
from factorlab.operators.relational import clip
from factorlab.plans.common import fact, item_mean_scored, shifted
from factorlab.sources import tables as T


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_every_behaviour_occurs(spark, scale):
    d = f"/root/testdata/{scale}"
    i = fact(spark, d)
    items, users = T.items(spark, d), T.users(spark, d)
    train, test = i.where("bucket < 8"), i.where("bucket >= 8")
    scored = item_mean_scored(i)
    moved = shifted(scored)
    residual = F.floor(F.col("rating") - F.col("prediction"))
    n_items = T.table(spark, d, "part").count()
    flags = genre_flags(items).agg(*[F.sum(c).alias(c) for c in GENRE_COLS]).first()
    counts = {
        "ratings of 0": i.where("rating = 0").count(),
        "masked ratings above 0": i.where("rating > 0 and rating <= 0.5").count(),
        "items without a dimension row": i.join(items, "item_id", "left_anti").count(),
        "users without a dimension row": i.join(users, "user_id", "left_anti").count(),
        "ids at the edge of their range": i.where(f"item_id >= {n_items} - 2").count(),
        "cold items": test.join(train, "item_id", "left_anti").count(),
        "cold users": test.join(train, "user_id", "left_anti").count(),
        "predictions below 0": moved.where("prediction < 0").count(),
        "predictions above 5": moved.where("prediction > 5").count(),
        "corrections clipped again": moved.where(clip(F.col("prediction")) > 4.9).count(),
        "residuals in the first bin": moved.where(residual <= -4).count(),
        "residuals in the last bin": moved.where(residual >= 4).count(),
        "truth without prediction": scored.where("item_id % 10 = 3").count(),
        "titles to fold": items.where("title rlike '[^\\\\x00-\\\\x7F]'").count(),
        "zip codes that do not parse": users.where(F.substring("zip", 1, 5).try_cast("bigint").isNull()).count(),
        "aliases met": i.where("item_id % 10 = 7").count(),
        "personal ratings": T.personal(spark, d).count(),
        "rarest genre": min(flags),
    }
    assert all(n > 0 for n in counts.values()), counts
