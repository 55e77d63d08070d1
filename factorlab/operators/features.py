"""Feature table for the neighbour / forest / cluster rating predictors:
genre flags by substring test, gender flag, zip prefix, global L2
normalisation, all as one DataFrame pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Fixed values (must equal the reference): flag column name and the substring
# searched in the genre string, in the reference's order.
GENRE_FLAGS = [
    ("Action", "Action"),
    ("Adventure", "Adventure"),
    ("Animation", "Animation"),
    ("Children", "Children's"),
    ("Comedy", "Comedy"),
    ("Crime", "Crime"),
    ("Documentary", "Documentary"),
    ("Drama", "Drama"),
    ("Fantasy", "Fantasy"),
    ("Fnoir", "Film-Noir"),
    ("Horror", "Horror"),
    ("Musical", "Musical"),
    ("Mystery", "Mystery"),
    ("Romance", "Romance"),
    ("SciFi", "Sci-Fi"),
    ("Thriller", "Thriller"),
    ("War", "War"),
    ("Western", "Western"),
]
GENRE_COLS = [c for c, _ in GENRE_FLAGS]

# The columns the reference's normalise-all step rescales
# (17 genre flags without Mystery, the two ids, zip and the gender flag).
NORMALIZE_ALL_COLS = [c for c in GENRE_COLS if c != "Mystery"] + [
    "item_id", "user_id", "zip5", "gender_binary"]

# Feature order of the reference's matrix: user, item, age, occupation, zip,
# 18 genre flags, gender flag (24 features, column 0 = user).
FEATURE_COLS = ["user_id", "item_id", "age", "occupation", "zip5"] + GENRE_COLS + ["gender_binary"]


def genre_flags(df: DataFrame, genres_col: str = "genres") -> DataFrame:
    """P10: one int column per genre, 1 when the substring occurs."""
    g = F.col(genres_col)
    return df.select("*", *[g.contains(s).cast("int").alias(c) for c, s in GENRE_FLAGS])


def l2_normalize(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Divide each column by its global L2 norm. All norms come from one narrow pass (only ``cols``
    are read; one row of len(cols) numbers reaches the driver and enters the plan as literals). A zero
    norm gives NULL."""
    if not cols:
        return df
    row = df.agg(*[F.sum(F.col(c).cast("double") * F.col(c).cast("double")).alias(f"n{k}")
                   for k, c in enumerate(cols)]).first()
    new = {}
    for k, c in enumerate(cols):
        n = (row[f"n{k}"] or 0.0) ** 0.5
        new[c + suffix] = F.col(c).cast("double") / F.lit(n) if n else F.lit(None).cast("double")
    return df.withColumns(new)


def feature_table(ratings: DataFrame, items: DataFrame, users: DataFrame,
                  normalize=("user_id", "item_id", "zip5")) -> DataFrame:
    """Ratings ⋈ items ⋈ users (inner), flags and encodings, normalised
    ids and zip, feature array ``x`` in the reference's column order.

    Output keeps user_id_raw for equality matching and the split bucket."""
    # encoded once per item and user, not once per rating
    items = genre_flags(items.drop("title")).drop("genres")
    users = (users.withColumn("gender_binary", (F.col("gender") == "M").cast("int"))
             .withColumn("zip5", F.substring("zip", 1, 5).try_cast("bigint")).drop("gender", "zip"))
    j = ratings.join(items, "item_id").join(users, "user_id")
    j = j.withColumn("user_id_raw", F.col("user_id")).withColumn("item_id_raw", F.col("item_id"))
    j = l2_normalize(j, list(normalize))
    x = F.array(*[F.col(c).cast("double") for c in FEATURE_COLS])
    return j.withColumn("x", x)
