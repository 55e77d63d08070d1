"""Registered relational queries over the rating views (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_hash01
from ..operators import metrics as MX
from ..operators import recommend as RC
from ..operators import relational as R
from ..operators import splits as S
from ..session import cut_lineage
from ..sources import tables as T
from .common import ITEM_MEAN_SCORED_SQL, fact, item_mean_scored, r6, shifted

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- slice
@register("q_dataset_summary", T.with_views("inter") + """
SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users,
       count(DISTINCT item_id) AS n_items, max(user_id) AS max_user_id,
       max(item_id) AS max_item_id,
       count(*) FILTER (WHERE bucket < 6) AS n_train,
       count(*) FILTER (WHERE bucket >= 6 AND bucket < 8) AS n_validation,
       count(*) FILTER (WHERE bucket >= 8) AS n_test
FROM inter""")
def q_dataset_summary(spark, sf_dir):
    """A1-A3 + U3: counts, exact distinct users/items, max ids, split sizes."""
    i = T.inter(spark, sf_dir)
    b = F.col("bucket")
    return i.agg(
        F.count(F.lit(1)).alias("n_ratings"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        F.max("user_id").alias("max_user_id"),
        F.max("item_id").alias("max_item_id"),
        F.count_if(b < 6).alias("n_train"),
        F.count_if((b >= 6) & (b < 8)).alias("n_validation"),
        F.count_if(b >= 8).alias("n_test"))


@register("q_bucket_counts", T.with_views("inter") + """
SELECT bucket, count(*) AS n FROM inter GROUP BY bucket""")
def q_bucket_counts(spark, sf_dir):
    """Rows per time bucket."""
    return T.inter(spark, sf_dir).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@register("q_split_602020", T.with_views("inter") + """
SELECT CASE WHEN bucket < 6 THEN 'train' WHEN bucket < 8 THEN 'validation' ELSE 'test' END AS split,
       count(*) AS n, round(avg(rating), 6) AS mean_rating
FROM inter GROUP BY 1""")
def q_split_602020(spark, sf_dir):
    """One-pass 60/20/20 split label."""
    d = S.split_by_bucket(T.inter(spark, sf_dir))
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rating")).alias("mean_rating"))


@register("q_split_8020", T.with_views("inter") + """
SELECT CASE WHEN bucket < 8 THEN 'train' ELSE 'test' END AS part, count(*) AS n,
       sum(rating) AS sum_rating
FROM inter GROUP BY 1""")
def q_split_8020(spark, sf_dir):
    """80/20 split."""
    part = F.when(F.col("bucket") < 8, "train").otherwise("test")
    return T.inter(spark, sf_dir).groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating"))


@register("q_split_overlap", T.with_views("inter") + """
SELECT count(*) FILTER (WHERE bucket < 8) AS n_train,
       count(*) FILTER (WHERE bucket >= 6 AND bucket < 8) AS n_validation,
       count(*) FILTER (WHERE bucket < 8 AND bucket >= 6) AS n_overlap,
       round(avg(rating) FILTER (WHERE bucket < 8), 6) AS mean_train,
       round((sum(rating) FILTER (WHERE bucket < 8) + sum(rating) FILTER (WHERE bucket >= 6 AND bucket < 8))
             / (count(*) FILTER (WHERE bucket < 8) + count(*) FILTER (WHERE bucket >= 6 AND bucket < 8)), 6)
         AS mean_train_union_validation
FROM inter""")
def q_split_overlap(spark, sf_dir):
    """P4 (+U2 as the reference does it): validation lies inside train, so the
    union mean counts validation twice."""
    b, r = F.col("bucket"), F.col("rating")
    train, val = b < 8, (b >= 6) & (b < 8)
    sum_if = lambda c: F.sum(F.when(c, r).otherwise(0.0))
    return T.inter(spark, sf_dir).agg(
        F.count_if(train).alias("n_train"), F.count_if(val).alias("n_validation"),
        F.count_if(train & val).alias("n_overlap"),
        r6(sum_if(train) / F.count_if(train)).alias("mean_train"),
        r6((sum_if(train) + sum_if(val)) / (F.count_if(train) + F.count_if(val)))
        .alias("mean_train_union_validation"))


@register("q_sample_split_exact", T.with_views("inter") + """,
h AS (SELECT row_key, row_number() OVER (ORDER BY md5(concat_ws(':', '1992', row_key)), row_key) - 1 AS pos,
             count(*) OVER () AS n FROM inter)
SELECT row_key, CASE WHEN pos < floor(0.9 * n + 0.5) THEN 'first' ELSE 'second' END AS part FROM h""")
def q_sample_split_exact(spark, sf_dir):
    """P5 exact + J7: 90% by hash rank, complement by anti-join."""
    first, second = S.sample_split_exact(T.inter(spark, sf_dir).select("row_key"), "row_key", 0.9, 1992)
    return (first.select("row_key", F.lit("first").alias("part"))
            .unionByName(second.select("row_key", F.lit("second").alias("part"))))


@register("q_sample_split_hash", T.with_views("inter") + f"""
SELECT row_key, CASE WHEN {sql_hash01("concat_ws(':', '1992', row_key)")} < 0.9 THEN 'first' ELSE 'second' END AS part
FROM inter""")
def q_sample_split_hash(spark, sf_dir):
    """P5 scale path: per-row hash threshold."""
    return T.inter(spark, sf_dir).select(
        "row_key", F.when(S.in_first("row_key", 0.9, 1992), "first").otherwise("second").alias("part"))


@register("q_last_rating", T.with_views("inter") + """
SELECT user_id, item_id, rating FROM inter WHERE bucket < 8
QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY day DESC, row_key DESC) = 1""")
def q_last_rating(spark, sf_dir):
    """Of repeated (user, item) ratings the last one stays."""
    rows = T.inter(spark, sf_dir).where(F.col("bucket") < 8).select("user_id", "item_id", "rating", "day", "row_key")
    return S.dedupe(rows, policy="last").select("user_id", "item_id", "rating")


@register("q_positive_ratings", T.with_views("inter") + """
SELECT rating, count(*) AS n FROM inter WHERE rating > 0 GROUP BY rating""")
def q_positive_ratings(spark, sf_dir):
    """Keep rating > 0."""
    return (T.inter(spark, sf_dir).where(F.col("rating") > 0)
            .groupBy("rating").agg(F.count(F.lit(1)).alias("n")))


@register("q_id_in_range", T.with_views("inter", "items", "users") + """
SELECT count(*) AS n_in_range FROM inter
WHERE item_id < (SELECT count(*) FROM items) AND user_id < (SELECT count(*) FROM users)""")
def q_id_in_range(spark, sf_dir):
    """Ids below the row count of their table (scalar subqueries)."""
    i = T.inter(spark, sf_dir)
    n_items = T.items(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    n_users = T.users(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    return (i.where((F.col("item_id") < n_items) & (F.col("user_id") < n_users))
            .agg(F.count(F.lit(1)).alias("n_in_range")))


@register("q_baseline_rmse", T.with_views("inter") + """,
m AS (SELECT avg(rating) AS mean_rating FROM inter WHERE bucket < 8)
SELECT round(m.mean_rating, 6) AS mean_rating,
       round(sqrt(avg((i.rating - m.mean_rating) * (i.rating - m.mean_rating))), 6) AS baseline_rmse,
       count(*) AS n_test
FROM inter i CROSS JOIN m WHERE i.bucket >= 8 GROUP BY m.mean_rating""")
def q_baseline_rmse(spark, sf_dir):
    """A4 + A20: mean of train ∪ validation, RMSE of predicting it on test."""
    b = MX.baseline_of(T.inter(spark, sf_dir), F.col("bucket") < 8, F.col("bucket") >= 8)
    return b.select(r6("mean_rating").alias("mean_rating"), r6("baseline_rmse").alias("baseline_rmse"),
                    "n_test")


# ------------------------------------------------------- scalar functions
@register("q_user_features", T.with_views("users") + """
SELECT user_id, CASE WHEN gender = 'M' THEN 1 ELSE 0 END AS gender_binary,
       TRY_CAST(substr(zip, 1, 5) AS BIGINT) AS zip5, age, occupation FROM users""")
def q_user_features(spark, sf_dir):
    """P11 + P12: gender flag, first five zip characters as an integer."""
    u = T.users(spark, sf_dir)
    return u.select("user_id", (F.col("gender") == "M").cast("int").alias("gender_binary"),
                    F.substring("zip", 1, 5).try_cast("bigint").alias("zip5"), "age", "occupation")


@register("q_mask_counts", T.with_views("inter") + """
SELECT CASE WHEN rating > 0.5 THEN 1 ELSE 0 END AS observed, count(*) AS n FROM inter GROUP BY 1""")
def q_mask_counts(spark, sf_dir):
    """P20: observation mask rating > 0.5."""
    i = T.inter(spark, sf_dir)
    return (i.select((F.col("rating") > 0.5).cast("int").alias("observed"))
            .groupBy("observed").agg(F.count(F.lit(1)).alias("n")))


@register("q_clip_predictions", T.with_views("inter") + ",\n" + ITEM_MEAN_SCORED_SQL + """
SELECT row_key, round(greatest(0.0, least(5.0, prediction)), 6) AS clipped FROM shifted""")
def q_clip_predictions(spark, sf_dir):
    """Clip a shifted prediction to [0, 5]."""
    s = shifted(item_mean_scored(fact(spark, sf_dir, "row_key")))
    return s.select("row_key", r6(R.clip(F.col("prediction"))).alias("clipped"))


@register("q_mean_correction", T.with_views("inter") + ",\n" + ITEM_MEAN_SCORED_SQL + """,
c AS (SELECT avg(rating - greatest(0.0, least(5.0, prediction))) AS correction
      FROM shifted WHERE rating > 0.5)
SELECT s.row_key, round(c.correction, 6) + 0e0 AS correction,
       round(greatest(0.0, least(5.0, greatest(0.0, least(5.0, s.prediction)) + c.correction)), 6) AS prediction
FROM shifted s CROSS JOIN c""")
def q_mean_correction(spark, sf_dir):
    """P16 (+A23): mean residual correction, re-clipped (fit on the same rows,
    as the reference does)."""
    s = cut_lineage(shifted(item_mean_scored(fact(spark, sf_dir, "row_key"))))
    out = R.mean_correction(s, s)
    return out.select("row_key", (r6("correction") + 0.0).alias("correction"),
                      r6("prediction").alias("prediction"))


@register("q_residual_histogram", T.with_views("inter") + ",\n" + ITEM_MEAN_SCORED_SQL + """,
r AS (SELECT floor(rating - prediction) AS r FROM shifted WHERE rating > 0.5),
b AS (SELECT CAST(least(r, 4) AS INTEGER) AS bin, count(*) AS n FROM r WHERE r BETWEEN -5 AND 5 GROUP BY 1),
spine AS (SELECT CAST(range AS INTEGER) AS bin FROM range(-5, 5))
SELECT spine.bin, coalesce(b.n, 0) AS n FROM spine LEFT JOIN b ON spine.bin = b.bin""")
def q_residual_histogram(spark, sf_dir):
    """A14 over item-mean predictions."""
    return MX.residual_histogram(shifted(item_mean_scored(fact(spark, sf_dir))))


@register("q_residual_moments", T.with_views("inter") + ",\n" + ITEM_MEAN_SCORED_SQL + """
SELECT round(avg(floor(rating - prediction)), 6) + 0e0 AS mean_residual,
       round(stddev_pop(floor(rating - prediction)), 6) AS std_residual, count(*) AS n_obs
FROM shifted WHERE rating > 0.5""")
def q_residual_moments(spark, sf_dir):
    """Mean and population std of floored residuals."""
    m = MX.residual_moments(shifted(item_mean_scored(fact(spark, sf_dir))))
    return m.select((r6("mean_residual") + 0.0).alias("mean_residual"),
                    r6("std_residual").alias("std_residual"), "n_obs")


@register("q_error_summary", T.with_views("inter") + ",\n" + ITEM_MEAN_SCORED_SQL + """
SELECT round(sum((rating - prediction) * (rating - prediction)), 4) AS sse,
       round(sum(abs(rating - prediction)), 4) AS sae, count(*) AS n_obs
FROM shifted WHERE rating > 0.5""")
def q_error_summary(spark, sf_dir):
    """A12 + A13: masked squared / absolute error sums."""
    e = MX.error_summary(shifted(item_mean_scored(fact(spark, sf_dir))))
    return e.select(F.round("sse", 4).alias("sse"), F.round("sae", 4).alias("sae"), "n_obs")


@register("q_rmse", T.with_views("inter") + ",\n" + ITEM_MEAN_SCORED_SQL + """,
pred AS (SELECT user_id, item_id, avg(prediction) AS prediction FROM scored
         WHERE item_id % 10 <> 3 GROUP BY 1, 2),
j AS (SELECT t.rating, p.prediction FROM test t LEFT JOIN pred p ON t.user_id = p.user_id AND t.item_id = p.item_id)
SELECT round(sum((prediction - rating) * (prediction - rating)), 4) AS sse, count(*) AS n_truth,
       count(prediction) AS n_matched,
       round(sqrt(sum((prediction - rating) * (prediction - rating)) / count(*)), 6) AS rmse
FROM j""")
def q_rmse(spark, sf_dir):
    """A5: RMSE of keyed predictions against the test truth, divided by the
    truth row count (items with keys ending in 3 have no prediction)."""
    i = fact(spark, sf_dir)
    s = item_mean_scored(i).where(F.pmod("item_id", F.lit(10)) != 3)
    pred = s.groupBy("user_id", "item_id").agg(F.avg("prediction").alias("prediction"))
    test = i.where(F.col("bucket") >= 8)
    m = MX.rmse(pred, test, denominator="truth")
    return m.select(F.round("sse", 4).alias("sse"), "n_truth", "n_matched", r6("rmse").alias("rmse"))


# ------------------------------------------------------------------ joins
@register("q_enrich_left", T.with_views("inter", "items", "users") + """
SELECT i.row_key, i.rating, it.title, u.gender, u.age, u.occupation
FROM inter i LEFT JOIN items it ON i.item_id = it.item_id LEFT JOIN users u ON i.user_id = u.user_id""")
def q_enrich_left(spark, sf_dir):
    """Ratings left-joined to items and users on real keys."""
    e = R.enrich(T.inter(spark, sf_dir), T.items(spark, sf_dir), T.users(spark, sf_dir), "left")
    return e.select("row_key", "rating", "title", "gender", "age", "occupation")


@register("q_enrich_inner", T.with_views("inter", "items", "users") + """
SELECT i.user_id, i.row_key, it.genres, u.zip
FROM inter i JOIN items it ON i.item_id = it.item_id JOIN users u ON i.user_id = u.user_id
ORDER BY i.user_id, i.row_key""")
def q_enrich_inner(spark, sf_dir):
    """J3 + O3: inner joins, sorted by user."""
    e = R.enrich(T.inter(spark, sf_dir), T.items(spark, sf_dir), T.users(spark, sf_dir), "inner")
    return e.select("user_id", "row_key", "genres", "zip").orderBy("user_id", "row_key")


@register("q_alias_resolve", T.with_views("plays", "aliases") + """
SELECT p.user_id, coalesce(a.good_id, p.item_id) AS item_id, sum(p.plays) AS plays
FROM plays p LEFT JOIN aliases a ON p.item_id = a.bad_id GROUP BY 1, 2""")
def q_alias_resolve(spark, sf_dir):
    """One-hop alias resolution of play counts, then per-(user,item) sum."""
    p = R.resolve_aliases(T.plays(spark, sf_dir), T.aliases(spark, sf_dir))
    return p.groupBy("user_id", "item_id").agg(F.sum("plays").alias("plays"))


@register("q_candidates", T.with_views("personal", "items") + """
SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM personal)""")
def q_candidates(spark, sf_dir):
    """Items the personal user has not rated."""
    uid = T.personal_user(spark, sf_dir)
    return R.candidates(T.items(spark, sf_dir), T.personal(spark, sf_dir), uid).select("item_id")


@register("q_pred_truth_join", T.with_views("inter") + ",\n" + ITEM_MEAN_SCORED_SQL + """,
pred AS (SELECT user_id, item_id, avg(prediction) AS prediction FROM scored GROUP BY 1, 2)
SELECT t.row_key, t.rating, round(p.prediction, 6) AS prediction
FROM test t JOIN pred p ON t.user_id = p.user_id AND t.item_id = p.item_id""")
def q_pred_truth_join(spark, sf_dir):
    """Predictions joined to the truth on (user, item)."""
    i = fact(spark, sf_dir, "row_key")
    s = item_mean_scored(i)
    pred = s.groupBy("user_id", "item_id").agg(F.avg("prediction").alias("prediction"))
    test = i.where(F.col("bucket") >= 8)
    j = test.join(pred, ["user_id", "item_id"], "inner")
    return j.select("row_key", "rating", r6("prediction").alias("prediction"))


@register("q_train_union_personal", T.with_views("inter", "personal") + """,
u AS (SELECT user_id, item_id, rating FROM inter WHERE bucket < 6
      UNION ALL SELECT user_id, item_id, rating FROM personal)
SELECT user_id, count(*) AS n, sum(rating) AS sum_rating FROM u GROUP BY user_id""")
def q_train_union_personal(spark, sf_dir):
    """Training rows plus the personal ratings (bag union)."""
    train = T.inter(spark, sf_dir).where(F.col("bucket") < 6).select("user_id", "item_id", "rating")
    u = train.unionByName(T.personal(spark, sf_dir))
    return u.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("sum_rating"))


# ----------------------------------------------------------- aggregations
@register("q_pivot_mean_long", T.with_views("inter") + """
SELECT user_id, item_id, round(avg(rating), 6) AS rating, count(*) AS n FROM inter GROUP BY 1, 2""")
def q_pivot_mean_long(spark, sf_dir):
    """A7 long form: mean of duplicate (user, item) cells."""
    i = T.inter(spark, sf_dir)
    return i.groupBy("user_id", "item_id").agg(r6(F.avg("rating")).alias("rating"),
                                               F.count(F.lit(1)).alias("n"))


@register("q_pivot_wide", T.with_views("inter") + """
SELECT user_id,
       round(avg(rating) FILTER (WHERE bucket < 6), 6) AS train,
       round(avg(rating) FILTER (WHERE bucket >= 6 AND bucket < 8), 6) AS validation,
       round(avg(rating) FILTER (WHERE bucket >= 8), 6) AS test
FROM inter GROUP BY user_id""")
def q_pivot_wide(spark, sf_dir):
    """A7 wide form over a bounded column list: mean rating per user and split."""
    d = S.split_by_bucket(T.inter(spark, sf_dir))
    w = R.pivot_wide(d, "user_id", "split", ["train", "validation", "test"])
    return w.select("user_id", *[r6(c).alias(c) for c in ("train", "validation", "test")])


@register("q_matrix_sum", T.with_views("inter") + """,
tr AS (SELECT user_id, item_id, avg(rating) AS rating FROM inter WHERE bucket < 8 GROUP BY 1, 2),
te AS (SELECT user_id, item_id, avg(rating) AS rating FROM inter WHERE bucket >= 8 GROUP BY 1, 2),
u AS (SELECT * FROM tr UNION ALL SELECT * FROM te)
SELECT user_id, item_id, round(sum(rating), 6) AS q, sum(CASE WHEN rating > 0.5 THEN 1e0 ELSE 0e0 END) AS w
FROM u GROUP BY 1, 2""")
def q_matrix_sum(spark, sf_dir):
    """Q = Q_train + Q_test, W = W_train + W_test (cells averaged per part)."""
    i = fact(spark, sf_dir)
    tr = R.pivot_mean_long(i.where(F.col("bucket") < 8))
    te = R.pivot_mean_long(i.where(F.col("bucket") >= 8))
    m = R.matrix_sum(tr, te)
    return m.select("user_id", "item_id", r6("q").alias("q"), "w")


@register("q_topk_per_user", T.with_views("inter") + ",\n" + ITEM_MEAN_SCORED_SQL + """,
pred AS (SELECT user_id, item_id, avg(prediction) AS prediction FROM scored GROUP BY 1, 2),
ranked AS (SELECT user_id, item_id, prediction,
                  row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS rank
           FROM pred)
SELECT user_id, item_id, round(prediction, 6) AS prediction, rank FROM ranked WHERE rank <= 5""")
def q_topk_per_user(spark, sf_dir):
    """O2: 1-based rank of each user's scored items, top 5 per user."""
    s = item_mean_scored(fact(spark, sf_dir))
    pred = s.groupBy("user_id", "item_id").agg(F.avg("prediction").alias("prediction"))
    ranked = RC.top_n(pred, 5)
    return ranked.select("user_id", "item_id", r6("prediction").alias("prediction"), "rank")
