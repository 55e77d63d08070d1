"""Registered factor-model queries: md5 initialisation, half-steps (SQL
checked at k = 2), full hand-written ALS loops, library ALS, tuning and
recommendation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_uniform_factor
from ..operators import factors as FA
from ..operators import library_als as LA
from ..operators import metrics as MX
from ..operators import recommend as RC
from ..operators import tuning as TU
from ..operators.top_all import top_all_users
from ..session import cut_lineage
from ..sources import tables as T
from .common import r6

QUERIES: dict = {}
ORACLE: dict = {}

SEED = 45
REG = 0.1


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _user_spine(spark, sf_dir):
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def _item_spine(spark, sf_dir):
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def _factor_sql(side: str, table: str, key: str, rank: int, prefix: str) -> str:
    cols = ", ".join(f"{sql_uniform_factor(SEED, side, key, i)} AS {prefix}{i}" for i in range(rank))
    return f"SELECT {key} AS id, {cols} FROM {table}"


def _dot_sql(a: str, b: str, rank: int) -> str:
    return " + ".join(f"{a}.f{i} * {b}.f{i}" for i in range(rank))


# ------------------------------------------------------------ M7 / A6 / A8
@register("q_factor_init", f"""
SELECT id AS user_id, {", ".join(f"round(f{i}, 6) AS f{i}" for i in range(4))}
FROM ({_factor_sql("user", "customer", "c_custkey", 4, "f")})""")
def q_factor_init(spark, sf_dir):
    """M7: rank-4 user factors 5·U[0,1) from md5(seed:side:id:i)."""
    f = FA.init_factors(_user_spine(spark, sf_dir), "id", 4, "user", SEED)
    return f.select(F.col("id").alias("user_id"), *[r6(F.col("f")[i]).alias(f"f{i}") for i in range(4)])


@register("q_factor_rmse", T.with_views("inter") + f""",
u AS ({_factor_sql("user", "customer", "c_custkey", 4, "f")}),
v AS ({_factor_sql("item", "part", "p_partkey", 4, "f")})
SELECT round(sqrt(avg(power(i.rating - ({_dot_sql("u", "v", 4)}), 2))), 6) AS rmse, count(*) AS n
FROM inter i JOIN u ON i.user_id = u.id JOIN v ON i.item_id = v.id WHERE i.bucket >= 8""")
def q_factor_rmse(spark, sf_dir):
    """RMSE straight from factor tables (dot product per test row)."""
    u = FA.init_factors(_user_spine(spark, sf_dir), "id", 4, "user", SEED)
    v = FA.init_factors(_item_spine(spark, sf_dir), "id", 4, "item", SEED)
    test = T.inter(spark, sf_dir).where(F.col("bucket") >= 8)
    s = FA.score(u, v, test)
    return s.agg(r6(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2)))).alias("rmse"),
                 F.count(F.lit(1)).alias("n"))


@register("q_keyed_vector_sum", T.with_views("inter") + f""",
v AS ({_factor_sql("item", "part", "p_partkey", 4, "f")})
SELECT i.user_id, {", ".join(f"round(sum(i.rating * v.f{a}), 6) AS b{a}" for a in range(4))}
FROM inter i JOIN v ON i.item_id = v.id WHERE i.bucket < 8 GROUP BY i.user_id""")
def q_keyed_vector_sum(spark, sf_dir):
    """A8 + J9: Σ r·y_i per user over training rows (duplicates summed)."""
    v = FA.init_factors(_item_spine(spark, sf_dir), "id", 4, "item", SEED)
    train = T.inter(spark, sf_dir).where(F.col("bucket") < 8)
    j = FA.attach_factors(train, v, "item_id", "f", v.count(), 4)
    return j.groupBy("user_id").agg(*[r6(F.sum(F.col("rating") * F.col("f")[a])).alias(f"b{a}")
                                      for a in range(4)])


# ------------------------------------------------------------- half-steps
def _train_cells_sql() -> str:
    return """r AS (SELECT user_id, item_id, avg(rating) AS rating FROM inter WHERE bucket < 8 GROUP BY 1, 2)"""


_Y2 = _factor_sql("item", "part", "p_partkey", 2, "y")


@register("q_masked_halfstep", T.with_views("inter") + f""",
{_train_cells_sql()},
y AS ({_Y2}),
s AS (SELECT r.user_id, sum(o * y0 * y0) + 0.1e0 AS a, sum(o * y0 * y1) AS b, sum(o * y1 * y1) + 0.1e0 AS d,
             sum(o * rating * y0) AS p, sum(o * rating * y1) AS q
      FROM (SELECT *, CASE WHEN rating > 0.5 THEN 1e0 ELSE 0e0 END AS o FROM r) r
      JOIN y ON r.item_id = y.id GROUP BY r.user_id)
SELECT c.c_custkey AS user_id,
       round(coalesce((d * p - b * q) / (a * d - b * b), 0e0), 6) + 0e0 AS x0,
       round(coalesce((a * q - b * p) / (a * d - b * b), 0e0), 6) + 0e0 AS x1,
       s.user_id IS NULL AS cold
FROM customer c LEFT JOIN s ON c.c_custkey = s.user_id""")
def q_masked_halfstep(spark, sf_dir):
    """M6, first user half-step at k = 2 from md5 item factors (λ = 0.1)."""
    r = FA.prepare_ratings(T.inter(spark, sf_dir).where(F.col("bucket") < 8))
    items = _item_spine(spark, sf_dir)
    y = FA.init_factors(items, "id", 2, "item", SEED)
    x = FA.masked_half_step(r, y, "user_id", "item_id", 2, REG)
    x = FA.with_cold(x, _user_spine(spark, sf_dir), 2)
    return x.select(F.col("id").alias("user_id"), *[(r6(F.col("f")[a]) + 0.0).alias(f"x{a}") for a in range(2)],
                    "cold")


@register("q_zero_filled_halfstep", T.with_views("inter") + f""",
{_train_cells_sql()},
y AS ({_Y2}),
g AS (SELECT sum(y0 * y0) + 0.1e0 AS a, sum(y0 * y1) AS b, sum(y1 * y1) + 0.1e0 AS d FROM y),
s AS (SELECT r.user_id, sum(rating * y0) AS p, sum(rating * y1) AS q
      FROM r JOIN y ON r.item_id = y.id GROUP BY r.user_id)
SELECT c.c_custkey AS user_id,
       round(coalesce((g.d * s.p - g.b * s.q) / (g.a * g.d - g.b * g.b), 0e0), 6) + 0e0 AS x0,
       round(coalesce((g.a * s.q - g.b * s.p) / (g.a * g.d - g.b * g.b), 0e0), 6) + 0e0 AS x1,
       s.user_id IS NULL AS cold
FROM customer c LEFT JOIN s ON c.c_custkey = s.user_id CROSS JOIN g""")
def q_zero_filled_halfstep(spark, sf_dir):
    """M5, first user half-step at k = 2: one global Gram over all items."""
    r = FA.prepare_ratings(T.inter(spark, sf_dir).where(F.col("bucket") < 8))
    items = _item_spine(spark, sf_dir)
    y = FA.init_factors(items, "id", 2, "item", SEED)
    x = FA.zero_filled_half_step(r, y, "user_id", "item_id", 2, REG)
    x = FA.with_cold(x, _user_spine(spark, sf_dir), 2)
    return x.select(F.col("id").alias("user_id"), *[(r6(F.col("f")[a]) + 0.0).alias(f"x{a}") for a in range(2)],
                    "cold")


IMPLICIT_ALPHA, IMPLICIT_REG = 1.0, 0.01


def _resolved_plays(spark, sf_dir):
    """Play counts after alias resolution, one row per (user, item)."""
    from ..operators import relational as R
    plays = R.resolve_aliases(T.plays(spark, sf_dir), T.aliases(spark, sf_dir))
    return plays.groupBy("user_id", "item_id").agg(F.sum("plays").alias("plays"))


@register("q_implicit_halfstep", T.with_views("plays", "aliases") + f""",
r AS (SELECT p.user_id, coalesce(a.good_id, p.item_id) AS item_id, CAST(sum(p.plays) AS DOUBLE) AS plays
      FROM plays p LEFT JOIN aliases a ON p.item_id = a.bad_id GROUP BY 1, 2),
y AS ({_Y2}),
g AS (SELECT sum(y0 * y0) AS a, sum(y0 * y1) AS b, sum(y1 * y1) AS d FROM y),
s AS (SELECT r.user_id, sum(plays * y0 * y0) AS a, sum(plays * y0 * y1) AS b, sum(plays * y1 * y1) AS d,
             sum((1e0 + plays) * y0) AS p, sum((1e0 + plays) * y1) AS q
      FROM r JOIN y ON r.item_id = y.id GROUP BY r.user_id),
n AS (SELECT s.user_id, g.a + s.a + {IMPLICIT_REG} AS a, g.b + s.b AS b, g.d + s.d + {IMPLICIT_REG} AS d, p, q
      FROM s CROSS JOIN g)
SELECT user_id, round((d * p - b * q) / (a * d - b * b), 6) + 0e0 AS x0,
       round((a * q - b * p) / (a * d - b * b), 6) + 0e0 AS x1 FROM n""")
def q_implicit_halfstep(spark, sf_dir):
    """M1, first user half-step of the implicit model at k = 2 from md5 item factors (α = 1, λ = 0.01)."""
    plays = _resolved_plays(spark, sf_dir).select("user_id", "item_id", F.col("plays").cast("double").alias("rating"))
    y = FA.init_factors(_item_spine(spark, sf_dir), "id", 2, "item", SEED)
    x = FA.implicit_half_step(plays, y, "user_id", "item_id", 2, IMPLICIT_REG, IMPLICIT_ALPHA)
    return x.select(F.col("id").alias("user_id"), *[(r6(F.col("f")[a]) + 0.0).alias(f"x{a}") for a in range(2)])


# ------------------------------------------------------- recommendation
@register("q_top_items", T.with_views("personal", "items") + f""",
u AS ({_factor_sql("user", "(SELECT DISTINCT user_id FROM personal)", "user_id", 4, "f")}),
v AS ({_factor_sql("item", "part", "p_partkey", 4, "f")}),
c AS (SELECT u.id AS user_id, v.id AS item_id, {_dot_sql("u", "v", 4)} AS prediction
      FROM u CROSS JOIN v WHERE v.id IN (SELECT item_id FROM items)
        AND v.id NOT IN (SELECT item_id FROM personal)),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY prediction DESC, item_id) AS rank FROM c)
SELECT t.rank, t.user_id, t.item_id, regexp_replace(it.title, '[^\\x00-\\x7F]', '', 'g') AS title,
       round(t.prediction, 6) AS prediction
FROM t JOIN items it ON t.item_id = it.item_id WHERE t.rank <= 50""")
def q_top_items(spark, sf_dir):
    """M10 with md5 factors: J6 -> score -> O1/O2 top 50 -> J5 titles -> P17."""
    pers = T.personal(spark, sf_dir)
    uid = T.personal_user(spark, sf_dir)
    u = FA.init_factors(spark.createDataFrame([(uid,)], "id bigint"), "id", 4, "user", SEED)
    v = FA.init_factors(_item_spine(spark, sf_dir), "id", 4, "item", SEED)
    rec = RC.recommend(lambda pairs: FA.score(u, v, pairs), pers, T.items(spark, sf_dir), uid, 50)
    return rec.select("rank", "user_id", "item_id", "title", r6("prediction").alias("prediction"))


TOP_ALL = 10


@register("q_top_all_users", T.with_views("inter") + f""",
u AS ({_factor_sql("user", "customer", "c_custkey", 4, "f")}),
v AS ({_factor_sql("item", "part", "p_partkey", 4, "f")}),
seen AS (SELECT DISTINCT user_id, item_id FROM inter WHERE bucket < 8),
c AS (SELECT u.id AS user_id, v.id AS item_id, {_dot_sql("u", "v", 4)} AS score
      FROM u CROSS JOIN v ANTI JOIN seen ON u.id = seen.user_id AND v.id = seen.item_id),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM c)
SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM t WHERE rank <= {TOP_ALL}""")
def q_top_all_users(spark, sf_dir):
    """M10 for every user: the 10 best items not rated in training, md5 factors of rank 4."""
    u = FA.init_factors(_user_spine(spark, sf_dir), "id", 4, "user", SEED)
    v = FA.init_factors(_item_spine(spark, sf_dir), "id", 4, "item", SEED)
    seen = T.inter(spark, sf_dir).where(F.col("bucket") < 8).select("user_id", "item_id")
    top = top_all_users(u, v, seen, TOP_ALL, first=256)
    return top.select("user_id", F.col("rank").cast("int").alias("rank"), "item_id", r6("score").alias("score"))


# ------------------------------------------ full loops (rows-only checks)
RANK, ITERS = 4, 20  # the reference's masked setting
ZERO_RANK = 32  # and its zero-filled one


def _rated(spark, sf_dir, *more):
    """The rating view's ids, rating and bucket and the columns ``more``, written once as a table partitioned by
    bucket (the fact join runs once, not once per use, and carries only these columns)."""
    return cut_lineage(T.inter(spark, sf_dir).select("user_id", "item_id", "rating", "bucket", *more),
                       partition_by=["bucket"])


def _splits(spark, sf_dir, *more):
    """Train / validation / test of the rating view: filters on :func:`_rated` that
    prune bucket directories."""
    i, b = _rated(spark, sf_dir, *more), F.col("bucket")
    return i.where(b < 6), i.where((b >= 6) & (b < 8)), i.where(b >= 8)


def _scored_test(model, test):
    return model.score(test.select("row_key", "user_id", "item_id", "rating"))


@register("q_masked_als")
def q_masked_als(spark, sf_dir):
    """M6 loop: rank 4, 20 iterations, λ 0.1; test rows scored."""
    train, _, test = _splits(spark, sf_dir, "row_key")
    m = FA.train_als(train, RANK, ITERS, REG, "masked", _user_spine(spark, sf_dir),
                     _item_spine(spark, sf_dir))
    return _scored_test(m, test).select("row_key", "rating", "prediction")


@register("q_zero_filled_als")
def q_zero_filled_als(spark, sf_dir):
    """M5 loop: rank 32, 20 iterations, λ 0.1; test rows scored."""
    train, _, test = _splits(spark, sf_dir, "row_key")
    m = FA.train_als(train, ZERO_RANK, ITERS, REG, "zero_filled", _user_spine(spark, sf_dir),
                     _item_spine(spark, sf_dir))
    return _scored_test(m, test).select("row_key", "rating", "prediction")


@register("q_als_trace")
def q_als_trace(spark, sf_dir):
    """Train and test RMSE after every iteration of the masked ALS."""
    train, _, test = _splits(spark, sf_dir)
    m = FA.train_als(train, RANK, ITERS, REG, "masked", trace_on=test)
    return FA.trace_frame(spark, m, model="masked", rank=RANK, reg=REG)


@register("q_model_report")
def q_model_report(spark, sf_dir):
    """M9 + A20: validation and test RMSE of the masked ALS, the mean baseline
    and the improvement over it."""
    train, val, test = _splits(spark, sf_dir)
    m = FA.train_als(train, RANK, ITERS, REG, "masked", _user_spine(spark, sf_dir),
                     _item_spine(spark, sf_dir))
    rv = MX.rmse(m.score(val.select("user_id", "item_id").distinct()), val).select("rmse").scalar()
    base = MX.baseline(train.unionByName(val), test)
    mean_rating = base.select("mean_rating").scalar()
    baseline_rmse = base.select("baseline_rmse").scalar()
    rep = MX.rmse(m.score(test.select("user_id", "item_id").distinct()), test).select(
        rv.alias("validation_rmse"), F.col("rmse").alias("test_rmse"),
        mean_rating.alias("mean_rating"), baseline_rmse.alias("baseline_rmse"))
    return rep.select(F.lit("masked").alias("model"), F.lit(RANK).alias("rank"),
                      F.lit(REG).alias("reg"), F.lit(ITERS).alias("iters"),
                      "validation_rmse", "test_rmse", "mean_rating", "baseline_rmse",
                      MX.improvement(F.col("test_rmse"), F.col("baseline_rmse")).alias("improvement_pct"))


@register("q_grid_search")
def q_grid_search(spark, sf_dir):
    """M8 + A17 with the library explicit ALS (as in the reference's
    recommender): its 20 fits, ranks (8, 12, 16, 20, 24) x λ (0.1, 10) x iterations
    (10, 20), on the fixed validation split; every grid row kept, ``best`` marks the winner."""
    train, val, _ = _splits(spark, sf_dir)
    metrics, best, _ = TU.grid_search("library", train, val, [8, 12, 16, 20, 24], [0.1, 10.0], [10, 20])
    return metrics.withColumn("best", F.col("grid_id") == F.lit(best["grid_id"]))


@register("q_rank_curve")
def q_rank_curve(spark, sf_dir):
    """Validation RMSE per rank of the masked ALS, ranks 1..23 at 20 iterations
    (the reference's sweep of its own solver), all ranks trained in one loop."""
    train, val, _ = _splits(spark, sf_dir)
    metrics, _, _ = TU.grid_search("masked", train, val, list(range(1, 24)), [REG], [ITERS])
    return TU.rank_curve(metrics)


@register("q_explicit_als")
def q_explicit_als(spark, sf_dir):
    """M2: library explicit ALS, rank 4, 20 iterations, λ 0.1; test rows scored."""
    train, _, test = _splits(spark, sf_dir, F.when(F.col("bucket") >= 8, F.col("row_key")).alias("row_key"))
    model = LA.train_explicit(train, RANK, ITERS, REG)
    pred = LA.predict_pairs(model, test.select("user_id", "item_id").distinct())
    return test.select("row_key", "user_id", "item_id", "rating").join(pred, ["user_id", "item_id"])


@register("q_implicit_als")
def q_implicit_als(spark, sf_dir):
    """M1 (+J4): implicit ALS on alias-resolved play counts, rank 10,
    5 iterations, λ 0.01, α 1.0; preference scores of the observed pairs."""
    plays = cut_lineage(_resolved_plays(spark, sf_dir))
    model = LA.train_implicit(plays, rank=10, iters=5, reg=0.01, alpha=1.0)
    return LA.predict_pairs(model, plays.select("user_id", "item_id", "plays"))


@register("q_predict_pairs")
def q_predict_pairs(spark, sf_dir):
    """M3: library predictions for validation pairs plus the personal user's
    items (an unknown user: no row)."""
    rows = _rated(spark, sf_dir)
    model = LA.train_explicit(rows.where("bucket < 6"), RANK, ITERS, REG)
    pairs = (rows.where("bucket >= 6 and bucket < 8").select("user_id", "item_id")
             .unionByName(T.personal(spark, sf_dir, rows).select("user_id", "item_id")).distinct())
    return LA.predict_pairs(model, pairs)


@register("q_recommend_als")
def q_recommend_als(spark, sf_dir):
    """M10 with library ALS: train ∪ personal ratings (U1), top 50 unrated
    items for the personal user with titles."""
    rows = _rated(spark, sf_dir)
    pers = cut_lineage(T.personal(spark, sf_dir, rows))
    model = LA.train_explicit(rows.where("bucket < 6").select("user_id", "item_id", "rating").unionByName(pers),
                              RANK, ITERS, REG)
    rec = RC.recommend(lambda pairs: LA.predict_pairs(model, pairs), pers,
                       T.items(spark, sf_dir), T.personal_user(spark, sf_dir), 50)
    return rec.select("rank", "user_id", "item_id", "title", "prediction")


# ------------------------------------- full loops at k = 2, SQL-checked
LOOP_ITERS = 2


def _loop_ctes(method: str, iters: int = LOOP_ITERS) -> list:
    """CTE chain of ``iters`` alternating closed-form k = 2 half-steps (users
    first), the same algorithm as ``train_als`` with md5 item initialisation,
    cold entities at zero, λ = 0.1."""
    ctes = [_train_cells_sql(), f"y0 AS ({_Y2.replace('AS y0', 'AS f0').replace('AS y1', 'AS f1')})"]

    def step(out, fixed, key, other):
        # fixed: (id, f0, f1) of the other side; solve the key side
        if method == "masked":
            s = (f"SELECT r.{key} AS id, sum(o * f0 * f0) + 0.1e0 AS a, sum(o * f0 * f1) AS b, "
                 f"sum(o * f1 * f1) + 0.1e0 AS d, sum(o * r.rating * f0) AS p, sum(o * r.rating * f1) AS q "
                 f"FROM (SELECT *, CASE WHEN rating > 0.5 THEN 1e0 ELSE 0e0 END AS o FROM r) r "
                 f"JOIN {fixed} v ON r.{other} = v.id GROUP BY r.{key}")
            return (f"{out} AS (SELECT id, (d * p - b * q) / (a * d - b * b) AS f0, "
                    f"(a * q - b * p) / (a * d - b * b) AS f1 FROM ({s}))")
        g = f"(SELECT sum(f0 * f0) + 0.1e0 AS a, sum(f0 * f1) AS b, sum(f1 * f1) + 0.1e0 AS d FROM {fixed})"
        s = (f"SELECT r.{key} AS id, sum(r.rating * f0) AS p, sum(r.rating * f1) AS q "
             f"FROM r JOIN {fixed} v ON r.{other} = v.id GROUP BY r.{key}")
        return (f"{out} AS (SELECT s.id, (g.d * s.p - g.b * s.q) / (g.a * g.d - g.b * g.b) AS f0, "
                f"(g.a * s.q - g.b * s.p) / (g.a * g.d - g.b * g.b) AS f1 FROM ({s}) s CROSS JOIN {g} g)")

    prev_items = "y0"
    for t in range(1, iters + 1):
        ctes.append(step(f"x{t}", prev_items, "user_id", "item_id"))
        ctes.append(step(f"y{t}", f"x{t}", "item_id", "user_id"))
        prev_items = f"y{t}"
    return ctes


def _loop_sql(method: str, iters: int = LOOP_ITERS) -> str:
    body = ",\n".join(_loop_ctes(method, iters))
    out = f"""
SELECT 'user' AS side, c.c_custkey AS id, round(coalesce(x.f0, 0e0), 6) + 0e0 AS f0,
       round(coalesce(x.f1, 0e0), 6) + 0e0 AS f1, x.id IS NULL AS cold
FROM customer c LEFT JOIN x{iters} x ON c.c_custkey = x.id
UNION ALL
SELECT 'item' AS side, p.p_partkey AS id, round(coalesce(y.f0, 0e0), 6) + 0e0 AS f0,
       round(coalesce(y.f1, 0e0), 6) + 0e0 AS f1, y.id IS NULL AS cold
FROM part p LEFT JOIN y{iters} y ON p.p_partkey = y.id"""
    return T.with_views("inter") + ",\n" + body + out


def _loop_query(spark, sf_dir, method):
    train = T.inter(spark, sf_dir).where(F.col("bucket") < 8)
    m = FA.train_als(train, 2, LOOP_ITERS, REG, method, _user_spine(spark, sf_dir),
                     _item_spine(spark, sf_dir))
    cols = lambda side, d: d.select(F.lit(side).alias("side"), "id",
                                    *[(r6(F.col("f")[a]) + 0.0).alias(f"f{a}") for a in range(2)], "cold")
    return cols("user", m.users).unionByName(cols("item", m.items))


@register("q_masked_iterations", _loop_sql("masked"))
def q_masked_iterations(spark, sf_dir):
    """M6 end to end: ``train_als`` (masked, k = 2, 2 iterations, λ 0.1) on
    bucket < 8; both factor tables with cold flags, checked against the
    closed-form SQL chain."""
    return _loop_query(spark, sf_dir, "masked")


@register("q_zero_filled_iterations", _loop_sql("zero_filled"))
def q_zero_filled_iterations(spark, sf_dir):
    """M5 end to end: ``train_als`` (zero-filled, k = 2, 2 iterations, λ 0.1)."""
    return _loop_query(spark, sf_dir, "zero_filled")


TRACE_ITERS = 3


def _trace_sql(iters: int = TRACE_ITERS) -> str:
    ctes = _loop_ctes("masked", iters)
    ctes.append("te AS (SELECT user_id, item_id, rating FROM inter WHERE bucket >= 8)")
    parts = []
    for t in range(1, iters + 1):
        pred = (f"coalesce(x.f0, 0e0) * coalesce(y.f0, 0e0) + coalesce(x.f1, 0e0) * coalesce(y.f1, 0e0)")
        rm = lambda src: (f"(SELECT sqrt(avg(power(s.rating - ({pred}), 2))) FROM {src} s "
                          f"LEFT JOIN x{t} x ON s.user_id = x.id LEFT JOIN y{t} y ON s.item_id = y.id)")
        parts.append(f"SELECT {t} AS iteration, round({rm('r')}, 6) AS train_rmse, "
                     f"round({rm('te')}, 6) AS eval_rmse")
    return T.with_views("inter") + ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


@register("q_masked_trace", _trace_sql())
def q_masked_trace(spark, sf_dir):
    """A19 at k = 2: train (cells of bucket < 8) and test (bucket >= 8) RMSE
    after each of 3 masked iterations; cold entities predict 0."""
    i = T.inter(spark, sf_dir)
    m = FA.train_als(i.where(F.col("bucket") < 8), 2, TRACE_ITERS, REG, "masked",
                     _user_spine(spark, sf_dir), _item_spine(spark, sf_dir),
                     trace_on=i.where(F.col("bucket") >= 8))
    tf = FA.trace_frame(spark, m, model="masked")
    return tf.select("iteration", r6("train_rmse").alias("train_rmse"), r6("eval_rmse").alias("eval_rmse"))


# --------------------------- checked evaluation at ranks 1 and 2 (closed forms)
EVAL_ITERS = 2


def _rank_ctes(rank: int, iters: int = EVAL_ITERS, reg: str = "0.1e0", name: str | None = None,
               snapshots=()) -> list:
    """CTE chain of the masked loop at rank 1 or 2, names suffixed by ``name`` (default: the rank); factors
    always have two components (the second is 0 at rank 1). ``snapshots``: rounds to predict after, as
    pred_<name>_<round>, in place of the last one."""
    name = name or str(rank)
    start = _factor_sql("item", "part", "p_partkey", 2, "f")
    if rank == 1:
        start = f"SELECT id, f0, 0e0 AS f1 FROM ({start})"
    ctes, prev = [f"y0_{name} AS ({start})"], f"y0_{name}"
    for t in range(1, iters + 1):
        for out, fixed, key, other in ((f"x{t}_{name}", prev, "user_id", "item_id"),
                                       (f"y{t}_{name}", f"x{t}_{name}", "item_id", "user_id")):
            s = (f"SELECT r.{key} AS id, sum(o * f0 * f0) + {reg} AS a, sum(o * f0 * f1) AS b, "
                 f"sum(o * f1 * f1) + {reg} AS d, sum(o * r.rating * f0) AS p, sum(o * r.rating * f1) AS q "
                 f"FROM (SELECT *, CASE WHEN rating > 0.5 THEN 1e0 ELSE 0e0 END AS o FROM r) r "
                 f"JOIN {fixed} v ON r.{other} = v.id GROUP BY r.{key}")
            f0, f1 = ("p / a", "0e0") if rank == 1 else (
                "(d * p - b * q) / (a * d - b * b)", "(a * q - b * p) / (a * d - b * b)")
            ctes.append(f"{out} AS (SELECT id, {f0} AS f0, {f1} AS f1 FROM ({s}))")
        prev = f"y{t}_{name}"
    for t, out in [(t, f"pred_{name}_{t}") for t in snapshots] or [(iters, f"pred_{name}")]:
        ctes.append(f"{out} AS (SELECT i.row_key, i.bucket, i.rating, coalesce(x.f0, 0e0) * coalesce(y.f0, 0e0) "
                    "+ coalesce(x.f1, 0e0) * coalesce(y.f1, 0e0) AS prediction FROM inter i "
                    f"LEFT JOIN x{t}_{name} x ON i.user_id = x.id LEFT JOIN y{t}_{name} y ON i.item_id = y.id)")
    return ctes


def _eval_sql(body: str) -> str:
    cells = "r AS (SELECT user_id, item_id, avg(rating) AS rating FROM inter WHERE bucket < 6 GROUP BY 1, 2)"
    scored = " UNION ALL ".join(f"SELECT {k} AS rank, * FROM pred_{k}" for k in (1, 2))
    return (T.with_views("inter") + ",\n" + ",\n".join([cells, *_rank_ctes(1), *_rank_ctes(2)])
            + f",\nsc AS ({scored})" + body)


def _eval_models(spark, sf_dir):
    """Scored rows of ranks 1 and 2 trained in one loop on bucket < 6: (rank, row_key, bucket,
    rating, prediction), written."""
    i = cut_lineage(T.inter(spark, sf_dir).select("user_id", "item_id", "rating", "day", "bucket", "row_key"),
                    partition_by=["bucket"])
    models = FA.train_models(i.where("bucket < 6"), [1, 2], [REG, REG], EVAL_ITERS, "masked",
                             _user_spine(spark, sf_dir), _item_spine(spark, sf_dir))
    out = None
    for m in models:
        s = m.score(i).select(F.lit(m.rank).alias("rank"), "row_key", "bucket", "rating", "prediction")
        out = s if out is None else out.unionByName(s)
    return cut_lineage(out), i


def _rmse(cond=None):
    e = F.pow(F.col("rating") - F.col("prediction"), 2)
    return F.sqrt(F.avg(e if cond is None else F.when(cond, e)))


@register("q_rank_rmse", _eval_sql("""
SELECT rank,
       round(sqrt(avg(power(rating - prediction, 2)) FILTER (WHERE bucket >= 6 AND bucket < 8)), 6) AS validation_rmse,
       round(sqrt(avg(power(rating - prediction, 2)) FILTER (WHERE bucket >= 8)), 6) AS test_rmse
FROM sc GROUP BY rank"""))
def q_rank_rmse(spark, sf_dir):
    """A18 at ranks 1 and 2 (2 iterations): validation and test RMSE, checked by closed forms."""
    s, _ = _eval_models(spark, sf_dir)
    b = F.col("bucket")
    return s.groupBy("rank").agg(r6(_rmse((b >= 6) & (b < 8))).alias("validation_rmse"),
                                 r6(_rmse(b >= 8)).alias("test_rmse"))


@register("q_best_config", _eval_sql("""
SELECT rank, round(sqrt(avg(power(rating - prediction, 2))), 6) AS rmse FROM sc
WHERE bucket >= 6 AND bucket < 8 GROUP BY rank ORDER BY sqrt(avg(power(rating - prediction, 2))), rank LIMIT 1"""))
def q_best_config(spark, sf_dir):
    """The rank of smallest validation RMSE, first grid point on ties."""
    s, _ = _eval_models(spark, sf_dir)
    m = s.where("bucket >= 6 and bucket < 8").groupBy("rank").agg(_rmse().alias("rmse")).select(
        (F.col("rank") - 1).cast("bigint").alias("grid_id"), "rank", "rmse")
    return TU.best_config(m).select("rank", r6("rmse").alias("rmse"))


GRID = [(k, lam) for k in (1, 2) for lam in (0.1, 10.0)]
GRID_ITERS = (1, 2)


def _grid_sql() -> str:
    ctes, parts = ["r AS (SELECT user_id, item_id, avg(rating) AS rating FROM inter WHERE bucket < 6 GROUP BY 1, 2)"], []
    for g, (k, lam) in enumerate(GRID):
        ctes += _rank_ctes(k, max(GRID_ITERS), f"{lam}e0", f"g{g}", GRID_ITERS)
        # a validation pair is scored when both its ids have factors (customers and parts without ratings: 0)
        parts += [f"SELECT CAST({k} AS BIGINT) AS rank, CAST({lam} AS DOUBLE) AS reg, CAST({t} AS BIGINT) AS iters, "
                  f"round(sqrt(avg(power(rating - prediction, 2))), 6) AS rmse FROM pred_g{g}_{t} "
                  "WHERE bucket >= 6 AND bucket < 8" for t in GRID_ITERS]
    return T.with_views("inter") + ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


@register("q_grid_snapshots", _grid_sql())
def q_grid_snapshots(spark, sf_dir):
    """M8 with the hand-written solver: ranks (1, 2) x λ (0.1, 10) trained in one loop whose state is
    kept after 1 and 2 iterations; validation RMSE per grid point."""
    train, val, _ = _splits(spark, sf_dir)
    m, _, _ = TU.grid_search("masked", train, val, [1, 2], [0.1, 10.0], list(GRID_ITERS),
                             user_spine=_user_spine(spark, sf_dir), item_spine=_item_spine(spark, sf_dir))
    return m.select("rank", "reg", "iters", r6("rmse").alias("rmse"))


@register("q_grid_masked")
def q_grid_masked(spark, sf_dir):
    """M8 + A17 with the hand-written solver on the reference's 20 points: ranks (8, 12, 16, 20, 24) x λ (0.1, 10)
    in one loop of 20 iterations, the state after 10 kept."""
    train, val, _ = _splits(spark, sf_dir)
    metrics, best, _ = TU.grid_search("masked", train, val, [8, 12, 16, 20, 24], [0.1, 10.0], [10, 20])
    return metrics.withColumn("best", F.col("grid_id") == F.lit(best["grid_id"]))


@register("q_improvement", _eval_sql("""
, m AS (SELECT avg(rating) AS mean_rating FROM inter WHERE bucket < 8),
b AS (SELECT sqrt(avg(power(i.rating - m.mean_rating, 2))) AS baseline_rmse
      FROM inter i CROSS JOIN m WHERE i.bucket >= 8),
t AS (SELECT rank, sqrt(avg(power(rating - prediction, 2))) AS test_rmse FROM sc WHERE bucket >= 8 GROUP BY rank)
SELECT t.rank, round(t.test_rmse, 6) AS test_rmse, round(b.baseline_rmse, 6) AS baseline_rmse,
       round((b.baseline_rmse - t.test_rmse) / b.baseline_rmse * 100, 4) AS improvement_pct FROM t CROSS JOIN b"""))
def q_improvement(spark, sf_dir):
    """M9 + A20: test RMSE per model, the mean baseline and the improvement over it."""
    s, i = _eval_models(spark, sf_dir)
    base = MX.baseline(i.where("bucket < 8"), i.where("bucket >= 8")).select("baseline_rmse").scalar()
    t = s.where("bucket >= 8").groupBy("rank").agg(_rmse().alias("rmse"))
    t = t.withColumn("base", base)
    return t.select("rank", r6("rmse").alias("test_rmse"), r6("base").alias("baseline_rmse"),
                    F.round(MX.improvement(F.col("rmse"), F.col("base")), 4).alias("improvement_pct"))


@register("q_residuals_by_rank", _eval_sql("""
, f AS (SELECT rank, floor(rating - prediction) AS r FROM sc WHERE bucket >= 8 AND rating > 0.5)
SELECT f.rank, count(*) FILTER (WHERE r BETWEEN -5 AND 5) AS n_binned, count(*) AS n_obs,
       count(*) FILTER (WHERE r < 0 AND r >= -5) AS n_negative, count(*) FILTER (WHERE r = 0) AS n_zero,
       count(*) FILTER (WHERE r > 0 AND r <= 5) AS n_positive,
       round(avg(r), 6) + 0e0 AS mean_residual, round(stddev_pop(r), 6) AS std_residual FROM f GROUP BY f.rank"""))
def q_residuals_by_rank(spark, sf_dir):
    """A14 + A15 per rank of a factor model: floored test residuals by sign, their mean and
    population standard deviation."""
    s, _ = _eval_models(spark, sf_dir)
    r = F.floor(F.col("rating") - F.col("prediction"))
    s = s.where("bucket >= 8 and rating > 0.5").select("rank", r.alias("r"))
    r = F.col("r")
    return s.groupBy("rank").agg(
        F.count_if(r.between(-5, 5)).alias("n_binned"), F.count(F.lit(1)).alias("n_obs"),
        F.count_if((r < 0) & (r >= -5)).alias("n_negative"), F.count_if(r == 0).alias("n_zero"),
        F.count_if((r > 0) & (r <= 5)).alias("n_positive"),
        (r6(F.avg("r")) + 0.0).alias("mean_residual"), r6(F.stddev_pop("r")).alias("std_residual"))


_CLIP = "greatest(0e0, least(5e0, prediction))"


@register("q_corrected_als", _eval_sql(f"""
, c AS (SELECT rank, avg(rating - {_CLIP}) AS correction FROM sc
        WHERE bucket >= 6 AND bucket < 8 AND rating > 0.5 GROUP BY rank)
SELECT sc.rank, round(max(c.correction), 6) + 0e0 AS correction,
       round(sqrt(avg(power(rating - {_CLIP}, 2))), 6) AS clipped_rmse,
       round(sqrt(avg(power(rating - greatest(0e0, least(5e0, {_CLIP} + c.correction)), 2))), 6) AS corrected_rmse
FROM sc JOIN c ON sc.rank = c.rank WHERE bucket >= 8 GROUP BY sc.rank"""))
def q_corrected_als(spark, sf_dir):
    """P15 + P16 on model predictions: the mean residual is fitted on validation and applied to
    the clipped test predictions, re-clipped."""
    from ..operators.relational import clip
    s, _ = _eval_models(spark, sf_dir)
    s = s.withColumn("prediction", clip(F.col("prediction")))
    c = (s.where("bucket >= 6 and bucket < 8 and rating > 0.5").groupBy("rank")
         .agg(F.avg(F.col("rating") - F.col("prediction")).alias("correction")))
    t = s.where("bucket >= 8").join(c, "rank")
    new = clip(F.col("prediction") + F.col("correction"))
    return t.groupBy("rank").agg(
        (r6(F.max("correction")) + 0.0).alias("correction"), r6(_rmse()).alias("clipped_rmse"),
        r6(F.sqrt(F.avg(F.pow(F.col("rating") - new, 2)))).alias("corrected_rmse"))


@register("q_residual_sweep")
def q_residual_sweep(spark, sf_dir):
    """A14 + A15 + P15 + P16 over the sweep of q_rank_curve (ranks 1 to 23, 20 iterations, one loop): per rank
    the signs, mean and deviation of the floored test residuals, the validation correction, and the
    test RMSE clipped and corrected."""
    from ..operators.relational import clip
    train, val, test = _splits(spark, sf_dir)
    ranks = list(range(1, 24))
    models = FA.train_models(train, ranks, [REG] * len(ranks), ITERS, "masked")
    together, blocks, scored = models[0].together, [], None
    for name, part in (("validation", val), ("test", test)):
        blocks.append(together.blocks(part))
        s = together.scored(blocks[-1]).withColumn("part", F.lit(name))
        scored = s if scored is None else scored.unionByName(s)
    scored = scored.select(F.get(F.array(*map(F.lit, ranks)), "m").alias("rank"), "part", "rating", "prediction")
    scored = cut_lineage(scored.withColumn("clipped", clip(F.col("prediction"))), partition_by=["part"])
    for b in blocks:
        b.drop(spark)
    c = (scored.where("part = 'validation' and rating > 0.5").groupBy("rank")
         .agg(F.avg(F.col("rating") - F.col("clipped")).alias("correction")))
    t = scored.where("part = 'test'").join(F.broadcast(c), "rank")  # one row a rank
    r = F.when(F.col("rating") > 0.5, F.floor(F.col("rating") - F.col("prediction")))
    rmse = lambda p: F.sqrt(F.avg(F.pow(F.col("rating") - p, 2)))
    return t.withColumn("r", r).groupBy("rank").agg(
        F.count("r").alias("n_obs"), F.count_if((F.col("r") < 0) & (F.col("r") >= -5)).alias("n_negative"),
        F.count_if(F.col("r") == 0).alias("n_zero"), F.count_if((F.col("r") > 0) & (F.col("r") <= 5)).alias("n_positive"),
        F.avg("r").alias("mean_residual"), F.stddev_pop("r").alias("std_residual"),
        F.max("correction").alias("correction"), rmse(F.col("clipped")).alias("clipped_rmse"),
        rmse(clip(F.col("clipped") + F.col("correction"))).alias("corrected_rmse"))
