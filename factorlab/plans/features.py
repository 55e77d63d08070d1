"""Registered feature-model queries: feature table, labelled pairs, pair
distances and losses, metric learning, 1-NN, forest and cluster predictors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import md5_u32, sql_hash01, sql_md5_u32, sql_md5_u60
from ..operators import features as FE
from ..operators import metric_learning as ML
from ..operators import predictors as PR
from ..session import cut_lineage
from ..sources import tables as T
from .common import r6

QUERIES: dict = {}
ORACLE: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r9(c):
    return F.round(c if not isinstance(c, str) else F.col(c), 9)


# ----------------------------------------------------------- feature table
def _flag_sql(src: str = "genres") -> str:
    return ", ".join(f"CASE WHEN contains({src}, '{s.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END AS {c}"
                     for c, s in FE.GENRE_FLAGS)


def feature_table(spark, sf_dir):
    return FE.feature_table(T.inter(spark, sf_dir), T.items(spark, sf_dir), T.users(spark, sf_dir))


def feature_table_written(spark, sf_dir):
    """The feature table written once, for queries that read it several times
    (train and test branches): the fact join runs once, not once per branch."""
    ft = feature_table(spark, sf_dir).select("row_key", "bucket", "rating", "user_id_raw", "x")
    return cut_lineage(ft, partition_by=["bucket"])


_FT_BASE_SQL = T.with_views("inter", "items", "users") + f""",
j AS (SELECT i.row_key, i.bucket, i.rating, i.user_id, i.item_id, u.age, u.occupation,
             TRY_CAST(substr(u.zip, 1, 5) AS BIGINT) AS zip5,
             CASE WHEN u.gender = 'M' THEN 1 ELSE 0 END AS gender_binary, {_flag_sql("it.genres")}
      FROM inter i JOIN items it ON i.item_id = it.item_id JOIN users u ON i.user_id = u.user_id),
nrm AS (SELECT sqrt(sum(CAST(user_id AS DOUBLE) * CAST(user_id AS DOUBLE))) AS n_user,
               sqrt(sum(CAST(item_id AS DOUBLE) * CAST(item_id AS DOUBLE))) AS n_item,
               sqrt(sum(CAST(zip5 AS DOUBLE) * CAST(zip5 AS DOUBLE))) AS n_zip FROM j),
ft AS (SELECT j.*, j.user_id AS user_id_raw,
              CASE WHEN n_user <> 0 THEN user_id / n_user END AS user_n,
              CASE WHEN n_item <> 0 THEN item_id / n_item END AS item_n,
              CASE WHEN n_zip <> 0 THEN zip5 / n_zip END AS zip_n
       FROM j CROSS JOIN nrm)"""


@register("q_genre_flags", T.with_views("items") + f"""
SELECT item_id, {_flag_sql()} FROM items""")
def q_genre_flags(spark, sf_dir):
    """P10: 18 genre flags by substring test."""
    return FE.genre_flags(T.items(spark, sf_dir)).select("item_id", *FE.GENRE_COLS)


@register("q_l2_normalize", T.with_views("inter", "users") + """,
j AS (SELECT i.row_key, i.user_id, i.item_id, TRY_CAST(substr(u.zip, 1, 5) AS BIGINT) AS zip5
      FROM inter i JOIN users u ON i.user_id = u.user_id),
n AS (SELECT sqrt(sum(CAST(user_id AS DOUBLE) * user_id)) AS nu, sqrt(sum(CAST(item_id AS DOUBLE) * item_id)) AS ni,
             sqrt(sum(CAST(zip5 AS DOUBLE) * zip5)) AS nz FROM j)
SELECT row_key, round(CASE WHEN nu <> 0 THEN user_id / nu END, 9) AS user_n,
       round(CASE WHEN ni <> 0 THEN item_id / ni END, 9) AS item_n,
       round(CASE WHEN nz <> 0 THEN zip5 / nz END, 9) AS zip_n
FROM j CROSS JOIN n""")
def q_l2_normalize(spark, sf_dir):
    """User id, item id and zip divided by their global L2 norms."""
    j = T.inter(spark, sf_dir).join(T.users(spark, sf_dir), "user_id")
    j = j.select("row_key", "user_id", "item_id", F.substring("zip", 1, 5).try_cast("bigint").alias("zip5"))
    n = FE.l2_normalize(j, ["user_id", "item_id", "zip5"], suffix="_n")
    return n.select("row_key", r9("user_id_n").alias("user_n"), r9("item_id_n").alias("item_n"),
                    r9("zip5_n").alias("zip_n"))


def _norm_all_sql() -> str:
    cols = FE.NORMALIZE_ALL_COLS
    norms = ", ".join(f"sqrt(sum(CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE))) AS n_{c}" for c in cols)
    outs = ", ".join(f"round(CASE WHEN n_{c} <> 0 THEN {c} / n_{c} END, 9) AS {c}" for c in cols)
    return _FT_BASE_SQL + f""",
n AS (SELECT {norms} FROM ft)
SELECT row_key, {outs} FROM ft CROSS JOIN n"""


@register("q_l2_normalize_all", _norm_all_sql())
def q_l2_normalize_all(spark, sf_dir):
    """The reference's 21 normalised feature columns (list is a
    parameter); a zero norm gives NULL."""
    ft = FE.feature_table(T.inter(spark, sf_dir), T.items(spark, sf_dir), T.users(spark, sf_dir),
                          normalize=())
    n = FE.l2_normalize(ft, FE.NORMALIZE_ALL_COLS)
    return n.select("row_key", *[r9(c).alias(c) for c in FE.NORMALIZE_ALL_COLS])


_FEATURE_OUT = ["user_n", "item_n", "age", "occupation", "zip_n"] + FE.GENRE_COLS + ["gender_binary"]


@register("q_feature_table", _FT_BASE_SQL + f"""
SELECT row_key, CASE WHEN bucket < 8 THEN 'train' ELSE 'test' END AS split, rating,
       {", ".join(f"round({c}, 9) AS {c}" if c.endswith("_n") else c for c in _FEATURE_OUT)}
FROM ft""")
def q_feature_table(spark, sf_dir):
    """Joined, encoded, normalised 24-feature table with its split."""
    ft = feature_table(spark, sf_dir)
    x = F.col("x")
    cols = [r9(x[i]).alias(n) if n.endswith("_n") else x[i].cast(
        "int" if n in FE.GENRE_COLS or n == "gender_binary" else "bigint").alias(n)
        for i, n in enumerate(_FEATURE_OUT)]
    return ft.select("row_key", F.when(F.col("bucket") < 8, "train").otherwise("test").alias("split"),
                     "rating", *cols)


# -------------------------------------------------------------------- pairs
N_PAIRS, P_SAME, PAIR_SEED = 1000, 0.1, 42
DIAG = [1.0 + (i % 4) for i in range(64)]
DIAG_SQL = "[" + ", ".join(f"{v}e0" for v in DIAG) + "]"


def _pairs(spark, sf_dir):
    return ML.generate_pairs(T.feat(spark, sf_dir), "row_id", "label", N_PAIRS, P_SAME, PAIR_SEED)


def _pairs_sql(n_pairs: str, seed: str) -> str:
    """CTEs up to ``pv``: pairs drawn with a seed text, with both vectors."""
    key = lambda tag: f"concat_ws(':', '{seed}', '{tag}', CAST(r.range AS VARCHAR))"
    return T.with_views("feat") + f""",
idx AS (SELECT row_id, label, row_number() OVER (ORDER BY label, row_id) - 1 AS pos FROM feat),
lab AS (SELECT label, count(*) AS lc, min(pos) AS g0 FROM idx GROUP BY label),
nn AS (SELECT count(*) AS n FROM idx),
t2 AS (SELECT r.range AS pair_id, {sql_md5_u60(key("a"))} % nn.n AS a_pos,
              {sql_hash01(key("p"))} AS u, {sql_md5_u60(key("b"))} AS hb, nn.n
       FROM range({n_pairs}) r CROSS JOIN nn),
t3 AS (SELECT t2.*, ia.row_id AS a_id, ia.label AS a_label, lab.lc, lab.g0
       FROM t2 JOIN idx ia ON ia.pos = t2.a_pos JOIN lab ON lab.label = ia.label),
t4 AS (SELECT *, CASE WHEN u <= {P_SAME} THEN g0 + hb % lc
                      WHEN n - lc > 0 THEN CASE WHEN hb % (n - lc) < g0 THEN hb % (n - lc)
                                                ELSE hb % (n - lc) + lc END END AS b_pos FROM t3),
pairs AS (SELECT t4.pair_id, t4.a_id, ib.row_id AS b_id,
                 CASE WHEN t4.a_label = ib.label THEN 1e0 ELSE -1e0 END AS y
          FROM t4 JOIN idx ib ON ib.pos = t4.b_pos),
pv AS (SELECT p.pair_id, p.y, fa.x AS xa, fb.x AS xb
       FROM pairs p JOIN feat fa ON p.a_id = fa.row_id JOIN feat fb ON p.b_id = fb.row_id)"""


PAIRS_SQL = _pairs_sql(str(N_PAIRS), str(PAIR_SEED))
# one epoch of the learner: as many fresh pairs as there are rows
EPOCH_PAIRS_SQL = _pairs_sql("(SELECT count(*) FROM embeddings)", ML.epoch_seed(PAIR_SEED, 0))


@register("q_generate_pairs", PAIRS_SQL + """
SELECT pair_id, a_id, b_id, y FROM pairs""")
def q_generate_pairs(spark, sf_dir):
    """1000 labelled pairs, 10% same-label, seed 42."""
    return _pairs(spark, sf_dir)


def _pv(spark, sf_dir):
    return ML.pair_vectors(_pairs(spark, sf_dir), T.feat(spark, sf_dir))


_SQD = "list_sum(list_transform(xa, lambda v, i: (v - xb[i]) * (v - xb[i])))"
_MD2 = f"list_sum(list_transform(xa, lambda v, i: {DIAG_SQL}[i] * ((v - xb[i]) * (v - xb[i]))))"


@register("q_pair_euclid", PAIRS_SQL + f"""
SELECT pair_id, round(sqrt({_SQD}), 6) AS dist FROM pv""")
def q_pair_euclid(spark, sf_dir):
    """M15 + J10: Euclidean distance of each pair."""
    return ML.pair_euclid(_pv(spark, sf_dir)).select("pair_id", r6("dist").alias("dist"))


@register("q_pair_mahalanobis", PAIRS_SQL + f"""
SELECT pair_id, round({_MD2}, 6) AS d2 FROM pv""")
def q_pair_mahalanobis(spark, sf_dir):
    """δᵀ M δ with a fixed diagonal M (1, 2, 3, 4, 1, 2, ...)."""
    return ML.pair_mahalanobis(_pv(spark, sf_dir), DIAG).select("pair_id", r6("d2").alias("d2"))


def full_metric(d: int) -> np.ndarray:
    """The fixed full matrix of the checked query: 1 / (1 + |i - j|)."""
    i = np.arange(d)
    return 1.0 / (1.0 + np.abs(i[:, None] - i[None, :]))


@register("q_pair_mahalanobis_full", PAIRS_SQL + """,
dl AS (SELECT pair_id, list_transform(xa, lambda v, i: v - xb[i]) AS dx FROM pv)
SELECT pair_id, round(list_sum(list_transform(dx, lambda v, i:
         v * list_sum(list_transform(dx, lambda w, j: w / (1e0 + abs(i - j)))))), 6) AS d2 FROM dl""")
def q_pair_mahalanobis_full(spark, sf_dir):
    """M16 with a full 64 x 64 matrix: factored once, each row projected once."""
    return ML.pair_mahalanobis_full(_pairs(spark, sf_dir), T.feat(spark, sf_dir), full_metric(64)).select(
        "pair_id", r6("d2").alias("d2"))


@register("q_pair_hinge", PAIRS_SQL + f"""
SELECT pair_id, y, round(greatest(0e0, 1e0 + y * ({_MD2} - 2e0)), 6) AS hinge FROM pv""")
def q_pair_hinge(spark, sf_dir):
    """Hinge loss max(0, 1 + y (d² - 2)) per pair."""
    d = ML.pair_mahalanobis(_pv(spark, sf_dir), DIAG)
    return d.select("pair_id", "y", r6(ML.hinge(F.col("d2"), F.col("y"), 2.0)).alias("hinge"))


@register("q_pair_mse", PAIRS_SQL + f"""
SELECT round(0.5e0 * avg(power(y - ({_MD2} - 2e0), 2)), 6) AS mse_loss FROM pv""")
def q_pair_mse(spark, sf_dir):
    """½ mean((y - (d² - 2))²)."""
    d = ML.pair_mahalanobis(_pv(spark, sf_dir), DIAG)
    return ML.mse_loss(d, 2.0).select(r6("mse_loss").alias("mse_loss"))


ALPHA = 1e-8


@register("q_metric_objective", PAIRS_SQL + f""",
d AS (SELECT y, {_SQD} AS d2 FROM pv)
SELECT round(avg(greatest(0e0, 1e0 + y * (d2 - 2e0))) + {ALPHA} / 2 * sqrt(64e0), 6) AS objective,
       count(*) AS n_pairs, count(*) FILTER (WHERE 1e0 + y * (d2 - 0.5e0) > 0) AS n_active FROM d""")
def q_metric_objective(spark, sf_dir):
    """M20, one epoch at M = I: objective mean hinge (margin 2) + α/2 ‖M‖_F
    and the number of pairs with an active gradient hinge (margin 0.5)."""
    g = ML.epoch_gradient(_pv(spark, sf_dir), np.eye(64), 2.0, 0.5).where(F.col("i") < 0)
    row = g.groupBy().pivot("j", [0, 1, 2]).agg(F.first("v"))
    return row.select(r6(F.col("0") / F.col("1") + ALPHA / 2 * 8.0).alias("objective"),
                      F.col("1").cast("bigint").alias("n_pairs"), F.col("2").cast("bigint").alias("n_active"))


@register("q_metric_gradient", EPOCH_PAIRS_SQL + f""",
d AS (SELECT pair_id, y, list_transform(xa, lambda v, i: v - xb[i]) AS delta, {_SQD} AS d2 FROM pv),
w AS (SELECT pair_id, y * CASE WHEN 1e0 + y * (d2 - 0.5e0) > 0 THEN 1e0 ELSE 0e0 END AS w, delta FROM d),
e AS (SELECT pair_id, w, unnest(delta) AS v, generate_subscripts(delta, 1) AS i FROM w),
np AS (SELECT count(*) AS n FROM pv)
SELECT CAST(a.i - 1 AS INTEGER) AS i, CAST(b.i - 1 AS INTEGER) AS j,
       round(sum(a.w * a.v * b.v) / max(np.n) + CASE WHEN a.i = b.i THEN {ALPHA} ELSE 0e0 END, 6) + 0e0 AS grad
FROM e a JOIN e b ON a.pair_id = b.pair_id CROSS JOIN np GROUP BY a.i, b.i""")
def q_metric_gradient(spark, sf_dir):
    """M20, the first epoch at M = I: mean hinge sub-gradient + α M, per entry, over
    fresh pairs drawn from all rows."""
    feat = T.feat(spark, sf_dir)
    index = ML.pair_index(feat, "row_id", "label")
    pairs = ML.pairs_of_index(index, index.n, P_SAME, ML.epoch_seed(PAIR_SEED, 0))
    g = ML.epoch_gradient(ML.pair_vectors(pairs, feat), np.eye(64), 2.0, 0.5)
    g = cut_lineage(g)
    n = g.where((F.col("i") == -1) & (F.col("j") == 1)).agg(F.first("v")).scalar()
    grad = F.col("v") / n + F.when(F.col("i") == F.col("j"), ALPHA).otherwise(0.0)
    return g.where(F.col("i") >= 0).select("i", "j", (r6(grad) + 0.0).alias("grad"))


@register("q_metric_norm", T.with_views("feat") + f"""
SELECT row_id, round(list_sum(list_transform(x, lambda v, i: {DIAG_SQL}[i] * (v * v))), 6) AS xmx FROM feat""")
def q_metric_norm(spark, sf_dir):
    """xᵀ M x per row for the fixed diagonal M."""
    return ML.row_quad(T.feat(spark, sf_dir), DIAG).select("row_id", r6("xmx").alias("xmx"))


@register("q_metric_norm_head", T.with_views("feat") + f"""
SELECT row_id, label, round(list_sum(list_transform(x, lambda v, i: {DIAG_SQL}[i] * (v * v))), 6) AS xmx
FROM feat ORDER BY row_id LIMIT 100""")
def q_metric_norm_head(spark, sf_dir):
    """O4 + M22: the first 100 rows by id with xᵀ M x (the slice the reference
    plots); a top-k by key, planned as TakeOrderedAndProject."""
    q = ML.row_quad(T.feat(spark, sf_dir), DIAG)
    return q.orderBy("row_id").limit(100).select("row_id", "label", r6("xmx").alias("xmx"))


@register("q_label_first_id", T.with_views("feat") + """
SELECT label, min(row_id) AS first_id, count(*) AS n FROM feat GROUP BY label""")
def q_label_first_id(spark, sf_dir):
    """First row id per label."""
    return T.feat(spark, sf_dir).groupBy("label").agg(F.min("row_id").alias("first_id"),
                                                      F.count(F.lit(1)).alias("n"))


@register("q_metric_learning")
def q_metric_learning(spark, sf_dir):
    """10 epochs from M = I, γ(t) = 0.001/√(t+1), α = 1e-8, each over as many fresh
    pairs as there are rows; objective on the fixed 1000 pairs per epoch."""
    m, trace = ML.learn_metric(T.feat(spark, sf_dir), 64, epochs=10, alpha=ALPHA, n_objective=N_PAIRS,
                               positive_ratio=P_SAME, seed=PAIR_SEED)
    return spark.createDataFrame(trace, "epoch bigint, objective double, n_pairs bigint, n_active bigint")


@register("q_metric_stochastic")
def q_metric_stochastic(spark, sf_dir):
    """M20 at the reference's length: 100,000 stochastic steps of 10 pairs (10 rounds of 10 groups of
    1,000), γ(t) = 0.001/√(t+1), α = 1e-8; the objective on the fixed 1000 pairs before every round and at the end."""
    _, trace = ML.stochastic_metric(T.feat(spark, sf_dir), 64, alpha=lambda t: ALPHA, n_objective=N_PAIRS,
                                    positive_ratio=P_SAME, seed=PAIR_SEED)
    return spark.createDataFrame(trace, "round bigint, steps bigint, objective double, n_pairs bigint")


# Normalised ids are O(1e-5); the fixed metric weighs them by 1e10 so that
# squared distances are O(1) before rounding to 6 decimals.
NN_WEIGHTS = [1e10, 1e10, 1.0, 1.0, 1e10] + [1.0] * 18 + [1.0]
NN_DECIMALS = 6


def _nn_d2_sql() -> str:
    terms = []
    for w, c in zip(NN_WEIGHTS, _FEATURE_OUT):
        gap = f"(coalesce(CAST(te.{c} AS DOUBLE), 0e0) - coalesce(CAST(tr.{c} AS DOUBLE), 0e0))"
        terms.append(f"{w!r}e0 * ({gap} * {gap})"
                     .replace("1e+10e0", "1e10").replace("1.0e0", "1e0"))
    return " + ".join(terms)


@register("q_metric_1nn", _FT_BASE_SQL + f""",
tr AS (SELECT * FROM ft WHERE bucket < 8), te AS (SELECT * FROM ft WHERE bucket >= 8),
c AS (SELECT te.row_key AS q_id, tr.row_key AS t_ord, tr.rating AS nn_rating,
             round({_nn_d2_sql()}, {NN_DECIMALS}) AS d2
      FROM te JOIN tr ON te.user_id_raw = tr.user_id_raw),
b AS (SELECT q_id, t_ord, nn_rating FROM (
        SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, t_ord) AS rk FROM c) WHERE rk = 1),
gm AS (SELECT avg(rating) AS global_mean FROM tr)
SELECT te.row_key, te.rating, coalesce(b.nn_rating, gm.global_mean) AS prediction, b.t_ord AS nn_row_key
FROM te LEFT JOIN b ON te.row_key = b.q_id CROSS JOIN gm""")
def q_metric_1nn(spark, sf_dir):
    """Each test row copies the rating of the nearest training row of the
    same user under a fixed diagonal M (ties: smallest row key); users without
    training rows fall back to the global training mean."""
    ft = feature_table_written(spark, sf_dir)
    train = ft.where(F.col("bucket") < 8).select(
        F.col("user_id_raw").alias("key"), F.col("row_key").alias("t_ord"), "rating", "x")
    test = ft.where(F.col("bucket") >= 8)
    q = test.select(F.col("user_id_raw").alias("key"), F.col("row_key").alias("q_id"), "x")
    nn = ML.nearest_train(train, q, "key", NN_WEIGHTS, block=256, decimals=NN_DECIMALS)
    global_mean = train.agg(F.avg("rating")).scalar()
    out = test.select("row_key", "rating").join(nn, test.row_key == nn.q_id, "left")
    return out.select("row_key", "rating", F.coalesce(F.col("nn_rating"), global_mean).alias("prediction"),
                      F.col("t_ord").alias("nn_row_key"))


# --------------------------------------------------------------- predictors
@register("q_forest_curve")
def q_forest_curve(spark, sf_dir):
    """Random-forest classifier RMSE for 1 to 29 trees of unlimited depth."""
    ft = feature_table_written(spark, sf_dir)
    curve = PR.forest_curve(ft.where(F.col("bucket") < 8), ft.where(F.col("bucket") >= 8), range(1, 30))
    return curve.select(F.col("trees").cast("bigint").alias("trees"), "rmse")


KMEANS_K = 1024


@register("q_kmeans_rating")
def q_kmeans_rating(spark, sf_dir):
    """Mini-batch k-means (k = 1024, 40 batches of 8,192 rows) on training features; cluster
    mean rating, plain and rescaled, test RMSE."""
    ft = feature_table_written(spark, sf_dir)
    tr, te = PR.kmeans_assign(ft.where(F.col("bucket") < 8), ft.where(F.col("bucket") >= 8), KMEANS_K)
    tr, te = cut_lineage(tr), cut_lineage(te)
    b = PR.cluster_rating(tr, te, rescale=True).agg(PR.rmse_of()).scalar()
    a = PR.cluster_rating(tr, te, rescale=False)
    return a.agg(F.lit(KMEANS_K).alias("k"), PR.rmse_of().alias("rmse_mean"), b.alias("rmse_rescaled"))


KM_K, KM_BATCH, KM_STEPS, KM_SEED = 4, 2000, 2, 7
# the fixed metric's weights make the coordinates comparable, so that batches matter
_KM_X = ", ".join(f"coalesce({c}, 0) * {1e5 if c.endswith('_n') else 1.0!r}" for c in _FEATURE_OUT)


def _km_sql() -> str:
    """Two steps of the mini-batch fit: centres c0 -> c1 -> c2 in long form (centre, i, v) with counts n0 .. n2."""
    place = lambda e: f"CAST(floor({sql_hash01(f"'{KM_SEED}:{e}:' || row_key")} * per) AS BIGINT)"
    ctes = [_FT_BASE_SQL, f"""
t AS (SELECT row_key, md5('{KM_SEED}:c:' || row_key) AS h, list_transform([{_KM_X}], lambda v: CAST(v AS DOUBLE)) AS x
      FROM ft WHERE bucket < 8),
pe AS (SELECT greatest(1, (count(*) + {KM_BATCH - 1}) // {KM_BATCH}) AS per FROM t),
c0 AS (SELECT row_number() OVER (ORDER BY h, row_key) - 1 AS centre, x, 0 AS n FROM t
       QUALIFY row_number() OVER (ORDER BY h, row_key) <= {KM_K}),
bt AS (SELECT row_key, x, {place(0)} AS batch FROM t CROSS JOIN pe
       UNION ALL SELECT row_key, x, {place(1)} + per FROM t CROSS JOIN pe)"""]
    for s in range(KM_STEPS):
        ctes.append(f"""
d{s} AS (SELECT b.row_key, b.x, c.centre, round(list_sum(list_transform(b.x, lambda v, i: (v - c.x[i]) * (v - c.x[i]))), 9)
           AS d2 FROM bt b CROSS JOIN c{s} c WHERE b.batch = {s}),
a{s} AS (SELECT x, centre FROM d{s} QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY d2, centre) = 1),
u{s} AS (SELECT centre, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{s}),
s{s} AS (SELECT centre, i, sum(v) AS v, count(*) AS n FROM u{s} GROUP BY centre, i),
l{s} AS (SELECT centre, n, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM c{s}),
c{s + 1} AS (SELECT l.centre, list(coalesce((l.v * l.n + s.v) / (l.n + s.n), l.v) ORDER BY l.i) AS x,
             max(l.n + coalesce(s.n, 0)) AS n FROM l{s} l LEFT JOIN s{s} s ON l.centre = s.centre AND l.i = s.i
             GROUP BY l.centre)""")
    return ",".join(ctes) + f"""
SELECT CAST(centre AS INTEGER) AS centre, CAST(n AS BIGINT) AS n, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS i,
       round(unnest(x), 6) + 0e0 AS v FROM c{KM_STEPS}"""


@register("q_kmeans_minibatch", _km_sql())
def q_kmeans_minibatch(spark, sf_dir):
    """M13, the first two batches (k = 4, about 2,000 rows each) from md5-drawn centres: every centre's
    rows seen and coordinates."""
    from ..operators.kmeans import fit_minibatch
    ft = feature_table(spark, sf_dir).where(F.col("bucket") < 8)
    scale = [1e5 if c.endswith("_n") else 1.0 for c in _FEATURE_OUT]
    x = F.array(*[F.coalesce(F.col("x")[i], F.lit(0.0)) * F.lit(w) for i, w in enumerate(scale)])
    c = fit_minibatch(ft.select("row_key", x.alias("x")), KM_K, "row_key", KM_STEPS, KM_BATCH, KM_SEED)
    return c.select("centre", "n", F.posexplode("x").alias("i", "v")).withColumn("v", r6("v") + 0.0)


N_CLUSTERS = 16


def _hash_cluster(spark, sf_dir):
    i = T.inter(spark, sf_dir)
    return i.withColumn("cluster", F.pmod(md5_u32(F.col("user_id").cast("string")), F.lit(N_CLUSTERS)))


_CLUSTER_SQL = T.with_views("inter") + f""",
a AS (SELECT *, {sql_md5_u32("CAST(user_id AS VARCHAR)")} % {N_CLUSTERS} AS cluster FROM inter),
tr AS (SELECT * FROM a WHERE bucket < 8), te AS (SELECT * FROM a WHERE bucket >= 8),
cm AS (SELECT cluster, avg(rating) AS cluster_mean, count(*) AS n FROM tr GROUP BY cluster),
mm AS (SELECT min(cluster_mean) AS mn, max(cluster_mean) AS mx FROM cm),
gm AS (SELECT avg(rating) AS global_mean FROM tr)"""


@register("q_cluster_rating", _CLUSTER_SQL + """
SELECT cluster, round(cluster_mean, 6) AS cluster_mean, n FROM cm""")
def q_cluster_rating(spark, sf_dir):
    """A10: mean training rating per (given) cluster."""
    a = _hash_cluster(spark, sf_dir).where(F.col("bucket") < 8)
    return a.groupBy("cluster").agg(r6(F.avg("rating")).alias("cluster_mean"), F.count(F.lit(1)).alias("n"))


@register("q_cluster_rating_rescaled", _CLUSTER_SQL + """,
p AS (SELECT te.rating,
             coalesce(round_even(cm.cluster_mean, 0), gm.global_mean) AS p_mean,
             coalesce(CASE WHEN mm.mx > mm.mn THEN round_even((cm.cluster_mean - mm.mn) * 4 / (mm.mx - mm.mn) + 1, 0)
                           ELSE round_even(cm.cluster_mean, 0) END, gm.global_mean) AS p_rescaled
      FROM te LEFT JOIN cm ON te.cluster = cm.cluster CROSS JOIN mm CROSS JOIN gm)
SELECT round(sqrt(avg(power(p_mean - rating, 2))), 6) AS rmse_mean,
       round(sqrt(avg(power(p_rescaled - rating, 2))), 6) AS rmse_rescaled, count(*) AS n_test FROM p""")
def q_cluster_rating_rescaled(spark, sf_dir):
    """A10 + P18 + P19 + A11: rint(cluster mean) and min-max rescaled cluster
    ratings as test predictions, RMSE of both."""
    a = _hash_cluster(spark, sf_dir)
    tr, te = a.where(F.col("bucket") < 8), a.where(F.col("bucket") >= 8)
    rescaled = PR.cluster_rating(tr, te, rescale=True).agg(PR.rmse_of()).scalar()
    return PR.cluster_rating(tr, te, rescale=False).agg(
        r6(PR.rmse_of()).alias("rmse_mean"), r6(rescaled).alias("rmse_rescaled"),
        F.count(F.lit(1)).alias("n_test"))
