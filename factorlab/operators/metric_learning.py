"""Labelled pairs, pair distances and losses, and metric learning (the 1-nearest-neighbour
predictor under a metric is in :mod:`neighbours`).

Everything that scales with the data runs as Spark jobs: pair sampling is
equi-joins on exact global row positions, distances are native array
expressions (a full d x d metric is applied by projecting every row once), the gradient
of one epoch is a partial d x d sum per partition reduced by a native
aggregate, and stochastic steps run side by side in tasks whose matrices are averaged.
Only d x d matrices reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash01, md5_u60
from ..functions.vectors import diag_quad, dot, sq_dist, sub
from ..session import cut_lineage, drop_table, table_path
from .neighbours import matrix_of, metric_factor, nearest_train, project_rows  # noqa: F401 (re-exported)
from .splits import index_rows_total


# ------------------------------------------------------------------ pairs
def generate_pairs(df: DataFrame, id_col: str, label_col: str, n_pairs: int,
                   positive_ratio: float, seed: int = 42) -> DataFrame:
    """``n_pairs`` labelled pairs (pair_id, a_id, b_id, y = ±1).

    Anchor: a uniform row. With probability ``positive_ratio`` the partner is
    a uniform row of the anchor's label (possibly itself), otherwise a uniform
    row of any other label. Randomness is 60 bits of md5 of (seed, tag, pair id),
    so every position of a table of any size can be drawn; rows are addressed by
    exact global position in (label, id) order, so each label is one block
    [g0, g0 + count). A pair whose anchor has no row of another label to
    meet (one label only) is left out.
    """
    return pairs_of_index(pair_index(df, id_col, label_col), n_pairs, positive_ratio, seed)


@dataclass
class PairIndex:
    """Rows at their exact position in (label, id) order, and each label's block."""
    rows: DataFrame    # (_label, _id, pos)
    labels: DataFrame  # (_label, lc, g0)
    n: int


def pair_index(df: DataFrame, id_col: str, label_col: str) -> PairIndex:
    base = df.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    idx, n = index_rows_total(base, [F.col("_label"), F.col("_id")], "pos")
    labels = idx.groupBy("_label").agg(F.count(F.lit(1)).alias("lc"), F.min("pos").alias("g0"))
    return PairIndex(idx, labels, n)


def pairs_of_index(index: PairIndex, n_pairs: int, positive_ratio: float, seed) -> DataFrame:
    """Pairs drawn from an index; another ``seed`` (a number or text) draws other pairs."""
    idx, labels, n = index.rows, index.labels, index.n
    spark = idx.sparkSession
    t = draw_positions(spark.range(n_pairs).select(F.col("id").alias("pair_id")), n, seed)
    a = idx.select(F.col("pos").alias("a_pos"), F.col("_id").alias("a_id"), F.col("_label").alias("a_label"))
    t = a.join(F.broadcast(t) if n_pairs <= BROADCAST_PAIRS else t, "a_pos")
    t = t.join(labels.withColumnRenamed("_label", "a_label"), "a_label")
    m = F.pmod(F.col("hb"), F.col("_rest"))
    partner = (F.when(F.col("u") <= positive_ratio, F.col("g0") + F.pmod(F.col("hb"), F.col("lc")))
               .when(F.col("_rest") > 0, F.when(m < F.col("g0"), m).otherwise(m + F.col("lc"))))
    t = (t.withColumn("_rest", F.lit(n) - F.col("lc")).withColumn("b_pos", partner)
         .where("b_pos is not null").select("pair_id", "a_id", "a_label", "b_pos"))
    t = cut_lineage(t)
    b = idx.select(F.col("pos").alias("b_pos"), F.col("_id").alias("b_id"), F.col("_label").alias("b_label"))
    t = b.join(F.broadcast(t) if n_pairs <= BROADCAST_PAIRS else t, "b_pos")
    y = F.when(F.col("a_label") == F.col("b_label"), 1.0).otherwise(-1.0)
    return t.select("pair_id", "a_id", "b_id", y.alias("y"))


BROADCAST_PAIRS = 100_000  # drawn pairs (under 50 bytes each); beyond it a shuffle join


def draw_positions(pairs: DataFrame, n: int, seed=42) -> DataFrame:
    """(pair_id, a_pos, u, hb): anchor position in [0, n), uniform number, partner hash."""
    key = lambda tag: F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col("pair_id").cast("string"))
    return pairs.select("pair_id", F.pmod(md5_u60(key("a")), F.lit(n)).alias("a_pos"),
                        hash01(key("p")).alias("u"), md5_u60(key("b")).alias("hb"))


def pair_vectors(pairs: DataFrame, feat: DataFrame, id_col: str = "row_id",
                 x_col: str = "x") -> DataFrame:
    """Both feature vectors of every pair (two equi-joins)."""
    fa = feat.select(F.col(id_col).alias("a_id"), F.col(x_col).alias("xa"))
    fb = feat.select(F.col(id_col).alias("b_id"), F.col(x_col).alias("xb"))
    return pairs.join(fa, "a_id").join(fb, "b_id")


def pair_euclid(pv: DataFrame) -> DataFrame:
    """Euclidean distance per pair."""
    return pv.withColumn("dist", F.sqrt(sq_dist(F.col("xa"), F.col("xb"))))


def pair_mahalanobis(pv: DataFrame, m=None) -> DataFrame:
    """d² = δᵀ M δ per pair (no square root). ``m``: None (identity), a
    1-D diagonal or a full matrix, all native. Where a row lies in several pairs,
    :func:`pair_mahalanobis_full` applies a full matrix once a row instead."""
    if m is None:
        return pv.withColumn("d2", sq_dist(F.col("xa"), F.col("xb")))
    arr = np.asarray(m, dtype=float)
    if arr.ndim == 2:
        p, signs = metric_factor(arr)
        rows = F.lit(p.tolist())
        axes = F.transform(rows, lambda r: dot(r, sub(F.col("xa"), F.col("xb"))))
        return pv.withColumn("d2", diag_quad(axes, signs))
    return pv.withColumn("d2", diag_quad(sub(F.col("xa"), F.col("xb")), arr.tolist()))


def pair_mahalanobis_full(pairs: DataFrame, feat: DataFrame, m, id_col: str = "row_id",
                          x_col: str = "x") -> DataFrame:
    """M16 with a full d x d matrix: the matrix is factored once, every row is projected once,
    and a pair's d² is a signed sum of squares over both projections."""
    p, signs = metric_factor(m)
    rows = project_rows(feat.select(id_col, x_col), p, x_col)
    return pair_mahalanobis(pair_vectors(pairs, rows, id_col, x_col), signs)


def hinge(d2: F.Column, y: F.Column, margin: float = 2.0) -> F.Column:
    """max(0, 1 + y (d² - margin))."""
    return F.greatest(F.lit(0.0), F.lit(1.0) + y * (d2 - F.lit(margin)))


def mse_loss(pd2: DataFrame, margin: float = 2.0) -> DataFrame:
    """½ mean((y - (d² - margin))²)."""
    return pd2.agg((F.lit(0.5) * F.avg(F.pow(F.col("y") - (F.col("d2") - margin), 2))).alias("mse_loss"))


def row_quad(feat: DataFrame, m, x_col: str = "x") -> DataFrame:
    """xᵀ M x per row (diagonal or identity M as native expressions)."""
    if m is None:
        return feat.withColumn("xmx", F.aggregate(F.col(x_col), F.lit(0.0), lambda acc, v: acc + v * v))
    return feat.withColumn("xmx", diag_quad(F.col(x_col), list(np.asarray(m, dtype=float))))


# --------------------------------------------------------- metric learning
def nearest_psd(m: np.ndarray) -> np.ndarray:
    """The positive semidefinite matrix closest to ``m`` in the Frobenius norm: the
    symmetric part of ``m`` with its negative eigenvalues set to zero."""
    values, vectors = np.linalg.eigh((m + m.T) / 2.0)
    return vectors @ np.diag(np.maximum(values, 0.0)) @ vectors.T


def _grad_batches(m: np.ndarray, margin_obj: float, margin_grad: float):
    d = m.shape[0]
    ii, jj = np.meshgrid(np.arange(d), np.arange(d), indexing="ij")

    def run(batches):
        g = np.zeros((d, d))
        hinge_sum, n, active_n = 0.0, 0, 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            xa = matrix_of(rb.column("xa"))
            xb = matrix_of(rb.column("xb"))
            y = rb.column("y").to_numpy(zero_copy_only=False).astype(float)
            delta = xa - xb
            d2 = np.einsum("ni,ij,nj->n", delta, m, delta)
            hinge_sum += np.maximum(0.0, 1.0 + y * (d2 - margin_obj)).sum()
            active = (1.0 + y * (d2 - margin_grad)) > 0
            w = y * active
            g += np.einsum("n,ni,nj->ij", w, delta, delta)
            n += rb.num_rows
            active_n += int(active.sum())
        i = np.concatenate([ii.ravel(), [-1, -1, -1]]).astype(np.int32)
        j = np.concatenate([jj.ravel(), [0, 1, 2]]).astype(np.int32)
        v = np.concatenate([g.ravel(), [hinge_sum, float(n), float(active_n)]])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], ["i", "j", "v"])
    return run


def epoch_gradient(pv: DataFrame, m: np.ndarray, margin_obj: float = 2.0,
                   margin_grad: float = 0.5) -> DataFrame:
    """One pass over the pairs: (i, j, Σ y·[active]·δ_i δ_j) for all i, j plus
    rows i = -1 holding the hinge sum (j=0), pair count (j=1) and active count
    (j=2). Partial sums per partition, final native aggregate."""
    parts = pv.select("xa", "xb", "y").mapInArrow(
        _grad_batches(np.asarray(m, dtype=float), margin_obj, margin_grad),
        "i int, j int, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _collect_gradient(g: DataFrame, d: int):
    grad = np.zeros((d, d))
    extra = {}
    for r in g.collect():  # d*d + 3 rows: bounded by the feature dimension
        if r["i"] < 0:
            extra[r["j"]] = r["v"]
        else:
            grad[r["i"], r["j"]] = r["v"]
    return grad, extra.get(0, 0.0), extra.get(1, 0.0), extra.get(2, 0.0)


def learn_metric(feat: DataFrame, d: int, epochs: int = 20, gamma=lambda t: 0.001 / np.sqrt(t + 1),
                 alpha=lambda t: 1e-8, margin_obj: float = 2.0, margin_grad: float = 0.5,
                 m0: np.ndarray | None = None, batch_frac: float = 1.0, n_objective: int = 1000,
                 positive_ratio: float = 0.1, seed: int = 42, id_col: str = "row_id",
                 label_col: str = "label", x_col: str = "x"):
    """M20 (mini-batch): every epoch draws ``batch_frac`` x rows fresh pairs from all rows of
    ``feat`` (by hash of seed and epoch) and one Spark job sums their hinge sub-gradient;
    the driver steps M <- PSD(M - γ(t) G), with G = mean_pairs(y·[active]·δδᵀ) + α(t) M.
    The objective, mean hinge (margin ``margin_obj``) + α(t)/2 ‖M‖_F, is taken on one
    fixed list of ``n_objective`` pairs.

    Returns (M, trace rows [(epoch, objective, n_pairs, n_active)])."""
    gamma_f = gamma if callable(gamma) else (lambda t: gamma)
    alpha_f = alpha if callable(alpha) else (lambda t: alpha)
    m = np.eye(d) if m0 is None else np.array(m0, dtype=float)
    spark = feat.sparkSession
    feat = cut_lineage(feat.select(F.col(id_col).alias("row_id"), F.col(label_col).alias("label"),
                                   F.col(x_col).alias("x")))
    index = pair_index(feat, "row_id", "label")
    fixed = cut_lineage(pair_vectors(pairs_of_index(index, n_objective, positive_ratio, seed), feat)
                        .select("xa", "xb", "y"))
    size = max(1, round(batch_frac * index.n))
    trace = []
    for t in range(epochs):
        _, hsum, n_obj, _ = _collect_gradient(epoch_gradient(fixed, m, margin_obj, margin_grad), d)
        batch = pair_vectors(pairs_of_index(index, size, positive_ratio, epoch_seed(seed, t)), feat)
        grad, _, n, n_act = _collect_gradient(epoch_gradient(batch, m, margin_obj, margin_grad), d)
        if n == 0 or n_obj == 0:
            break
        a = alpha_f(t)
        trace.append((t, hsum / n_obj + a / 2.0 * float(np.linalg.norm(m)), int(n), int(n_act)))
        m = nearest_psd(m - gamma_f(t) * (grad / n + a * m))
    for table in (feat, fixed):
        drop_table(spark, table_path(table))
    return m, trace


def local_steps(m: np.ndarray, delta: np.ndarray, y: np.ndarray, first_step: int, batch: int, gamma, alpha,
                margin: float) -> np.ndarray:
    """Stochastic steps from ``m``: one per ``batch`` pairs, each M <- PSD(M - γ(t) G) with
    G = mean(y·[active]·δδᵀ) + α(t) M. A step whose matrix has a Cholesky factor needs no projection."""
    m, eye = m.copy(), np.eye(len(m)) * 1e-12
    for k, i in enumerate(range(0, len(y), batch)):
        t, d, s = first_step + k, delta[i:i + batch], y[i:i + batch]
        d2 = ((d @ m) * d).sum(1)
        w = s * (1.0 + s * (d2 - margin) > 0)
        m -= gamma(t) * ((d * w[:, None]).T @ d / len(s) + alpha(t) * m)
        try:
            np.linalg.cholesky(m + eye)
        except np.linalg.LinAlgError:
            m = nearest_psd(m)
    return m


def _group_steps(m: np.ndarray, first_step: int, batch: int, gamma, alpha, margin: float):
    """One group's steps on its pairs in the order of their numbers: (i, j, v) of its matrix."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pair_id")
        delta = matrix_of(t.column("xa")) - matrix_of(t.column("xb"))
        out = local_steps(m, delta, t.column("y").to_numpy(), first_step, batch, gamma, alpha, margin)
        i, j = np.indices(out.shape)
        return pa.table({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()),
                         "v": pa.array(out.ravel())})
    return run


def stochastic_metric(feat: DataFrame, d: int, rounds: int = 10, groups: int = 10, steps: int = 1000, batch: int = 10,
                      gamma=lambda t: 0.001 / np.sqrt(t + 1), alpha=lambda t: 1e-8, margin_obj: float = 2.0,
                      margin_grad: float = 0.5, n_objective: int = 1000, positive_ratio: float = 0.1, seed: int = 42,
                      id_col: str = "row_id", label_col: str = "label", x_col: str = "x"):
    """M20 (stochastic): ``rounds`` x ``groups`` x ``steps`` steps of ``batch`` pairs. In a round every
    group starts from the same matrix and takes ``steps`` steps on its own fresh pairs inside one task;
    the groups' matrices are averaged (one d x d partial sum a group). A group holds
    ``steps`` x ``batch`` pairs whatever the table's size; the step size goes on counting over the rounds.

    Returns (M, trace rows [(round, steps so far, objective, n_pairs)]); the objective is taken on fixed pairs
    before each round, and once more at the end."""
    spark = feat.sparkSession
    feat = cut_lineage(feat.select(F.col(id_col).alias("row_id"), F.col(label_col).alias("label"),
                                   F.col(x_col).alias("x")))
    index = pair_index(feat, "row_id", "label")
    fixed = cut_lineage(pair_vectors(pairs_of_index(index, n_objective, positive_ratio, seed), feat)
                        .select("xa", "xb", "y"))
    m, trace = np.eye(d), []

    def objective(t):
        _, hinge_sum, n, _ = _collect_gradient(epoch_gradient(fixed, m, margin_obj, margin_grad), d)
        return (hinge_sum / n if n else None), n

    for r in range(rounds + 1):
        done = r * steps
        loss, n = objective(done)
        if loss is None:
            break
        trace.append((r, done * groups, loss + alpha(done) / 2.0 * float(np.linalg.norm(m)), int(n)))
        if r == rounds:
            break
        pairs = pairs_of_index(index, groups * steps * batch, positive_ratio, epoch_seed(seed, r))
        pv = pair_vectors(pairs, feat).withColumn("g", F.col("pair_id") % groups)

        kernel = _group_steps(m, done, batch, gamma, alpha, margin_grad)
        mean = (pv.select("g", "pair_id", "xa", "xb", "y").groupBy("g").applyInArrow(kernel, "i int, j int, v double")
                .groupBy("i", "j").agg(F.avg("v").alias("v")))
        m = nearest_psd(_collect_gradient(mean, d)[0])
    for table in (feat, fixed):
        drop_table(spark, table_path(table))
    return m, trace


def epoch_seed(seed, epoch: int) -> str:
    return f"{seed}.{epoch}"
