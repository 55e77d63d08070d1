"""Nearest training row within a key, under a metric δᵀ M δ.

Keys with few training rows meet their queries in an equi-join, distances are
native expressions and a ``min_by`` picks the winner. A key with many rows is cut
into blocks along the coordinates in which its rows differ most (a grid of
quantiles over two of them); every block knows its smallest box. A query block
first meets the training block nearest to it, which bounds the distance its rows
can have; after that only blocks whose boxes are not farther apart than that
bound are joined. The bound is exact, so no winner is lost, and block pairs
that cannot hold one are dropped before any row is joined.

A full matrix is factored once (M = LᵀL - NᵀN) and every *row* is projected once; distances
are then sums of signed squares. No function runs per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_lineage_observed, drop_table, table_path
from . import joins

HOT_ROWS = 2048   # training rows of a key that an equi-join may meet with each query
QUANTILES = 256   # edges a coordinate is cut at
BROADCAST_ROWS = 200_000  # rows of a table of cells or boxes sent to every task (under 100 bytes a coordinate pair)


def matrix_of(arr) -> np.ndarray:
    """A list<double> Arrow column of equal-length rows as an (n, d) matrix
    (zero-copy view of the child values)."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1)


# ----------------------------------------------------------------- projection
def metric_factor(m) -> tuple[np.ndarray, list[float]]:
    """(P, signs) with δᵀ M δ = Σ signs_k (P δ)_k²: the eigenvectors of the symmetric part,
    scaled by the roots of their eigenvalues; a negative eigenvalue has sign -1."""
    arr = np.asarray(m, dtype=float)
    values, vectors = np.linalg.eigh((arr + arr.T) / 2.0)
    keep = np.abs(values) > 1e-14 * max(1e-300, np.abs(values).max())
    return (vectors[:, keep] * np.sqrt(np.abs(values[keep]))).T, np.sign(values[keep]).tolist()


def project_rows(rows: DataFrame, p: np.ndarray, x_col: str = "x") -> DataFrame:
    """Every row's vector replaced by ``p`` times it, once a row."""
    names = rows.columns
    schema = ", ".join(f"`{f.name}` " + ("array<double>" if f.name == x_col else f.dataType.simpleString())
                       for f in rows.schema.fields)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix_of(b.column(x_col))
            x = np.stack([(x * r).sum(1) for r in p], 1)  # the same sum for equal rows, wherever they lie
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, p.shape[0]), pa.int32()),
                                             pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([lists if n == x_col else b.column(n) for n in names], names)

    return rows.mapInArrow(run, schema)


def weighted_sq_dist(a: F.Column, b: F.Column, weights) -> F.Column:
    """Σ w_i (a_i - b_i)², one term after the other (one generated expression)."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        gap = a[i] - b[i]
        total = total + F.lit(float(w)) * (gap * gap)
    return total


# ------------------------------------------------------------------ block path
def _box_gap(lo1, hi1, lo2, hi2, weights, far: bool) -> F.Column:
    """Smallest (``far``: largest) value that Σ w_i gap_i² takes between two boxes."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        most = F.greatest(hi1[i] - lo2[i], hi2[i] - lo1[i])
        least = F.greatest(F.lit(0.0), lo1[i] - hi2[i], lo2[i] - hi1[i])
        gap = most if far == (w >= 0) else least
        total = total + F.lit(float(w)) * (gap * gap)
    return total


def _centre_gap(lo1, hi1, lo2, hi2, weights) -> F.Column:
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        gap = (lo1[i] + hi1[i]) - (lo2[i] + hi2[i])
        total = total + F.lit(abs(float(w))) * (gap * gap)
    return total


def _grid(train: DataFrame, key: str, weights, block: int) -> DataFrame:
    """One row per big key: its two most spread coordinates, their quantile edges and how many
    stretches each is cut into (about rows / ``block`` cells together)."""
    spread = F.sort_array(F.array(*[F.struct((F.var_pop(F.col("x")[i]) * abs(float(w))).alias("v"), F.lit(i).alias("i"))
                                    for i, w in enumerate(weights)]), asc=False)
    top = train.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), spread.alias("s"))
    one, two = F.col("s")[0], F.get("s", F.lit(1))
    cells = F.greatest(F.lit(1.0), F.ceil(F.col("_n") / F.lit(float(block))).cast("double"))
    ratio = F.sqrt(one["v"] / F.greatest(F.coalesce(two["v"], F.lit(0.0)), one["v"] * 1e-12, F.lit(1e-300)))
    g1 = F.least(F.lit(float(QUANTILES)), cells, F.greatest(F.lit(1.0), F.round(F.sqrt(cells * ratio))))
    top = top.select(key, one["i"].alias("_i1"), F.coalesce(two["i"], one["i"]).alias("_i2"),
                     g1.cast("int").alias("_g1"), cells.alias("_cells"))
    top = top.withColumn("_g2", F.least(F.lit(QUANTILES), F.ceil(F.col("_cells") / F.col("_g1"))).cast("int")).drop("_cells")
    points = F.lit([(q + 1) / QUANTILES for q in range(QUANTILES - 1)])
    top = cut_lineage(top)
    at = train.join(F.broadcast(top) if top.count() <= BROADCAST_ROWS else top, key)
    edges = at.groupBy(key).agg(
        F.percentile_approx(F.get("x", F.col("_i1")), points, F.lit(10_000)).alias("_e1"),
        F.percentile_approx(F.get("x", F.col("_i2")), points, F.lit(10_000)).alias("_e2"))
    return cut_lineage(top.join(edges, key))


def _celled(rows: DataFrame, grid: DataFrame, key: str, hot: list, id_col: str, block: int):
    """Rows with their block (``_blk``): the grid cell, cut by hash where it has more rows than a
    block. NULL keys have no row in ``grid`` and leave here."""
    place = lambda i, e, g: F.floor(F.size(F.filter(F.col(e), lambda v: v < F.get("x", F.col(i))))
                                    * F.col(g) / F.lit(QUANTILES))
    cells = joins.split_join(rows, grid, key, hot).withColumn(
        "_cell", (place("_i1", "_e1", "_g1") * QUANTILES + place("_i2", "_e2", "_g2")).cast("bigint"))
    cells = cut_lineage(cells.drop("_i1", "_i2", "_e1", "_e2", "_g1", "_g2"))
    counts, seen = cut_lineage_observed(
        cells.groupBy(key, "_cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_cuts"))
        .where("_cuts > 1"), [F.count(F.lit(1)).alias("n")])
    side = F.broadcast(counts) if seen["n"] <= BROADCAST_ROWS else counts
    out = cells.join(side, [key, "_cell"], "left").withColumn(
        "_blk", F.col("_cell") * F.lit(1 << 40)
        + F.pmod(F.xxhash64(id_col), F.coalesce("_cuts", F.lit(1)))).drop("_cuts", "_cell")
    return out, [cells, counts]


def _blocks(rows: DataFrame, key: str, d: int, row: list, name: str):
    """(key, _blk, rows sorted by their first column, lo, hi) as a written table."""
    x = F.col("x")
    return cut_lineage(rows.groupBy(key, "_blk").agg(
        F.sort_array(F.collect_list(F.struct(*row))).alias(name),
        F.array(*[F.min(x[i]) for i in range(d)]).alias("lo"),
        F.array(*[F.max(x[i]) for i in range(d)]).alias("hi")))


def _block_kernel(key: str, weights, decimals: int):
    """For every pair of blocks: each query row's best training row. Distances are summed
    coordinate by coordinate (equal ones stay bit-identical); training rows lie in the order of
    ``t_ord``, so the first smallest distance is the winner."""
    def run(batches):
        for rb in batches:
            for k in range(rb.num_rows):
                tr, te = rb.column("train")[k].values, rb.column("test")[k].values
                xt, xq = matrix_of(tr.field("x")), matrix_of(te.field("x"))
                d2 = np.zeros((len(xq), len(xt)))
                for c, w in enumerate(weights):
                    gap = xq[:, c, None] - xt[None, :, c]
                    d2 += w * (gap * gap)
                d2 = np.round(d2, decimals)
                pick = d2.argmin(1)
                win, here = pa.array(pick), pa.array(np.full(len(pick), k))
                yield pa.RecordBatch.from_arrays(
                    [rb.column(key).take(here), rb.column("qblk").take(here), te.field("q_id"),
                     pa.array(d2[np.arange(len(pick)), pick]), tr.field("t_ord").take(win),
                     tr.field("rating").take(win)], [key, "qblk", "q_id", "d2", "t_ord", "nn_rating"])
    return run


def _meet(pairs: DataFrame, tb: DataFrame, qb: DataFrame, key: str, weights, decimals: int) -> DataFrame:
    t = tb.select(key, F.col("_blk").alias("tblk"), "train")
    q = qb.select(key, F.col("_blk").alias("qblk"), "test")
    kind = lambda df, col, name: df.schema[col].dataType.elementType[name].dataType.simpleString()
    return pairs.select(key, "qblk", "tblk").join(t, [key, "tblk"]).join(q, [key, "qblk"]).select(
        key, "qblk", "train", "test").mapInArrow(
        _block_kernel(key, weights, decimals),
        f"`{key}` {qb.schema[key].dataType.simpleString()}, qblk bigint, q_id {kind(qb, 'test', 'q_id')}, d2 double, "
        f"t_ord {kind(tb, 'train', 't_ord')}, nn_rating {kind(tb, 'train', 'rating')}")


def _pruned(train: DataFrame, test: DataFrame, key: str, weights, block: int, decimals: int, hot: list,
            report: dict | None) -> DataFrame:
    """The block path: (q_id, d2, t_ord, nn_rating), written."""
    spark, d = train.sparkSession, len(weights)
    grid = _grid(train, key, weights, block)
    t_rows, tmp1 = _celled(train, grid, key, hot, "t_ord", block)
    q_rows, tmp2 = _celled(test, grid, key, hot, "q_id", block)
    tb = _blocks(t_rows, key, d, ["t_ord", "rating", "x"], "train")
    qb = _blocks(q_rows, key, d, ["q_id", "x"], "test")
    t_box = tb.select(key, F.col("_blk").alias("tblk"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    q_box = qb.select(key, F.col("_blk").alias("qblk"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"))
    boxes = [F.col(c) for c in ("qlo", "qhi", "tlo", "thi")]
    both = q_box.join(F.broadcast(t_box) if tb.count() * d <= 32 * BROADCAST_ROWS else t_box, key).select(
        key, "qblk", "tblk", _box_gap(*boxes, weights, False).alias("least"),
        _centre_gap(*boxes, weights).alias("centre"))
    first, seen = cut_lineage_observed(
        both.groupBy(key, "qblk").agg(F.min_by("tblk", F.struct("least", "centre", "tblk")).alias("tblk"),
                                      F.count(F.lit(1)).alias("n")),
        [F.count(F.lit(1)).alias("met"), F.sum("n").alias("pairs")])
    found1 = cut_lineage(_meet(first, tb, qb, key, weights, decimals))
    reach = found1.groupBy(key, "qblk").agg(F.max("d2").alias("reach")).join(
        first.select(key, "qblk", F.col("tblk").alias("done")), [key, "qblk"])
    slack = F.col("reach") + F.abs("reach") * 1e-9 + F.lit(2.0 * 10.0 ** -decimals)
    rest, seen2 = cut_lineage_observed(
        both.join(reach, [key, "qblk"]).where((F.col("least") <= slack) & (F.col("tblk") != F.col("done")))
        .select(key, "qblk", "tblk"), [F.count(F.lit(1)).alias("met")])
    found2 = cut_lineage(_meet(rest, tb, qb, key, weights, decimals))
    for table in (grid, *tmp1, *tmp2, tb, qb, first, rest):
        drop_table(spark, table_path(table))
    if report is not None:
        report.update(pairs=seen["pairs"] or 0, compared=seen["met"] + seen2["met"])
    cols = ["q_id", "d2", "t_ord", "nn_rating"]
    return found1.select(*cols).unionByName(found2.select(*cols))


def nearest_train(train: DataFrame, test: DataFrame, key: str, m=None, block: int = 256, decimals: int = 9,
                  hot_rows: int = HOT_ROWS, report: dict | None = None) -> DataFrame:
    """For every query row, the training row with the same ``key`` and
    the smallest δᵀ M δ (rounded to ``decimals``), ties to the smallest
    ``t_ord``; returns (q_id, d2, t_ord, nn_rating). ``m``: None (identity), a
    diagonal, or a full matrix. train: (key, t_ord, rating, x); test: (key, q_id, x).

    A NULL component counts as 0 (the mean of a centred feature), so rows with
    missing features stay comparable. Keys with more than ``hot_rows`` training rows, or with so many
    queries that one task would get too large a share, take the block path (about ``block`` rows a
    block); ``report`` then receives the number of block ``pairs`` and those ``compared``.
    """
    filled = F.transform(F.col("x"), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    train = train.select(key, "t_ord", "rating", filled.alias("x"))
    test = test.select(key, "q_id", filled.alias("x"))
    if m is None:
        row = train.select(F.size("x")).first()
        weights = [1.0] * (row[0] if row else 0)
    elif np.ndim(m) == 1:
        weights = [float(w) for w in m]
    else:
        p, weights = metric_factor(m)
        train, test = project_rows(train, p), project_rows(test, p)

    parts = joins.shuffle_parts(train)
    t_counts = train.groupBy(key).agg(F.count(F.lit(1)).alias("_ct"))
    q_counts = test.groupBy(key).agg(F.count(F.lit(1)).alias("_cq"))
    counts = cut_lineage(t_counts.join(q_counts, key, "full"))
    total = counts.agg(F.sum("_ct").alias("t"), F.sum("_cq").alias("q")).first()
    hot_t = joins.hot_keys_from_counts(counts, key, "_ct", total["t"] or 0, parts)
    hot_q = joins.hot_keys_from_counts(counts, key, "_cq", total["q"] or 0, parts)
    hot = sorted(set(hot_t) | set(hot_q))
    many_q = max(hot_rows, (total["q"] or 0) // (2 * parts))
    big, seen = cut_lineage_observed(
        counts.where(F.col("_ct").isNotNull() & F.col("_cq").isNotNull()
                     & ((F.col("_ct") > hot_rows) | (F.col("_cq") > many_q))).select(key, F.lit(True).alias("_big")),
        [F.count(F.lit(1)).alias("n")])
    found = None
    if seen["n"]:
        tag = lambda df: joins.split_join(df, big, key, hot, "left")
        train, test = tag(train), tag(test)
        found = _pruned(train.where("_big").drop("_big"), test.where("_big").drop("_big"), key, weights, block,
                        decimals, hot, report)
        train, test = train.where("_big is null").drop("_big"), test.where("_big is null").drop("_big")
    elif report is not None:
        report.update(pairs=0, compared=0)
    # ordinary keys: at most ``hot_rows`` training rows each, as one list a key
    lists = train.groupBy(key).agg(F.collect_list(F.struct("t_ord", "rating", F.col("x").alias("xt"))).alias("_t"))
    best = F.array_min(F.transform("_t", lambda t: F.struct(
        F.round(weighted_sq_dist(F.col("x"), t["xt"], weights), decimals).alias("d2"), t["t_ord"].alias("t_ord"),
        t["rating"].alias("r"))))
    near = test.join(lists, key).select("q_id", best.alias("b")).select(
        "q_id", F.col("b.d2").alias("d2"), F.col("b.t_ord").alias("t_ord"), F.col("b.r").alias("nn_rating"))
    if found is None:
        return near
    won = found.groupBy("q_id").agg(F.min("d2").alias("d2"),
                                    F.min_by(F.struct("t_ord", "nn_rating"), F.struct("d2", "t_ord")).alias("_w"))
    return near.unionByName(won.select("q_id", "d2", F.col("_w.t_ord").alias("t_ord"),
                                       F.col("_w.nn_rating").alias("nn_rating")))
