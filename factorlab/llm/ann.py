"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stop.

Vectors are projected to ``PROJECTED`` dimensions with independent normal
directions: for a pair at distance r, the squared projected distance divided by
r squared follows a chi-square distribution. A small kd-tree over a bounded
sample (``SAMPLE_ROWS`` rows by id hash) cuts the projected space into at most
``MAX_CELLS`` cells; every row of the table lies in one, and a cell with many
rows (also a third of all, if vectors repeat) is dealt by id hash into blocks of
about ``BLOCK_ROWS`` rows. A block builds its own kd-tree, and a query visits
its leaves in order of projected distance: each next projected neighbour is
verified on the original vector until no unseen row of that projected distance
would be closer than the k-th best with probability above 1 - ``CONFIDENCE``.

Round 1 searches each query's own cell; round 2 only the cells whose box meets
the stopping radius that round 1 leaves. Equal query vectors are searched once.

Defined cases: vectors that are null, zero, of another length than the most
frequent one (ties: the longer), or that hold null or non-finite components, and rows without
id, take no part; repeated rows count once; a query id with several vectors uses the
smallest, and rows under the query's id are its own; fewer than k candidates give all of them; ties go to
the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PROJECTED = 32  # even, so that the chi-square function has a closed form
CONFIDENCE = 0.88  # an unseen row that is near is missed with at most this much less than certainty
WAVE = 32  # leaves whose points are looked at together
FIRST_CHECKED = 64  # projected neighbours verified at first; then twice as many each time
SAMPLE_ROWS = 16_384
MAX_CELLS = 1024
BLOCK_ROWS = 8192
LEAF_ROWS = 64


def chi_square_quantile(p: float, m: int = PROJECTED) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    def cdf(x):
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= (x / 2) / i
            total += term
        return 1.0 - math.exp(-x / 2) * total
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


@dataclass
class Cells:
    """Projection and the kd-tree of cells (heap order: children of i are 2i+1, 2i+2)."""
    directions: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    depth: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.directions

    def cell(self, z: np.ndarray) -> np.ndarray:
        node = np.zeros(len(z), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (z[np.arange(len(z)), self.axis[node]] > self.cut[node])
        return node - (2 ** self.depth - 1)


def build_cells(sample: np.ndarray, dim: int, n_rows: int, seed: int = 7) -> Cells:
    directions = np.random.default_rng(seed).normal(size=(dim, PROJECTED))
    z = sample @ directions
    depth = max(0, math.ceil(math.log2(max(1, n_rows / BLOCK_ROWS))))
    depth = min(depth, int(math.log2(MAX_CELLS)), max(0, int(math.log2(max(1, len(z) / 16)))))
    inner = 2 ** depth - 1
    axis, cut = np.zeros(max(1, inner), np.int64), np.zeros(max(1, inner))
    rows = {0: np.arange(len(z))}
    for i in range(inner):
        r = rows.pop(i)
        if len(r):
            axis[i] = int(np.ptp(z[r], axis=0).argmax())
            cut[i] = float(np.median(z[r, axis[i]]))
        right = z[r, axis[i]] > cut[i]
        rows[2 * i + 1], rows[2 * i + 2] = r[~right], r[right]
    return Cells(directions, axis, cut, depth)


class KdTree:
    """Leaves of about ``LEAF_ROWS`` projected points with their bounding boxes."""

    def __init__(self, z: np.ndarray):
        todo, leaves = [np.arange(len(z))], []
        while todo:
            r = todo.pop()
            spread = np.ptp(z[r], axis=0)
            if len(r) <= LEAF_ROWS or not spread.max() > 0:
                leaves.append(r)
                continue
            a, h = int(spread.argmax()), len(r) // 2
            order = r[np.argpartition(z[r, a], h)]
            todo += [order[:h], order[h:]]
        self.z, self.leaves, self.verified = z, leaves, 0
        self.z2, self.x2 = (z * z).sum(1), None
        self.low = np.array([z[r].min(0) for r in leaves])
        self.high = np.array([z[r].max(0) for r in leaves])

    def nearest(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qz: np.ndarray, k: int, stop: float,
                bound: float = math.inf) -> list[tuple[float, int]]:
        """The k nearest found (distance, id); ``bound`` is a k-th distance known elsewhere."""
        gap = np.maximum(0, np.maximum(self.low - qz, qz - self.high))
        # projected distances come from products: below this they may be rounding only
        qz2, q2 = float(qz @ qz), float(q @ q)
        tiny = 1e-12 * (1.0 + qz2)
        lower = np.maximum(0, (gap * gap).sum(1) - tiny)
        order = np.argsort(lower, kind="stable")
        x2 = np.einsum("ij,ij->i", x, x) if self.x2 is None else self.x2
        self.x2 = x2
        pool_d, pool_i = np.zeros(0), np.zeros(0, np.int64)
        best_d, best_i, kth = np.zeros(0), np.zeros(0, np.int64), bound
        for pos in range(0, len(order), WAVE):
            if lower[order[pos]] > stop * kth * kth and (not len(pool_d) or pool_d.min() > stop * kth * kth):
                break
            r = np.concatenate([self.leaves[leaf] for leaf in order[pos:pos + WAVE]])
            d = self.z2[r] - 2.0 * (self.z[r] @ qz) + qz2
            pool_d = np.concatenate([pool_d, np.maximum(0, d - tiny - 1e-12 * self.z2[r])])
            pool_i = np.concatenate([pool_i, r])
            nxt = lower[order[pos + WAVE]] if pos + WAVE < len(order) else math.inf
            now = np.flatnonzero((pool_d <= nxt) & (pool_d <= stop * kth * kth))  # the next projected neighbours
            now = now[np.argsort(pool_d[now], kind="stable")]
            at, size = 0, FIRST_CHECKED
            while at < len(now) and pool_d[now[at]] <= stop * kth * kth:  # nearest first, the bound tightens
                v = pool_i[now[at:at + size]]
                self.verified += len(v)
                xv = x[v]
                if len(best_d) >= k or kth < math.inf:  # what is farther than the k-th best by product is farther
                    near = x2[v] - 2.0 * (xv @ q) + q2 <= kth * kth + 1e-9 * (1.0 + kth * kth + x2[v] + q2)
                    v, xv = v[near], xv[near]
                d = xv - q
                best_d = np.concatenate([best_d, np.sqrt((d * d).sum(1))])
                best_i = np.concatenate([best_i, ids[v]])
                if len(best_d) > k:
                    o = np.lexsort((best_i, best_d))[:k]
                    best_d, best_i = best_d[o], best_i[o]
                if len(best_d) >= k:
                    kth = min(kth, best_d.max())
                at, size = at + size, 2 * size
            keep = pool_d > nxt
            pool_d, pool_i = pool_d[keep], pool_i[keep]
        o = np.lexsort((best_i, best_d))[:k]
        return list(zip(best_d[o].tolist(), best_i[o].tolist()))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the rows that take part, and their common length."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = int(top["d"]) if top else 0
    return rows.where(F.size("v") == dim), dim


def _matrix(col) -> np.ndarray:
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id",
                       vec_col: str = "embedding", confidence: float = CONFIDENCE,
                       seed: int = 7) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest found.

    ``is_query``: a Column over ``id`` that picks the query rows.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_col, vec_col)
    n = rows.count()
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE_ROWS).select("v").collect()
    cells = build_cells(np.array([r["v"] for r in sample]).reshape(-1, max(1, dim)), max(1, dim), n, seed)
    stop, m, k1 = chi_square_quantile(confidence), PROJECTED, k + 1

    def place(batches):
        for b in batches:
            if b.num_rows:
                z = cells.project(_matrix(b.column("v")))
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, z.size + 1, m), pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("v"), pa.array(cells.cell(z).astype(np.int32)), flat],
                    ["id", "v", "cell", "z"])

    placed = cut_lineage(rows.mapInArrow(place, "id long, v array<double>, cell int, z array<double>"))
    boxes = placed.groupBy("cell").agg(
        F.count("*").alias("n"), *[F.min(F.col("z")[i]).alias(f"l{i}") for i in range(m)],
        *[F.max(F.col("z")[i]).alias(f"h{i}") for i in range(m)]).orderBy("cell").collect()  # <= MAX_CELLS
    cell_ids = np.array([r["cell"] for r in boxes], np.int64)
    blocks_of = {int(r["cell"]): max(1, -(-int(r["n"]) // BLOCK_ROWS)) for r in boxes}
    low = np.array([[r[f"l{i}"] for i in range(m)] for r in boxes]).reshape(-1, m)
    high = np.array([[r[f"h{i}"] for i in range(m)] for r in boxes]).reshape(-1, m)
    if blocks_of:
        n_blocks = F.element_at(F.create_map(*[F.lit(x) for kv in blocks_of.items() for x in kv]), F.col("cell"))
    else:
        n_blocks = F.lit(1)
    data = placed.select("id", "v", "cell",
                         F.pmod(F.xxhash64(F.lit(seed), "id"), n_blocks).cast("int").alias("block"))

    members = (placed.where(is_query).groupBy("id").agg(F.min(F.struct("v", "cell", "z")).alias("q"))
               .select(F.col("id").alias("query_id"), "q.*"))
    members = cut_lineage(members)
    queries = (members.groupBy("v").agg(F.min("query_id").alias("rep"), F.first("cell").alias("cell"),
                                        F.first("z").alias("z")))
    queries = cut_lineage(queries)

    def search(key, points: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(qs):
            x = np.stack(points["v"].to_numpy())
            ids = points["id"].to_numpy()
            if len(np.unique(ids)) < len(ids):  # repeated rows lie in one block and count once
                keep = list({(i, v.tobytes()): r for r, (i, v) in enumerate(zip(ids, x))}.values())
                x, ids = x[keep], ids[keep]
            tree = KdTree(cells.project(x))
            for rep, q, bound in zip(qs["rep"], qs["v"], qs["bound"]):
                q = np.asarray(q, float)
                got = tree.nearest(x, ids, q, cells.project(q[None])[0], k1, stop, bound)
                out += [(rep, i, d) for d, i in got]
        return pd.DataFrame(out, columns=["rep", "id", "score"]).astype(
            {"rep": "int64", "id": "int64", "score": "float64"})

    def round_of(q: DataFrame) -> DataFrame:
        q = q.withColumn("block", F.explode(F.sequence(F.lit(0), (n_blocks - 1).cast("int"))))
        found = data.groupBy("cell", "block").cogroup(
            q.select("rep", "v", "bound", "cell", "block").groupBy("cell", "block")).applyInPandas(
            search, "rep long, id long, score double")
        best = Window.partitionBy("rep").orderBy("score", "id")
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k1).drop("r")

    inf = F.lit(float("inf"))
    first = cut_lineage(round_of(queries.withColumn("bound", inf)))
    bounds = first.groupBy("rep").agg(
        F.when(F.count("*") >= k1, F.max("score")).otherwise(inf).alias("bound"))

    def others(batches):
        for b in batches:
            if not b.num_rows:
                continue
            z, own = _matrix(b.column("z")), np.asarray(b.column("cell"))
            bound = np.asarray(b.column("bound"), float)
            at, cell = [], []
            for i in range(len(z)):
                gap = np.maximum(0, np.maximum(low - z[i], z[i] - high))
                near = cell_ids[((gap * gap).sum(1) <= stop * bound[i] * bound[i]) & (cell_ids != own[i])]
                at += [i] * len(near)
                cell += near.tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("rep").take(pa.array(at, pa.int64())), b.column("v").take(pa.array(at, pa.int64())),
                 pa.array(bound[at] if at else [], pa.float64()), pa.array(cell, pa.int32())],
                ["rep", "v", "bound", "cell"])

    more = (queries.join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", inf))
            .select("rep", "v", "cell", "z", "bound")
            .mapInArrow(others, "rep long, v array<double>, bound double, cell int"))
    found = first.unionByName(round_of(more))
    ranked = Window.partitionBy("query_id").orderBy("score", "id")
    return (members.select("query_id", "v").join(queries.select("v", "rep"), "v").select("query_id", "rep")
            .join(found, "rep").where(F.col("id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
