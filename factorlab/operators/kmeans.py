"""Mini-batch k-means: hash-drawn batches, per-centre counts as step sizes, centres as a
small table.

Batches are drawn once: in each epoch every row gets a place by hash, and the epoch is cut into
batches of about ``batch_rows``; only rows of the batches that will be used are written, one
folder a batch, so a step reads its own rows and nothing else. A step assigns its rows to
the nearest centre inside the tasks (one partial sum per centre and task), and moves every
centre towards its rows' mean by rows / (rows it has ever seen). Centres are k rows; they
and their k x d sums are all that reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash01
from ..session import cut_lineage, cut_lineage_observed, drop_table, table_path
from .neighbours import matrix_of

DECIMALS = 9  # distances are compared after rounding, so equal ones go to the smaller centre number


def _key(seed, tag, key_col: str) -> F.Column:
    return F.concat_ws(":", F.lit(str(seed)), F.lit(str(tag)), F.col(key_col).cast("string"))


def draw_centres(rows: DataFrame, k: int, key_col: str, seed: int) -> DataFrame:
    """(centre, x): the k rows of smallest md5 of (seed, 'c', key), numbered from 0 in that
    order; equal vectors may be drawn twice (the second then stays without rows)."""
    h = F.md5(_key(seed, "c", key_col))
    top = rows.select(h.alias("h"), F.col(key_col).cast("string").alias("key"), "x").orderBy("h", "key").limit(k)
    listed = top.groupBy().agg(F.sort_array(F.collect_list(F.struct("h", "key", "x"))).alias("all"))  # k rows
    return listed.select(F.posexplode("all").alias("centre", "r")).select("centre", F.col("r.x").alias("x"))


def batch_of(key_col: str, seed, epoch, batches: int) -> F.Column:
    """Place of a row's batch in an epoch of ``batches`` batches."""
    return F.floor(hash01(_key(seed, epoch, key_col)) * F.lit(batches)).cast("int")


def draw_batches(rows: DataFrame, key_col: str, n: int, steps: int, batch_rows: int, seed: int) -> tuple[DataFrame, int]:
    """(batch, x) of the batches 0 .. steps - 1, one folder each, and the batches of an epoch."""
    per = max(1, -(-n // batch_rows))
    epochs = -(-steps // per)
    places = F.array(*[batch_of(key_col, seed, e, per) + F.lit(e * per) for e in range(epochs)])
    drawn = rows.select(F.explode(places).alias("batch"), "x").where(F.col("batch") < steps)
    return cut_lineage(drawn, partition_by=["batch"]), per


def _nearest_of_all(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest of all centres; distances are summed coordinate by coordinate."""
    d2 = np.zeros((len(x), len(centres)))
    for c in range(x.shape[1]):
        gap = x[:, c, None] - centres[None, :, c]
        d2 += gap * gap
    return np.round(d2, DECIMALS).argmin(1)


def nearest_centre(x: np.ndarray, centres: np.ndarray, chunk: int = 1 << 22) -> np.ndarray:
    """Number of the nearest centre of every row. One matrix product finds the centres that can be nearest; where
    that leaves several, their distances are summed coordinate by coordinate and compared, as
    :func:`_nearest_of_all` does (rows that are not finite go there)."""
    out = np.zeros(len(x), np.int64)
    step = max(1, chunk // max(1, len(centres)))
    with np.errstate(over="ignore", invalid="ignore"):
        c2 = (centres * centres).sum(1)
        reach = np.sqrt(c2.max()) if len(c2) else 0.0
        for i in range(0, len(x), step):
            part = x[i:i + step]
            near = part @ (-2.0 * centres.T)
            near += c2
            best = near.min(1)
            # errors of product and sums on both sides, and the rounding of what is compared
            size = (np.sqrt((part * part).sum(1)) + reach) ** 2
            edge = best + 16 * (x.shape[1] + 8) * np.finfo(float).eps * size + 2 * 10.0 ** -DECIMALS
            whole = np.isfinite(edge)
            row, at = np.nonzero(near <= np.where(whole, edge, -np.inf)[:, None])
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
            got = np.zeros(len(part), np.int64)
            got[row[first]] = at[first]
            many = np.repeat(np.diff(np.append(first, len(row))) > 1, np.diff(np.append(first, len(row))))
            r, c = row[many], at[many]
            if len(r):
                d2 = np.zeros(len(r))
                for k in range(x.shape[1]):
                    gap = part[r, k] - centres[c, k]
                    d2 += gap * gap
                d2 = np.round(d2, DECIMALS)
                start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                least = np.repeat(np.minimum.reduceat(d2, start), np.diff(np.append(start, len(r))))
                hit = np.flatnonzero(d2 == least)
                one = hit[np.concatenate([[True], r[hit][1:] != r[hit][:-1]])]  # the smallest number
                got[r[one]] = c[one]
            if not whole.all():
                got[~whole] = _nearest_of_all(part[~whole], centres)
            out[i:i + step] = got
    return out


def _sums(shared):
    def run(batches):
        centres = shared.value
        k, d = centres.shape
        total, count = np.zeros((k, d)), np.zeros(k, np.int64)
        for b in batches:
            x = matrix_of(b.column("x"))
            if len(x):
                at = nearest_centre(x, centres)
                count += np.bincount(at, minlength=k)
                for c in range(d):
                    total[:, c] += np.bincount(at, x[:, c], k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.float64()))],
            ["centre", "n", "s"])
    return run


def _filled(rows: DataFrame, key_col: str, x_col: str) -> DataFrame:
    return rows.select(key_col, F.transform(F.col(x_col), lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("x"))


def fit_minibatch(rows: DataFrame, k: int, key_col: str, steps: int, batch_rows: int, seed: int = 42,
                  x_col: str = "x") -> DataFrame:
    """(centre, x, n) after ``steps`` batches; n counts the rows a centre has ever seen."""
    spark = rows.sparkSession
    rows, seen = cut_lineage_observed(_filled(rows, key_col, x_col), [F.count(F.lit(1)).alias("n")])
    drawn = draw_centres(rows, k, key_col, seed).orderBy("centre").toArrow()  # k rows
    centres = matrix_of(drawn.column("x"))
    counts = np.zeros(len(centres), np.int64)
    d = centres.shape[1] if len(centres) else 0
    batches, _ = draw_batches(rows, key_col, seen["n"], steps, batch_rows, seed)
    for b in range(steps if len(centres) else 0):
        shared = spark.sparkContext.broadcast(centres)
        parts = batches.where(F.col("batch") == b).select("x").mapInArrow(
            _sums(shared), "centre int, n bigint, s array<double>")
        got = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.array(
            *[F.sum(F.col("s")[i]) for i in range(d)]).alias("s")).toArrow()  # k rows at most
        shared.unpersist()
        if not got.num_rows:
            continue
        at, n = got.column("centre").to_numpy(), got.column("n").to_numpy()
        total = matrix_of(got.column("s"))
        before = counts[at]
        counts[at] += n
        centres = centres.copy()
        centres[at] = (centres[at] * before[:, None] + total) / counts[at][:, None]
    for table in (rows, batches):
        drop_table(spark, table_path(table))
    return spark.createDataFrame([(i, c.tolist(), int(v)) for i, (c, v) in enumerate(zip(centres, counts))],
                                 "centre int, x array<double>, n bigint")


def assign(rows: DataFrame, centres: DataFrame, x_col: str = "x", out: str = "cluster") -> DataFrame:
    """Every row with the number of its nearest centre (k rows are sent to the tasks)."""
    got = centres.orderBy("centre").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast(matrix_of(got.column("x")))
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{out}` int"
    filled = F.transform(F.col(x_col), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))

    def run(batches):
        for b in batches:
            x = matrix_of(b.column("_filled"))
            at = nearest_centre(x, shared.value) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(at, pa.int32())], [*names, out])

    return rows.withColumn("_filled", filled).mapInArrow(run, schema)
