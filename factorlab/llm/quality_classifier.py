"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

The document statistics are written once as a narrow table. Their mean and
spread come from native aggregates; random cosine features then approximate a
Gaussian kernel over the standardised statistics. Every labelled row of the
learning fold enters the normal equations: each task sums its part of Z'Z and
Z'y, a second layer adds the parts of a group of tasks, and the driver adds the
few sums left and solves. A fifth of the fold is held back: its raw scores,
counted per bin by a native aggregate, give the isotonic step function.

Defined cases: a null text reads as empty and gets the score of an empty text;
equal texts get equal scores; without both labels every score is the share of
label 1 (0.5 without any label); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import chunks, hash01, labelled, texts_of, utf8
from .models import isotonic
from .textstats import FEATURES, Words, features

N_FOURIER = 192
RIDGE = 1e-3
BINS = 1024


@dataclass
class FourierRidge:
    mean: np.ndarray
    sd: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    steps: np.ndarray | None = None
    prior: float = 0.5

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        c = np.cos(z @ self.omega + self.phase) * math.sqrt(2.0 / self.omega.shape[1])
        return np.c_[c, np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.lift(x) @ self.weights, 0.0, 1.0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        r = self.raw(x)
        if self.steps is None:
            return np.round(r, 9)
        # rounded: equal texts must not differ by the order of a sum
        return np.round(np.clip(np.interp(r, (np.arange(BINS) + 0.5) / BINS, self.steps), 0.0, 1.0), 9)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of :data:`~.textstats.FEATURES`, one pass over the texts."""
    def run(batches):
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            for i, j in chunks(off):
                x = features(Words(texts_of(data, off, i, j)))
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), flat],
                                                 ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def matrix(col) -> np.ndarray:
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


def learn_quality(stats: DataFrame, labels: DataFrame, n_fourier: int = N_FOURIER,
                  ridge: float = RIDGE, seed: int = 9) -> FourierRidge:
    """Fit on all labelled rows of the learning fold (``stats`` is a written table)."""
    nf = len(FEATURES)
    m = stats.agg(*[F.avg(F.col("x")[f]).alias(f"m{f}") for f in range(nf)],
                  *[F.stddev_pop(F.col("x")[f]).alias(f"s{f}") for f in range(nf)]).first()
    rng = np.random.default_rng(seed)
    mean = np.array([m[f"m{f}"] or 0.0 for f in range(nf)])
    sd = np.array([m[f"s{f}"] or 0.0 for f in range(nf)])
    model = FourierRidge(mean, np.where(sd > 1e-9, sd, 1.0),
                         rng.normal(0, 1 / math.sqrt(nf), (nf, n_fourier)),
                         rng.uniform(0, 2 * math.pi, n_fourier))
    rows = (labelled(labels, "quality").join(stats, "doc_id")
            .select("x", "y", (hash01("doc_id", seed) < 0.8).alias("fit")))
    rows = cut_lineage(rows)
    d = n_fourier + 1

    def part(batches):
        a, v, n, p = np.zeros((d, d)), np.zeros(d), 0, 0.0
        for b in batches:
            x, y = matrix(b.column("x")), np.asarray(b.column("y"), float)
            for i in range(0, len(y), 4096):
                z = model.lift(x[i:i + 4096])
                a += z.T @ z
                v += z.T @ y[i:i + 4096]
            n, p = n + len(y), p + y.sum()
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n]), pa.array([p]),
                 pa.array([np.c_[a, v].tobytes()], pa.binary())], ["p", "n", "pos", "sums"])

    def merge(batches):
        a, n, p = np.zeros((d, d + 1)), 0, 0.0
        for b in batches:
            for r in b.to_pylist():
                a += np.frombuffer(r["sums"]).reshape(d, d + 1)
                n, p = n + r["n"], p + r["pos"]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n]), pa.array([p]),
                                              pa.array([a.tobytes()], pa.binary())],
                                             ["p", "n", "pos", "sums"])

    schema = "p int, n long, pos double, sums binary"
    parts = rows.where("fit").select("x", "y").mapInArrow(part, schema)
    n_groups = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    got = parts.repartition(n_groups, "p").mapInArrow(merge, schema).collect()
    n, pos = sum(r["n"] for r in got), sum(r["pos"] for r in got)
    model.prior = pos / n if n else 0.5
    if n and 0 < pos < n:
        s = np.sum([np.frombuffer(r["sums"]).reshape(d, d + 1) for r in got], axis=0)
        model.weights = np.linalg.solve(s[:, :d] + ridge * n / d * np.eye(d), s[:, d])

        def bins(batches):
            for b in batches:
                r = model.raw(matrix(b.column("x")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum((r * BINS).astype(np.int32), BINS - 1)), b.column("y")],
                    ["bin", "y"])

        held = (rows.where("not fit").select("x", "y").mapInArrow(bins, "bin int, y int")
                .groupBy("bin").agg(F.sum("y").alias("pos"), F.count("y").alias("n"))
                .orderBy("bin").collect())  # at most BINS rows
        if held:
            at = np.array([r["bin"] for r in held])
            level = isotonic(at, np.array([r["pos"] for r in held]), np.array([r["n"] for r in held]))
            model.steps = np.interp(np.arange(BINS), at, level)
    return model


def score_quality(stats: DataFrame, model: FourierRidge) -> DataFrame:
    """(doc_id, score): calibrated probability of label 1."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(model.predict(matrix(b.column("x"))))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
