"""Hard-negative mining with exact integer scores from a residue-number-system product.

Components become integers, floor(``SCALE`` * x). A block of anchors meets a
block of rows: both matrices are reduced modulo several small primes and
multiplied in float32, which is exact, since at most ``SLICE`` products of
residues below p/2 are summed (up to 2^24) before the sum is reduced again.
Chinese remaindering (mixed radix) gives the signed scores; the number of
primes follows from the largest squared length in the data, so that twice its
value stays below their product (Cauchy-Schwarz).

Two passes over the blocks: the first keeps each anchor's best rows of its label (its
positives), the second, for each positive, the best rows of other labels whose
score lies in the window [``LOW``/``HIGH`` of the positive score, positive score].
Each pass sends on at most k rows per anchor (and positive) and block; a window per
anchor (and positive) picks the final ones. A row's block is chosen by hash, so no label, id or
vector fills a block; a block is bounded (``ROWS`` rows, ``ANCHORS`` anchors), and
anchors are a stated query set that meets all rows, block by block.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no
part (vectors without components do, at score 0); vectors of different length
meet as if the shorter one went on with zeros; rows equal in id, label and vector
count once; rows that share an id but not label and vector are rows of their own, also as anchors; ties go to the
smaller id; an anchor without positives, or a positive without negatives, gives no row;
scores of 2^62 or more raise an error; an empty table gives an empty result; further
columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_lineage_observed

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # window in percent of the positive score
SLICE = 64  # products summed in float32 before a reduction
ROWS = 65_536
ANCHORS = 4096
TILE = 1 << 20  # scores held at once


def primes_below(top: int, product: int) -> list[int]:
    """The largest primes below ``top``, as many as it takes for ``product`` (two at least)."""
    out, made, n = [], 1, top
    while made <= product or len(out) < 2:
        n -= 1
        if n < 3:
            raise ValueError("scores are too large for the small primes")
        if all(n % q for q in range(2, int(n ** 0.5) + 1)):
            out.append(n)
            made *= n
    return out


def top_prime(width: int = SLICE) -> int:
    """Residues lie within (p-1)/2 of zero, so ``width`` products stay exact in float32
    while width * ((p-1)/2)^2 <= 2^24."""
    return 2 * int((2 ** 24 / width) ** 0.5) + 2


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """Integers modulo p as float32 in [-(p-1)/2, (p-1)/2]."""
    r = m % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p from float32 residues, as float32 residues (exact)."""
    out = np.zeros((a.shape[0], b.shape[0]), np.float32)
    for i in range(0, a.shape[1], SLICE):
        part = a[:, i:i + SLICE] @ b[:, i:i + SLICE].T
        part -= np.float32(p) * np.rint(part / np.float32(p))
        out = part if i == 0 else out + part
        if i:
            out -= np.float32(p) * np.rint(out / np.float32(p))
    return out


def remainder_scores(parts: list, primes: list) -> np.ndarray:
    """Signed integers from their residues: mixed radix digits, then the upper half of the
    range counts as negative."""
    x = np.mod(parts[0].astype(np.int64), primes[0])
    m = primes[0]
    for r, p in zip(parts[1:], primes[1:]):
        digit = np.mod((r.astype(np.int64) - x % p) * pow(m, -1, p), p)
        if m * p < 1 << 62:
            x, m = x + m * digit, m * p
        else:  # the last digit: its signed form keeps the sum inside 64 bits
            digit = np.where(digit > p // 2, digit - p, digit)
            return x + m * digit
    return np.where(x > m // 2, x - m, x)


def scores(a: list, b: list, primes: list) -> np.ndarray:
    """Exact scores of anchors and rows given by their residues per prime."""
    return remainder_scores([residue_product(x, y, p) for x, y, p in zip(a, b, primes)], primes)


def _best(s: np.ndarray, open_: np.ndarray, k: int):
    """(row of s, column) of the k largest open scores of every row, ties to the smaller column."""
    low = np.iinfo(np.int64).min
    v = np.where(open_, s, low)
    rows, cols = [], []
    at = np.arange(len(v))
    for _ in range(min(k, v.shape[1])):
        best = v.argmax(1)
        ok = v[at, best] > low
        if not ok.any():
            break
        rows.append(at[ok])
        cols.append(best[ok])
        v[at, best] = low
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list<bigint> column as a matrix, shorter rows ended by zeros."""
    col = col.combine_chunks()
    out = np.zeros((len(col), width), np.int64)
    size = np.diff(np.asarray(col.offsets))
    flat = np.asarray(col.flatten())
    if len(flat):
        row = np.repeat(np.arange(len(col)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


class _Block:
    """One side of a block pair: ids, keys, labels and residues per prime, by (id, key)."""

    def __init__(self, t: pa.Table, width: int, primes: list):
        ids, keys = _column(t, "id"), _column(t, "key")
        self.order = np.lexsort((keys, ids))
        self.ids, self.keys, self.labels = ids[self.order], keys[self.order], _column(t, "label")[self.order]
        m = _matrix(t.column("v"), width)[self.order]
        self.parts = [residues(m, p) for p in primes]

    def take(self, at) -> list:
        return [x[at] for x in self.parts]


def _positives(width: int, primes: list, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor_id", "anchor_key", "id", "key", "score"]
        found = []
        if anchors.num_rows and rows.num_rows:
            a, b = _Block(anchors, width, primes), _Block(rows, width, primes)
            step = max(1, TILE // len(b.ids))
            for label in np.unique(a.labels):
                mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
                if not len(theirs):
                    continue
                other = b.take(theirs)
                for i in range(0, len(mine), step):
                    at = mine[i:i + step]
                    s = scores(a.take(at), other, primes)
                    self_ = (a.ids[at][:, None] == b.ids[theirs]) & (a.keys[at][:, None] == b.keys[theirs])
                    r, c = _best(s, ~self_, k)
                    found.append((a.ids[at[r]], a.keys[at[r]], b.ids[theirs[c]], b.keys[theirs[c]], s[r, c]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names)
    return run


def _negatives(width: int, primes: list, positives: int, k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor_id", "anchor_key", "p", "id", "key", "score"]
        found = []
        if anchors.num_rows and rows.num_rows:
            a, b = _Block(anchors, width, primes), _Block(rows, width, primes)
            marks = _matrix(anchors.column("marks"), positives)[a.order]
            n_marks = np.diff(np.asarray(anchors.column("marks").combine_chunks().offsets))[a.order]
            step = max(1, TILE // len(b.ids))
            for i in range(0, len(a.ids), step):
                at = np.arange(i, min(i + step, len(a.ids)))
                s = scores(a.take(at), b.parts, primes)
                other = a.labels[at][:, None] != b.labels
                for j in range(positives):
                    t = marks[at, j][:, None]
                    low = -((-LOW * t) // HIGH)  # smallest score s with HIGH * s >= LOW * t
                    inside = other & (s <= t) & (s >= low) & (j < n_marks[at])[:, None]
                    r, c = _best(s, inside, k)
                    if len(r):
                        found.append((a.ids[at[r]], a.keys[at[r]], np.full(len(r), j + 1), b.ids[c], b.keys[c],
                                      s[r, c]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 6
        return pa.table([pa.array(c, pa.int32() if n == "p" else pa.int64()) for c, n in zip(cols, names)], names)
    return run


def prepared(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: str | Column = "label"):
    """(id, label, v, key) of the rows that take part, equal rows once; v holds the
    integer components."""
    x = F.transform(F.col(f"`{vec_col}`"), lambda c: c.cast("double"))
    finite = F.forall(F.col("x"), lambda c: F.coalesce((c > float("-inf")) & (c < float("inf")), F.lit(False)))
    whole = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"),
                        (F.col(f"`{label}`") if isinstance(label, str) else label).cast("bigint").alias("label"),
                        x.alias("x")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    ints = F.transform("x", lambda c: F.floor(F.lit(float(SCALE)) * c))
    return (whole.select("id", "label", ints.alias("v")).distinct()
            .withColumn("key", F.xxhash64("id", "label", "v")))


def _meet(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, kernel, schema: str) -> DataFrame:
    """Every anchor block with every row block, one kernel call a pair."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(-(-n_rows // ROWS), min(tasks, -(-n_rows // 4096)), 1)
    anchor_blocks = max(-(-n_anchors // ANCHORS), 1)
    block = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("key")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("ab", block(1, anchor_blocks)).withColumn("rb", every(row_blocks))
    b = rows.toDF(*rows.columns).withColumn("rb", block(2, row_blocks)).withColumn("ab", every(anchor_blocks))
    return a.groupBy("ab", "rb").cogroup(b.groupBy("ab", "rb")).applyInArrow(kernel, schema)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
         label: str | Column = "label", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score).
    ``is_anchor`` is an expression over ``id``."""
    v = F.transform("v", lambda c: c.cast("double"))
    data, seen = cut_lineage_observed(prepared(rows, id_col, vec_col, label), [
        F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("v")).alias("width"),
        F.max(F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c)).alias("norm")])
    n, n_anchors, width = seen["n"], seen["anchors"], max(seen["width"] or 0, 1)
    norm = (seen["norm"] or 0.0) * (1 + 1e-9) + 1  # of a sum of doubles
    if norm >= 2.0 ** 62:
        raise ValueError("scores of 2^62 or more do not fit")
    primes = primes_below(top_prime(), 2 * int(norm) + 1)
    anchors = data.where(is_anchor)

    best = _meet(anchors, data, n_anchors, n, _positives(width, primes, positives),
                 "anchor_id bigint, anchor_key bigint, id bigint, key bigint, score bigint")
    first = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "id", "key")
    pos = cut_lineage(best.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives))
    marks = pos.groupBy("anchor_id", "anchor_key").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda m: m["score"]).alias("marks"))
    marked = anchors.join(marks.select(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key"), "marks"),
                          ["id", "key"])

    near = _meet(marked, data, n_anchors, n, _negatives(width, primes, positives, negatives),
                 "anchor_id bigint, anchor_key bigint, p int, id bigint, key bigint, score bigint")
    first = Window.partitionBy("anchor_id", "anchor_key", "p").orderBy(F.desc("score"), "id", "key")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return near.select("anchor_id", "anchor_key", "p", "rank", F.col("id").alias("negative_id"),
                       F.col("score").alias("negative_score")).join(
        pos.select("anchor_id", "anchor_key", F.col("rank").alias("p"), F.col("id").alias("positive_id"),
                   F.col("score").alias("positive_score")), ["anchor_id", "anchor_key", "p"]).select(
        "anchor_id", "positive_id", F.col("p").alias("positive_rank"), "rank", "negative_id", "positive_score",
        "negative_score")
