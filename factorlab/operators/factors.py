"""Hand-written alternating least squares as DataFrame iterations.

Two variants of the reference, both updating users first, then items, with
a plain ridge term lambda (not lambda * n as the library ALS does):

* masked (M6): per entity solve (sum over its observed partners of y yᵀ +
  lambda I) x = sum r y.
* zero-filled (M5): unrated cells count as rating 0, so the Gram matrix is one
  global k x k matrix over all partners, summed per task and inverted once on
  the driver (k x k).

Layout. The de-duplicated ratings are written twice, once per side, as rating
blocks: one row holds the partners and ratings of an entity (an entity with more
than ``CHUNK`` ratings has several rows, spread by hash), and rows are dealt into
parts by a bucketed table, so a part is read where it lies in every half-step.
A row of a loop's blocks also lists the parts of the other side that name its entity (``to``); the list
goes through the solve and stands beside the new factors. A half-step deals the factor rows to the parts
so named, many rows packed as bytes into one (an exchange of ids and factors, never
of ratings or Gram rows, and no join), and one Arrow kernel per part builds Gram matrix and
right-hand side and solves. Only entities with several rows send partial sums
on, one per part and entity, added before the solve.

Several models (ranks, ridge terms) train in the same pass: their factors lie
side by side in one array, so a sweep costs one loop.

Errors on given cells (a round's trace, a grid's validation error) are summed for all models
in one pass over such blocks: a part receives the factor rows of both sides that its cells
name (:func:`squared_errors`, :func:`score_cells`), so nothing is broadcast and no model
costs a pass of its own.

Every half-step output is written as a table into the shared checkpoint
folder (the previous iteration's tables are dropped), so the plan does not
grow with the iterations and a lost executor only costs the current half-step.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform_factor
from ..functions.vectors import dot
from ..session import BATCH_BYTES, cut_lineage, cut_lineage_observed, drop_table, new_table_path, release, table_path
from . import joins
from .splits import dedupe

USER, ITEM = "user_id", "item_id"


def init_factors(ids: DataFrame, id_col: str, rank: int, side: str, seed: int = 45,
                 scale: float = 5.0) -> DataFrame:
    """M7: f_i = scale * U[0,1) from md5(seed:side:id:i); partition-independent."""
    idc = F.col(id_col)
    f = F.array(*[uniform_factor(seed, side, idc, i, scale) for i in range(rank)])
    return ids.select(idc.cast("bigint").alias("id"), f.alias("f"))


def prepare_ratings(ratings: DataFrame, duplicates: str = "mean") -> DataFrame:
    """(user_id, item_id, rating) with one row per cell."""
    cols = [USER, ITEM, "rating"]
    extra = [c for c in ("day", "row_key") if c in ratings.columns]
    if duplicates == "last" and len(extra) < 2:
        raise ValueError("duplicates='last' needs day and row_key columns")
    return dedupe(ratings.select(*cols, *extra), policy=duplicates)


CHUNK = 8192  # ratings of one entity in one row
PART_BYTES = 128 << 20  # factors and ratings one part brings together
LOOP_BYTES = 8 << 30  # factors a half-step sends at most; more models train in loops one after the other
RELEASE_BYTES = 128 << 20  # factors a half-step of a loop sends at most before its shuffle files are let go at once
CELL_BYTES = 64  # of a cell beside its partner's factors: id, rating and place, and the copies made on the way


@dataclass
class Layout:
    """How the entities of one side are dealt into parts: entities of more than ``CHUNK`` ratings over several rows.
    ``labels``: the number of each part, chosen so that the parts are spread evenly over the buckets of a table."""
    parts: int
    buckets: int
    labels: list | None
    large: DataFrame  # (entity, chunks) of several rows
    several: bool

    def deal(self, r: DataFrame, key: str, other: str, pre: str = "") -> DataFrame:
        """``r`` with <pre>chunks, <pre>chunk and <pre>p: the row and part that keep a cell on the side of ``key``."""
        chunks, chunk = pre + "chunks", pre + "chunk"
        if self.several:
            r = r.join(self.large.toDF(key, chunks), key, "left").withColumn(chunks, F.coalesce(chunks, F.lit(1)))
        else:
            r = r.withColumn(chunks, F.lit(1))
        r = r.withColumn(chunk, F.pmod(F.xxhash64(other), F.col(chunks)).cast("int"))
        p = F.pmod(F.xxhash64(key, chunk), F.lit(self.parts)).cast("int")
        return r.withColumn(pre + "p", p if self.labels is None else F.get(F.lit(self.labels), p))


_LABELS: dict = {}


def _even_labels(spark, parts: int, buckets: int) -> list | None:
    """Numbers for the parts of which every bucket holds as many as any other, give or take one."""
    if parts > MAX_LABELS or (parts, buckets) in _LABELS:
        return _LABELS.get((parts, buckets))
    most, found, at = -(-parts // buckets), {}, 0
    while sum(map(len, found.values())) < parts and at < 64 * MAX_LABELS:
        size = 16 * max(parts, 64)
        rows = spark.range(at, at + size, 1, 1).select(
            "id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(buckets)).alias("b")).collect()
        for r in rows:
            mine = found.setdefault(r["b"], [])
            if len(mine) < most:
                mine.append(r["id"])
        at += size
    by_turn = [v[i] for i in range(most) for _, v in sorted(found.items()) if i < len(v)]
    if len(by_turn) < parts:
        return None
    _LABELS[parts, buckets] = by_turn[:parts]
    return by_turn[:parts]


def layout(ratings: DataFrame, key: str, width: int, n_cells: int) -> Layout:
    spark = ratings.sparkSession
    # a part of so many bytes at most, and one for every core; a bucket holds several parts where there are more
    # of them than a table may have buckets
    parts = max(8, spark.sparkContext.defaultParallelism, -(-n_cells * (CELL_BYTES + 8 * width) // PART_BYTES))
    buckets = min(parts, MAX_BUCKETS)
    large = (ratings.groupBy(F.col(key).cast("bigint").alias("key")).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("chunks")))
    large, m = cut_lineage_observed(large, [F.count(F.lit(1)).alias("m")])
    return Layout(parts, buckets, _even_labels(spark, parts, buckets), large, bool(m["m"]))


@dataclass
class RatingBlocks:
    """Ratings by entity, dealt into parts."""
    blocks: DataFrame
    name: str | None
    path: str | None
    several: bool  # does any entity have more than one row
    routes: dict = field(default_factory=dict)  # what each part needs, written when first asked for

    def _written(self, what: str, build) -> DataFrame:
        if what not in self.routes:
            self.routes[what] = build() if self.name is None else cut_lineage(build())
        return self.routes[what]

    @property
    def needs(self) -> DataFrame:
        """(p, id): the partners that each part names."""
        return self._written("needs", lambda: self.blocks.select("p", F.explode("other").alias("id")).distinct()
                             .toDF("p", "id"))

    @property
    def partners(self) -> DataFrame:
        """(id, to): the parts that name a partner."""
        return self._written("partners", lambda: _parts_of(self.blocks.select(F.explode("other").alias("id"), "p")))

    @property
    def own(self) -> DataFrame:
        """(id, to): the parts that hold an entity's rows."""
        return self._written("own", lambda: _parts_of(self.blocks.select(F.col("key").alias("id"), "p")))

    @property
    def onward(self) -> DataFrame:
        """(id, to): the parts of the other side that name an entity (blocks of a loop)."""
        to = self.blocks.select(F.col("key").alias("id"), "to")
        if self.several:
            to = to.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))
        return to

    def drop(self, spark) -> None:
        if self.name is None:
            return
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_table(spark, self.path)
        for table in self.routes.values():
            drop_table(spark, table_path(table))


def _parts_of(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.collect_set("p").alias("to")).toDF("id", "to")


def rating_blocks(ratings: DataFrame, key: str, other: str, width: int, n_cells: int,
                  written: bool = True, mine: Layout | None = None, toward: Layout | None = None) -> RatingBlocks:
    """The ratings of one side as blocks; ``width``: factor components per row. A loop reads them in
    every round, so they are ``written`` (bucketed by part); a single half-step plans them in place. With the
    layout of the other side as ``toward`` rows list the parts there that name their entity."""
    spark, given = ratings.sparkSession, mine is not None
    mine = mine or layout(ratings, key, width, n_cells)
    r = ratings.select(F.col(key).cast("bigint").alias("key"), F.col(other).cast("bigint").alias("other"), "rating")
    r, cell = mine.deal(r, "key", "other"), ["other", "rating"]
    if toward is not None:
        r, cell = toward.deal(r, "other", "key", "to_"), ["other", "rating", "to_p"]
    rows = (r.repartition(mine.buckets, "p").groupBy("p", "key", "chunk", "chunks")  # at most about CHUNK ratings each
            .agg(F.collect_list(F.struct(*cell)).alias("cells")))
    cols = ["p", "key", "chunks", F.col("cells.other").alias("other"), F.col("cells.rating").alias("rating")]
    if toward is not None:  # nobody meets an entity without a key
        cols.append(F.when(F.col("key").isNotNull(), F.array_distinct("cells.to_p"))
                    .otherwise(F.array().cast("array<int>")).alias("to"))
    rows = rows.select(*cols)
    if not written:
        return RatingBlocks(rows, None, None, mine.several)
    name, path = "factorlab_blocks_" + uuid.uuid4().hex, new_table_path(spark)
    rows.write.bucketBy(mine.buckets, "p").sortBy("p").format("parquet").option("path", path).saveAsTable(name)
    if not given:
        drop_table(spark, table_path(mine.large))
    return RatingBlocks(spark.table(name), name, path, mine.several)


@dataclass
class Models:
    """Ranks and ridge terms trained side by side; model m owns components [at[m], at[m+1])."""
    ranks: list
    regs: list

    def __post_init__(self):
        self.at = np.concatenate([[0], np.cumsum(self.ranks)]).astype(int)
        self.width = int(self.at[-1])

    def slices(self):
        return [(int(a), int(b), float(g)) for a, b, g in zip(self.at[:-1], self.at[1:], self.regs)]


def _wide(col: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), float).reshape(len(col), width)


def _bytes(col) -> memoryview | bytes:
    """The values of a binary column one after the other."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return b""
    off = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)
    return memoryview(col.buffers()[2])[int(off[col.offset]):int(off[col.offset + len(col)])]


def _factor_rows(table: pa.Table, width: int):
    """(ids, factors, rows of each table row): plain or packed (see :func:`_packed`)."""
    ids = table.column("id")
    if not (pa.types.is_binary(ids.type) or pa.types.is_large_binary(ids.type)):
        f = _wide(table.column("f"), width) if table.num_rows else np.zeros((0, width))
        return np.asarray(ids.combine_chunks()), f, np.ones(table.num_rows, int)
    n = np.asarray(pc.binary_length(ids).combine_chunks()) // 8
    return (np.frombuffer(_bytes(ids), np.int64),
            np.frombuffer(_bytes(table.column("f")), np.float64).reshape(-1, width), n)


def _packed(factors: DataFrame, width: int) -> DataFrame:
    """(p, id, f) for the parts that (id, f, to) rows name: the rows of a batch that go to one part are packed
    into one, ids and factors as bytes, so that an exchange moves few large rows."""

    def run(batches):
        for batch in batches:
            to, off = _lists(batch.column("to"))
            ids, f = np.asarray(batch.column("id"), np.int64), _wide(batch.column("f"), width)
            order = np.argsort(to, kind="stable")
            to, rows = to[order], np.repeat(np.arange(len(ids)), np.diff(off))[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            out, held = [], 0
            for p, r in zip(to[cut].tolist(), np.split(rows, cut[1:])):
                out.append((p, ids[r].tobytes(), f[r].tobytes()))
                held += len(out[-1][2])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["p", "id", "f"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["p", "id", "f"])

    named = factors.select("id", "f", "to").where(F.col("id").isNotNull() & (F.size("to") > 0))
    return named.mapInArrow(run, "p bigint, id binary, f binary").select(F.col("p").cast("int").alias("p"), "id", "f")


def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten()), np.asarray(col.offsets) - col.offsets[0].as_py()


MAX_BUCKETS = 100_000  # the library's own bound on the buckets of a table
MAX_LABELS = 4096  # parts that are given numbers by hand
CELLS = 1 << 17  # numbers in one stacked product (they stay in the processor's cache)
TABLE_RANGE = 1 << 23  # places of a table in which ids are looked up (32 MB), or two an id where that is more


@dataclass(frozen=True)
class Rule:
    """What a half-step sums per entity.

    masked: Gram and right-hand side over ratings above ``mask_threshold`` (``rhs_mask``: the latter too);
    zero_filled: right-hand side only, one global Gram; implicit: confidence 1 + ``alpha`` |r|, preference
    r > 0, so a correction of the global Gram by alpha |r| y yᵀ and the right-hand side
    (1 + alpha |r|) y of the preferred ones. ``reg_by_count``: the ridge term times their number."""
    method: str = "masked"
    mask_threshold: float = 0.5
    rhs_mask: bool = True
    alpha: float = 1.0
    reg_by_count: bool = False

    @property
    def own_gram(self) -> bool:
        return self.method != "zero_filled"

    @property
    def global_gram(self) -> bool:
        return self.method != "masked"


def _weights(rule: Rule, r: np.ndarray, ok: np.ndarray):
    """(weight of y yᵀ, weight of y, counted) per rating; padding and unknown partners weigh 0."""
    if rule.method == "implicit":
        c, liked = rule.alpha * np.abs(r) * ok, (r > 0) & ok
        return c, (1.0 + c) * liked, liked
    seen = (r > rule.mask_threshold) & ok
    return seen.astype(float), r * (seen if rule.rhs_mask and rule.method == "masked" else ok), seen


def _entity_sums(models: Models, rule: Rule, y: np.ndarray, r: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Sums of stacked entities: y (E, L, width), r and ok (E, L) -> per entity, for every model, Gram
    entries (where it has its own) and right-hand side, then the number of counted ratings."""
    cw, w, counted = _weights(rule, r, ok)
    out = []
    for a, b, _ in models.slices():
        m = y[:, :, a:b]
        if rule.own_gram:
            out.append((np.swapaxes(m * cw[:, :, None], 1, 2) @ m).reshape(len(m), -1))
        out.append((w[:, None, :] @ m)[:, 0, :])
    return np.concatenate([*out, counted.sum(1, keepdims=True)], 1)


def _lengths(size: np.ndarray) -> np.ndarray:
    """The length that an entity's row is padded to: its own up to 32 cells, beyond that the next multiple of an
    eighth of the power of two above (so at most a quarter is padding and the lengths stay few)."""
    step = 1 << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1))).astype(int) - 3)
    return np.maximum(1, np.where(size <= 32, size, -(-size // step) * step))


def _places(ids: np.ndarray, wanted: np.ndarray):
    """(row of ``ids`` for each wanted id, whether there is one). Ids that lie close together are looked up in a table of
    their range, others by bisection."""
    if not len(ids):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    if wanted.dtype.kind == "f":  # a column with nulls
        at, known = _places(ids, np.where(np.isnan(wanted), 0, wanted).astype(np.int64))
        return at, known & ~np.isnan(wanted)
    low, high = int(ids.min()), int(ids.max())
    if high - low < max(TABLE_RANGE, 2 * (len(ids) + len(wanted))):
        table = np.full(high - low + 1, -1, np.int32)
        table[ids - low] = np.arange(len(ids), dtype=np.int32)
        inside = (wanted >= low) & (wanted <= high)
        at = np.take(table, np.where(inside, wanted, low) - low)
        known = inside & (at >= 0)
        return np.where(known, at, 0), known
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids[order], wanted), len(ids) - 1)]
    return at, ids[at] == wanted


def _stacked_errors(models: Models, y: np.ndarray, x: np.ndarray, r: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """(E, models) sums of squared errors of solved entities x over their rated cells, then their number."""
    rated = ok & ~np.isnan(r)
    out = [(np.where(rated, (y[:, :, a:b] @ x[:, a:b, None])[:, :, 0] - r, 0.0) ** 2).sum(1)
           for a, b, _ in models.slices()]
    return np.stack([*out, rated.sum(1)], 1)


def _normal_kernel(models: Models, rule: Rule, grams: list | None, errors: bool = False):
    """cogroup kernel: rating blocks of a part x the factors it needs -> solved factors, or
    partial sums (``part``) of entities with several rows. Entities of equal (long ones: about equal) length
    are stacked and summed and solved together, ``CELLS`` numbers at a time. Rows that list the parts to send
    factors to (``to``) hand the list on. ``errors``: also the squared errors over the cells of entities solved here."""
    per_entity = sum((b - a) ** 2 * rule.own_gram + b - a for a, b, _ in models.slices()) + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        routed = "to" in left.column_names
        if not left.num_rows:
            return _solved_table([], np.zeros((0, models.width)), [], models.width,
                                 _int_lists([], pa.list_(pa.int32())) if routed else None, np.zeros((0, len(models.ranks) + 1)) if errors else None)
        other, off = _lists(left.column("other"))
        rating = _lists(left.column("rating"))[0]
        # a partner without factors (not rated in training, or null) adds nothing
        ids, f, _ = _factor_rows(right, models.width)
        at, known = _places(ids, other)
        f = f if len(f) else np.zeros((1, models.width))
        named = left.column("key").combine_chunks()
        keys, named = np.asarray(named), np.asarray(named.is_valid())
        several = np.asarray(left.column("chunks").combine_chunks()) > 1
        to = left.column("to").combine_chunks() if routed else None
        cells = len(other)
        del left, right, other
        size = np.diff(off)
        padded = _lengths(size)
        one, one_f, one_e, parts = [], [], [], {}
        for length in np.unique(padded):
            rows = np.flatnonzero(padded == length)
            step = max(1, min(CELLS // (length * models.width), CELLS // per_entity))
            for i in range(0, len(rows), step):
                e = rows[i:i + step]
                place = np.arange(length)[None, :]
                inside = place < size[e][:, None]
                place = np.minimum(off[e][:, None] + place, max(0, cells - 1))
                ok = inside & known[place]
                r = np.where(inside, rating[place], 0.0)
                y = np.take(f, at[place], axis=0)
                v = _entity_sums(models, rule, y, r, ok)
                many = several[e]
                x = solve_sums(v[~many], models, rule, grams)
                one.append(e[~many])
                one_f.append(x)
                if errors:
                    one_e.append(_stacked_errors(models, y[~many], x, r[~many], ok[~many]) * named[e[~many]][:, None])
                for j, z in zip(e[many].tolist(), v[many]):
                    k = keys[j].item()
                    sums, froms = parts.get(k, (0.0, []))
                    parts[k] = sums + z, [*froms, j]
        one = np.concatenate(one)
        lists = None
        if routed:
            lists = pa.concat_arrays([to.take(pa.array(one)), _int_lists(
                [np.unique(_lists(to.take(pa.array(js)))[0]) for _, js in parts.values()], to.type)])
        return _solved_table(keys[one], np.concatenate(one_f), [(k, z) for k, (z, _) in parts.items()], models.width,
                             lists, np.concatenate(one_e) if errors else None)

    return run


_SOLVED = "id bigint, f array<double>, part array<double>"


def _list_column(rows: np.ndarray, nulls_before: int = 0, nulls_after: int = 0) -> pa.Array:
    """Equal-length rows as a list<double> column between null rows."""
    n, k = rows.shape
    off = np.concatenate([np.zeros(nulls_before, np.int32), np.arange(n + 1, dtype=np.int32) * k,
                          np.full(nulls_after, n * k, np.int32)])
    null = np.ones(nulls_before + n + nulls_after, bool)
    null[nulls_before:nulls_before + n] = False
    return pa.ListArray.from_arrays(pa.array(off), pa.array(rows.ravel()), mask=pa.array(null))


def _int_lists(rows: list, as_type: pa.DataType) -> pa.Array:
    return pa.array([r.tolist() for r in rows], pa.list_(pa.int32())).cast(as_type)


def _solved_table(keys, solved: np.ndarray, several: list, width: int, to: pa.Array | None = None,
                  errors: np.ndarray | None = None) -> pa.Table:
    n, m = len(keys), len(several)
    sums = np.array([v for _, v in several]) if m else np.zeros((0, 1))
    ids = np.concatenate([np.asarray(keys, np.int64), np.array([k for k, _ in several], np.int64)])
    out = {"id": pa.array(ids), "f": _list_column(solved.reshape(n, width), 0, m),
           "part": _list_column(sums, n, 0)}
    if to is not None:
        out["to"] = to
    if errors is not None:
        out["errors"] = _list_column(errors, 0, m)
    return pa.table(out)


def solve_sums(v: np.ndarray, models: Models, rule: Rule, grams: list | None) -> np.ndarray:
    """Factors of all models from rows of sums (see :func:`_entity_sums`)."""
    out, at = np.zeros((len(v), models.width)), 0
    if not len(v):
        return out
    count = v[:, -1] if rule.reg_by_count else np.ones(len(v))
    for m, (a, b, reg) in enumerate(models.slices()):
        k = b - a
        if rule.own_gram:
            g = v[:, at:at + k * k].reshape(-1, k, k) + (reg * count)[:, None, None] * np.eye(k)
            g = g + grams[m] if rule.global_gram else g
            at += k * k
            out[:, a:b] = np.linalg.solve(g, v[:, at:at + k, None])[:, :, 0]
        else:
            out[:, a:b] = np.linalg.solve(grams[m] + reg * np.eye(k), v[:, at:at + k].T).T
        at += k
    return out


def half_step(side: RatingBlocks, fixed: DataFrame, models: Models, rule: Rule = Rule(),
              errors: bool = False) -> DataFrame:
    """(id, f) of the entities of ``side`` given the other side's factors (id, f), which a join deals to the parts. In
    a loop ``fixed`` brings the parts it goes to (id, f, to) and the result does so too; with ``errors`` it also
    has the squared errors of each entity's cells under the new factors (see :func:`own_errors`)."""
    grams = global_grams(fixed, models) if rule.global_gram else None
    routed, schema = "to" in fixed.columns, _SOLVED
    if routed:
        sent, schema = _packed(fixed, models.width), schema + ", to array<int>"
        blocks = side.blocks
    else:
        sent = fixed.select("id", "f").join(side.needs, "id").select("p", "id", "f")
        blocks = side.blocks.drop("to")
    if errors:
        schema += ", errors array<double>"
    out = blocks.groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(
        _normal_kernel(models, rule, grams, errors), schema)
    cols = ["id", "f"] + ["to"] * routed + ["errors"] * errors
    if side.name is None and not side.several:
        return out.select(*cols)
    out = cut_lineage(out)
    if not side.several:
        done = out.select(*cols)
        done._factorlab_table = table_path(out)
        return done

    def add(table: pa.Table) -> pa.Table:
        part = table.column("part").combine_chunks()
        v = np.asarray(part.flatten(), float).reshape(len(part), -1).sum(0)
        f = solve_sums(v[None], models, rule, grams)
        one = {"id": table.column("id").slice(0, 1), "f": pa.array([f[0].tolist()], pa.list_(pa.float64()))}
        if routed:
            one["to"] = _int_lists([np.unique(_lists(table.column("to"))[0])], pa.list_(pa.int32()))
        return pa.table(one)

    # entities with several rows: at most one partial sum per part
    more = out.where("part is not null").select("id", "part", *["to"] * routed).groupBy("id").applyInArrow(
        add, "id bigint, f array<double>" + ", to array<int>" * routed)
    if errors:
        more = more.withColumn("errors", F.lit(None).cast("array<double>"))
    done = out.where("part is null").select(*cols).unionByName(more)
    done._factorlab_table = table_path(out)
    return done


def own_errors(side: RatingBlocks, own: DataFrame, other: DataFrame, models: Models) -> list:
    """:func:`squared_errors` over the cells of ``side`` right after ``own`` was solved from ``other`` with its errors: they
    are there already, only the cells of entities with several rows are scored."""
    n_models = len(models.ranks)
    sums = own.agg(*[F.sum(F.col("errors")[m]).alias(f"e{m}") for m in range(n_models + 1)]).first()
    out = [(sums[m] or 0.0, int(sums[n_models] or 0)) for m in range(n_models)]
    if side.several:
        long = RatingBlocks(side.blocks.where("chunks > 1"), None, None, True)
        out = [(a + c, b + d) for (a, b), (c, d) in zip(out, squared_errors(long, own, other, models))]
    return out


def global_grams(fixed: DataFrame, models: Models) -> list:
    """Σ f fᵀ over all rows of a factor table for every model: one partial sum per task."""
    sl = models.slices()

    def part(batches):
        g = [np.zeros((b - a, b - a)) for a, b, _ in sl]
        for batch in batches:
            f = _wide(batch.column("f"), models.width)
            for x, (a, b, _) in zip(g, sl):
                x += f[:, a:b].T @ f[:, a:b]
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.concatenate([x.ravel() for x in g]).tolist()], pa.list_(pa.float64()))], ["g"])

    rows = fixed.select("f").mapInArrow(part, "g array<double>")
    total = rows.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    v = np.zeros(sum((b - a) ** 2 for a, b, _ in sl))
    for r in total.collect():  # k x k numbers per model
        v[r["i"]] = r["v"]
    out, at = [], 0
    for a, b, _ in sl:
        out.append(v[at:at + (b - a) ** 2].reshape(b - a, b - a))
        at += (b - a) ** 2
    return out


def cell_blocks(cells: DataFrame, width: int) -> RatingBlocks:
    """(user_id, item_id, rating) rows, repeated ones included, as blocks by user for the two functions below."""
    cells = cells.select(USER, ITEM, "rating").where(F.col(USER).isNotNull() & F.col(ITEM).isNotNull())
    cells, m = cut_lineage_observed(cells, [F.count(F.lit(1)).alias("n")])
    out = rating_blocks(cells, USER, ITEM, width, m["n"])
    drop_table(cells.sparkSession, table_path(cells))
    return out


def _cell_predictions(models: Models, left: pa.Table, right: pa.Table):
    """Stretches of the cells of a part that have factors on both sides: (rating, predictions (cells, models))."""
    if not left.num_rows or not right.num_rows:
        return
    ids, f, n = _factor_rows(right, models.width)
    mine = np.repeat(np.asarray(right.column("own").combine_chunks()), n)
    other, off = _lists(left.column("other"))
    rating = _lists(left.column("rating"))[0].astype(float)
    keys = np.repeat(np.asarray(left.column("key").combine_chunks()), np.diff(off))
    at, known = [], np.ones(len(other), bool)
    for wanted, rows in ((keys, np.flatnonzero(mine)), (other, np.flatnonzero(~mine))):
        if not len(rows):
            return
        place, found = _places(ids[rows], wanted)
        known &= found
        at.append(rows[place])
    cells, step = np.flatnonzero(known), max(1, CELLS // models.width)
    for i in range(0, len(cells), step):
        c = cells[i:i + step]
        yield rating[c], np.add.reduceat(np.take(f, at[0][c], axis=0) * np.take(f, at[1][c], axis=0),
                                         models.at[:-1], axis=1)


def _with_both_sides(side: RatingBlocks, own: DataFrame, other: DataFrame, models: Models, kernel, schema: str) -> DataFrame:
    """``kernel`` over every part of ``side`` and the factor rows of both sides that its cells name."""
    sent = None
    for factors, routes, mine in ((own, side.own, True), (other, side.partners, False)):
        s = _packed(factors.select("id", "f").join(routes, "id"), models.width).withColumn("own", F.lit(mine))
        sent = s if sent is None else sent.unionByName(s)
    return side.blocks.groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(kernel, schema)


def squared_errors(side: RatingBlocks, own: DataFrame, other: DataFrame, models: Models) -> list:
    """(sum of squared errors, scored cells) of every model over cells kept by ``own``'s side; cells without
    factors on both sides or without a rating do not count. One partial sum per part and model."""
    n_models = len(models.ranks)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sse, n = np.zeros(n_models), 0
        for r, p in _cell_predictions(models, left, right):
            rated = ~np.isnan(r)
            sse += ((p[rated] - r[rated, None]) ** 2).sum(0)
            n += int(rated.sum())
        return pa.table({"model": pa.array(np.arange(n_models)), "sse": pa.array(sse),
                         "n": pa.array(np.full(n_models, n))})

    sums = _with_both_sides(side, own, other, models, run, "model bigint, sse double, n bigint").groupBy("model").agg(
        F.sum("sse").alias("sse"), F.sum("n").alias("n"))
    found = {x["model"]: (x["sse"], x["n"]) for x in sums.collect()}  # two numbers a model
    return [found.get(m, (0.0, 0)) for m in range(n_models)]


def score_cells(side: RatingBlocks, own: DataFrame, other: DataFrame, models: Models) -> DataFrame:
    """(rating, predictions array: one per model) of the cells that have factors on both sides."""
    n_models = len(models.ranks)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = list(_cell_predictions(models, left, right))
        r = np.concatenate([np.zeros(0), *[x for x, _ in got]])
        p = np.concatenate([np.zeros((0, n_models)), *[x for _, x in got]])
        return pa.table({"rating": pa.array(r, from_pandas=True), "predictions": _list_column(p)})

    return _with_both_sides(side, own, other, models, run, "rating double, predictions array<double>")


def one_half_step(ratings: DataFrame, fixed: DataFrame, key: str, other: str, rank: int, reg: float,
                  rule: Rule = Rule()) -> DataFrame:
    """A single half-step from plain (user_id, item_id, rating) cells: (id, f) of the
    ``key`` side for keys that have ratings; cold keys are added by :func:`with_cold`."""
    ratings, m = cut_lineage_observed(ratings.select(USER, ITEM, "rating"), [F.count(F.lit(1)).alias("n")])
    models = Models([rank], [reg])
    side = rating_blocks(ratings, key, other, rank, m["n"], written=False)
    return half_step(side, fixed.select(F.col("id").cast("bigint").alias("id"), "f"), models, rule)


def masked_half_step(ratings, fixed, key, other, rank, reg, **kw) -> DataFrame:
    """Solve the ``key`` side given the ``other`` side's factors (M6)."""
    return one_half_step(ratings, fixed, key, other, rank, reg, Rule("masked", **kw))


def zero_filled_half_step(ratings, fixed, key, other, rank, reg) -> DataFrame:
    """Solve the ``key`` side with unrated cells as zeros (M5):
    x_u = (YᵀY + lambda I)⁻¹ Σ_i r_ui y_i."""
    return one_half_step(ratings, fixed, key, other, rank, reg, Rule("zero_filled"))


def implicit_half_step(plays, fixed, key, other, rank, reg, alpha=1.0, reg_by_count=False) -> DataFrame:
    """Solve the ``key`` side of the implicit model (M1) from (user_id, item_id, rating) counts, one row a cell:
    x_u = (YᵀY + Σ_i α|r_ui| y_i y_iᵀ + λ I)⁻¹ Σ_{r_ui > 0} (1 + α r_ui) y_i. YᵀY is summed over all rows of
    ``fixed`` once; per entity only its own counts correct it. ``reg_by_count``: λ times the number of
    positive counts, as the library model has it."""
    return one_half_step(plays, fixed, key, other, rank, reg, Rule("implicit", alpha=alpha, reg_by_count=reg_by_count))


def with_cold(solved: DataFrame, spine: DataFrame | None, rank: int, start: DataFrame | None = None) -> DataFrame:
    """Add spine ids without ratings with ``cold = true`` and factor 0, or their row of
    ``start`` (id, f): the random start row left unchanged."""
    if spine is None:
        return solved.withColumn("cold", F.lit(False))
    zero = F.array(*[F.lit(0.0) for _ in range(rank)])
    out = spine.select(F.col("id").cast("bigint")).join(solved, "id", "left")
    rest = zero
    if start is not None:
        out = out.join(start.select("id", F.col("f").alias("_start")), "id", "left")
        rest = F.coalesce("_start", zero)
    return out.select("id", F.coalesce(F.col("f"), rest).alias("f"), F.col("f").isNull().alias("cold"))


@dataclass
class Loop:
    """Factors of the models of one loop after a round, cold entities included: (id, f) with the models' components
    one after the other; ``numbers``: their places among all models."""
    numbers: list
    users: DataFrame
    items: DataFrame
    models: Models


@dataclass
class SideBySide:
    """All models of :func:`train_models` after one round."""
    loops: list

    def blocks(self, cells: DataFrame) -> RatingBlocks:
        return cell_blocks(cells, max(x.models.width for x in self.loops))

    def squared_errors(self, blocks: RatingBlocks) -> list:
        found = {n: e for x in self.loops
                 for n, e in zip(x.numbers, squared_errors(blocks, x.users, x.items, x.models))}
        return [found[n] for n in sorted(found)]

    def score_cells(self, blocks: RatingBlocks) -> DataFrame:
        """(rating, predictions array) of models that share one loop."""
        if len(self.loops) > 1:
            raise ValueError("several loops: see scored()")
        x = self.loops[0]
        return score_cells(blocks, x.users, x.items, x.models)

    def scored(self, blocks: RatingBlocks) -> DataFrame:
        """(m, rating, prediction): a row for every model and cell that has factors on both sides."""
        out = None
        for x in self.loops:
            s = score_cells(blocks, x.users, x.items, x.models).select(
                F.posexplode("predictions").alias("m", "prediction"), "rating")
            s = s.select(F.get(F.lit(x.numbers), "m").alias("m"), "rating", "prediction")
            out = s if out is None else out.unionByName(s)
        return out


@dataclass
class FactorModel:
    users: DataFrame          # (id, f, cold)
    items: DataFrame          # (id, f, cold)
    trace: list               # [(iteration, train_rmse, eval_rmse)]
    rank: int
    n_users: int = 0
    n_items: int = 0
    broadcast_max_bytes: int = joins.DEFAULT_BROADCAST_MAX_BYTES
    together: "SideBySide | None" = None  # the models trained in the same loop, this one included

    def score(self, pairs: DataFrame) -> DataFrame:
        """Predictions for pairs. Each factor table is broadcast when its size
        bound allows; otherwise it meets the pairs through a split join whose
        hot keys are counted on the pairs."""
        out = attach_factors(pairs, self.users, USER, "_fu", self.n_users, self.rank, self.broadcast_max_bytes)
        out = attach_factors(out, self.items, ITEM, "_fi", self.n_items, self.rank, self.broadcast_max_bytes)
        return out.withColumn("prediction", dot(F.col("_fu"), F.col("_fi"))).drop("_fu", "_fi")


def attach_factors(rows: DataFrame, factors: DataFrame, key: str, col: str, n: int, rank: int,
                   broadcast_max_bytes: int = joins.DEFAULT_BROADCAST_MAX_BYTES) -> DataFrame:
    """Rows with the factors (id, f) of their ``key`` as ``col``; rows without factors leave. A factor table of
    ``n`` rows under the bound is broadcast, otherwise hot keys and all others join apart."""
    side = factors.select(F.col("id").alias(key), F.col("f").alias(col))
    if n * joins.factor_row_bytes(rank) <= broadcast_max_bytes:
        return rows.join(F.broadcast(side), key, "inner")
    return joins.split_join(rows, side, key, joins.hot_keys(rows, key), "inner")


def score(users: DataFrame, items: DataFrame, pairs: DataFrame, pred_col: str = "prediction",
          broadcast_max_bytes: int = joins.DEFAULT_BROADCAST_MAX_BYTES) -> DataFrame:
    """Predict dot(x_u, y_i) for given pairs; unknown ids give no row (M3)."""
    row = users.select(F.size("f")).first()
    model = FactorModel(users, items, [], row[0] if row else 0, users.count(), items.count(), broadcast_max_bytes)
    return model.score(pairs).withColumnRenamed("prediction", pred_col)


def _loops(ranks: list, n_cells: int) -> list:
    """Numbers of the models that train together: a half-step sends a factor row a cell at most, and its shuffle
    files should not outgrow ``LOOP_BYTES``."""
    out, width = [[]], 0
    for i, k in enumerate(ranks):
        if out[-1] and n_cells * 8 * (width + k) > LOOP_BYTES:
            out, width = [*out, []], 0
        out[-1].append(i)
        width += k
    return out


def train_models(ratings: DataFrame, ranks: list, regs: list, iters: int, method: str = "masked",
                 user_spine: DataFrame | None = None, item_spine: DataFrame | None = None,
                 seed: int = 45, duplicates: str = "mean", mask_threshold: float = 0.5,
                 rhs_mask: bool = True, trace_on: DataFrame | None = None, cold: str = "zero",
                 broadcast_max_bytes: int = joins.DEFAULT_BROADCAST_MAX_BYTES, snapshots=None):
    """Alternating least squares, users first then items, ``iters`` rounds, for several
    (rank, ridge term) models in one loop (or several, see :func:`_loops`); one :class:`FactorModel` each. ``snapshots``: rounds whose state is kept
    on the way; the result is then {round: models} of these rounds, the last of which ends the loop.

    ``user_spine`` / ``item_spine``: DataFrames with an ``id`` column listing
    every entity; default: ids present in the ratings. ``cold``: entities without
    ratings end with factor 0 (``zero``) or keep their random start row (``start``).
    """
    if method not in ("masked", "zero_filled") or cold not in ("zero", "start"):
        raise ValueError(f"{method}, {cold}")
    spark = ratings.sparkSession
    count = [F.count(F.lit(1)).alias("n")]
    r, m = cut_lineage_observed(prepare_ratings(ratings, duplicates), count)
    loops = [(g, Models([ranks[i] for i in g], [regs[i] for i in g])) for g in _loops(ranks, m["n"])]
    width = max(models.width for _, models in loops)
    lay_u, lay_i = (layout(r, col, width, m["n"]) for col in (USER, ITEM))
    by_user = rating_blocks(r, USER, ITEM, width, m["n"], mine=lay_u, toward=lay_i)
    by_item = rating_blocks(r, ITEM, USER, width, m["n"], mine=lay_i, toward=lay_u)
    for lay in (lay_u, lay_i):
        drop_table(spark, table_path(lay.large))

    def spine(given, col):
        ids = given if given is not None else r.select(F.col(col).alias("id"))
        out, n = cut_lineage_observed(ids.select(F.col("id").cast("bigint")).distinct(), count)
        return out, n["n"]

    u_ids, n_users = spine(user_spine, USER)
    i_ids, n_items = spine(item_spine, ITEM)
    rule = Rule(method, mask_threshold, rhs_mask)
    traced = None if trace_on is None else cell_blocks(trace_on, width)
    rmse = lambda sse, n: float(np.sqrt(sse / n)) if n else None

    def start(ids, side, models):
        f = F.array(*[uniform_factor(seed, side, F.col("id"), i) for k in models.ranks for i in range(k)])
        return ids.select("id", f.alias("f"))

    def whole(solved, given, ids, side, models):
        if given is None:  # every id has ratings
            return solved.select("id", "f")
        return with_cold(solved, ids, models.width, start(ids, side, models) if cold == "start" else None).select("id", "f")

    def after(numbers, models, users, items):
        return Loop(numbers, whole(users, user_spine, u_ids, "user", models),
                    whole(items, item_spine, i_ids, "item", models), models)

    def train(numbers, models):
        """{round kept: (users, items, trace)} of one loop."""
        def step(side, fixed, errors=False):
            out = half_step(side, fixed, models, rule, errors)
            if m["n"] * models.width * 8 > RELEASE_BYTES:
                release(spark)  # the files of one half-step lie on disk, not those of all rounds
            return out

        # Inside the loop only entities with ratings carry factors: a cold entity's
        # factor is 0 after its first update, so it adds nothing to any sum. The
        # initial item table covers the whole item spine (the first user half-step
        # of the zero-filled variant sums all of it).
        few = i_ids.repartition(spark.sparkContext.defaultParallelism, "id")  # a file of ids would be one task's numbers
        items_f = cut_lineage(start(few, "item", models).join(by_item.onward, "id", "left").select(
            "id", "f", F.coalesce("to", F.array().cast("array<int>")).alias("to")))
        users_f, trace, kept = None, [], {}
        rounds = max(snapshots) if snapshots else iters
        for it in range(1, rounds + 1):
            old = [table_path(d) for d in (users_f, items_f) if d is not None and it - 1 not in kept]
            users_f = step(by_user, items_f)
            items_f = step(by_item, users_f, trace_on is not None)
            if trace_on is not None:
                now = after(numbers, models, users_f, items_f)
                trace.append([(it, rmse(*a), rmse(*b)) for a, b in
                              zip(own_errors(by_item, items_f, users_f, models),
                                  squared_errors(traced, now.users, now.items, models))])
            for path in old:
                drop_table(spark, path)
            if snapshots and it in snapshots:
                kept[it] = users_f, items_f, list(trace)
        return kept if snapshots else {rounds: (users_f, items_f, trace)}

    states = [(numbers, models, train(numbers, models)) for numbers, models in loops]

    def fitted(it):
        together = SideBySide([after(numbers, models, *kept[it][:2]) for numbers, models, kept in states])
        out = {}
        for numbers, models, kept in states:
            users, items, trace = kept[it]
            for i, (a, b, _) in enumerate(models.slices()):
                part = lambda d: d.select("id", F.slice("f", a + 1, b - a).alias("f"))  # noqa: B023, E731
                s0 = [part(start(ids, side, models)) if cold == "start" else None
                      for ids, side in ((u_ids, "user"), (i_ids, "item"))]
                out[numbers[i]] = FactorModel(
                    with_cold(part(users), u_ids, b - a, s0[0]), with_cold(part(items), i_ids, b - a, s0[1]),
                    [t[i] for t in trace], b - a, n_users, n_items, broadcast_max_bytes, together)
        return [out[i] for i in range(len(ranks))]

    out = {it: fitted(it) for it in states[0][2]}
    for side in (by_user, by_item, traced):
        if side is not None:
            side.drop(spark)
    drop_table(spark, table_path(r))  # the models do not reference the ratings
    return out if snapshots else out[max(out)]


def train_als(ratings: DataFrame, rank: int, iters: int, reg: float, method: str = "masked",
              user_spine: DataFrame | None = None, item_spine: DataFrame | None = None, **kw) -> FactorModel:
    """:func:`train_models` for a single model."""
    return train_models(ratings, [rank], [reg], iters, method, user_spine, item_spine, **kw)[0]


def trace_frame(spark, fitted: FactorModel, **params) -> DataFrame:
    """One metrics row per iteration."""
    rows = [dict(params, iteration=i, train_rmse=tr, eval_rmse=ev) for i, tr, ev in fitted.trace]
    schema = ", ".join([f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}"
                        for k, v in params.items()] +
                       ["iteration bigint", "train_rmse double", "eval_rmse double"])
    return spark.createDataFrame(rows, schema)
