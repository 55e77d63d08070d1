"""Top-N unseen items for every user: exact maximum-inner-product search over norm-sorted items.

Items are cut by norm into segments, the largest norms first, each several times as large as
the one before. A round brings the users that are still open to the next segment, block
by block; a user whose N-th best score is above norm x the segment's largest norm
(Cauchy-Schwarz) can gain nothing from it or any later one and is finished. A block cuts its items into boxes
of neighbouring factors; a user is scored against a box only if the largest score that the box
can hold is at least the user's N-th best so far, and only scores that reach it travel on.

Seen (user, item) pairs are dealt once to the segment and block of their item and mask its scores; a user's own
list of seen items is never brought together.

Defined cases: users with fewer than N unseen items get all of them; ties go to the smaller item id; ids
without factors give no row; repeated seen pairs count once; an item whose score is NaN is last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_lineage_observed, drop_table, table_path

FIRST = 4096         # items of the first segment
GROWTH = 4           # each segment is this many times larger
USER_BLOCK = 1 << 17
ITEM_BLOCK = 1 << 18
BOX = 256            # items of a box
TILE = 1 << 20       # scores held at once


def norm_segments(items: DataFrame, n: int, first: int, growth: int) -> tuple[DataFrame, list]:
    """Items (id, f) with their segment and block, written one folder a segment, and the segments'
    largest norms. Segment edges are quantiles of the norm; equal norms share a segment,
    however many they are: its blocks are bounded, not the segment."""
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, v: s + v * v))
    shares, size, taken = [], first, first
    while taken < n:
        shares.append(1.0 - taken / n)
        size *= growth
        taken += size
    items = items.select("id", "f", norm.alias("norm"))
    edges = []
    if shares:
        got = items.agg(F.percentile_approx("norm", F.lit(shares), F.lit(100_000))).first()[0]
        edges = sorted(set(got), reverse=True)
    seg = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):  # a logarithmic number of edges
        seg = F.when(F.col("norm") >= edges[k], F.lit(k)).otherwise(seg)
    out = cut_lineage(items.withColumn("seg", seg), partition_by=["seg"])
    per = {r["seg"]: (r["m"], r["n"]) for r in out.groupBy("seg").agg(
        F.max("norm").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    return out, [(s, *per[s]) for s in sorted(per)]


def _boxes(v: np.ndarray, most: int) -> list:
    """Rows of ``v`` (items, k) in boxes of at most ``most``: cut at the median of the widest coordinate."""
    out, todo = [], [np.arange(len(v))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(np.sort(rows))
            continue
        here = v[rows]
        spread = np.nan_to_num(here.max(0) - here.min(0), nan=np.inf)
        by = np.argpartition(here[:, int(spread.argmax())], len(rows) // 2)
        todo += [rows[by[:len(rows) // 2]], rows[by[len(rows) // 2:]]]
    return out


def _best_of(user: np.ndarray, item: np.ndarray, score: np.ndarray, n: int):
    """The n best rows of every user, ties to the smaller item."""
    by = np.lexsort((item, -score, user))
    user = user[by]
    first = np.flatnonzero(np.concatenate([[True], user[1:] != user[:-1]]))
    place = np.arange(len(user)) - np.repeat(first, np.diff(np.concatenate([first, [len(user)]])))
    keep = by[place < n]
    return item[keep], score[keep], user[place < n]


def _kernel(n: int, box: int = BOX):
    """(user block: rows with f, and seen pairs without) x (item block) -> every user's n best that reach ``low``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["user_id", "item_id", "score"]
        types = [pa.int64(), pa.int64(), pa.float64()]
        empty = pa.table([pa.array([], t) for t in types], names)
        is_user = left.column("f").is_valid().to_numpy()
        if not is_user.any() or not right.num_rows:
            return empty
        ids = left.column("user_id").to_numpy()
        users = ids[is_user]
        low = left.column("low").to_numpy(zero_copy_only=False)[is_user]
        vectors = left.column("f").combine_chunks().drop_null()
        u = np.asarray(vectors.flatten()).reshape(len(users), -1)
        items = right.column("id").to_numpy()
        order = np.argsort(items)  # columns by item id: the first largest score has the smallest id
        items = items[order]
        v = np.asarray(right.column("f").combine_chunks().flatten()).reshape(len(items), -1)[order]
        user_order = np.argsort(users)
        users, u, low = users[user_order], u[user_order], low[user_order]
        seen_u, seen_i = ids[~is_user], left.column("item_id").to_numpy(zero_copy_only=False)[~is_user].astype(np.int64)
        row, col = np.searchsorted(users, seen_u), np.searchsorted(items, seen_i)
        hit = (row < len(users)) & (col < len(items))
        hit[hit] = (users[row[hit]] == seen_u[hit]) & (items[col[hit]] == seen_i[hit])
        row, col = row[hit], col[hit]
        cut = _boxes(v, box)
        box_of, place = np.empty(len(items), int), np.empty(len(items), int)
        for k, mine in enumerate(cut):
            box_of[mine], place[mine] = k, np.arange(len(mine))
        by = np.lexsort((row, box_of[col]))
        row, col = row[by], col[by]
        edge = np.searchsorted(box_of[col], np.arange(len(cut) + 1))
        out = []
        step = max(1, TILE // box)
        for k, mine in enumerate(cut):
            lo, hi = v[mine].min(0), v[mine].max(0)
            bound = np.zeros(len(users))
            for c in range(u.shape[1]):  # the order in which scores are summed: no rounded score is above it
                bound += np.maximum(u[:, c] * lo[c], u[:, c] * hi[c])
            some = np.flatnonzero(~(bound < low))
            mask_row, mask_col = row[edge[k]:edge[k + 1]], place[col[edge[k]:edge[k + 1]]]
            for i in range(0, len(some), step):
                at = some[i:i + step]
                s = np.zeros((len(at), len(mine)))
                for c in range(u.shape[1]):  # summed component by component: the same bits everywhere
                    s += u[at, c, None] * v[None, mine, c]
                a, b = np.searchsorted(mask_row, [at[0], at[-1] + 1])
                if b > a:
                    x = np.searchsorted(at, mask_row[a:b])
                    ok = at[x] == mask_row[a:b]
                    s[x[ok], mask_col[a:b][ok]] = -np.inf
                s[np.isnan(s)] = -np.inf
                left_over = np.arange(len(at))
                for _ in range(min(n, len(mine))):
                    best = s[left_over].argmax(1)
                    top = s[left_over, best]
                    ok = (top > -np.inf) & (top >= low[at[left_over]])
                    left_over, best = left_over[ok], best[ok]
                    if not len(left_over):
                        break
                    out.append((at[left_over], mine[best], top[ok]))
                    s[left_over, best] = -np.inf
            if len(out) > 64 * n:  # a user's candidates of many boxes do not pile up
                out = [_again(out, n)]
        if not out:
            return empty
        who, what, score = _again(out, n)
        return pa.table([pa.array(c, t) for c, t in zip((users[who], items[what], score), types)], names)

    def _again(found: list, most: int):
        who, what, score = (np.concatenate(c) for c in zip(*found))
        what, score, who = _best_of(who, what, score, most)
        return who, what, score

    return run


def top_all_users(users: DataFrame, items: DataFrame, seen: DataFrame, n: int, first: int = FIRST,
                  growth: int = GROWTH, user_block: int = USER_BLOCK, item_block: int = ITEM_BLOCK,
                  report: dict | None = None) -> DataFrame:
    """(user_id, rank, item_id, score): the n best unseen items of every user. users, items:
    (id, f); seen: (user_id, item_id). ``report`` receives the numbers of users, items, rounds and of
    (user, item) scores computed."""
    spark = users.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    count = [F.count(F.lit(1)).alias("n")]
    items, n_items = cut_lineage_observed(items.select("id", "f"), count)
    table_of_items, segments = norm_segments(items, n_items["n"], first, growth)
    table = table_of_items
    drop_table(spark, table_path(items))
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, v: s + v * v))
    none = F.array().cast("array<struct<neg:double,item_id:bigint>>")
    state, n_users = cut_lineage_observed(
        users.select(F.col("id").alias("user_id"), "f", norm.alias("norm"), none.alias("top")), count)
    blocks = max(-(-n_users["n"] // user_block), min(tasks, -(-n_users["n"] // 256)), 1)
    ub = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")
    parts = {s: max(1, -(-size // item_block)) for s, _, size in segments}
    many = F.lit(1)
    for s, k in parts.items():  # a logarithmic number of segments
        many = F.when(F.col("seg") == s, F.lit(k)).otherwise(many)
    table = table.select("id", "f", "seg", F.pmod(F.xxhash64(F.lit(3), "id"), many).cast("int").alias("ib"))
    seen = seen.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("item_id").cast("bigint").alias("item_id"))
    seen = cut_lineage(seen.where("user_id is not null").distinct().join(table.select(F.col("id").alias("item_id"), "seg", "ib"), "item_id"),
                       partition_by=["seg"])
    finished, scored, rounds = [], 0, 0
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    reached = F.when(F.size("top") >= n, -F.element_at("top", -1)["neg"]).otherwise(F.lit(float("-inf")))
    for s, largest, size in segments:
        # Cauchy-Schwarz, with room for the rounding of norms and scores
        reach = F.col("norm") * F.lit(float(largest) * (1 + 1e-9)) + F.lit(1e-300)
        open_ = (F.size("top") < n) | (reach >= -F.element_at("top", -1)["neg"])
        left = state.where(open_).count()
        if rounds:
            finished.append(state.where(~open_).select("user_id", "top"))
        if not left:
            state = None
            break
        rounds += 1
        scored += left * size
        state = state.where(open_)
        segment = table.where(F.col("seg") == s).select("id", "f", "ib")
        people = state.select(ub.alias("ub"), every(parts[s]).alias("ib"), "user_id", "f", reached.alias("low"),
                              F.lit(None).cast("bigint").alias("item_id"))
        # pairs of finished users meet no row of the user block
        seen_rows = seen.where(F.col("seg") == s).select(
            ub.alias("ub"), "ib", "user_id", F.lit(None).cast("array<double>").alias("f"),
            F.lit(None).cast("double").alias("low"), "item_id")
        stock = segment.withColumn("ub", every(blocks))
        got = people.unionByName(seen_rows).groupBy("ub", "ib").cogroup(stock.groupBy("ub", "ib")).applyInArrow(
            _kernel(n), "user_id bigint, item_id bigint, score double")
        # at most n rows of a user and block
        now = got.groupBy("user_id").agg(F.collect_list(F.struct((-F.col("score")).alias("neg"), "item_id")).alias("now"))
        # rows of one user share their finds, the old ones and the new
        tops = F.flatten(F.collect_list("top").over(Window.partitionBy("user_id")))
        merged = F.slice(F.sort_array(F.concat(tops, F.coalesce("now", none))), 1, n)
        state = cut_lineage(state.join(now, "user_id", "left").select("user_id", "f", "norm", merged.alias("top")))
    if state is not None:
        finished.append(state.select("user_id", "top"))
    for t in (table_of_items, seen):
        drop_table(spark, table_path(t))
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    if report is not None:
        report.update(users=n_users["n"], items=n_items["n"], rounds=rounds, scored=scored)
    return out.select("user_id", F.posexplode("top").alias("p", "t")).select(
        "user_id", (F.col("p") + 1).alias("rank"), F.col("t.item_id").alias("item_id"), (-F.col("t.neg")).alias("score"))
