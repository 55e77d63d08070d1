"""Forest, mini-batch clusters, pruned neighbours, stochastic metric, all-user top N and the implicit
half-step against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.operators import factors as FA
from factorlab.operators import forest as FO
from factorlab.operators import kmeans as KM
from factorlab.operators import metric_learning as ML
from factorlab.operators import neighbours as NB
from factorlab.operators.top_all import top_all_users


# ---------------------------------------------------------------------- forest
def brute_tree(codes, y, w, key, classes, m):
    """Recursive growth of one tree: (feature, code, left, right) or ('leaf', shares)."""
    d = codes.shape[1]

    def grow(rows, key):
        cnt = np.bincount(y[rows], w[rows], classes)
        leaf = ("leaf", tuple((cnt / cnt.sum()).tolist()))
        if (cnt > 0).sum() <= 1:
            return leaf
        order = FO.feature_order(np.array([key]), d)[0].tolist()
        best = None
        while order and best is None:
            for f in order[:m]:
                for c in sorted(set(codes[rows, f].tolist())):
                    low = codes[rows, f] <= c
                    a, b = np.bincount(y[rows[low]], w[rows[low]], classes), np.bincount(y[rows[~low]], w[rows[~low]], classes)
                    if a.sum() and b.sum():
                        s = float((a * a).sum() / a.sum() + (b * b).sum() / b.sum())
                        if best is None or s > best[0]:
                            best = (s, f, c)
            order = order[m:]
        if best is None:
            return leaf
        _, f, c = best
        low = codes[rows, f] <= c
        left, right = (FO.child_keys(np.array([key]), s)[0] for s in (0, 1))
        return (f, c, grow(rows[low], left), grow(rows[~low], right))

    return grow(np.flatnonzero(w > 0), key)


def model_trees(model):
    """The trees of a written model, in the form of :func:`brute_tree`."""
    sub = {}
    for r in model.subtrees.collect():
        get = lambda b, t: np.frombuffer(bytes(b), t)
        sub[r.node] = (get(r.feature, np.int16), get(r.code, np.int32), get(r.left, np.int32),
                       get(r.share, np.float64).reshape(-1, len(model.values)))

    def inner(p, i):
        f, c, left, share = p
        if f[i] < 0:
            return ("leaf", tuple(share[left[i]].tolist()))
        return (int(f[i]), int(c[i]), inner(p, left[i]), inner(p, left[i] + 1))

    def top(n):
        t = model.top
        if t.left[n] < 0:
            return inner(sub[n], 0)
        return (int(t.feature[n]), int(t.code[n]), top(t.left[n]), top(t.left[n] + 1))

    return [top(t) for t in range(model.trees)]


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(4)
    n = 700
    x = np.stack([rng.integers(0, 30, n), rng.integers(0, 2, n), np.full(n, 3), rng.integers(0, 50, n) / 7,
                  rng.integers(0, 3, n)], 1).astype(float)
    r = np.clip(np.round(x[:, 0] / 8 + x[:, 1] + rng.normal(0, 0.7, n)), 0, 5) / 2 + 0.5
    rows = [(f"k{i}", [float(v) for v in x[i]], float(r[i])) for i in range(n)]
    return spark.createDataFrame(rows, "row_key string, x array<double>, rating double").repartition(3), rows


def test_forest_equals_recursive_growth(spark, rated):
    """The same trees from histograms down to small nodes, from local growth alone, and by recursion."""
    df, rows = rated
    whole = FO.train_forest(df, 3, "row_key", m=2, seed=5)
    split = FO.train_forest(df, 3, "row_key", m=2, seed=5, node_rows=60)
    assert whole.levels == 0 and split.levels > 3 and len(split.top.feature) > 20
    trees = model_trees(whole)
    assert model_trees(split) == trees
    h = {r.row_key: r.h for r in df.select("row_key", F.xxhash64("row_key").alias("h")).collect()}
    codes = np.array([[np.searchsorted(e, v) for e, v in zip(whole.edges, x)] for _, x, _ in rows])
    y = np.array([whole.values.index(r) for *_, r in rows])
    hashes = np.array([h[k] for k, *_ in rows]).view(np.uint64)
    roots = FO.Top.roots(3, 5)
    for t in range(3):
        w = FO.draws(hashes, t, 5)
        assert 0.9 < w.mean() < 1.1 and trees[t] == brute_tree(codes, y, w, roots.key[t], len(whole.values), 2)
    # a model is a table; nothing of it travels inside a task
    assert split.subtrees.count() == int((split.top.state == FO.GATHER).sum() + (split.top.state == FO.LEAF).sum())


def test_forest_scores(spark, rated):
    df, rows = rated
    test = df.where("row_key like '%7'").withColumn("x", F.transform("x", lambda v: v + 0.01))
    model = FO.train_forest(df, 4, "row_key", m=2, seed=5, node_rows=80)
    trees = model_trees(model)
    got = {(r.rid, r.tree): (r.rating, r.share) for r in FO.forest_shares(model, test, "row_key").collect()}
    n = test.count()
    assert len(got) == 4 * n
    want = []
    for r in test.collect():
        codes, shares = [np.searchsorted(e, v) for e, v in zip(model.edges, r.x)], []
        for t in trees:
            while t[0] != "leaf":
                t = t[2] if codes[t[0]] <= t[1] else t[3]
            shares.append(t[1])
        want.append((r.rating, shares))
    mine = {}
    for (rid, tree), (rating, share) in got.items():
        mine.setdefault(rid, [rating, [None] * 4])[1][tree] = tuple(share)
    assert sorted(map(repr, ((a, list(b)) for a, b in mine.values()))) == sorted(map(repr, want))
    curve = {r.trees: (r.rmse, r.rows) for r in FO.prefix_errors(
        FO.forest_shares(model, test, "row_key"), model.values, [1, 2, 4]).collect()}
    for size in (1, 2, 4):
        sse = 0.0
        for rating, shares in want:
            total = np.round(np.sum(shares[:size], 0), 9)
            sse += (model.values[int(np.argmax(total))] - rating) ** 2
        assert curve[size][1] == n and math.isclose(curve[size][0], math.sqrt(sse / n), abs_tol=1e-9)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_forest_counted_and_sorted_cuts(seed):
    """Features of few codes are counted, others sorted: the same cuts, and the trees of recursive growth."""
    rng = np.random.default_rng(seed)
    n, classes, nodes = 400, 3, 9
    node, v, y = (rng.integers(0, k, n) for k in (nodes, FO.FEW_CODES, classes))
    v[node == 3] = 5  # one code only: no cut
    w = rng.integers(1, 4, n)
    total = np.bincount(node * classes + y, w, nodes * classes).reshape(nodes, classes).astype(np.int64)
    v = v.astype(np.uint16)
    counted = {int(a): (b, int(c)) for a, b, c in zip(*FO._cuts_by_count(node, v, y, w, total, FO.FEW_CODES, classes)) if b >= 0}
    sorted_ = {int(a): (b, int(c)) for a, b, c in zip(*FO._cuts_by_sort(node, v, y, w, total, classes))}
    assert counted == sorted_ and set(counted) == set(range(nodes)) - {3}
    codes = np.stack([rng.integers(0, k, 120) for k in (2, 1, 8, 60, 2, 9)], 1).astype(np.uint16)
    y, w, key = rng.integers(0, classes, 120), rng.integers(0, 3, 120), np.uint64(77 + seed)
    k = w > 0
    f, c, left, share = FO.grow_subtree(codes[k], y[k], w[k], key, 0, classes, 2)

    def inner(i):
        if f[i] < 0:
            return ("leaf", tuple(share[left[i]].tolist()))
        return (int(f[i]), int(c[i]), inner(left[i]), inner(left[i] + 1))

    assert inner(0) == brute_tree(codes, y, w, key, classes, 2)


def test_forest_edges_sketches_by_row(spark, rated):
    """Distinct values are sketched in one small row a feature; nulls and short rows count as 0."""
    df, rows = rated
    x = df.select("x").unionByName(spark.createDataFrame([([None, 7.0],)], "x array<double>"))
    seen = []
    plain = FO.F.approx_count_distinct
    FO.F.approx_count_distinct = lambda c, *a: seen.append(c) or plain(c, *a)
    try:
        edges = FO.feature_edges(x, 5)
    finally:
        FO.F.approx_count_distinct = plain
    want = np.array([r[1] for r in rows] + [[0.0, 7.0, 0.0, 0.0, 0.0]])
    for f in range(5):
        v = np.unique(want[:, f])
        assert np.array_equal(edges[f], (v[1:] + v[:-1]) / 2)
    assert len(seen) == 1


def test_forest_many_values_and_one_class(spark):
    df = spark.createDataFrame([(str(i), [float(i), None], 2.0) for i in range(300)],
                               "row_key string, x array<double>, rating double")
    model = FO.train_forest(df, 2, "row_key", max_codes=50, node_rows=20)
    assert len(model.edges[0]) < 50 and (model.top.state != FO.ACTIVE).all()
    curve = FO.prefix_errors(FO.forest_shares(model, df, "row_key"), model.values, [1, 2]).collect()
    assert {r.rmse for r in curve} == {0.0}
    with pytest.raises(ValueError):
        FO.train_forest(df.limit(0), 2, "row_key")


def test_forest_task_stays_small(spark, sf):
    """The task of the scoring stage does not carry the model."""
    from factorlab.plans.features import feature_table_written
    from pyspark import cloudpickle
    ft = feature_table_written(spark, sf)
    model = FO.train_forest(ft.where("bucket < 8"), 5, "row_key", node_rows=500)
    kernel = FO._score_kernel(spark.sparkContext.broadcast(model.top.tree), 24, 7)
    assert model.levels > 0 and len(cloudpickle.dumps(kernel)) < 50_000


# -------------------------------------------------------------------- clusters
def test_minibatch_equals_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i}", [float(v) for v in rng.integers(0, 9, 3)]) for i in range(500)]
    df = spark.createDataFrame(rows, "row_key string, x array<double>").repartition(4)
    k, steps, size, seed = 5, 7, 120, 3
    got = {r.centre: (r.x, r.n) for r in KM.fit_minibatch(df, k, "row_key", steps, size, seed).collect()}
    per = -(-500 // size)
    place = {}
    for e in range(-(-steps // per)):
        for r in df.select("row_key", KM.batch_of("row_key", seed, e, per).alias("b")).collect():
            place.setdefault(e * per + r.b, []).append(r.row_key)
    x = {key: np.array(v) for key, v in rows}
    c = [np.array(r.x) for r in KM.draw_centres(df, k, "row_key", seed).orderBy("centre").collect()]
    n = [0] * k
    for b in range(steps):
        mine = [[] for _ in c]
        for key in place[b]:
            mine[int(np.argmin([round(((x[key] - v) ** 2).sum(), 9) for v in c]))].append(x[key])
        for i, m in enumerate(mine):
            if m:
                c[i] = (c[i] * n[i] + np.sum(m, 0)) / (n[i] + len(m))
                n[i] += len(m)
    assert all(np.allclose(got[i][0], c[i]) and got[i][1] == n[i] for i in range(k))
    used = sum(len(place[b]) for b in range(steps))
    assert sum(n) == used
    near = {r.row_key: r.cluster for r in KM.assign(df, KM.fit_minibatch(df, k, "row_key", steps, size, seed)).collect()}
    assert all(near[key] == int(np.argmin([round(((v - np.array(got[i][0])) ** 2).sum(), 9) for i in range(k)]))
               for key, v in x.items())


def test_minibatch_few_rows(spark):
    df = spark.createDataFrame([("a", [1.0, None]), ("b", [1.0, 0.0])], "row_key string, x array<double>")
    assert KM.fit_minibatch(df, 5, "row_key", 3, 10).count() == 2
    assert KM.fit_minibatch(df.limit(0), 5, "row_key", 3, 10).count() == 0


# ------------------------------------------------------------------ neighbours
def brute_near(train, test, m, decimals):
    out = {}
    for key, qid, xq in test:
        best = None
        for k2, tord, rating, xt in train:
            if k2 == key and key is not None:
                gap = np.array(xq) - np.array(xt)
                d = round(float(gap @ m @ gap), decimals)
                if best is None or (d, tord) < best[:2]:
                    best = (d, tord, rating)
        if best:
            out[qid] = best
    return out


@pytest.mark.parametrize("m", [None, [4.0, 0.5, 1.0], "full", [1.0, -0.5, 2.0]])
def test_pruned_neighbours_equal_brute_force(spark, m):
    rng = random.Random(7)
    point = lambda: [float(rng.randrange(0, 200)), rng.randrange(0, 40) / 8, float(rng.randrange(2))]
    train = [(0 if i < 700 else rng.randrange(1, 9), f"t{i:04d}", float(rng.randrange(1, 6)), point()) for i in range(900)]
    train += [(0, f"u{i:04d}", 1.0, [5.0, 1.0, 0.0]) for i in range(60)] + [(None, "n", 1.0, point())]
    test = [(0 if i < 150 else rng.randrange(1, 12), f"q{i:04d}", point()) for i in range(200)] + [(None, "qn", point())]
    full = np.array([[2.0, 0.3, 0.0], [0.3, 1.0, -0.2], [0.0, -0.2, 0.7]]) if m == "full" else \
        np.diag(m) if m else np.eye(3)
    tr = spark.createDataFrame(train, "key bigint, t_ord string, rating double, x array<double>").repartition(3)
    te = spark.createDataFrame(test, "key bigint, q_id string, x array<double>")
    report = {}
    got = NB.nearest_train(tr, te, "key", full if m == "full" else m, block=16, decimals=6, hot_rows=100, report=report)
    got = {r.q_id: (r.d2, r.t_ord, r.nn_rating) for r in got.collect()}
    assert got == {k: (pytest.approx(v[0], abs=2e-6), *v[1:]) for k, v in brute_near(train, test, full, 6).items()}
    assert report["pairs"] > 100
    if m != [1.0, -0.5, 2.0]:
        assert report["compared"] < 0.2 * report["pairs"], report


def test_neighbours_of_equal_rows(spark):
    """All training rows of a hot key are equal: blocks stay bounded, the smallest order wins."""
    tr = spark.createDataFrame([(1, f"t{i:04d}", float(i % 5), [1.0, 2.0]) for i in range(600)],
                               "key bigint, t_ord string, rating double, x array<double>")
    te = spark.createDataFrame([(1, f"q{i}", [float(i), 2.0]) for i in range(30)], "key bigint, q_id string, x array<double>")
    got = NB.nearest_train(tr, te, "key", None, block=32, hot_rows=50).collect()
    assert len(got) == 30 and {r.t_ord for r in got} == {"t0000"}
    assert NB.nearest_train(tr.limit(0), te, "key", [1.0, 1.0]).collect() == []
    assert NB.nearest_train(tr.limit(0), te, "key").collect() == []


def test_full_metric_as_projection(spark):
    rng = np.random.RandomState(3)
    a = rng.randn(4, 4)
    df = spark.createDataFrame([(i, i % 3, [float(v) for v in rng.randn(4)]) for i in range(50)],
                               "row_id bigint, label int, x array<double>")
    pairs = ML.generate_pairs(df, "row_id", "label", 40, 0.3)
    x = {r.row_id: np.array(r.x) for r in df.collect()}
    for m in (a @ a.T, a + a.T, a):  # definite, indefinite, not symmetric
        want = {r.pair_id: float((x[r.a_id] - x[r.b_id]) @ m @ (x[r.a_id] - x[r.b_id])) for r in pairs.collect()}
        for got in (ML.pair_mahalanobis_full(pairs, df, m), ML.pair_mahalanobis(ML.pair_vectors(pairs, df), m)):
            assert {r.pair_id: r.d2 for r in got.collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_stochastic_round_equals_numpy(spark):
    rng = np.random.RandomState(8)
    df = spark.createDataFrame([(i, int(rng.randint(3)), [float(v) for v in rng.randn(4)]) for i in range(60)],
                               "row_id bigint, label int, x array<double>")
    gamma, alpha = (lambda t: 0.2 / np.sqrt(t + 1)), (lambda t: 1e-3)
    m, trace = ML.stochastic_metric(df, 4, rounds=2, groups=3, steps=5, batch=4, gamma=gamma, alpha=alpha,
                                    n_objective=50, positive_ratio=0.4, seed=6)
    index = ML.pair_index(df, "row_id", "label")
    ref = np.eye(4)
    for r in range(2):
        pv = ML.pair_vectors(ML.pairs_of_index(index, 60, 0.4, ML.epoch_seed(6, r)), df).orderBy("pair_id").collect()
        out = []
        for g in range(3):
            mine, local = [p for p in pv if p.pair_id % 3 == g], ref.copy()
            for k in range(5):
                grad = np.zeros((4, 4))
                chunk = mine[4 * k:4 * k + 4]
                for p in chunk:
                    gap = np.array(p.xa) - np.array(p.xb)
                    if 1 + p.y * (gap @ local @ gap - 0.5) > 0:
                        grad += p.y * np.outer(gap, gap)
                local = ML.nearest_psd(local - gamma(5 * r + k) * (grad / len(chunk) + 1e-3 * local))
            out.append(local)
        ref = ML.nearest_psd(np.mean(out, 0))
    assert np.allclose(m, ref, atol=1e-8) and [t[1] for t in trace] == [0, 15, 30]


# ------------------------------------------------------------------- top N
@pytest.mark.parametrize("first,item_block", [(4096, 4096), (8, 5)])
def test_top_all_users_equals_brute_force(spark, first, item_block):
    rng = np.random.RandomState(first)
    users = [(i, [float(v) for v in rng.randint(-3, 9, 3)]) for i in range(40)]
    items = [(i, [float(v) for v in rng.randint(-2, 3, 3) * (1 + 20 * (i % 17 == 0))]) for i in range(200)]
    seen = [(int(rng.randint(45)), int(rng.randint(210))) for _ in range(400)] + [(0, i) for i in range(197)]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, f array<double>")
    sdf = spark.createDataFrame(seen * 2, "user_id bigint, item_id bigint")
    report = {}
    got = top_all_users(frame(users), frame(items), sdf, 6, first=first, growth=3, user_block=16,
                        item_block=item_block, report=report)
    got = sorted((r.user_id, r["rank"], r.item_id, r.score) for r in got.collect())
    skip, want = set(seen), []
    for u, fu in users:
        s = sorted((-sum(a * b for a, b in zip(fu, fi)), i) for i, fi in items if (u, i) not in skip)[:6]
        want += [(u, k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert got == want and sum(r[0] == 0 for r in want) == 3
    if first == 8:
        assert report["rounds"] > 2 and report["scored"] < 0.7 * report["users"] * report["items"]


# ---------------------------------------------------------------- implicit ALS
def test_implicit_half_step_solves_the_librarys_equations(spark):
    """The library's own user factors solve our normal equations for its item factors."""
    from factorlab.operators import library_als as LA
    rng = np.random.RandomState(5)
    plays = spark.createDataFrame([(u, i, int(rng.randint(1, 9))) for u in range(30) for i in range(20)
                                   if rng.rand() < 0.4], "user_id bigint, item_id bigint, plays int")
    model = LA.train_implicit(plays, rank=3, iters=4, reg=0.05, alpha=0.7, reindex="never")
    items = model.itemFactors.select(F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("f"))
    cells = plays.select("user_id", "item_id", F.col("plays").cast("double").alias("rating"))
    x = FA.implicit_half_step(cells, items, "user_id", "item_id", 3, 0.05, 0.7, reg_by_count=True)
    got = {r.id: r.f for r in x.collect()}
    want = {r.id: r.features for r in model.userFactors.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-4) for k in got)


def test_implicit_half_step_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(FA, "CHUNK", 16)  # user 0 has several rows
    rng = np.random.RandomState(6)
    cells = [(u, i, float(rng.randint(-2, 6))) for u in range(12) for i in range(40) if u == 0 or rng.rand() < 0.3]
    y = rng.rand(41, 2)  # item 40 has no plays: it counts in the global Gram
    fixed = spark.createDataFrame([(i, [float(v) for v in y[i]]) for i in range(41)], "id bigint, f array<double>")
    df = spark.createDataFrame(cells, "user_id bigint, item_id bigint, rating double")
    got = {r.id: r.f for r in FA.implicit_half_step(df, fixed, "user_id", "item_id", 2, 0.3, 2.0).collect()}
    for u in range(12):
        mine = [(i, r) for v, i, r in cells if v == u]
        a = y.T @ y + 0.3 * np.eye(2) + sum(2.0 * abs(r) * np.outer(y[i], y[i]) for i, r in mine)
        b = sum(((1 + 2.0 * r) * y[i] for i, r in mine if r > 0), np.zeros(2))
        assert np.allclose(got[u], np.linalg.solve(a, b))


def test_snapshots_equal_single_runs(spark):
    rng = np.random.RandomState(1)
    r = spark.createDataFrame([(u, i, float(rng.randint(1, 6))) for u in range(15) for i in range(12) if rng.rand() < 0.5],
                              "user_id bigint, item_id bigint, rating double")
    state = FA.train_models(r, [1, 3], [0.1, 2.0], 4, "masked", snapshots=[2, 4])
    for it in (2, 4):
        for m, k, lam in zip(state[it], [1, 3], [0.1, 2.0]):
            one = FA.train_als(r, k, it, lam, "masked")
            a, b = ({x.id: x.f for x in d.collect()} for d in (m.users, one.users))
            assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-9) for i in a)


def test_few_buckets_hold_several_parts(spark, monkeypatch):
    """More parts than a table may have buckets: the same factors."""
    rng = np.random.RandomState(1)
    r = spark.createDataFrame([(u, i, float(rng.randint(1, 6))) for u in range(40) for i in range(12) if rng.rand() < 0.5],
                              "user_id bigint, item_id bigint, rating double")
    a = {x.id: x.f for x in FA.train_als(r, 2, 2, 0.1).users.collect()}
    monkeypatch.setattr(FA, "PART_BYTES", 256)
    monkeypatch.setattr(FA, "MAX_BUCKETS", 3)
    b = {x.id: x.f for x in FA.train_als(r, 2, 2, 0.1).users.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-9) for i in a)
