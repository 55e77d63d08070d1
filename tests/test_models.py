"""Invariants of the hand-written ALS variants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.operators import factors as FA


def ratings_df(spark, cells):
    return spark.createDataFrame([(u, i, float(r)) for u, i, r in cells],
                                 "user_id bigint, item_id bigint, rating double")


def factors_np(df, rank):
    rows = sorted((r.id, list(r.f)) for r in df.collect())
    return np.array([f for _, f in rows]), [i for i, _ in rows]


FULL = [(u, i, 1 + (u * 3 + i * 2) % 5) for u in range(3) for i in range(3)]


def test_full_matrix_masked_equals_zero_filled(spark):
    r = ratings_df(spark, FULL)
    a = FA.train_als(r, 2, 3, 0.1, "masked")
    b = FA.train_als(r, 2, 3, 0.1, "zero_filled")
    xa, _ = factors_np(a.users, 2)
    xb, _ = factors_np(b.users, 2)
    assert np.allclose(xa, xb, atol=1e-9)


def test_missing_cell_makes_them_differ(spark):
    r = ratings_df(spark, FULL[1:])
    a = FA.train_als(r, 2, 3, 0.1, "masked")
    b = FA.train_als(r, 2, 3, 0.1, "zero_filled")
    xa, _ = factors_np(a.users, 2)
    xb, _ = factors_np(b.users, 2)
    assert not np.allclose(xa, xb, atol=1e-6)


def test_cold_user_gets_zero(spark):
    r = ratings_df(spark, FULL)
    spine = spark.createDataFrame([(0,), (1,), (2,), (3,)], "id bigint")
    for method in ("masked", "zero_filled"):
        m = FA.train_als(r, 2, 2, 0.1, method, user_spine=spine)
        row = m.users.where("id = 3").first()
        assert row.cold is True and list(row.f) == [0.0, 0.0]
        assert m.users.where("cold").count() == 1


def dense_zero_filled(q, y0, lam, iters):
    """The reference's dense zero-filled algorithm (users first)."""
    k = y0.shape[1]
    y = y0.copy()
    for _ in range(iters):
        x = np.linalg.solve(y.T @ y + lam * np.eye(k), y.T @ q.T).T
        y = np.linalg.solve(x.T @ x + lam * np.eye(k), x.T @ q).T
    return x, y


def test_zero_filled_equals_dense(spark):
    rng = np.random.RandomState(3)
    cells = [(u, i, float(rng.randint(1, 6))) for u in range(20) for i in range(15) if rng.rand() < 0.4]
    r = ratings_df(spark, cells)
    spine_u = spark.range(20).select(F.col("id"))
    spine_i = spark.range(15).select(F.col("id"))
    m = FA.train_als(r, 3, 4, 0.1, "zero_filled", spine_u, spine_i)
    q = np.zeros((20, 15))
    for u, i, v in cells:
        q[u, i] = v
    y0, _ = factors_np(FA.init_factors(spine_i, "id", 3, "item", 45), 3)
    x_ref, y_ref = dense_zero_filled(q, y0, 0.1, 4)
    x, _ = factors_np(m.users, 3)
    y, _ = factors_np(m.items, 3)
    assert np.allclose(x, x_ref, atol=1e-8) and np.allclose(y, y_ref, atol=1e-8)


def test_masked_fixed_point_and_monotone_loss(spark):
    rng = np.random.RandomState(5)
    cells = [(u, i, float(rng.randint(1, 6))) for u in range(25) for i in range(12) if rng.rand() < 0.5]
    r = ratings_df(spark, cells)
    lam, k = 0.1, 3
    losses = []
    users = None
    items = FA.init_factors(r.select(F.col("item_id").alias("id")).distinct(), "id", k, "item", 45)

    def loss(xu, yi):
        s = sum((v - xu[u] @ yi[i]) ** 2 for u, i, v in cells)
        return s + lam * (sum(np.sum(x ** 2) for x in xu.values()) + sum(np.sum(y ** 2) for y in yi.values()))

    as_map = lambda df: {row.id: np.array(row.f) for row in df.collect()}
    yi = as_map(items)
    for _ in range(4):
        users = FA.masked_half_step(r, items, "user_id", "item_id", k, lam)
        xu = as_map(users)
        losses.append(loss(xu, yi))
        items = FA.masked_half_step(r, users, "item_id", "user_id", k, lam)
        yi = as_map(items)
        losses.append(loss(xu, yi))
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    # the items, updated last, solve their normal equations exactly
    for i, y in yi.items():
        obs = [(u, v) for u, ii, v in cells if ii == i]
        g = sum(np.outer(xu[u], xu[u]) for u, _ in obs) + lam * np.eye(k)
        b = sum(v * xu[u] for u, v in obs)
        assert np.max(np.abs(g @ y - b)) < 1e-8


def test_partition_count_does_not_change_result(spark):
    rng = np.random.RandomState(9)
    cells = [(u, i, float(rng.randint(1, 6))) for u in range(30) for i in range(10) if rng.rand() < 0.5]
    outs = []
    for p in (1, 4, 16):
        r = ratings_df(spark, cells).repartition(p)
        m = FA.train_als(r, 2, 2, 0.1, "masked")
        outs.append(factors_np(m.users, 2)[0])
    assert np.allclose(outs[0], outs[1], atol=1e-10) and np.allclose(outs[0], outs[2], atol=1e-10)


def numpy_masked(cells, rank, iters, lam, y):
    """Reference loop: {id: factor} of both sides from the same start factors."""
    x = {}
    for _ in range(iters):
        for side, fixed, pos in ((x, y, 0), (y, x, 1)):
            for k in {c[pos] for c in cells}:
                rows = [(fixed[c[1 - pos]], c[2]) for c in cells if c[pos] == k and c[1 - pos] in fixed]
                g = lam * np.eye(rank) + sum((np.outer(v, v) for v, r in rows if r > 0.5), np.zeros((rank, rank)))
                b = sum((r * v for v, r in rows if r > 0.5), np.zeros(rank))
                side[k] = np.linalg.solve(g, b)
    return x, y


def test_hot_user_in_several_blocks_equals_numpy(spark, monkeypatch):
    """One user holds a third of all cells and is spread over many rows and parts."""
    monkeypatch.setattr(FA, "CHUNK", 7)
    rng = np.random.RandomState(4)
    cells = [(0, i, float(rng.choice([0, 0.5, 1, 2, 3, 4, 5]))) for i in range(120)]
    cells += [(1 + int(u), int(i), float(rng.randint(1, 6))) for u, i in
              {(u, i) for u, i in zip(rng.randint(0, 40, 300), rng.randint(0, 120, 300))}]
    r = ratings_df(spark, cells)
    m = FA.train_als(r, 3, 2, 0.1, "masked")
    y0 = {i: f for i, f in ((q.id, np.array(q.f)) for q in FA.init_factors(
        r.select(r.item_id.alias("id")).distinct(), "id", 3, "item").collect())}
    x, y = numpy_masked(cells, 3, 2, 0.1, y0)
    got = {q.id: np.array(q.f) for q in m.users.collect()}
    assert set(got) == set(x) and all(np.allclose(got[k], x[k], atol=1e-8) for k in x)
    got = {q.id: np.array(q.f) for q in m.items.collect()}
    assert all(np.allclose(got[k], y[k], atol=1e-8) for k in y)


@pytest.mark.parametrize("method", ["masked", "zero_filled"])
def test_models_side_by_side_equal_single_fits(spark, method):
    rng = np.random.RandomState(12)
    cells = [(u, i, float(rng.randint(1, 6))) for u in range(25) for i in range(12) if rng.rand() < 0.5]
    r = ratings_df(spark, cells)
    many = FA.train_models(r, [1, 4, 2], [0.1, 0.5, 2.0], 3, method)
    for model, rank, reg in zip(many, [1, 4, 2], [0.1, 0.5, 2.0]):
        one = FA.train_als(r, rank, 3, reg, method)
        for a, b in ((model.users, one.users), (model.items, one.items)):
            a, b = ({q.id: q.f for q in d.collect()} for d in (a, b))
            assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_half_step_exchanges_no_ratings(spark):
    """The only exchange before the solve carries (part, id, factors)."""
    rng = np.random.RandomState(3)
    cells = [(u, i, float(rng.randint(1, 6))) for u in range(50) for i in range(30) if rng.rand() < 0.4]
    r = ratings_df(spark, cells)
    models = FA.Models([24], [0.1])
    side = FA.rating_blocks(r, "user_id", "item_id", 24, len(cells))
    fixed = FA.init_factors(r.select(r.item_id.alias("id")).distinct(), "id", 24, "item")
    sent = fixed.join(side.needs, "id").select("p", "id", "f")
    out = side.blocks.groupBy("p").cogroup(sent.groupBy("p")).applyInArrow(
        FA._normal_kernel(models, FA.Rule(), None), FA._SOLVED)
    plan = out._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("factorlab_blocks") - 3000 if plan.index("factorlab_blocks") > 3000 else 0:]
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(p" in x]
    assert len(exchanges) == 1 and "Bucketed: true" in left and out.count() == 50
    side.drop(spark)


def test_cold_rows_keep_their_start(spark):
    r = ratings_df(spark, [(1, 1, 4.0), (2, 1, 3.0)])
    spine = spark.range(4).select("id")
    m = FA.train_als(r, 2, 1, 0.1, "masked", spine, spine, cold="start")
    start = {q.id: q.f for q in FA.init_factors(spine, "id", 2, "user").collect()}
    got = {q.id: (q.f, q.cold) for q in m.users.collect()}
    assert got[0] == (start[0], True) and got[3] == (start[3], True) and not got[1][1]


def test_duplicate_policies(spark):
    df = spark.createDataFrame([(1, 2, 4.0, 10, "a"), (1, 2, 2.0, 11, "b")],
                               "user_id bigint, item_id bigint, rating double, day bigint, row_key string")
    from factorlab.operators.splits import dedupe
    assert dedupe(df, policy="mean").first().rating == 3.0
    assert dedupe(df, policy="sum").first().rating == 6.0
    assert dedupe(df, policy="last").first().rating == 2.0
    with pytest.raises(ValueError):
        dedupe(df, policy="first")


def test_score_drops_unknown_ids(spark):
    u = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, f array<double>")
    i = spark.createDataFrame([(5, [3.0, 4.0])], "id bigint, f array<double>")
    pairs = spark.createDataFrame([(1, 5), (2, 5), (1, 6)], "user_id bigint, item_id bigint")
    rows = FA.score(u, i, pairs).collect()
    assert [(r.user_id, r.item_id, r.prediction) for r in rows] == [(1, 5, 11.0)]


def test_library_factors_score_like_the_model(spark):
    from factorlab.operators import library_als as LA
    rng = np.random.RandomState(4)
    cells = [(u, i, float(rng.randint(1, 6))) for u in range(30) for i in range(12) if rng.rand() < 0.5]
    r = ratings_df(spark, cells)
    model = LA.train_explicit(r, 3, 4, 0.1)
    pairs = r.select("user_id", "item_id")
    a = {(x.user_id, x.item_id): x.prediction for x in LA.predict_pairs(model, pairs).collect()}
    u, i = LA.factor_frames(model)
    b = {(x.user_id, x.item_id): x.prediction for x in FA.score(u, i, pairs).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-4 for k in a)


def test_best_config_first_wins_ties(spark):
    from factorlab.operators.tuning import METRICS_SCHEMA, best_config, rank_curve
    rows = [(0, "m", 2, 0.1, 3, "validation", 1.0), (1, "m", 4, 0.1, 3, "validation", 0.9),
            (2, "m", 8, 0.1, 3, "validation", 0.9), (3, "m", 8, 10.0, 3, "validation", None)]
    m = spark.createDataFrame(rows, METRICS_SCHEMA)
    assert best_config(m).first().grid_id == 1
    assert {(x["rank"], x.rmse) for x in rank_curve(m).collect()} == {(2, 1.0), (4, 0.9), (8, 0.9)}


def test_library_als_reindexes_large_ids(spark):
    from factorlab.operators import library_als as LA
    big = 2 ** 40
    rng = np.random.RandomState(8)
    cells = [(big + u, big * 3 + i, float(rng.randint(1, 6))) for u in range(20) for i in range(10)
             if rng.rand() < 0.6]
    r = ratings_df(spark, cells)
    model = LA.train_explicit(r, 2, 3, 0.1)
    assert isinstance(model, LA.IndexedALS)
    pairs = r.select("user_id", "item_id").unionByName(
        spark.createDataFrame([(7, 7)], "user_id bigint, item_id bigint"))
    pred = {(x.user_id, x.item_id): x.prediction for x in LA.predict_pairs(model, pairs).collect()}
    assert set(pred) == {(u, i) for u, i, _ in cells}  # the unknown pair gives no row
    u, i = LA.factor_frames(model)
    b = {(x.user_id, x.item_id): x.prediction for x in FA.score(u, i, r.select("user_id", "item_id")).collect()}
    assert all(abs(pred[k] - b[k]) < 1e-4 for k in pred)


def test_model_score_split_path_equals_broadcast_path(spark):
    rng = np.random.RandomState(12)
    cells = [(0, i, float(rng.randint(1, 6))) for i in range(12)]  # user 0 is hot
    cells += [(u, i, float(rng.randint(1, 6))) for u in range(1, 15) for i in range(12) if rng.rand() < 0.3]
    r = ratings_df(spark, cells)
    m = FA.train_als(r, 2, 2, 0.1, "masked")
    a = {(x.user_id, x.item_id): x.prediction for x in m.score(r.select("user_id", "item_id")).collect()}
    m.broadcast_max_bytes = 0
    b = {(x.user_id, x.item_id): x.prediction for x in m.score(r.select("user_id", "item_id")).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def _random_cells(seed, users, items, share):
    rng = np.random.RandomState(seed)
    return [(u, i, float(rng.randint(0, 6))) for u in range(users) for i in range(items) if rng.rand() < share]


def _errors_by_join(models, cells):
    """Squared errors and counts from the models' own factor rows, one pair at a time."""
    out = []
    for m in models:
        x, y = ({r.id: np.array(r.f) for r in d.collect()} for d in (m.users, m.items))
        e = [(x[u] @ y[i] - r) ** 2 for u, i, r in cells if u in x and i in y and r is not None]
        out.append((sum(e), len(e)))
    return out


@pytest.mark.parametrize("cold", ["zero", "start"])
def test_models_of_a_loop_are_scored_in_one_pass(spark, monkeypatch, cold):
    """Repeated, unknown and unrated cells, ids without ratings, entities of several rows; nothing is broadcast
    and no single model is scored on its own."""
    monkeypatch.setattr(FA, "CHUNK", 5)
    r = ratings_df(spark, _random_cells(11, 12, 9, 0.6))
    cells = _random_cells(12, 16, 11, 0.5) + [(1, 1, 3.0), (1, 1, 3.0), (None, 2, 1.0), (2, None, 1.0), (99, 1, 2.0)]
    spine = spark.range(14).select(F.col("id")), spark.range(10).select(F.col("id"))
    pairs = spark.createDataFrame(cells + [(3, 3, None)], "user_id bigint, item_id bigint, rating double")
    for given in (spine, (None, None)):
        models = FA.train_models(r, [1, 3], [0.1, 1.0], 2, "masked", *given, cold=cold)
        together = models[0].together
        blocks = together.blocks(pairs)
        monkeypatch.setattr(FA.FactorModel, "score", None)
        want = _errors_by_join(models, cells)
        got = together.squared_errors(blocks)
        assert [n for _, n in got] == [n for _, n in want]
        assert np.allclose([s for s, _ in got], [s for s, _ in want], rtol=1e-9)
        rows = together.score_cells(blocks).collect()
        assert len(rows) == want[0][1] + (1 if all(m.users.where("id = 3").count() for m in models) else 0)
        sse = np.sum([(np.array(x.predictions) - x.rating) ** 2 for x in rows if x.rating is not None], 0)
        assert np.allclose(sse, [s for s, _ in want], rtol=1e-9)


def test_trace_and_grid_take_one_pass_for_all_models(spark, monkeypatch):
    from factorlab.operators import tuning as TU
    train, val = _random_cells(21, 12, 9, 0.6), _random_cells(22, 15, 10, 0.4)
    r, v = ratings_df(spark, train), ratings_df(spark, val)
    kw = dict(user_spine=spark.range(14).select("id"), item_spine=spark.range(10).select("id"))
    want = {n: FA.train_models(r, [1, 2], [0.1, 0.1], n, "masked", **kw) for n in (1, 2)}
    errors = {n: (_errors_by_join(m, train), _errors_by_join(m, val)) for n, m in want.items()}
    monkeypatch.setattr(FA.FactorModel, "score", lambda *a: pytest.fail("a pass for one model"))
    traced = FA.train_models(r, [1, 2], [0.1, 0.1], 2, "masked", trace_on=v, **kw)
    for k, m in enumerate(traced):
        for it, a, b in m.trace:
            (s, n), (s2, n2) = errors[it][0][k], errors[it][1][k]
            assert np.allclose([a, b], [(s / n) ** 0.5, (s2 / n2) ** 0.5], rtol=1e-9)
    monkeypatch.undo()
    calls = []
    score = FA.FactorModel.score
    monkeypatch.setattr(FA.FactorModel, "score", lambda self, pairs: calls.append(1) or score(self, pairs))
    metrics, best, _ = TU.grid_search("masked", r, v, [1, 2], [0.1], [1, 2], **kw)
    assert not calls
    for row in metrics.collect():  # unmatched truth rows count in the denominator
        sse = errors[row.iters][1][row["rank"] - 1][0]
        assert np.isclose(row.rmse, (sse / len(val)) ** 0.5, rtol=1e-9)
    assert best["rmse"] == min(x.rmse for x in metrics.collect())
