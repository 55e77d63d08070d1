"""Metrics, splits, pair sampling, metric learning helpers and the blocked
1-NN against brute force on small fixtures."""

import math

import numpy as np
from pyspark.sql import functions as F

from factorlab.operators import metric_learning as ML
from factorlab.operators import metrics as MX
from factorlab.operators import splits as S


def test_residual_histogram_fixture(spark):
    res = [-5, -0.3, 0, 0.9, 4, 4.2, 5]
    df = spark.createDataFrame([(3.0, 3.0 - r) for r in res], "rating double, prediction double")
    got = {r.bin: r.n for r in MX.residual_histogram(df).collect()}
    assert got == {-5: 1, -4: 0, -3: 0, -2: 0, -1: 1, 0: 2, 1: 0, 2: 0, 3: 0, 4: 3}
    m = MX.residual_moments(df).first()
    fl = np.floor(np.array(res, dtype=float))
    assert math.isclose(m.mean_residual, fl.mean()) and math.isclose(m.std_residual, fl.std())


def test_rmse_denominators(spark):
    truth = spark.createDataFrame([(1, 1, 4.0), (1, 2, 3.0), (2, 1, 5.0)],
                                  "user_id bigint, item_id bigint, rating double")
    pred = spark.createDataFrame([(1, 1, 3.0), (2, 1, 5.0)], "user_id bigint, item_id bigint, prediction double")
    a = MX.rmse(pred, truth, denominator="truth").first()
    b = MX.rmse(pred, truth, denominator="matched").first()
    assert a.n_truth == 3 and a.n_matched == 2
    assert math.isclose(a.rmse, math.sqrt(1 / 3)) and math.isclose(b.rmse, math.sqrt(1 / 2))
    assert a.rmse <= b.rmse


def test_index_rows_exact(spark):
    df = spark.range(0, 1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000))).repartition(7)
    out, n = S.index_rows_total(df, [F.col("k")], "pos")
    assert n == 1000
    out = out.collect()
    got = sorted((r.pos, r.k) for r in out)
    assert [p for p, _ in got] == list(range(1000))
    assert [k for _, k in got] == sorted(k for _, k in got)


def test_sample_split_exact_sizes(spark):
    df = spark.range(0, 101).select(F.col("id").cast("string").alias("row_key"))
    a, b = S.sample_split_exact(df, "row_key", 0.9, 1992)
    ka, kb = {r.row_key for r in a.collect()}, {r.row_key for r in b.collect()}
    assert len(ka) == 91 and len(kb) == 10 and not (ka & kb) and len(ka | kb) == 101


def test_sample_split_exact_on_tied_keys(spark):
    rows = [(f"k{i % 4}", i % 10) for i in range(20)] + [("same", 1)] * 20
    df = spark.createDataFrame(rows, "row_key string, v bigint").repartition(3)
    for frac, k in ((0.9, 36), (0.5, 20), (0.05, 2), (1.0, 40), (0.0, 0)):
        a, b = S.sample_split_exact(df, "row_key", frac, 1992)
        a, b = [tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]
        assert (len(a), len(b)) == (k, 40 - k) and sorted(a + b) == sorted(rows)
        key = lambda r: __import__("hashlib").md5(f"1992:{r[0]}".encode()).hexdigest()
        assert not a or not b or max(map(key, a)) <= min(map(key, b))


def test_nearest_psd():
    assert np.allclose(ML.nearest_psd(np.diag([1.0, -1.0])), np.diag([1.0, 0.0]))
    r = np.random.RandomState(0).randn(6, 6)
    sym = (r + r.T) / 2
    p = ML.nearest_psd(r)
    assert np.linalg.eigvalsh(p).min() >= -1e-9 and np.allclose(ML.nearest_psd(p), p)
    rng = np.random.RandomState(1)
    for _ in range(50):  # no other PSD matrix lies closer
        q = rng.randn(6, 6) * 0.3
        other = p + q @ q.T
        assert np.linalg.norm(sym - p) <= np.linalg.norm(sym - other) + 1e-9


def test_pair_positions_reach_beyond_32_bits(spark):
    n = 2 ** 45
    pos = [r.a_pos for r in ML.draw_positions(spark.range(2000).withColumnRenamed("id", "pair_id"), n).collect()]
    assert max(pos) > 0.99 * n and min(pos) < 0.01 * n and abs(np.mean(pos) / n - 0.5) < 0.03


def test_hot_null_and_text_keys(spark):
    from factorlab.operators import joins
    big = spark.createDataFrame([(None, 1)] * 50 + [(7, 2)] * 60 + [(8, 3), (9, 4)], "k bigint, v bigint")
    small = spark.createDataFrame([(7, "a"), (8, "b")], "k bigint, w string")
    hot = joins.hot_keys(big, "k", 4)
    assert hot == [7]
    inner = joins.split_join(big, small, "k", hot)
    assert inner.count() == 61 and inner.columns == ["k", "v", "w"]
    left = joins.split_join(big, small, "k", hot, "left")
    assert left.count() == big.count() and left.where("k is null").count() == 50


def test_1nn_with_null_features(spark):
    tr = spark.createDataFrame([(1, "a", 1.0, [1.0, None]), (1, "b", 2.0, [9.0, None]), (1, "c", 3.0, [3.0, None])],
                               "key bigint, t_ord string, rating double, x array<double>")
    te = spark.createDataFrame([(1, "q", [9.0, None])], "key bigint, q_id string, x array<double>")
    r = ML.nearest_train(tr, te, "key", [1.0, 1.0]).first()
    assert (r.t_ord, r.d2) == ("b", 0.0)


def test_forest_on_half_star_ratings(spark):
    from factorlab.operators import predictors as PR
    rows = [([float(i % 5), 1.0], 0.5 + (i % 5)) for i in range(200)]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "row_key string, x array<double>, rating double")
    (trees, rmse, n), = PR.forest_curve(df, df, [5]).collect()
    assert trees == 5 and rmse < 0.2 and n == 200


def feat_df(spark, n=60, d=5, labels=3, seed=1):
    rng = np.random.RandomState(seed)
    rows = [(i, int(rng.randint(labels)), [float(v) for v in rng.randn(d)]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, label int, x array<double>"), rows


def test_pairs_labels_consistent(spark):
    df, rows = feat_df(spark)
    lab = {i: l for i, l, _ in rows}
    for p, expect in ((1.0, 1.0), (0.0, -1.0)):
        pairs = ML.generate_pairs(df, "row_id", "label", 200, p, seed=7).collect()
        assert len(pairs) == 200
        for r in pairs:
            assert r.y == (1.0 if lab[r.a_id] == lab[r.b_id] else -1.0) == expect


def test_mahalanobis_identity_is_squared_euclid(spark):
    df, rows = feat_df(spark)
    pairs = ML.generate_pairs(df, "row_id", "label", 50, 0.3, seed=3)
    pv = ML.pair_vectors(pairs, df)
    a = {r.pair_id: r.d2 for r in ML.pair_mahalanobis(pv, np.eye(5)).collect()}
    b = {r.pair_id: r.dist ** 2 for r in ML.pair_euclid(pv).collect()}
    c = {r.pair_id: r.d2 for r in ML.pair_mahalanobis(pv, None).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) and math.isclose(a[k], c[k], rel_tol=1e-9) for k in a)


def test_learn_metric_runs_and_stays_psd(spark):
    df, _ = feat_df(spark)
    m, trace = ML.learn_metric(df, 5, epochs=3, gamma=0.01, alpha=1e-3, n_objective=50)
    assert len(trace) == 3 and np.linalg.eigvalsh(m).min() >= -1e-9


def brute_1nn(train, test, w, decimals):
    out = {}
    for key, qid, xq in test:
        best = None
        for k2, tord, rating, xt in train:
            if k2 != key:
                continue
            d = round(sum(wc * (a - b) ** 2 for wc, a, b in zip(w, xq, xt)), decimals)
            if best is None or (d, tord) < best[:2]:
                best = (d, tord, rating)
        out[qid] = best
    return out


def test_blocked_1nn_matches_brute_force_with_hot_key(spark):
    rng = np.random.RandomState(11)
    train, test = [], []
    for j in range(300):
        key = 0 if j < 150 else int(rng.randint(1, 20))  # key 0 holds half of the rows
        x = [float(rng.randint(0, 4)), float(rng.randint(0, 3))]  # small grid: many ties
        train.append((key, f"t{j:04d}", float(rng.randint(1, 6)), x))
    for j in range(80):
        key = 0 if j < 40 else int(rng.randint(1, 25))  # keys 20..24 have no training rows
        test.append((key, f"q{j:04d}", [float(rng.randint(0, 4)), float(rng.randint(0, 3))]))
    tr = spark.createDataFrame(train, "key bigint, t_ord string, rating double, x array<double>")
    te = spark.createDataFrame(test, "key bigint, q_id string, x array<double>")
    w = [1.0, 2.0]
    got = {r.q_id: (r.d2, r.t_ord, r.nn_rating) for r in ML.nearest_train(tr, te, "key", w, block=16).collect()}
    want = {k: v for k, v in brute_1nn(train, test, w, 9).items() if v is not None}
    assert got == want


def test_densify_bounded_slice(spark):
    from factorlab.operators.relational import densify
    df = spark.createDataFrame([(1, 1, 4.0), (1, 1, 2.0), (2, 3, 5.0), (9, 9, 1.0)],
                               "user_id bigint, item_id bigint, rating double")
    got = {(r.user_id, r.item_id): r.rating for r in densify(df, [1, 2], [1, 2, 3]).collect()}
    assert got == {(1, 1): 3.0, (1, 2): 0.0, (1, 3): 0.0, (2, 1): 0.0, (2, 2): 0.0, (2, 3): 5.0}


def test_candidates_of_one_user(spark):
    from factorlab.operators.relational import candidates
    items = spark.range(5).select(F.col("id").alias("item_id"))
    seen = spark.createDataFrame([(7, 1), (7, 3), (8, 0)], "user_id bigint, item_id bigint")
    for user, want in ((7, [0, 2, 4]), (8, [1, 2, 3, 4]), (9, [0, 1, 2, 3, 4])):
        got = sorted((r.user_id, r.item_id) for r in candidates(items, seen, user).collect())
        assert got == [(user, i) for i in want]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 1 and "test_rmse" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_complement_is_anti_join(spark):
    df = spark.range(0, 20).select(F.col("id").cast("string").alias("row_key"))
    a, b = S.sample_split_exact(df, "row_key", 0.7, 5)
    assert {r.row_key for r in S.complement(df, a).collect()} == {r.row_key for r in b.collect()}


def test_split_join_matches_plain_join(spark):
    from factorlab.operators import joins
    big = spark.createDataFrame([(0 if i < 60 else i % 7 + 1, i) for i in range(100)], "k bigint, v bigint")
    small = spark.createDataFrame([(k, k * 10) for k in range(0, 6)], "k bigint, w bigint")
    hot = joins.hot_keys(big, "k", parts=4)
    assert hot == [0]
    a = sorted(tuple(r) for r in joins.split_join(big, small, "k", hot).collect())
    b = sorted(tuple(r) for r in big.join(small, "k").collect())
    assert a == b and len(a) > 60


def test_als_split_join_path_equals_broadcast_path(spark):
    from factorlab.operators import factors as FA
    rng = np.random.RandomState(2)
    cells = [(u, 0, float(rng.randint(1, 6))) for u in range(40)]  # item 0 is hot
    cells += [(u, i, float(rng.randint(1, 6))) for u in range(40) for i in range(1, 8) if rng.rand() < 0.3]
    r = spark.createDataFrame(cells, "user_id bigint, item_id bigint, rating double")
    a = FA.train_als(r, 2, 2, 0.1, "masked")
    b = FA.train_als(r, 2, 2, 0.1, "masked", broadcast_max_bytes=0)
    fa = {x.id: list(x.f) for x in a.users.collect()}
    fb = {x.id: list(x.f) for x in b.users.collect()}
    assert fa.keys() == fb.keys() and all(np.allclose(fa[k], fb[k], atol=1e-10) for k in fa)


def test_rank_prefix_matches_sort(spark):
    import hashlib
    keys = [hashlib.md5(str(i).encode()).hexdigest() for i in range(500)]
    # force shared 60-bit prefixes: three rows that differ only after digit 15
    keys += [keys[0][:15] + "0" * 17, keys[0][:15] + "f" * 17, keys[0][:15] + "8" * 17]
    df = spark.createDataFrame([(h,) for h in keys], "h string")
    ordered = sorted(keys)
    for k in (1, 2, 250, 499, 503):
        prefix, below, inside = S.rank_prefix(df, "h", k)
        assert ordered[k - 1].startswith(prefix) and below < k <= below + inside
        assert below == sum(h < prefix for h in keys) and inside == sum(h.startswith(prefix) for h in keys)


def test_learn_metric_matches_numpy(spark):
    df, rows = feat_df(spark, n=80, d=4, labels=3, seed=5)
    gamma = lambda t: 0.05 / np.sqrt(t + 1)
    m, trace = ML.learn_metric(df, 4, epochs=4, gamma=gamma, alpha=1e-3, n_objective=120,
                               positive_ratio=0.4, seed=9)
    index = ML.pair_index(df, "row_id", "label")

    def vectors(n, seed):
        got = ML.pair_vectors(ML.pairs_of_index(index, n, 0.4, seed), df).select("xa", "xb", "y").collect()
        return np.array([r.xa for r in got]) - np.array([r.xb for r in got]), np.array([r.y for r in got])

    fixed, yf = vectors(120, 9)
    ref, seen = np.eye(4), set()
    for t in range(4):
        d2 = np.einsum("ni,ij,nj->n", fixed, ref, fixed)
        obj = np.maximum(0, 1 + yf * (d2 - 2)).mean() + 1e-3 / 2 * np.linalg.norm(ref)
        assert math.isclose(trace[t][1], obj, rel_tol=1e-9) and trace[t][2] == 80
        delta, y = vectors(80, ML.epoch_seed(9, t))
        seen.add(round(float(delta.sum()), 9))
        d2 = np.einsum("ni,ij,nj->n", delta, ref, delta)
        w = y * ((1 + y * (d2 - 0.5)) > 0)
        g = np.einsum("n,ni,nj->ij", w, delta, delta) / len(y) + 1e-3 * ref
        ref = ML.nearest_psd(ref - gamma(t) * g)
    assert len(seen) == 4  # fresh pairs in every epoch
    assert np.allclose(m, ref, atol=1e-10)


def test_blocked_1nn_full_metric(spark):
    rng = np.random.RandomState(21)
    a = rng.randn(3, 3)
    m = a @ a.T
    train = [(int(rng.randint(0, 4)), f"t{j:03d}", float(rng.randint(1, 6)),
              [float(v) for v in rng.randint(0, 3, 3)]) for j in range(120)]
    test = [(int(rng.randint(0, 5)), f"q{j:03d}", [float(v) for v in rng.randint(0, 3, 3)]) for j in range(40)]
    tr = spark.createDataFrame(train, "key bigint, t_ord string, rating double, x array<double>")
    te = spark.createDataFrame(test, "key bigint, q_id string, x array<double>")
    got = {r.q_id: (r.t_ord, r.nn_rating) for r in ML.nearest_train(tr, te, "key", m, block=8, decimals=6).collect()}
    want = {}
    for key, qid, xq in test:
        best = None
        for k2, tord, rating, xt in train:
            if k2 == key:
                dlt = np.array(xq) - np.array(xt)
                d = round(float(dlt @ m @ dlt), 6)
                if best is None or (d, tord) < best[:2]:
                    best = (d, tord, rating)
        if best is not None:
            want[qid] = best[1:]
    assert got == want


def test_genre_flags_substrings(spark):
    from factorlab.operators.features import GENRE_COLS, genre_flags
    df = spark.createDataFrame([(1, "Comedy|Children's|Sci-Fi"), (2, "Film-Noir|Mystery"),
                                (3, "Drama|War"), (4, "Western")], "item_id bigint, genres string")
    got = {r.item_id: {c for c in GENRE_COLS if r[c] == 1} for r in genre_flags(df).collect()}
    assert got == {1: {"Comedy", "Children", "SciFi"}, 2: {"Fnoir", "Mystery"},
                   3: {"Drama", "War"}, 4: {"Western"}}
