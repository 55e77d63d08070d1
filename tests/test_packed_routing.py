"""In a loop factor rows go to the parts that need them packed, without a join, and a round's training errors come
out of its last half-step."""

import numpy as np
import pytest

from factorlab.operators import factors as FA


def _cells(spark):
    """User 0 has several rows, user 7 no key, one cell no item, one item is rated by nobody else."""
    rng = np.random.RandomState(6)
    cells = [(0, i, float(rng.randint(0, 6))) for i in range(40)] + [(None, 3, 4.0), (None, 900, 4.0), (5, None, 2.0)]
    cells += sorted({(int(u), int(i), float(1 + (u + i) % 5)) for u, i in zip(rng.randint(1, 25, 150), rng.randint(0, 40, 150))})
    return spark.createDataFrame(cells, "user_id bigint, item_id bigint, rating double"), len(cells)


def _rows(df):
    return {r.id: np.array(r.f) for r in df.where("id is not null").collect()}


@pytest.fixture
def sides(spark, monkeypatch):
    monkeypatch.setattr(FA, "CHUNK", 8)
    r, n = _cells(spark)
    lay = {c: FA.layout(r, c, 3, n) for c in ("user_id", "item_id")}
    u = FA.rating_blocks(r, "user_id", "item_id", 3, n, mine=lay["user_id"], toward=lay["item_id"])
    i = FA.rating_blocks(r, "item_id", "user_id", 3, n, mine=lay["item_id"], toward=lay["user_id"])
    yield u, i
    u.drop(spark)
    i.drop(spark)


@pytest.mark.parametrize("method", ["masked", "zero_filled"])
def test_packed_half_steps_equal_joined_ones(spark, sides, method):
    u, i = sides
    models, rule = FA.Models([1, 2], [0.1, 0.5]), FA.Rule(method)
    start = FA.init_factors(spark.range(41).select("id"), "id", 3, "item")
    plain = FA.half_step(u, start, models, rule)
    routed = FA.half_step(u, start.join(i.onward, "id", "left"), models, rule)
    assert plain.columns == ["id", "f"] and routed.columns == ["id", "f", "to"]
    for a, b in ((plain, routed), (FA.half_step(i, plain, models, rule), FA.half_step(i, routed, models, rule))):
        a, b = _rows(a), _rows(b)
        assert a.keys() == b.keys() and len(a) > 20
        assert all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_a_row_goes_to_the_parts_that_name_it_and_no_join_is_planned(spark, sides):
    u, i = sides
    start = FA.init_factors(spark.range(41).select("id"), "id", 3, "item").join(i.onward, "id", "left")
    start = start.localCheckpoint()
    sent = FA._packed(start, 3)
    assert "Join" not in sent._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.p, k) for r in sent.collect() for k in np.frombuffer(r.id, np.int64).tolist()]
    want = {(r.p, r.id) for r in u.needs.where("id is not null").collect()}
    assert len(got) == len(set(got)) and {x for x in got if x[1] < 41} == {x for x in want if x[1] < 41}
    rows = {r.id: r.f for r in start.collect()}
    for r in sent.collect():
        f = np.frombuffer(r.f).reshape(-1, 3)
        assert all(np.array_equal(f[n], rows[k]) for n, k in enumerate(np.frombuffer(r.id, np.int64).tolist()))


def test_training_errors_come_out_of_the_half_step(spark, sides):
    u, i = sides
    models = FA.Models([1, 2], [0.1, 0.5])
    start = FA.init_factors(spark.range(41).select("id"), "id", 3, "item").join(i.onward, "id", "left")
    users = FA.half_step(u, start, models)
    items = FA.half_step(i, users, models, errors=True)
    got, want = FA.own_errors(i, items, users, models), FA.squared_errors(u, users, items, models)
    assert [n for _, n in got] == [n for _, n in want] and want[0][1] > 150
    assert np.allclose([s for s, _ in got], [s for s, _ in want], rtol=1e-9)


def test_parts_lie_evenly_in_the_buckets(spark):
    from pyspark.sql import functions as F
    for parts, buckets in ((8, 8), (103, 103), (40, 16)):
        labels = FA._even_labels(spark, parts, buckets)
        assert len(set(labels)) == parts
        n = spark.createDataFrame([(x,) for x in labels], "p int").groupBy(F.pmod(F.hash("p"), F.lit(buckets))).count()
        assert [r[1] for r in n.collect() if not parts // buckets <= r[1] <= -(-parts // buckets)] == []
