"""Models whose half-steps would send too much at once train in loops one after the other, with the same results."""

import numpy as np
import pytest

from factorlab.operators import factors as FA
from factorlab.operators import tuning as TU


def _cells(spark):
    rng = np.random.RandomState(5)
    return spark.createDataFrame([(u, i, float(rng.randint(0, 6))) for u in range(20) for i in range(12) if rng.rand() < 0.5],
                                 "user_id bigint, item_id bigint, rating double").localCheckpoint()


def test_no_half_step_sends_more_than_the_bound():
    ranks = [k for k in (8, 12, 16, 20, 24) for _ in (0.1, 10.0)]  # q_grid_masked at 1 GB: 21.6 million training cells
    loops = FA._loops(ranks, 21_600_000)
    assert [i for g in loops for i in g] == list(range(10)) and len(loops) > 1
    assert all(21_600_000 * 8 * sum(ranks[i] for i in g) <= FA.LOOP_BYTES for g in loops)
    assert FA._loops(ranks, 1000) == [list(range(10))]
    assert FA._loops([5, 5], 10 ** 12) == [[0], [1]]


@pytest.mark.parametrize("bound", [1, 4800])  # about 120 cells: every model alone, and two beside one
def test_several_loops_equal_one(spark, monkeypatch, bound):
    r, fits = _cells(spark), {}
    run = lambda **kw: FA.train_models(r, [1, 3, 2], [0.1, 0.5, 2.0], 2, "masked", spark.range(22).select("id"), **kw)
    for at in (FA.LOOP_BYTES, bound):
        monkeypatch.setattr(FA, "LOOP_BYTES", at)
        models = run(trace_on=r)
        blocks = models[0].together.blocks(r)
        fits[at] = ([{x.id: x.f for x in m.users.collect()} for m in models], [m.trace for m in models],
                    models[0].together.squared_errors(blocks),
                    sorted((x.m, x.rating, round(x.prediction, 7)) for x in models[0].together.scored(blocks).collect()))
        assert (len(models[0].together.loops) > 1) == (at == bound)
    a, b = fits.values()
    for x, y in zip(a[0], b[0]):
        assert x.keys() == y.keys() and all(np.allclose(x[k], y[k], atol=1e-9) for k in x)
    assert np.allclose(a[1], b[1]) and np.allclose(a[2], b[2]) and np.allclose(a[3], b[3], atol=2e-7)


def test_a_grid_over_several_loops(spark, monkeypatch):
    r = _cells(spark)
    grid = lambda: [(x["rank"], x.reg, x.iters, round(x.rmse, 9)) for x in
                    TU.grid_search("masked", r, r, [1, 2], [0.1, 1.0], [1, 2])[0].orderBy("grid_id").collect()]
    one = grid()
    monkeypatch.setattr(FA, "LOOP_BYTES", 1)
    assert grid() == one
