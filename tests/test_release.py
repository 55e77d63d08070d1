"""Loops and grids let go of the shuffle files of what is done, and their results stay the same."""

from factorlab.operators import factors as FA
from factorlab.operators import tuning as TU


def _ratings(spark):
    return spark.range(600).selectExpr("id % 30 as user_id", "(id * 7) % 41 as item_id", "cast(id % 5 + 1 as double) as rating")


def test_a_large_loop_releases_after_every_half_step(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(FA, "release", lambda s: calls.append(s))
    plain = FA.train_als(_ratings(spark), 2, 3, 0.1)
    assert not calls
    monkeypatch.setattr(FA, "RELEASE_BYTES", 0)
    again = FA.train_als(_ratings(spark), 2, 3, 0.1)
    assert len(calls) == 6
    rows = lambda m: sorted((r.id, [round(v, 8) for v in r.f]) for r in m.users.collect())
    assert rows(plain) == rows(again)


def test_large_library_fits_run_one_after_the_other(spark, monkeypatch):
    r, calls = _ratings(spark).localCheckpoint(), []
    grid = lambda: [x["rmse"] for x in TU.grid_search("library", r, r, [2], [0.1, 1.0], [2])[0].orderBy("grid_id").collect()]
    side_by_side = grid()
    monkeypatch.setattr(TU, "LARGE_FIT", 1)
    monkeypatch.setattr(TU, "release", lambda s: calls.append(s))
    one_by_one = grid()
    assert len(calls) == 2
    assert all(abs(a - b) < 1e-6 for a, b in zip(side_by_side, one_by_one))
