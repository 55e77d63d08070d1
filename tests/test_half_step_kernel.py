"""The Arrow kernel of a half-step alone: its sums, its padding and its lookup of factor rows."""

import numpy as np
import pyarrow as pa

from factorlab.operators import factors as FA


def _tables(entities, ids, f):
    """entities: [(key, [(other, rating)])]."""
    other = [[o for o, _ in cells] for _, cells in entities]
    rating = [[r for _, r in cells] for _, cells in entities]
    left = pa.table({"p": pa.array([0] * len(entities), pa.int32()), "key": pa.array([k for k, _ in entities], pa.int64()),
                     "chunks": pa.array([1] * len(entities), pa.int32()), "other": pa.array(other, pa.list_(pa.int64())),
                     "rating": pa.array(rating, pa.list_(pa.float64()))})
    return left, pa.table({"id": pa.array(ids, pa.int64()), "f": pa.array(f.tolist(), pa.list_(pa.float64()))})


def test_kernel_solves_the_normal_equations_for_close_and_far_ids():
    rng = np.random.default_rng(3)
    for spread in (1, 10**12):  # looked up in a table, and by bisection
        ids = rng.permutation(40) * spread
        f = rng.random((40, 5))
        entities = [(k, [(int(i), float(rng.integers(0, 6))) for i in rng.choice(ids, n, replace=False)] + [(7 * spread + 10**14, 4.0)])
                    for k, n in enumerate([1, 2, 3, 33, 39, 17, 5])]
        models = FA.Models([2, 3], [0.1, 0.2])
        out = FA._normal_kernel(models, FA.Rule(), None)(*_tables(entities, ids, f)).to_pylist()
        row = {int(i): v for i, v in zip(ids, f)}
        assert {r["id"] for r in out} == set(range(7))
        for r in out:
            for a, b, reg in models.slices():
                seen = [(row[o][a:b], x) for o, x in entities[r["id"]][1] if o in row and x > 0.5]
                g = sum((np.outer(y, y) for y, _ in seen), reg * np.eye(b - a))
                want = np.linalg.solve(g, sum((x * y for y, x in seen), np.zeros(b - a)))
                np.testing.assert_allclose(r["f"][a:b], want, rtol=1e-8)


def test_null_partners_and_ratings_of_a_neighbour_add_nothing():
    f = np.array([[1.0], [2.0]])
    left, right = _tables([(1, [(0, 3.0), (None, 5.0), (1, 4.0)]), (2, [(1, None)] * 2)], [0, 1], f)
    out = FA._normal_kernel(FA.Models([1], [0.1]), FA.Rule("zero_filled"), [np.eye(1)])(left, right).to_pylist()
    assert abs(next(r["f"][0] for r in out if r["id"] == 1) - 11 / 1.1) < 1e-9


def test_little_is_padded():
    size = np.arange(1, 10_000)
    padded = FA._lengths(size)
    assert (padded >= size).all() and (padded <= 1.25 * size).all()
    assert len(np.unique(padded)) < 120


def test_places_of_missing_ids():
    for ids in (np.array([5, 3, 9]), np.array([5, 3, 10**15])):
        at, known = FA._places(ids, np.array([3, 4, 5, -1, 10**16, int(ids[2])]))
        assert known.tolist() == [True, False, True, False, False, True]
        assert ids[at[known]].tolist() == [3, 5, int(ids[2])]
    assert not FA._places(np.zeros(0, np.int64), np.array([1]))[1].any()


def test_parts_count_all_bytes_of_a_cell(spark, monkeypatch):
    """A cell takes more than its partner's factors: the parts of narrow models stay under the bound as well."""
    monkeypatch.setattr(FA, "PART_BYTES", 1000)
    rows = spark.range(1000).selectExpr("id % 250 as user_id", "id as item_id", "1.0D as rating")
    side = FA.rating_blocks(rows, "user_id", "item_id", 2, 1000, written=False)
    cells = [r["n"] for r in side.blocks.selectExpr("p", "size(rating) as n").groupBy("p").sum("n").toDF("p", "n").collect()]
    assert sum(cells) == 1000
    assert len(cells) > 40 and np.mean(cells) * (FA.CELL_BYTES + 16) < 2 * FA.PART_BYTES
