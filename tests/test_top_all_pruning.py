"""The kernel of the top-N search alone: boxes that cannot reach a user's N-th best are not scored, nothing below it travels on."""

import numpy as np
import pyarrow as pa

from factorlab.operators import top_all as TA


def _tables(u, low, v, seen):
    n, m = len(u), len(seen)
    left = pa.table({"user_id": pa.array([*range(n), *[a for a, _ in seen]], pa.int64()),
                     "f": pa.array([*u.tolist(), *[None] * m], pa.list_(pa.float64())),
                     "low": pa.array([*low.tolist(), *[None] * m], pa.float64()),
                     "item_id": pa.array([*[None] * n, *[b for _, b in seen]], pa.int64())})
    return left, pa.table({"id": pa.array(range(len(v)), pa.int64()), "f": pa.array(v.tolist(), pa.list_(pa.float64()))})


def test_only_scores_that_reach_the_bound_travel_on():
    rng = np.random.default_rng(5)
    u, v = rng.integers(-3, 4, (40, 3)).astype(float), rng.integers(-3, 4, (500, 3)).astype(float)
    seen = [(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 300), rng.integers(0, 500, 300))]
    scores = u @ v.T
    for a, b in seen:
        scores[a, b] = -np.inf
    for low in (np.full(40, -np.inf), np.sort(scores, 1)[:, -4], np.full(40, 1e9)):
        got = TA._kernel(6, box=16)(*_tables(u, low, v, seen)).to_pylist()
        want = {(i, int(j), float(scores[i, j])) for i in range(40) for j in np.lexsort((np.arange(500), -scores[i]))[:6]
                if scores[i, j] >= low[i]}
        assert {(r["user_id"], r["item_id"], r["score"]) for r in got} == want
        assert len(got) == len(want)


def test_boxes_hold_every_item_once():
    v = np.random.default_rng(1).random((1000, 4))
    boxes = TA._boxes(v, 64)
    assert sorted(np.concatenate(boxes).tolist()) == list(range(1000)) and max(map(len, boxes)) <= 64
    assert max(np.prod(v[b].max(0) - v[b].min(0)) for b in boxes) < 0.25  # neighbours lie together
