"""Nearest centres by one matrix product equal the whole comparison."""

import numpy as np
import pytest

from factorlab.operators import kmeans as K


@pytest.mark.parametrize("d, scale", [(1, 1.0), (6, 1e-6), (20, 1.0), (8, 1e8)])
def test_nearest_centre_compares_few_distances(monkeypatch, d, scale):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(60, d)) * scale
    centres[9], centres[40] = centres[3], centres[3] + 1e-10  # equal and nearly equal ones
    x = np.concatenate([rng.normal(size=(500, d)) * scale, centres, centres + 1e-11, (centres[:-1] + centres[1:]) / 2])
    whole = K._nearest_of_all
    want = whole(x, centres)

    def few(rows, c):
        assert not np.isfinite(rows).all(1).any()
        return whole(rows, c)

    monkeypatch.setattr(K, "_nearest_of_all", few)
    assert (K.nearest_centre(x, centres, 1 << 12) == want).all()
    odd = np.concatenate([x[:5], np.full((1, d), np.nan), np.full((1, d), np.inf)])
    with np.errstate(invalid="ignore"):
        assert (K.nearest_centre(odd, centres) == whole(odd, centres)).all()
