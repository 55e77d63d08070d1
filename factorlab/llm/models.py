"""Small learners fitted on the driver from bounded inputs: logistic
regression (calibration), isotonic regression and boosted trees."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Logistic:
    """Ridge logistic regression by Newton steps on standardised inputs."""

    def __init__(self, ridge: float = 1e-2, steps: int = 30):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Logistic":
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-9
        a = np.c_[(x - self.mean) / self.sd, np.ones(len(x))]
        self.w = np.zeros(a.shape[1])
        for _ in range(self.steps):
            p = sigmoid(a @ self.w)
            hess = (a * (p * (1 - p))[:, None]).T @ a + self.ridge * np.eye(len(self.w))
            step = np.linalg.solve(hess, a.T @ (y - p) - self.ridge * self.w)
            self.w = self.w + step
            if np.abs(step).max() < 1e-8:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.c_[(x - self.mean) / self.sd, np.ones(len(x))] @ self.w)


def isotonic(x: np.ndarray, positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: non-decreasing rates for groups in order of ``x``."""
    level, weight, size = [], [], []
    for p, t in zip(positives.astype(float), totals.astype(float)):
        level.append(p / t)
        weight.append(t)
        size.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            t2, t1 = weight.pop(), weight.pop()
            v2, v1 = level.pop(), level.pop()
            level.append((v1 * t1 + v2 * t2) / (t1 + t2))
            weight.append(t1 + t2)
            s2, s1 = size.pop(), size.pop()
            size.append(s1 + s2)
    return np.repeat(level, size)


class BoostedTrees:
    """Gradient-boosted trees for a 0/1 label (logistic loss, histogram splits).

    Trees are complete, of a fixed depth, and stored as flat numpy node arrays
    (``feature``, ``threshold``, ``leaf``), so a batch is scored by ``depth``
    gathers for all trees together. ``monotone[f]`` of +1 / -1 forces the score
    never to fall / rise with feature f: a split against it is refused and the
    children's values are bounded by the middle of the split (passed down).
    """

    def __init__(self, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64,
                 l2: float = 2.0, min_weight: float = 4.0):
        self.n_trees, self.depth, self.rate = n_trees, depth, rate
        self.bins, self.l2, self.min_weight = bins, l2, min_weight

    def fit(self, x: np.ndarray, y: np.ndarray, monotone: np.ndarray | None = None) -> "BoostedTrees":
        n, nf = x.shape
        mono = np.zeros(nf, int) if monotone is None else np.asarray(monotone)
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(nf)]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        prior = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(prior / (1 - prior)))
        inner, leaves = 2 ** self.depth - 1, 2 ** self.depth
        self.feature = np.zeros((self.n_trees, inner), np.int64)
        self.threshold = np.full((self.n_trees, inner), np.inf)
        self.leaf = np.zeros((self.n_trees, leaves))
        z = np.full(n, self.base)
        nb = self.bins + 1
        for t in range(self.n_trees):
            p = sigmoid(z)
            g, hs = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            lo, hi = {0: -np.inf}, {0: np.inf}
            for level in range(self.depth):
                width, base = 2 ** level, 2 ** level - 1
                best = {}
                for f in range(nf):
                    if not len(cuts[f]):
                        continue
                    key = (node - base) * nb + binned[:, f]
                    gs = np.bincount(key, g, width * nb).reshape(width, nb).cumsum(1)
                    ws = np.bincount(key, hs, width * nb).reshape(width, nb).cumsum(1)
                    gt, wt = gs[:, -1:], ws[:, -1:]
                    gl, wl = gs[:, :len(cuts[f])], ws[:, :len(cuts[f])]
                    gr, wr = gt - gl, wt - wl
                    vl, vr = gl / (wl + self.l2), gr / (wr + self.l2)
                    gain = gl * vl + gr * vr - gt * gt / (wt + self.l2)
                    ok = (wl >= self.min_weight) & (wr >= self.min_weight)
                    if mono[f]:
                        ok &= mono[f] * (vr - vl) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    k = gain.argmax(1)
                    for v in range(width):
                        if gain[v, k[v]] > max(1e-6, best.get(v, (1e-6,))[0]):
                            best[v] = (gain[v, k[v]], f, k[v], vl[v, k[v]], vr[v, k[v]])
                nlo, nhi = {}, {}
                for v in range(width):
                    i = base + v
                    left, right = 2 * i + 1, 2 * i + 2
                    nlo[left] = nlo[right] = lo[i]
                    nhi[left] = nhi[right] = hi[i]
                    if v in best:
                        _, f, k, vl_, vr_ = best[v]
                        self.feature[t, i], self.threshold[t, i] = f, cuts[f][k]
                        if mono[f]:
                            mid = min(max((vl_ + vr_) / 2, lo[i]), hi[i])
                            if mono[f] > 0:
                                nhi[left] = min(nhi[left], mid)
                                nlo[right] = max(nlo[right], mid)
                            else:
                                nlo[left] = max(nlo[left], mid)
                                nhi[right] = min(nhi[right], mid)
                lo, hi = nlo, nhi
                go = x[np.arange(n), self.feature[t, node]] > self.threshold[t, node]
                node = 2 * node + 1 + go
            at = node - inner
            value = np.bincount(at, g, leaves) / (np.bincount(at, hs, leaves) + self.l2)
            low = np.array([lo[inner + v] for v in range(leaves)])
            high = np.array([hi[inner + v] for v in range(leaves)])
            self.leaf[t] = self.rate * np.clip(value, low, high)
            z = z + self.leaf[t, at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        if not n:
            return np.zeros(0)
        rows, trees = np.arange(n)[:, None], np.arange(self.n_trees)[None, :]
        node = np.zeros((n, self.n_trees), np.int64)
        for _ in range(self.depth):
            go = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + go
        return sigmoid(self.base + self.leaf[trees, node - (2 ** self.depth - 1)].sum(1))
