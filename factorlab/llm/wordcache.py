"""Token ids by distinct pieces of text.

Tokenizers encode the pieces of their pre-tokenisation independently, so equal
pieces have equal ids. A chunk of text is cut into pieces by numpy, distinct
pieces (by 64-bit hash) are encoded once by the tokenizer, and ids are gathered.
A worker keeps what it has encoded, up to a bound.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_P = 0x2545F4914F6CDD1D
_PINV = pow(_P, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)
_LOW = mix64(np.arange(1, 0x10001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int):
    global _POW, _IPOW
    while len(_POW) < n:
        m = len(_POW)
        _POW = np.concatenate([_POW, _POW * np.uint64(pow(_P, m, 1 << 64))])
        _IPOW = np.concatenate([_IPOW, _IPOW * np.uint64(pow(_PINV, m, 1 << 64))])
    return _POW[:n], _IPOW[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def span_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    v = _LOW[np.minimum(cp, 0xFFFF)]
    if len(cp) and cp.max() > 0xFFFF:
        v = np.where(cp > 0xFFFF, mix64(cp.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), v)
    pw, ipw = _powers(len(cp) + 1)
    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * pw[:-1])])
    h = (cum[end] - cum[start]) * ipw[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class PieceIds:
    """Ids of pieces; ``encode(list of pieces) -> list of id lists`` is called once per distinct piece."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)  # sorted hashes, and the place of each one's ids
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.used = 0

    def _add(self, keys: np.ndarray, pieces: list[str]):
        lens, new = [], []
        for i in range(0, len(pieces), 4096):
            for g in self.encode(pieces[i:i + 4096]):
                lens.append(len(g))
                new += g
        count = np.array(lens, np.int64)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(new)] = new
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, self.used + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.used += len(new)

    def ids(self, text: str, cp: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(ids of all pieces in order, number of ids of each piece)."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        h = span_hashes(cp, start, end)
        order = np.argsort(h)
        new_key = np.ones(len(h), bool)
        new_key[1:] = h[order[1:]] != h[order[:-1]]
        first = order[new_key]
        uniq = h[first]
        if len(self.keys) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == uniq
        if not known.all():
            miss = first[~known]
            self._add(uniq[~known], [text[a:b] for a, b in zip(start[miss].tolist(), end[miss].tolist())])
            at = np.searchsorted(self.keys, uniq)
        slot = np.empty(len(h), np.int64)
        slot[order] = at[np.cumsum(new_key) - 1]
        n, s = self.count[slot], self.start[slot]
        before = np.cumsum(n) - n
        return self.flat[np.arange(int(n.sum())) + np.repeat(s - before, n)], n
