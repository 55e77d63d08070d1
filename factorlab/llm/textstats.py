"""Vectorised word, line and character statistics over many texts at once.

Texts are handled as UTF-8 bytes. Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, which is exact on UTF-8 since separators are ASCII.
Words, lines and n-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_CONT = (np.arange(256) & 0xC0) == 0x80
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_BANG = np.zeros(256, bool)
_BANG[list(b"!?")] = True

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2^64
_PINV = pow(_P, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    while len(_POW) < n:
        m = len(_POW)
        _POW = np.concatenate([_POW, _POW * np.uint64(pow(_P, m, 1 << 64))])
        _IPOW = np.concatenate([_IPOW, _IPOW * np.uint64(pow(_PINV, m, 1 << 64))])
    return _POW[:n], _IPOW[:n]


class ByteSpans:
    """64-bit hashes of byte spans of one buffer."""

    def __init__(self, buf: np.ndarray):
        pw, self.ipw = _powers(len(buf) + 1)
        self.cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * pw[:-1])])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.cum[end] - self.cum[start]) * self.ipw[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Word table of a chunk of texts: word w is bytes [start[w], end[w]) of ``buf``
    and belongs to text ``doc[w]``; ``first[d]:first[d+1]`` are the words of text d."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.buf = _LOWER[raw] if lower else raw
        lens = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.doc_end = np.cumsum(lens + 1) - 1  # position of the newline after each text
        self.doc_start = self.doc_end - lens
        sep = _SEP[self.buf]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        if not sep[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]  # the last byte is a separator
        self.first = np.searchsorted(self.start, np.concatenate([self.doc_start, [len(self.buf)]]))
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))
        self._spans = None

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span."""
        if self._spans is None:
            self._spans = ByteSpans(self.buf)
        return self._spans.hash(start, end)

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        c = np.concatenate([[0], np.cumsum(flags)])
        return c[self.doc_end] - c[self.doc_start]


_GRAM = mix64(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every k-word window inside one text."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = h[:m] * _GRAM[0]
    for i in range(1, k):
        g = g + h[i:m + i] * _GRAM[i]
    at = np.flatnonzero(doc[:m] == doc[k - 1:])
    return at, mix64(g[at])


def repeated_in_doc(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(is the pair found again, is it a later occurrence) for (doc, hash) pairs in text order."""
    key = mix64(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    rep = np.zeros(len(s), bool)
    late = np.zeros(len(s), bool)
    rep[order[1:]] = same
    late[order[1:]] = same
    rep[order[:-1]] |= same
    return rep, late


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """Exact per-text counts: n_words, word_chars (code points in words), n_symbols,
    n_dup_lines (lines with a word, equal to an earlier line) and n_repeat_words
    (words inside 3-word windows found at least twice in the text)."""
    n = w.n
    sep = _SEP[w.buf]
    out = {
        "n_words": np.diff(w.first),
        "word_chars": w.per_doc(~sep & ~_CONT[w.buf]),
        "n_symbols": w.per_doc(_SYMBOL[w.buf]),
    }
    nl = np.flatnonzero(w.buf == 10)
    ls, le = np.concatenate([[0], nl[:-1] + 1]), nl
    nonsep = np.concatenate([[0], np.cumsum(~sep)])
    has = nonsep[le] > nonsep[ls]
    ls, le = ls[has], le[has]
    ldoc = np.searchsorted(w.doc_end, ls, "left")
    _, late = repeated_in_doc(ldoc, w.spans(ls, le), n)
    out["n_dup_lines"] = np.bincount(ldoc[late], minlength=n)
    out["n_lines"] = np.bincount(ldoc, minlength=n)
    h = w.hashes()
    at, g = grams(h, w.doc, 3)
    rep, _ = repeated_in_doc(w.doc[at], g, n)
    hit = np.zeros(len(h) + 2, bool)
    for i in range(3):
        hit[at[rep] + i] = True
    out["n_repeat_words"] = np.bincount(w.doc[hit[:len(h)]], minlength=n)
    rep1, late1 = repeated_in_doc(w.doc, h, n)
    out["n_distinct_words"] = out["n_words"] - np.bincount(w.doc[late1], minlength=n)
    return out


FEATURES = ["log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_word_rate",
            "distinct_rate", "words_per_line", "upper_rate", "digit_rate", "punct_rate",
            "bang_rate", "non_ascii_rate", "symbol_word_rate", "adjacent_repeat_rate",
            "longest_word", "byte_entropy"]


def features(w: Words, base: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """(n, 16) document statistics for the quality models; an empty text gives zeros
    except where a rate has a natural value."""
    b = base or base_counts(w)
    n, nw = w.n, b["n_words"].astype(float)
    d = np.maximum(nw, 1.0)
    chars = np.maximum(w.per_doc(~_CONT[w.buf]).astype(float), 1.0)
    rate = lambda lut: w.per_doc(lut[w.buf]) / chars
    h = w.hashes()
    adj = np.zeros(len(h), bool)
    if len(h) > 1:
        adj[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    symcum = np.concatenate([[0], np.cumsum(_SYMBOL[w.buf] | _BANG[w.buf])])
    symw = symcum[w.end] > symcum[w.start]
    longest = np.zeros(n)
    if len(h):
        np.maximum.at(longest, w.doc, (w.end - w.start).astype(float))
    ent = np.zeros(n)
    for i in range(n):
        c = np.bincount(w.buf[w.doc_start[i]:w.doc_end[i]], minlength=256)
        c = c[c > 0]
        if len(c):
            p = c / c.sum()
            ent[i] = -(p * np.log2(p)).sum()
    return np.column_stack([
        np.log1p(nw), b["word_chars"] / d, b["n_symbols"] / chars,
        b["n_dup_lines"] / np.maximum(b["n_lines"], 1), b["n_repeat_words"] / d,
        b["n_distinct_words"] / d, np.log1p(nw / np.maximum(b["n_lines"], 1)),
        rate(_UPPER), rate(_DIGIT), rate(_PUNCT), rate(_BANG),
        w.per_doc(~_CONT[w.buf] & (w.buf >= 128)) / chars,
        np.bincount(w.doc[symw], minlength=n) / d, np.bincount(w.doc[adj], minlength=n) / d,
        np.log1p(longest), ent])
