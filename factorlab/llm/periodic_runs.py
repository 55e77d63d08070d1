"""Periodic runs of words by maximal-pair enumeration.

A run is a stretch of consecutive words with smallest period q and at least
max(``MIN_WORDS``, 2q) words that no neighbouring word extends. A document's
words become numbers, its suffixes are sorted by prefix doubling, and its
LCP-interval tree is walked bottom-up. A node of string depth l keeps the
positions of its string in order, each with the class of its left word. Two
positions i < j of different children and different classes are a maximal
pair; if j - i <= l, words i .. j+l-1 are a stretch of period j - i that cannot
be extended. Between two occurrences no more than l apart another occurrence
means a smaller period (Fine and Wilf), so only neighbouring positions of a
node have to be met: every run is the maximal pair of its smallest period, and
no pair is extended afterwards.

A pair that makes a run shares at least ``MIN_WORDS`` / 2 words, so the tree is
built only over words that some repeated gram of that length covers (exact:
other words differ from all others at their place). Children are merged
smaller into larger: O(n log n) steps a document.

Free style (Arrow batches in tasks): every document is a row of its own, nothing
is shuffled, no statistic leaves a task, and a lost task is simply run again. Memory
is some 150 bytes a word of the longest text beside one Arrow batch.

Defined cases: a null or empty text, or one without words, has no run and an
empty collapsed text; a null id has no planted order; repeated rows and equal
texts are judged alike, row by row; very long texts are processed whole; a
text that is not valid UTF-8 is taken as its bytes; columns beside the id and
the text do not matter, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, texts_of, utf8

MIN_WORDS = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_numbers(words: list) -> np.ndarray:
    """Equal words have equal numbers, from 0 in order of appearance."""
    index: dict = defaultdict(count().__next__)
    return np.fromiter(map(index.__getitem__, words), np.int64, len(words))


def repeated_cover(s: np.ndarray, gram: int) -> np.ndarray:
    """Marks the places that lie in a stretch of ``gram`` words occurring more than once."""
    n, cover = len(s), np.zeros(len(s), bool)
    if n <= gram:
        return cover
    v = mix64(s.astype(np.uint64) + np.uint64(1))
    h = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        h = h * np.uint64(0x2545F4914F6CDD1D) + v[k:n - gram + 1 + k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return cover
    hit = np.zeros(len(h) + 1, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit[:-1])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + gram, -1)
    return np.cumsum(edge[:-1]) > 0


def suffix_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, lcp[r] of suffixes r-1 and r) by prefix doubling."""
    m = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while True:
        key = rank * (m + 1)
        key[:m - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(m, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, width = new, 2 * width
        if rank[order[-1]] == m - 1:
            break
        levels.append(rank)
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(m, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) < m)
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
        lcp[1 + same] += 1 << k
    return order, lcp


def _merge(one: list, two: list, depth: int, place, left, least: int, runs: dict) -> list:
    """Joins two children of a node of ``depth``; neighbours of different children and
    classes that are no more than ``depth`` words apart are runs."""
    if len(one) < len(two):
        one, two = two, one
    for p in two:
        k = bisect_left(one, p)
        pairs = [(one[k - 1], p)] if k else []
        if k < len(one):
            pairs.append((p, one[k]))
        for i, j in pairs:
            d = place[j] - place[i]
            if d <= depth and d + depth >= least and left[i] != left[j]:
                key = (place[i], place[j] + depth)
                if runs.get(key, d + 1) > d:
                    runs[key] = d
    if len(two) == 1:
        insort(one, two[0])
    else:
        one.extend(two)
        one.sort()
    return one


def runs_of(s: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbered words, by start, then period."""
    gram = (least + 1) // 2
    cover = repeated_cover(s, gram)
    if not cover.any():
        return []
    # words outside: one separator (a number of its own) a gap; `place` is the original place
    gap = ~cover
    keep = cover | (gap & ~np.concatenate([[False], gap[:-1]]))
    at = np.flatnonzero(keep)
    t = s[at].copy()
    outside = np.flatnonzero(~cover[at])
    t[outside] = s.max() + 1 + np.arange(len(outside))
    order, lcp = suffix_order(t)
    left = [-1] + t[:-1].tolist()
    place, order, lcp = at.tolist(), order.tolist(), lcp.tolist()
    found: dict = {}
    stack: list = []  # (depth, positions of the node's finished children)
    last = [order[0]]
    for r in range(1, len(order) + 1):
        depth = lcp[r] if r < len(order) else 0
        while stack and stack[-1][0] > depth:
            l, node = stack.pop()
            last = _merge(node, last, l, place, left, least, found)
        if depth >= gram:
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, _merge(stack[-1][1], last, depth, place, left, least, found))
            else:
                stack.append((depth, last))
        if r < len(order):
            last = [order[r]]
    return sorted((i, e - i, d) for (i, e), d in found.items())


def kept_words(n: int, runs: list) -> np.ndarray:
    """Marks the words that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def tail_order(doc_id, n: int):
    """The planted order of a tenth of the documents: from word a on, the words a .. a+p-1
    over and over (None: the words as they are)."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS, order=None) -> DataFrame:
    """One row per document: (``id_col``, n_words, runs, collapsed), runs by start, then
    period, and the text left when every run keeps only its first period (its words joined
    by one space, as bytes). ``order``: function of (id, number of words) that gives the
    places of the words to take, or None for all in order."""
    schema = docs.select(id_col).schema

    def batches(it):
        for batch in it:
            ids = batch.column(0)
            data, off, _ = utf8(batch.column(1))
            for i, j in chunks(off):
                n_words, found, left = [], [], []
                for doc_id, text in zip(ids.slice(i, j - i).to_pylist(), texts_of(data, off, i, j)):
                    words = text.split()
                    places = order(doc_id, len(words)) if order else None
                    if places is not None:
                        words = [words[k] for k in places.tolist()]
                    runs = runs_of(word_numbers(words), min_words)
                    if runs:
                        keep = kept_words(len(words), runs)
                        left.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k]))
                    else:
                        left.append(b" ".join(words))
                    n_words.append(len(words))
                    found.append([{"start": a, "length": b, "period": q} for a, b, q in runs])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(found, _RUN_TYPE),
                     pa.array(left, pa.binary())], [id_col, "n_words", "runs", "collapsed"])

    id_type = schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        batches, f"`{id_col}` {id_type}, n_words bigint, runs {RUNS}, collapsed binary")


def longest_run(runs: Column) -> Column:
    """(length, start, period) of the longest run, ties to the smallest start, then period;
    null without runs."""
    key = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(key.isNotNull(), F.struct(key["length"].alias("length"), (-key["s"]).alias("start"),
                                            (-key["p"]).alias("period")))


def runs_digest(runs: Column) -> Column:
    """sha256 of every run's ``start,length,period`` and a line feed."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)
