"""Toxicity by compression distance to two zstandard dictionaries.

``learn_toxicity`` trains one dictionary on ordinary and one on toxic text of a
bounded sample of labelled documents. Of the toxic dictionary only the
stretches stay whose 6-byte substrings occur in far more toxic than ordinary
sample documents, so that what both classes share cannot tell them apart. A
text is cut into windows of about ``WINDOW`` bytes at word borders, and each
window is compressed twice: with the ordinary dictionary alone, and with the
toxic dictionary in front of it. The bytes saved by the toxic dictionary, per
window, give nine numbers per document (largest saving, shares of windows
above thresholds, mean), which a logistic fit on further labelled documents turns into a
calibrated score; 0.5 is the decision threshold.

Bounds of the sample: ``DICT_DOCS`` documents and ``DICT_BYTES`` bytes per
class for the dictionaries, ``FIT_DOCS`` documents for the calibration (only
their nine numbers are collected).

Defined cases: a null text reads as empty; an empty text gets the score of a
text without windows; equal texts get equal scores; without both labels (or with
too little text to train a dictionary) every score is the share of label 1
(0 without any label); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, labelled, sample_ids, texts_of, tidy, utf8
from .models import Logistic
from .quality_rules import filter_rows

DICT_DOCS = 1500
DICT_BYTES = 12 << 20
FIT_DOCS = 6000
ORDINARY_SIZE = 64 << 10
TOXIC_TRAINED = 128 << 10  # before pruning
TOXIC_SIZE = 24 << 10
WINDOW = 64
MIN_MATCH = 5
SEARCH_LOG = 7
DMER = 6
THRESHOLDS = (2, 3, 4, 5, 7)


def window_spans(text: bytes, size: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of consecutive windows that end at the first word border after ``size`` bytes."""
    out, n, at = [], len(text), 0
    while at < n:
        end = at + size
        if end >= n:
            out.append((at, n - at))
            break
        m = text.find(b" ", end)
        nl = text.find(b"\n", end, m if m >= 0 else n)
        end = nl if nl >= 0 else m
        if end < 0 or end > at + 4 * size:  # no border near: cut where it is
            end = min(n, at + 4 * size)
        out.append((at, end - at))
        at = end
    return out


def dmers(text: bytes, d: int = DMER) -> np.ndarray:
    u = np.frombuffer(text, np.uint8).astype(np.uint64)
    m = len(u) - d + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(m, np.uint64)
    for i in range(d):
        g |= u[i:m + i] << np.uint64(8 * i)
    return g


def document_share(cand: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Share of the texts that contain each candidate substring."""
    hits = np.zeros(len(cand))
    for t in texts:
        g = np.unique(dmers(t))
        at = np.minimum(np.searchsorted(cand, g), len(cand) - 1)
        hits[at[cand[at] == g]] += 1
    return hits / max(1, len(texts))


def prune_dictionary(content: bytes, toxic: list[bytes], ordinary: list[bytes],
                     size: int = TOXIC_SIZE, lift: float = 4.0, least: float = 0.01) -> bytes:
    """The stretches of a trained dictionary that set toxic documents apart, most
    frequent last (nearest to the data), at most ``size`` bytes."""
    g = dmers(content)
    if not len(g):
        return b""
    cand = np.unique(g)
    pt, po = document_share(cand, toxic), document_share(cand, ordinary)
    spread = np.sqrt(pt * (1 - pt) / max(1, len(toxic)))
    at = np.searchsorted(cand, g)
    hit = np.flatnonzero(((pt - 3 * spread > lift * po) & (pt >= least))[at])
    cover = np.zeros(len(content) + 2, np.int64)
    np.add.at(cover, hit + 1, 1)
    np.add.at(cover, hit + 1 + DMER, -1)
    inside = (np.cumsum(cover)[1:] > 0).astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside])))
    best: dict[bytes, float] = {}
    for s, e in zip(edge[::2], edge[1::2]):
        piece = content[s:e]
        best[piece] = max(best.get(piece, 0.0), float(pt[at[s:max(s + 1, e - DMER + 1)]].max()))
    return b"".join(sorted(best, key=lambda p: (best[p], p)))[-size:]


@dataclass
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    logistic: Logistic | None = None
    prior: float = 0.0
    _tools: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_tools": None}

    def _compressors(self):
        if self._tools is None:
            made = []
            # a binary-tree search finds the same matches whichever dictionary is longer
            how = zstd.ZstdCompressionParameters(
                strategy=zstd.STRATEGY_BTLAZY2, window_log=18, hash_log=17, chain_log=18,
                search_log=SEARCH_LOG, min_match=MIN_MATCH, write_content_size=0, write_checksum=0,
                write_dict_id=0)
            for content in (self.ordinary, self.toxic + self.ordinary):
                d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                made.append(zstd.ZstdCompressor(dict_data=d, compression_params=how))
            self._tools = tuple(made)
        return self._tools

    def savings(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes saved per window, windows per text)."""
        low = [t.decode("utf-8", "ignore").lower().encode() for t in texts]
        spans = [window_spans(t) for t in low]
        counts = np.array([len(s) for s in spans], np.int64)
        if not counts.sum():
            return np.zeros(0), counts
        base = np.concatenate([[0], np.cumsum([len(t) for t in low])[:-1]])
        at = np.array([(b + s, n) for b, ss in zip(base, spans) for s, n in ss], np.uint64)
        src = zstd.BufferWithSegments(b"".join(low), at.tobytes())
        sizes = []
        for c in self._compressors():
            got = c.multi_compress_to_buffer(src, threads=1)
            sizes.append(np.fromiter((len(x) for x in got), np.int64, len(got)))
        return (sizes[0] - sizes[1]).astype(float), counts

    def features(self, texts: list[bytes]) -> np.ndarray:
        gain, counts = self.savings(texts)
        n = len(texts)
        doc = np.repeat(np.arange(n), counts)
        d = np.maximum(counts, 1)
        top = np.zeros(n)
        np.maximum.at(top, doc, gain)
        order = np.lexsort((-gain, doc))
        rank = np.arange(len(gain)) - np.repeat(np.cumsum(counts) - counts, counts)
        top3 = np.bincount(doc[order][rank < 3], gain[order][rank < 3], n) / np.clip(counts, 1, 3)
        cols = [top, top3]
        cols += [np.bincount(doc[gain >= t], minlength=n) / d for t in THRESHOLDS]
        cols += [np.bincount(doc, gain, n) / d, np.log(d)]
        return np.column_stack(cols)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.logistic is None:
            return np.full(len(texts), self.prior)
        return np.round(self.logistic.predict(self.features(texts)), 9)


def _picked(docs: DataFrame, ids: list, spark) -> DataFrame:
    """One row per sampled id, of several texts the smallest: however often an id occurs, what is
    collected is bounded by the sample sizes."""
    few = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return (docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text")))


def learn_toxicity(docs: DataFrame, labels: DataFrame, dict_docs: int = DICT_DOCS,
                   dict_bytes: int = DICT_BYTES, fit_docs: int = FIT_DOCS, seed: int = 4) -> ToxicModel:
    """Train the dictionaries and the calibration on the learning fold of ``labels.toxic``."""
    spark = docs.sparkSession
    fold = labelled(labels, "toxic")
    dict_ids, fit_rows = {}, []
    for y in (0, 1):
        n = dict_docs * (2 if y == 0 else 1)
        got = [r["doc_id"] for r in sample_ids(fold.where(F.col("y") == y), 2 * n, seed).collect()]
        dict_ids[y] = got[:min(n, len(got) * 2 // 3)]
    used = set(dict_ids[0]) | set(dict_ids[1])
    fit_rows = [(r["doc_id"], r["y"]) for r in
                sample_ids(fold, fit_docs + len(used), seed + 1).collect() if r["doc_id"] not in used]
    y_of = dict(fit_rows)
    if not dict_ids[1] or not dict_ids[0] or len(set(y_of.values())) < 2:
        share = sum(y_of.values()) / len(y_of) if y_of else float(bool(dict_ids[1]))
        return ToxicModel(b"", b"", None, float(min(share, 1.0)))
    sized = _picked(docs, sorted(used), spark).select(
        "doc_id", F.octet_length("text").alias("n")).where("n > 0").collect()
    size_of: dict = {}
    for r in sized:
        size_of[r["doc_id"]] = size_of.get(r["doc_id"], 0) + r["n"]
    take = set()
    for y in (0, 1):
        room = dict_bytes
        for i in dict_ids[y]:
            if 0 < size_of.get(i, 0) <= room:
                take.add(i)
                room -= size_of[i]
    pool: dict = {0: [], 1: []}
    toxic_ids = set(dict_ids[1])
    rows = _picked(docs, sorted(take), spark).collect()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or "")):
        if r["text"]:
            pool[int(r["doc_id"] in toxic_ids)].append(r["text"].lower().encode())
    try:
        trained = [zstd.train_dictionary(size, pool[y], d=DMER, k=32, steps=1).as_bytes()
                   for y, size in ((0, ORDINARY_SIZE), (1, TOXIC_TRAINED))]
    except zstd.ZstdError:  # too little text: the texts themselves are the dictionary
        trained = [b"\n".join(pool[0])[-ORDINARY_SIZE:], b"\n".join(pool[1])[-TOXIC_TRAINED:]]
    model = ToxicModel(trained[0], prune_dictionary(trained[1], pool[1], pool[0]))

    def run(batches):
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            for i, j in chunks(off):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i),
                     pa.array(list(model.features(texts_of(data, off, i, j))), pa.list_(pa.float64()))],
                    ["doc_id", "x"])

    got = _picked(docs, sorted(y_of), spark).mapInArrow(tidy(run), "doc_id long, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    y = np.array([float(y_of[r["doc_id"]]) for r in got])
    model.prior = float(y.mean()) if len(y) else 0.0
    if len(y) and 0 < y.sum() < len(y):
        model.logistic = Logistic().fit(np.array([r["x"] for r in got]), y)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, score) of every whole text."""
    def run(batches):
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            for i, j in chunks(off):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i),
                     pa.array(model.score(texts_of(data, off, i, j)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """Pipeline form: the documents with a score under 0.5."""
    return filter_rows(docs, lambda texts: model.score(texts) < 0.5)
