"""Language identification: averaged hashed subword embeddings, linear softmax.

Every byte n-gram (2 to 5 bytes, inside a lower-cased word or touching its
border) is hashed into ``BUCKETS`` rows of an embedding table; a text is the
average of its rows, followed by a linear softmax. Embeddings and softmax are
trained together by mini-batch stochastic gradient descent in numpy on a
bounded sample of every language (about ``PER_LANG`` texts, chosen by id hash), which
it goes through at least ``EPOCHS`` times; only their n-gram counts reach the driver. A
held-back tenth gives the temperature that calibrates the score and the rejection
threshold: a prediction with a lower score is marked ``rejected``.

Since the average is linear, scoring uses the product of embedding table and
softmax weights: one gather and one sum per n-gram. With more than ``TABLE_LANGS``
languages the two stay apart, so the model grows by ``DIM`` numbers a language.

Defined cases: null texts and texts without a letter get ``und`` with score 0,
rejected; equal texts get equal results; a language seen in no learning row is
never predicted; without learning rows everything is ``und``; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_mod, hash01, texts_of, utf8

BUCKETS_LOG2 = 14
DIM = 16
PER_LANG = 500
TABLE_LANGS = 200
EPOCHS = 14  # passes of the gradient descent over the sample
STEPS, LANG_STEPS = 800, 200  # mini-batches of the gradient descent, at least: in all, for each language
BATCH = 32
_ASCII_NON_LETTER = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                             0xD6E8FEB86659FD93)]


def subwords(text: bytes, bits: int = BUCKETS_LOG2) -> np.ndarray:
    """Hash buckets of all byte n-grams of one text (with repetition)."""
    raw = np.frombuffer(b" " + text.decode("utf-8", "ignore").lower().encode() + b" ", np.uint8)
    b = np.where(_ASCII_NON_LETTER[raw], np.uint8(32), raw)
    gap = b == 32
    b = b[~(gap & np.concatenate([[False], gap[:-1]]))]  # one space between words
    gap = b == 32
    u = b.astype(np.uint64)
    out, gram = [], u
    inner = np.zeros(len(b), bool)  # is there a space strictly inside the n-gram
    for n in range(2, 6):
        if len(b) < n:
            break
        gram = gram[:-1] | (u[n - 1:] << np.uint64(8 * (n - 1)))
        if n > 2:
            inner = inner[:-1] | gap[n - 2:-1]
        else:
            inner = inner[:-1]
        out.append((gram[~inner] * _K[n - 2]) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray | None  # buckets x languages, embedding times softmax weights
    bias: np.ndarray | None
    temperature: float = 1.0
    reject_below: float = 0.0
    weights: np.ndarray | None = None  # softmax weights, where ``table`` is the embedding alone

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if self.table is None:
            return lang, score
        for i, t in enumerate(texts):
            if not any(map(str.isalpha, t.decode("utf-8", "ignore"))):
                continue
            idx = subwords(t)
            z = self.table[idx].mean(0) if len(idx) else np.zeros(self.table.shape[1])
            z = (z if self.weights is None else z @ self.weights) + self.bias
            z = z / self.temperature
            p = np.exp(z - z.max())
            k = int(p.argmax())
            lang[i], score[i] = self.langs[k], p[k] / p.sum()
        return lang, score


def steps_for(rows: int, langs: int) -> int:
    """Mini-batches of the gradient descent over a sample of ``rows`` texts."""
    return max(STEPS, LANG_STEPS * langs, -(-EPOCHS * rows // BATCH))


def train_softmax(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int,
                  buckets: int, dim: int = DIM, steps: int | None = None, rate: float = 60.0,
                  batch: int = BATCH, seed: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SGD on (embedding, softmax weights, bias), the step falling to zero over ``steps``
    mini-batches; ``rows`` are (bucket ids, shares)."""
    steps = steps_for(len(rows), n_langs) if steps is None else steps
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32) / dim
    w, bias = np.zeros((dim, n_langs), np.float32), np.zeros(n_langs, np.float32)
    place = np.zeros(buckets, np.int64)
    order = np.zeros(0, np.int64)
    for done in range(steps):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(rows))])
        pick, order = order[:batch], order[batch:]
        idx = np.concatenate([rows[k][0] for k in pick])
        mask = np.zeros(buckets, bool)
        mask[idx] = True
        used = np.flatnonzero(mask)
        place[used] = np.arange(len(used))
        x = np.zeros((len(pick), len(used)), np.float32)
        x[np.repeat(np.arange(len(pick)), [len(rows[k][0]) for k in pick]), place[idx]] = \
            np.concatenate([rows[k][1] for k in pick])
        e = x @ emb[used]
        z = e @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(pick)), y[pick]] -= 1
        step = np.float32(rate * (1 - done / steps) / len(pick))
        ge, gw = p @ w.T, e.T @ p
        emb[used] -= step * (x.T @ ge)
        w -= np.float32(0.1) * step * gw
        bias -= np.float32(0.1) * step * p.sum(0)
    return emb, w, bias


def learn_languages(docs: DataFrame, per_lang: int = PER_LANG, mod: int = 3, held_out: int = 1,
                    bits: int = BUCKETS_LOG2, seed: int = 2) -> LangModel:
    """Learn from text and non-null lang of rows outside the held-out fold."""
    fold = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", mod) != held_out))
    counts = fold.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids")).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return LangModel([], None, None)
    share = fold.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, per_lang / max(1, r["ids"]))) for r in counts], "lang string, share double")
    # the ids of smallest hash, one row each (of several the smallest), so that the sample is bounded
    # and the same for any order of the rows
    picked = (fold.join(F.broadcast(share), "lang").where(hash01("doc_id", seed) < F.col("share"))
              .groupBy("doc_id", "lang").agg(F.min("text").alias("text")))

    def run(batches):
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            ids, lang = b.column("doc_id"), b.column("lang")
            for i, j in chunks(off):
                got = [np.unique(subwords(t, bits), return_counts=True) for t in texts_of(data, off, i, j)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), lang.slice(i, j - i),
                     pa.array([g[0].astype(np.int32).tobytes() for g in got], pa.binary()),
                     pa.array([(g[1] / max(1, g[1].sum())).astype(np.float32).tobytes() for g in got],
                              pa.binary())], ["doc_id", "lang", "idx", "share"])

    rows = picked.select("doc_id", "text", "lang").mapInArrow(
        run, "doc_id long, lang string, idx binary, share binary").collect()
    rows = sorted((r for r in rows if len(r["idx"])), key=lambda r: (r["doc_id"], r["lang"], r["idx"]))
    if not rows:
        return LangModel([], None, None)
    number = {name: k for k, name in enumerate(langs)}
    y = np.array([number[r["lang"]] for r in rows])
    x = [(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows]
    held = np.arange(len(y)) % 10 == 9
    held &= np.isin(y, y[~held])  # a language is never held back whole
    fit = np.flatnonzero(~held)
    emb, w, bias = train_softmax([x[i] for i in fit], y[fit], len(langs), 1 << bits, seed=seed)
    whole = len(langs) <= TABLE_LANGS
    model = LangModel(langs, (emb @ w if whole else emb).astype(np.float64), bias.astype(np.float64),
                      weights=None if whole else w.astype(np.float64))
    if held.any():
        z = np.array([model.table[x[i][0]].T @ x[i][1] for i in np.flatnonzero(held)])
        z = (z if whole else z @ model.weights) + model.bias
        yh = y[held]
        best = None
        for t in np.geomspace(0.1, 10, 41):
            q = z / t - (z / t).max(1, keepdims=True)
            nll = -(q[np.arange(len(yh)), yh] - np.log(np.exp(q).sum(1))).mean()
            if best is None or nll < best[0]:
                best = (nll, t)
        model.temperature = float(best[1])
        q = np.exp(z / model.temperature - (z / model.temperature).max(1, keepdims=True))
        conf = q.max(1) / q.sum(1)
        # rejected: scores below those of 99 % of the right held-back predictions, or below chance
        right = conf[q.argmax(1) == yh]
        chance = 1.0 / len(langs) + 1e-9
        model.reject_below = float(max(chance, np.quantile(right, 0.01)) if len(right) else chance)
    return model


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text."""
    def run(batches):
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            for i, j in chunks(off):
                lang, score = model.predict(texts_of(data, off, i, j))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), pa.array(lang, pa.string()), pa.array(score),
                     pa.array((score < model.reject_below) | np.array([x == "und" for x in lang], bool))],
                    ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean")
