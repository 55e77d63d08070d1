"""Quality rules: exact base counts plus boosted trees over document statistics.

``learn_rules`` fits :class:`~.models.BoostedTrees` on the statistics of a
bounded sample of labelled documents (``sample_rows``, the rows with the
smallest id hash; only their statistics reach the driver). Repetition,
symbol and shouting rates are monotone: more of them never raises the score.
The verdict threshold is the score under which ``max_loss`` of the sample's
good documents fall, so clean documents stay.

Defined cases: a null text has no words, so the base rule rejects it; equal
rows get equal verdicts; without any usable label the verdict is the base rule
alone; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, labelled, sample_ids, texts_of, tidy, utf8
from .models import BoostedTrees
from .textstats import FEATURES, Words, base_counts, features

SAMPLE_ROWS = 20_000  # labelled documents whose statistics are collected for the fit
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_word_rate": -1, "bang_rate": -1,
            "symbol_word_rate": -1, "adjacent_repeat_rate": -1, "distinct_rate": 1}
MIN_WORDS = 50
MAX_REPEAT_PCT = 50


@dataclass
class RuleModel:
    trees: BoostedTrees | None
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x)) if self.trees is None else self.trees.predict(x)


def base_failed(b: dict) -> np.ndarray:
    return (b["n_words"] < MIN_WORDS) | (100 * b["n_repeat_words"] > MAX_REPEAT_PCT * b["n_words"])


def sample_features(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sampled documents: one row per id, of several texts the
    smallest, so that the sample bounds what is collected however often an id occurs."""
    picked = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
              .groupBy("doc_id", "y").agg(F.min("text").alias("text")))

    def run(batches):
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            for i, j in chunks(off):
                x = features(Words(texts_of(data, off, i, j)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("y").slice(i, j - i),
                     pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = picked.select("doc_id", "y", "text").mapInArrow(
        tidy(run), "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    if not rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    return np.array([r[2] for r in rows]), np.array([float(r[1]) for r in rows])


def learn_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS,
                max_loss: float = 0.002, seed: int = 8) -> RuleModel:
    """Fit the trees on the learning fold of ``labels.quality``."""
    x, y = sample_features(docs, sample_ids(labelled(labels, "quality"), sample_rows, seed))
    if not len(y) or y.min() == y.max():
        return RuleModel(None, 0.0)
    mono = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    fit = np.arange(len(y)) % 4 != 0  # the other quarter sets the threshold
    trees = BoostedTrees().fit(x[fit], y[fit], mono)
    good = trees.predict(x[~fit & (y == 1)]) if (~fit & (y == 1)).any() else trees.predict(x[y == 1])
    return RuleModel(trees, float(min(0.5, np.quantile(good, max_loss))))


RULE_COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                "n_repeat_words long, base_failed boolean, kept boolean, score double")


def judge(texts: list[bytes], model: RuleModel) -> dict[str, np.ndarray]:
    w = Words(texts)
    b = base_counts(w)
    score = model.score(features(w, b))
    bad = base_failed(b)
    return {"n_words": b["n_words"], "word_chars": b["word_chars"], "n_symbols": b["n_symbols"],
            "n_dup_lines": b["n_dup_lines"], "n_repeat_words": b["n_repeat_words"],
            "base_failed": bad, "kept": ~bad & (score >= model.threshold), "score": score}


def apply_rules(docs: DataFrame, model: RuleModel) -> DataFrame:
    """One row per document with the base counts, the verdict and the score."""
    def run(batches):
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            for i, j in chunks(off, CHUNK_BYTES):
                r = judge(texts_of(data, off, i, j), model)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i)] + [pa.array(v) for v in r.values()],
                    ["doc_id", *r])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, " + RULE_COLUMNS)


def filter_rows(docs: DataFrame, keep) -> DataFrame:
    """``docs`` with only the rows for which ``keep(list of texts)`` is true, all
    columns untouched (rows are filtered where they lie: no join, no shuffle)."""
    def run(batches):
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            mask = [keep(texts_of(data, off, i, j)) for i, j in chunks(off)]
            if mask:
                yield b.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(tidy(run), docs.schema)


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Pipeline form: the documents that the rules keep."""
    return filter_rows(docs, lambda texts: judge(texts, model)["kept"])
