"""Language ID, toxicity, quality rules and quality classifier: exact counts against
brute force, held-out accuracy, and the defined edge cases."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.llm import lang_id, models, quality_classifier, quality_rules, queries, toxicity
from factorlab.llm.textstats import Words, base_counts

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (None, "word " * 80), (6, "é" * 30_000 + " x"),
        (7, "the same line\nthe same line\n\nthe same line"), (8, "日本語 テキスト"), (9, "1234 5678 ½²_")]


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    inside = set()
    for i, x in enumerate(g):
        if g.count(x) > 1:
            inside |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside))


def test_base_counts_equal_brute_force():
    random.seed(3)
    pieces = ["the", "a", "é#x", "cat\n", "\n", "  ", "dog|", "\r\n", "\x0b", "the a", "x"]
    texts = [" ".join(random.choice(pieces) for _ in range(random.randint(0, 60))) for _ in range(200)]
    texts += [t or "" for _, t in EDGE]
    b = base_counts(Words([t.encode() for t in texts]))
    keys = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = list(zip(*[b[k].tolist() for k in keys]))
    assert got == [brute_counts(t) for t in texts]


def test_trees_respect_monotone_features_and_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=3000)) > 0).astype(float)
    mono = np.array([1, -1, -1, 0])
    m = models.BoostedTrees(n_trees=30).fit(x, y, mono)
    assert ((m.predict(x) > 0.5) == (y == 1)).mean() > 0.85
    base = x[:200].copy()
    for f, sign in ((0, 1), (1, -1), (2, -1)):
        last = None
        for v in np.linspace(-4, 4, 30):
            base[:, f] = v
            p = m.predict(base)
            if last is not None:
                assert (sign * (p - last) >= -1e-12).all()
            last = p


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 20, 50)
    p = rng.binomial(n, np.linspace(0.1, 0.9, 50))
    v = models.isotonic(np.arange(50), p, n)
    assert (np.diff(v) >= -1e-12).all() and abs((v * n).sum() - p.sum()) < 1e-9


def test_quality_rules_query(spark):
    rows = queries.op8_quality_rules(spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in random.Random(1).sample(rows, 150):
        want = brute_counts(text[r["doc_id"]]) if len(text[r["doc_id"]]) < 6000 else None
        if want:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    quality = {r[0]: r[1] for r in spark.read.parquet(SF + "/labels.parquet").select("doc_id", "quality").collect()}
    held = [r for r in rows if r["doc_id"] in quality and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            and not r["base_failed"]]
    good = [r["kept"] for r in held if quality[r["doc_id"]] == 1]
    bad = [r["kept"] for r in held if quality[r["doc_id"]] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.3


def test_rules_edge_rows(spark, docs_of, labels_of):
    docs = docs_of(EDGE)
    got = {(r["doc_id"], r["n_words"]): r for r in
           quality_rules.apply_rules(docs, quality_rules.learn_rules(docs, labels_of([]))).collect()}
    assert got[1, 0]["base_failed"] and not got[1, 0]["kept"] and got[6, 2]["word_chars"] == 30_001
    kept = quality_rules.keep_good(docs, quality_rules.RuleModel(None, 0.0))
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality_rules.apply_rules(docs.limit(0), quality_rules.RuleModel(None, 0.0)).count() == 0
    nulls = labels_of([(None, 1, 1), (4, None, None), (4, 1, None)])
    assert quality_rules.learn_rules(docs, nulls).trees is None  # one class only


def test_quality_classifier_held_out(spark):
    rows = queries.op9_quality_classifier(spark, SF).collect()
    quality = {r[0]: r[1] for r in spark.read.parquet(SF + "/labels.parquet").select("doc_id", "quality").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["predicted"] == quality[r["doc_id"]] for r in held]) > 0.93
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_classifier_edge_rows(spark, docs_of, labels_of):
    docs = docs_of(EDGE)
    stats = quality_classifier.document_statistics(docs)
    m = quality_classifier.learn_quality(stats, labels_of([]))
    got = quality_classifier.score_quality(stats, m).collect()
    assert len(got) == len(EDGE) and all(r["score"] == 0.5 for r in got)
    empty = quality_classifier.document_statistics(docs.limit(0))
    assert quality_classifier.score_quality(empty, quality_classifier.learn_quality(empty, labels_of([]))).count() == 0
    some = labels_of([(i, i % 2, 0) for i in range(1, 10)])
    scores = {(r["doc_id"], r["score"]) for r in quality_classifier.score_quality(
        stats, quality_classifier.learn_quality(stats, some)).collect() if r["doc_id"] == 4}
    assert len(scores) == 1  # repeated rows get one score


def test_normal_equations_equal_one_pass(spark, docs_of, labels_of):
    docs = docs_of([(i, f"word{i % 7} text " * (1 + i % 13) + "#" * (i % 5)) for i in range(200)])
    labels = labels_of([(i, int(i % 5 < 2), 0) for i in range(200)])
    stats = quality_classifier.document_statistics(docs)
    a = quality_classifier.learn_quality(stats.repartition(1), labels)
    b = quality_classifier.learn_quality(stats.repartition(7), labels)
    assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_language_held_out(spark):
    rows = queries.op2_language_id(spark, SF).collect()
    lang = {r[0]: r[1] for r in spark.read.parquet(SF + "/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 200 < len(held) < 450
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and np.mean([r["rejected"] for r in rows]) < 0.1


def test_many_languages(spark):
    """More than 200 languages: each is learned, and every sampled text is seen in every epoch."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(210):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 8))) for _ in range(60)]
        rows += [(k * 60 + i, " ".join(rng.choice(words, 12)), f"l{k:03d}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = lang_id.learn_languages(docs)
    assert model.langs == sorted({r[2] for r in rows})
    assert all(lang_id.BATCH * lang_id.steps_for(n, 4) >= lang_id.EPOCHS * n for n in (1, 1_800, 25_650, 500_000))
    lang = {r[0]: r[2] for r in rows}
    held = lang_id.identify(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1), model).collect()
    right = sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held)
    print("held-out accuracy over 210 languages:", round(right, 4), "of", len(held))
    assert right > 0.9


def test_language_edge_rows(spark, docs_of):
    docs = docs_of([r + (("en", "fr", None)[k % 3],) for k, r in enumerate(EDGE)])
    got = {r["doc_id"]: r for r in lang_id.identify(docs, lang_id.learn_languages(docs, per_lang=5)).collect()}
    for k in (1, 2, 3, 9):
        assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and got[k]["rejected"]
    assert got[8]["lang_pred"] in ("en", "fr")
    none = lang_id.learn_languages(docs.limit(0))
    assert {r["lang_pred"] for r in lang_id.identify(docs, none).collect()} == {"und"}


def test_toxicity_separates_planted_words(spark, docs_of, labels_of):
    rng = random.Random(2)
    syll = ["an", "the", "ing", "er", "on", "tion", "ed", "st", "re", "ha", "in", "ou"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 3)))
    bad = ["worthless", "pathetic", "disgusting"]
    rows, labels = [], []
    for i in range(1500):
        w = [word() for _ in range(rng.randint(60, 200))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(max(3, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, y))
    docs = docs_of(rows)
    m = toxicity.learn_toxicity(docs, labels_of(labels), dict_docs=300)
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, m).collect()}
    held = [(score[i] >= 0.5, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == bool(y) for p, y in held]) > 0.9
    kept = toxicity.keep_clean(docs, m)
    assert kept.columns == docs.columns and 1000 < kept.count() < 1250


def test_toxicity_edge_rows(spark, docs_of, labels_of):
    docs = docs_of(EDGE)
    m = toxicity.learn_toxicity(docs, labels_of([]))
    assert {r["score"] for r in toxicity.score_toxicity(docs, m).collect()} == {0.0}
    few = toxicity.learn_toxicity(docs, labels_of([(i, 0, i % 2) for i in range(1, 10)] + [(None, 1, 1)]))
    got = toxicity.score_toxicity(docs, few).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(docs.limit(0), m).count() == 0
    spans = toxicity.window_spans(b"ab " * 100 + b"x" * 2000)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    assert sum(n for _, n in spans) == 2300


@pytest.mark.parametrize("size", [1, 5])
def test_dictionary_pruning_keeps_what_sets_apart(size):
    toxic = [b"some common words and wretched things %d" % i for i in range(50)]
    plain = [b"some common words and other things %d" % i for i in range(50)]
    got = toxicity.prune_dictionary(b"xx wretched thi " * size + b"some common words", toxic, plain)
    assert b"wretched" in got and b"common" not in got
