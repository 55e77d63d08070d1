"""Hot keys, repeated rows, clashing column names, and plain references of the learned operators."""

import hashlib
import math
import random
import time

import numpy as np
import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from factorlab.llm import (ann, chat_format, jaccard_join, lang_id, quality_classifier as qc, quality_rules, queries,
                           suffix_dedup, toxicity)
from factorlab.session import cut_lineage

BPE = queries.tokenizer_file("byte_bpe_50k.json")


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ----------------------------------------------------------- repeated passages
def test_many_equal_rows_take_linear_time(spark):
    """1,600 copies of one long text (one id, no id, ids of their own), and others that share a part of it."""
    rng = random.Random(1)
    text = words(rng, 3000)
    other = words(rng, 300)
    part = text[5000:5600]
    rows = [(7 if i < 800 else None if i < 1200 else i, text) for i in range(1600)]
    rows += [(9000, other + " " + part + " " + other[:100]), (9001, other[200:450])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    got = {}
    for r in suffix_dedup.repeated_passages(df).collect():
        got.setdefault((r.doc_id, r.n_bytes), set()).add((r.n_removed, r.n_spans, r.kept_sha256))
    assert time.time() - began < 60
    empty = hashlib.sha256(b"").hexdigest()
    assert all(v == {(len(text), 1, empty)} for (i, n), v in got.items() if n == len(text))
    t = rows[-2][1]
    at = t.index(part)
    lo, hi = at, at + len(part)
    while t[lo - 1] == text[5000 - (at - lo) - 1]:
        lo -= 1
    while t[hi] == text[5600 + hi - at - len(part)]:
        hi += 1
    kept = hashlib.sha256((t[:lo] + t[hi:]).encode()).hexdigest()
    assert got[9000, len(t)] == {(hi - lo, 1, kept)}
    assert got[9001, 250] == {(0, 0, hashlib.sha256(rows[-1][1].encode()).hexdigest())}


@pytest.mark.parametrize("bound", [200_000, -1])
def test_copies_mark_other_texts_once(spark, monkeypatch, bound):
    """With and without broadcast lookups: the same rows as brute force over all strings."""
    monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", bound)
    rng = random.Random(2)
    length = 60
    base = [words(rng, 60, 40) for _ in range(12)]
    rows = [(i, base[i % 12]) for i in range(20)] + [(i, base[i % 12][: 40 + i]) for i in range(20, 40)]
    rows += [(i, words(rng, 8) + base[i % 5][70:170] + words(rng, 9)) for i in range(40, 60)]
    rows += [rows[3], rows[3], (None, base[1]), (None, base[11][10:200]), (61, None), (62, "")]
    seen = {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p:p + length], []).append((k, p))
    want = []
    for k, (i, t) in enumerate(rows):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if len(seen[b[p:p + length]]) > 1:
                mark[p:p + length] = True
        kept = bytes(c for c, m in zip(b, mark) if not m)
        spans = int((np.diff(np.concatenate([[False], mark]).astype(int)) == 1).sum())
        want.append((i, len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in suffix_dedup.repeated_passages(df, length).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_clashing_names_come_back_unchanged(spark):
    rng = random.Random(3)
    passage = words(rng, 120)
    rows = [(i, words(rng, 60) + " " + (passage if i % 3 == 0 else "") + f" end{i}") for i in range(9)]
    rows += [(20, rows[1][1]), (None, rows[1][1])]
    names = ["__rid", "__th", "__did", "__text", "__spans", "did", "TH", "whole", "spans", "rid", "th2", "rep"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, n in enumerate(names):
        df = df.withColumn(n, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")))
    for out, left in ((suffix_dedup.cut_passages(df), 11), (jaccard_join.keep_one(df, one_row=True), 9)):
        assert out.columns == df.columns
        got = out.collect()
        assert len(got) == left
        for r in got:
            i = -1 if r.doc_id is None else r.doc_id
            assert [r[n] for n in names] == [f"{k}:{i}" for k in range(len(names))]
    assert sorted(r.doc_id for r in got) == list(range(9))


# ------------------------------------------------------------------- join
def test_long_set(spark):
    """A document of 100,000 shingles, near copies of it and of short texts."""
    rng = random.Random(4)
    long = [f"w{rng.randrange(30_000)}" for _ in range(100_004)]
    near = long[:]
    for i in range(0, len(near), 100):
        near[i] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:60_000]))]
    for i in range(10, 60, 2):
        t = words(rng, 40 + i).split()
        u = t[:]
        u[rng.randrange(len(u))] = "other"
        rows += [(i, " ".join(t)), (i + 1, " ".join(u))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()}
    split = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in split.items()}
    for i, j in [(1, 2), (1, 3), (2, 3)] + [(i, i + 1) for i in range(10, 60, 2)]:
        linked = 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
        assert (got[i][0] == got[j][0]) == linked, (i, j)
    assert got[3][1] == 0


def test_short_sketches_are_a_bound():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 9000))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        drop = int(len(a) * 0.25 * rng.random())
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 62, max(0, len(a) // 9 - drop)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            x, y = (jaccard_join.short_sketch(jaccard_join.sketch(s)) for s in (a, b))
            assert len(x) <= jaccard_join.SHORT and jaccard_join.may_link(x, len(a), y, len(b))


# ------------------------------------------------------------- bounded samples
def test_an_id_of_very_many_rows_is_sampled_once(spark):
    """100,000 rows under one labelled id: what is learned and collected is one row of it."""
    rng = random.Random(6)
    base = spark.createDataFrame(
        [(i, words(rng, 60, 300) + (" vile scum idiot" if i % 3 == 0 else "")) for i in range(240)],
        "doc_id long, text string")
    hot = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"),
                                      F.concat(F.lit("tiny text "), F.col("id").cast("string")).alias("text"))
    docs = base.unionByName(hot).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(240)],
                                   "doc_id long, quality int, toxic int")
    ids = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, y int")
    x, y = quality_rules.sample_features(docs, ids)
    assert len(x) == len(y) == 100
    assert toxicity._picked(docs, [0, 1, 2], spark).count() == 3
    model = toxicity.learn_toxicity(docs, labels)
    assert model.logistic is not None
    langs = docs.withColumn("lang", F.lit("en")).unionByName(
        base.select((F.col("doc_id") + 1000).alias("doc_id"), F.lit("ça é là où").alias("text"), F.lit("fr").alias("lang")))
    one = lang_id.learn_languages(langs, per_lang=50)
    two = lang_id.learn_languages(langs.repartition(7), per_lang=50)
    assert one.langs == ["en", "fr"] and np.array_equal(one.bias, two.bias) and np.array_equal(one.table, two.table)


def test_one_id_two_texts_are_scored_apart(spark):
    rows = [(i, ("good plain words here " * 9) + str(i)) for i in range(60)] + \
        [(i, ("scum idiot vile " * 4) + str(i)) for i in range(60, 120)]
    rows += [(500, "scum idiot vile " * 4), (500, "good plain words here " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(120)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.learn_toxicity(docs, labels)
    got = [r.score for r in toxicity.score_toxicity(docs, model).where("doc_id = 500").collect()]
    alone = [model.score([t.encode()])[0] for _, t in rows[-2:]]
    assert sorted(got) == sorted(alone) and max(got) > 0.5 > min(got)
    stats = qc.document_statistics(docs).cache()
    quality = qc.learn_quality(stats, labels)
    got = [r.score for r in qc.score_quality(stats, quality).where("doc_id = 500").collect()]
    assert len(got) == 2 and max(got) > 0.5 > min(got)


# --------------------------------------------------------------- conversations
def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(7)
    turns = [(1, k, "user" if k % 2 else "assistant", words(rng, rng.randrange(9)) + "<|im_end|>") for k in range(3000)]
    turns += [(i, k, "assistant", f"x{i}") for i in range(2, 30) for k in range(3)] + [(None, 0, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # this little would be put together again
    spark.conf.set(setting, "false")
    try:
        formatted = cut_lineage(chat_format.format_conversations(df, BPE, block_chars=500))
    finally:
        spark.conf.unset(setting)
    spread = formatted.where("conv_id = 1").select(F.shiftright("block", 32).alias("task")).distinct().count()
    assert spread > 1
    spark.conf.set(setting, "false")
    try:
        got = {r.conv_id: r for r in chat_format.digest_conversations(
            chat_format.format_conversations(df, BPE, block_chars=500)).collect()}
    finally:
        spark.conf.unset(setting)
    assert len(got) == 30
    for conv in (1, 2, 29, None):
        mine = [(r or "", t or "") for c, _, r, t in sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])]
        r = got[conv]
        text = "".join(f"{a}\n{b}\n" for a, b in mine)
        loss = "".join(b for a, b in mine if a == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(mine), len(loss))
        assert r.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# ----------------------------------------------------------- nearest neighbours
def test_search_prunes_and_finds():
    """The stop leaves most rows of well separated data unverified, at a recall of 0.9 or more."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 48))[rng.integers(0, 400, 20_000)] * 1.5 + rng.normal(size=(20_000, 48)) * 0.7
    cells = ann.build_cells(x[:4000], 48, len(x))
    z = cells.project(x)
    tree, stop = ann.KdTree(z), ann.chi_square_quantile(ann.CONFIDENCE)
    ids, hit = np.arange(len(x)), 0
    for q in range(0, len(x), 200):
        got = {i for _, i in tree.nearest(x, ids, x[q], z[q], 11, stop)}
        hit += len(got & set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:11].tolist()))
    share = tree.verified / 100 / len(x)
    print("recall", hit / 1100, "verified", share)
    assert hit >= 0.9 * 1100 and share < 0.3


# ------------------------------------------------------------ plain references
def test_language_scores_by_loops():
    """op2: the mean of the subword rows, times weights, plus bias, softmax, in plain Python."""
    rng = np.random.default_rng(9)
    bits = lang_id.BUCKETS_LOG2
    emb, w, bias = rng.normal(size=(1 << bits, 3)), rng.normal(size=(3, 4)), rng.normal(size=4)
    for weights in (None, w):
        table = emb @ w if weights is None else emb
        model = lang_id.LangModel(["a", "b", "c", "d"], table, bias, 1.7, 0.0, weights)
        texts = [b"some words in here", "ça déjà".encode(), b"x", b"123 456", b""]
        lang, score = model.predict(texts)
        for t, name, s in zip(texts, lang, score):
            if not any(c.isalpha() for c in t.decode()):
                assert (name, s) == ("und", 0.0)
                continue
            mean = [0.0] * 3
            idx = lang_id.subwords(t).tolist()
            for i in idx:
                for k in range(3):
                    mean[k] += emb[i, k] / len(idx)
            z = [(sum(mean[k] * w[k, j] for k in range(3)) + bias[j]) / 1.7 for j in range(4)]
            p = [math.exp(v - max(z)) for v in z]
            best = max(range(4), key=lambda j: p[j])
            assert name == "abcd"[best] and math.isclose(s, p[best] / sum(p), rel_tol=1e-9)


def test_toxicity_savings_by_single_windows():
    """op4: bytes saved per window, each window compressed on its own."""
    ordinary, toxic = b"the quiet prose of every day goes on and on " * 30, b"vile scum idiot pathetic " * 20
    model = toxicity.ToxicModel(ordinary, toxic)
    text = b"the quiet prose of a vile scum idiot goes on and on, " * 6
    gain, counts = model.savings([text, b""])
    how = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_BTLAZY2, window_log=18, hash_log=17, chain_log=18, search_log=toxicity.SEARCH_LOG,
        min_match=toxicity.MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
    want = []
    for s, n in toxicity.window_spans(text):
        sizes = [len(zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT),
                                         compression_params=how).compress(text[s:s + n]))
                 for d in (ordinary, toxic + ordinary)]
        want.append(sizes[0] - sizes[1])
    assert counts.tolist() == [len(want), 0] and gain.tolist() == want and max(want) > 3


def test_quality_ridge_equals_dense_solution(spark):
    """op9: the ridge weights of partition-summed normal equations are those of one dense solve."""
    rng = random.Random(10)
    rows = [(i, words(rng, rng.randrange(3, 200), 50 + 400 * (i % 2))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    stats = qc.document_statistics(docs).cache()
    model = qc.learn_quality(stats, labels, n_fourier=12, ridge=0.5)
    fit = (qc.labelled(labels, "quality").join(stats, "doc_id")
           .where(qc.hash01("doc_id", 9) < 0.8).select("x", "y").collect())
    z = model.lift(np.array([r.x for r in fit]))
    y = np.array([float(r.y) for r in fit])
    n, d = z.shape
    dense = np.linalg.solve(z.T @ z + 0.5 * n / d * np.eye(d), z.T @ y)
    assert np.allclose(model.weights, dense, atol=1e-8)
