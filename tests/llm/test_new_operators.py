"""Hard negatives, sharding and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.llm import hard_negatives as HN, periodic_runs as PR, queries, sharding as SH

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------ hard negatives
def brute_negatives(rows):
    """rows: (id, vector, label), all taking part. Sorted (anchor, positive, rank, negative, scores)."""
    ints = [[math.floor(256 * float(x)) for x in v] for _, v, _ in rows]
    out = []
    for a, (aid, _, la) in enumerate(rows):
        if aid % 100:
            continue
        s = [sum(x * y for x, y in zip(ints[a], w)) for w in ints]
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-s[i], rows[i][0]))
        for p in [i for i in order if rows[i][2] == la][:5]:
            near = [i for i in order if rows[i][2] != la and 80 * s[p] <= 100 * s[i] <= 100 * s[p]][:5]
            out += [(aid, rows[p][0], k + 1, rows[i][0], s[p], s[i]) for k, i in enumerate(near)]
    return sorted(out)


def mined(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score)
                  for r in df.collect())


def test_op11_whole_table(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op11_hard_negatives(spark, SF)
    assert got.columns[:6] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                               "negative_score"]
    want = brute_negatives(rows)
    assert want and mined(got) == want


@pytest.mark.parametrize("width,scale", [(1, 0.3), (3, 40.0), (70, 1.0), (200, 9000.0)])
def test_residue_scores_are_exact(width, scale):
    rng = np.random.default_rng(width)
    a = np.floor(rng.normal(size=(17, width)) * 256 * scale).astype(np.int64)
    b = np.floor(rng.normal(size=(23, width)) * 256 * scale).astype(np.int64)
    top = 2 * int(max((a ** 2).sum(1).max(), (b ** 2).sum(1).max())) + 1
    primes = HN.primes_below(HN.top_prime(), top)
    got = HN.scores([HN.residues(a, p) for p in primes], [HN.residues(b, p) for p in primes], primes)
    assert (got == a @ b.T).all()
    extreme = np.array([[int((top // 2) ** 0.5)] + [0] * (width - 1)])
    got = HN.scores([HN.residues(extreme, p) for p in primes], [HN.residues(-extreme, p) for p in primes], primes)
    assert (got == -(extreme[0, 0] ** 2)).all()


def test_op11_scores_near_the_limit():
    primes = HN.primes_below(HN.top_prime(), 1 << 62)
    a = np.array([[(1 << 30) + 7, -5], [-(1 << 30), 3]])
    got = HN.scores([HN.residues(a, p) for p in primes], [HN.residues(a, p) for p in primes], primes)
    assert got.tolist() == [[int(sum(int(x) * int(y) for x, y in zip(u, v))) for v in a] for u in a]


def test_op11_cases(spark, monkeypatch):
    """Nulls, non-finite components, ties, repeated rows, mixed lengths; small blocks give the same."""
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, 1.0]) for _ in range(4)], rng.randrange(3)) for i in range(260)]
    rows += [(300, [1.0, 1.0], 0), (301, [1.0, 1.0, 0.0, 0.0, 2.0], 1), (400, [], 1)]
    bad = [(None, [1.0] * 4, 1), (500, None, 1), (600, [1.0] * 4, None), (700, [1.0, None, 1.0, 1.0], 1),
           (800, [float("nan")] * 4, 0), (900, [float("inf"), 1.0, 1.0, 1.0], 0)]
    schema = "vec_id long, embedding array<double>, label int"
    df = spark.createDataFrame(rows + bad + rows[:40], schema).withColumn("score", F.lit("x")).withColumn(
        "key", F.lit(1)).repartition(5)
    want = brute_negatives(rows)
    assert want and mined(HN.mine(df, F.col("id") % 100 == 0)) == want
    monkeypatch.setattr(HN, "ROWS", 50)
    monkeypatch.setattr(HN, "ANCHORS", 2)
    monkeypatch.setattr(HN, "TILE", 64)
    assert mined(HN.mine(df, F.col("id") % 100 == 0)) == want
    assert mined(HN.mine(df.limit(0), F.col("id") % 100 == 0)) == []


def test_op11_same_id_other_vector(spark):
    """Rows that share an id are rows of their own."""
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.9], 2)],
                               "vec_id long, embedding array<double>, label int")
    got = mined(HN.mine(df, F.col("id") % 100 == 0))
    one = 256 * 256
    assert got == [(0, 1, 1, 2, one, 256 * 230), (0, 1, 1, 2, one, one)]


def test_op11_too_large(spark):
    df = spark.createDataFrame([(0, [1e18], 1), (1, [1e18], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        HN.mine(df, F.col("id") % 100 == 0)


# ------------------------------------------------------------------ sharding
def check_shards(got, rows, shards):
    """got: (id, size, crc, shard, position); rows: (id, text)."""
    size = lambda t: len((t or "").encode()) + 8
    want = Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter(g[:3] for g in got) == want
    by = defaultdict(list)
    for g in got:
        by[g[3]].append(g)
    assert set(by) <= set(range(shards))
    for group in by.values():
        assert sorted(g[4] for g in group) == list(range(len(group)))
    loads = [sum(g[1] for g in by[k]) for k in range(shards)]
    return loads


def test_op12_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = queries.op12_sharding(spark, SF)
    assert df.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = df.collect()
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    loads = check_shards([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got], rows, 24)
    heaviest = max(len((t or "").encode()) + 8 for _, t in rows)
    mean = sum(loads) / 24
    assert max(loads) - mean <= heaviest and max(loads) <= 1.05 * mean
    # the same shards from another partitioning
    again = SH.shard_documents(docs.repartition(7), 24).collect()
    assert Counter((r.doc_id, r.shard) for r in again) == Counter((r.doc_id, r.shard) for r in got)


def test_op12_repeated_rows_spread(spark):
    """A third of all rows are one row; ids and texts are null; a helper's name is taken."""
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(90)) for i in range(1500)] + [(7, "same text")] * 1000 + [
        (None, f"t{i}") for i in range(200)] + [(i, None) for i in range(50)] + [(9000, "long " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    df = df.withColumn("virtual_slot", F.lit("a")).withColumn("size", F.lit(1.5)).withColumn("Row_No", F.lit(2))
    got = SH.shard_documents(df, 5, slots=64)
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.position) for r in got.collect()]
    loads = check_shards(got, rows, 5)
    mean = sum(loads) / 5
    assert max(loads) <= 1.1 * mean
    assert len({g[3] for g in got if g[0] == 7}) == 5  # the copies do not share a shard
    assert SH.shard_documents(df.limit(0), 5).collect() == []
    few = [(r.doc_id, r.size, r.text_crc32, r.shard, r.position)
           for r in SH.shard_documents(df.where("doc_id in (3, 4)"), 24).collect()]
    check_shards(few, [r for r in rows if r[0] in (3, 4)], 24)


def test_op12_map_versions(spark, tmp_path):
    rng = random.Random(1)
    path = str(tmp_path / "map")
    w1 = spark.createDataFrame([(s, 1, rng.randrange(1, 100)) for s in range(300)], "slot int, rows long, bytes long")
    SH.save_map(SH.first_map(w1, 6), path)
    # a shard more
    SH.save_map(SH.edit_map(SH.load_map(spark, path), w1, 7), path)
    one = {r.slot: (r.shard, r.bytes) for r in SH.load_map(spark, path, 1).collect()}
    two = {r.slot: (r.shard, r.bytes) for r in SH.load_map(spark, path).collect()}
    assert set(one) == set(two) and {s for s, _ in two.values()} == set(range(7))
    moved = {s for s in one if one[s][0] != two[s][0]}
    assert {two[s][0] for s in moved} == {6}
    loads = Counter()
    for shard, b in two.values():
        loads[shard] += b
    mean = sum(loads.values()) / 7
    assert max(loads.values()) <= mean + 100 and sum(one[s][1] for s in moved) <= mean
    # new weights, a new slot, and two shards given up; stored as version 3
    w3 = spark.createDataFrame([(s, 1, rng.randrange(1, 100)) for s in range(301)], "slot int, rows long, bytes long")
    SH.save_map(SH.edit_map(SH.load_map(spark, path), w3, 5), path)
    three = {r.slot: r.shard for r in SH.load_map(spark, path).collect()}
    assert len(three) == 301 and set(three.values()) == set(range(5))
    assert {r.version for r in spark.read.parquet(path).select("version").distinct().collect()} == {1, 2, 3}
    assert {r.slot: r.shard for r in SH.load_map(spark, path, 2).collect()} == {s: k for s, (k, _) in two.items()}


def test_op12_written_shards(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("mine"))
    wide, n = SH.with_slots(df, slots=32)
    heavy = SH.heavy_slots(wide, n, 4)
    m = SH.first_map(SH.slot_weights(SH.final_slots(wide, n, heavy), n), 4)
    SH.write_shards(df, m, heavy, str(tmp_path / "out"), slots=32)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.text, r.shard) for r in got) == sorted((i, t, "mine") for i, t in rows)
    assert {r._shard for r in got} == {0, 1, 2, 3}


# ------------------------------------------------------------- periodic runs
def brute_runs(s, least=12):
    """(start, length, period) by direct comparison of words q apart."""
    n, out = len(s), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and s[j] == s[j + q]:
                j += 1
            end = j + q
            smaller = any(all(s[k] == s[k + r] for k in range(i, end - r)) for r in range(1, q))
            if end - i >= max(least, 2 * q) and not smaller:
                out.append((i, end - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 3, 5, 20])
        s = [rng.randrange(k) for _ in range(n)]
        if n > 5 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            s[a:] = [s[a + (i - a) % p] for i in range(a, n)]
            if rng.random() < 0.5:
                s[rng.randrange(n)] = 99
        least = rng.choice([2, 3, 12, 12])
        assert PR.runs_of(np.array(s, np.int64), least) == brute_runs(s, least)


def rows_of(df):
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                          "collapsed_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_op13_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    # the direct comparison is quadratic in the words of a text
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) <= 600}
    got = rows_of(queries.op13_periodic_runs(spark, sf))
    assert len(got) == len(docs) and sum(r[1] for r in got) > 5
    assert [r for r in got if r[0] in short] == sorted(
        (brute_digest(i, t) for i, t in short.items()), key=repr)
    for r in got:  # longer ones: the longest run holds and cannot be extended
        if r[0] not in short and r[1]:
            text = next(d.text for d in docs if d.doc_id == r[0])
            w = WORD.findall(text)
            order = PR.tail_order(r[0], len(w))
            w = w if order is None else [w[k] for k in order]
            s, length, q = r[2:5]
            assert all(w[i] == w[i + q] for i in range(s, s + length - q))
            assert s == 0 or w[s - 1] != w[s - 1 + q]
            assert s + length == len(w) or w[s + length] != w[s + length - q]


def test_op13_cases(spark, docs_of, tmp_path):
    cycle = "a b c " * 10
    rows = [(1, cycle), (1, cycle), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, cycle), (None, None),
            (5, " x " * 14), (6, "w " * 11), (7, "w " * 12), (8, "p q r s t u " * 2 + "p"), (9, "é ü " * 400),
            *[(i, "k l m n o " * 5 + f"z{i} " + "a a b " * 8) for i in range(20, 60)]]
    docs = docs_of(rows).withColumn("runs", F.lit(3)).withColumn("collapsed", F.lit("no"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.op13_periodic_runs(spark, str(tmp_path)))
    assert got == sorted((brute_digest(i, t) for i, t in rows), key=repr)
    out = PR.periodic_runs(docs).where("doc_id = 7").first()
    assert [tuple(r) for r in out.runs] == [(0, 12, 1)] and bytes(out.collapsed) == b"w"
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op13_periodic_runs(spark, str(tmp_path / "none")).collect() == []


def test_op13_long_text():
    s = np.arange(120_000) % 5000
    s[60_000] = 7777
    assert PR.runs_of(s) == [(0, 60_000, 5000), (60_001, 59_999, 5000)]
