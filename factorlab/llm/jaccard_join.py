"""N-gram Jaccard join: a size-aware heavy-light set similarity join.

A document's set holds the 64-bit hashes of its distinct ``k``-word shingles.
Documents with equal sets form a class; classes are what is joined.

Every linked pair of different classes with sizes a and b shares at least
ceil(num * max(a, b) / den) elements. Under one global order of the elements (rare
ones first), two such sets share an element among the first
n - ceil(num * n / den) + 1 of each, and c elements when c - 1 more are taken.

* Light sets (size <= x) enumerate the 2-subsets of that longer prefix; two
  light sets meet in the list of a shared subset.
* Heavy sets enter the inverted lists of their prefix elements, as do light
  sets that may reach a heavy one (size >= num * (x + 1) / den).
* ``boundary`` chooses x: the least total of subsets written against list
  entries written and scanned, from the sizes of all classes.

The order puts elements that many documents share (found by counting inside
each task and adding up) last, so common passages start no lists.

Candidates of a list are first its smallest class with every other member;
verified links are contracted to components, and then only members of different
components in the same list are compared, so a group of copies costs links in
proportion to its size, and no link between different texts is lost.
A candidate pair is dropped when the parity sketches of its sets differ in more
bits than linked sets can differ in elements (an exact bound: each element flips
one bit); what is left is verified on the whole texts.

Links are counted inside the finished components: blocks of classes meet in groups that
intersect their whole sets, so every link counts and none becomes a row.

Defined cases: null texts and texts without a word have the empty set and link
with nothing; fewer than ``k`` words are one element, the whole sequence; rows
without doc_id link like others but get a null component; equal rows fall into
one class and are linked; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_lineage_observed, drop_table, table_path
from .common import chunks, free_name, mix64, release, text_key, texts_of, tidy, utf8
from .components import connected_components
from .textstats import Words, grams

WORDS = 5
NUM, DEN = 75, 100  # similarity of at least NUM / DEN
COUNT_BYTES = 8 << 20  # text per counting unit
COMMON_LEAST = 3  # documents of a unit that make an element worth counting
LIST_ROWS = 2048  # members of a list that are compared in one group
COMMON_MAX = 1 << 16  # elements kept by the order, the most frequent
MAX_LIGHT = 64
GROUP_ELEMENTS = 1 << 20  # elements of a component's classes in one block
BLOCK_ROWS, BLOCK_ELEMENTS = 128, 1 << 16  # classes and elements intersected at once (one class at least)
BROADCAST_IDS = 200_000  # rows of two keys and 16 bytes (some 20 MB as a lookup); beyond it a shuffle join
SHORT = 512  # bytes of a sketch that goes with every entry of a list
OWN_LISTS = 256  # lists of a class that go with each of its entries
SAMPLED = 4096  # one element in so many tells the mean length of a list
_NO_ID = (1 << 63) - 1  # stands for a null doc_id, after all others
_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct element hashes of every text."""
    w = Words(texts, lower=True)
    h = w.hashes()
    at, g = grams(h, w.doc, k)
    first = np.searchsorted(w.doc[at], np.arange(w.n + 1))
    out = []
    for d in range(w.n):
        n = w.first[d + 1] - w.first[d]
        if n >= k:
            out.append(np.unique(g[first[d]:first[d + 1]]))
        elif n:
            _, one = grams(h[w.first[d]:w.first[d + 1]], np.zeros(n, np.int64), n)
            out.append(mix64(one + np.full(1, n, np.uint64) * _SALT))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    h = [mix64(s ^ c).sum(dtype=np.uint64) for c in (_SALT, np.uint64(0xE7037ED1A0B428DB))]
    return tuple(int(x) for x in mix64(np.array(h, np.uint64)).view(np.int64))


def least_overlap(n: int) -> int:
    return -(-NUM * n // DEN)


def prefix_length(n: int, c: int = 1) -> int:
    return min(n, n - least_overlap(n) + c)


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set: element e flips bit e mod B, B the power of two from 2 n up."""
    bits = max(64, 2 << max(0, len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(9)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int) -> bool:
    """False only if the sets cannot be linked: the sketches differ in more bits than the
    symmetric difference of linked sets has elements."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # parities of half as many bits: the halves added
        if len(x) > len(y):
            x = x.reshape(2, -1)[0] ^ x.reshape(2, -1)[1]
        else:
            y = y.reshape(2, -1)[0] ^ y.reshape(2, -1)[1]
    differ = int(np.bitwise_count(x ^ y).sum())
    return differ * (NUM + DEN) <= (DEN - NUM) * (n + m)


def short_sketch(x: bytes, least: int = SHORT) -> bytes:
    """Parities of fewer bits: the halves added until at most ``least`` bytes (8 at least) are left."""
    v = np.frombuffer(x, np.uint8)
    while len(v) > max(8, least):
        v = v.reshape(2, -1)[0] ^ v.reshape(2, -1)[1]
    return v.tobytes()


def light_sketch(x: bytes, n: int) -> bytes:
    """The fewest bits that still tell unrelated sets apart: from 3/4 n up (they differ in about half of
    them, linked sets in 2/7 n at most)."""
    return short_sketch(x, 1 << max(0, -(-3 * n // 32) - 1).bit_length())


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    """Parities (rows of 64-bit words) of fewer bits: halves added until ``words`` are left."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def close_pairs(sketches: list[bytes], n: np.ndarray, comp: np.ndarray, side: np.ndarray | None = None):
    """(i, j) of all members of different components (and sides, if given) that may be linked."""
    words = np.array([len(x) // 8 for x in sketches])
    stacks = {w: np.frombuffer(b"".join(x for x, k in zip(sketches, words) if k == w), np.uint64)
              .reshape(-1, w) for w in np.unique(words)}
    place = {w: np.flatnonzero(words == w) for w in stacks}
    out = []
    for wa, a in stacks.items():
        for wb, b in stacks.items():
            if wb < wa:
                continue
            b = _fold(b, wa)
            pa_, pb = place[wa], place[wb]
            for k, i in enumerate(pa_):
                lo = k + 1 if wa == wb else 0
                j = pb[lo:]
                total = n[i] + n[j]
                ok = (comp[j] != comp[i]) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
                if side is not None:
                    ok &= side[j] != side[i]
                at = np.flatnonzero(ok)
                if len(at):
                    differ = np.bitwise_count(b[lo:][at] ^ a[k]).sum(1, dtype=np.int64)
                    at = at[differ * (NUM + DEN) <= (DEN - NUM) * total[at]]
                    out += [(int(i), int(x)) for x in j[at]]
    return out


def _rid():
    return F.coalesce("doc_id", F.lit(_NO_ID))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key("text").alias("th"))


def scan_sets(docs: DataFrame) -> DataFrame:
    """One pass over the texts: rows (doc_id, th, n, h1, h2, sketch), kind 0; elements that several
    documents of a counting unit share (token, cnt), kind 1; and every occurrence of one element in
    ``SAMPLED`` (token, cnt), kind 2."""
    def run(batches):
        seen: set = set()
        pool, size = [], 0

        def common():
            t, c = np.unique(np.concatenate(pool), return_counts=True)
            some = (t % np.uint64(SAMPLED)) == 0
            often = c >= COMMON_LEAST
            kind = np.concatenate([np.ones(int(often.sum()), np.int32), np.full(int(some.sum()), 2, np.int32)])
            t, c = np.concatenate([t[often], t[some]]), np.concatenate([c[often], c[some]])
            none = pa.nulls(len(t), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(kind), none, pa.nulls(len(t), pa.binary()), none, none, none,
                 pa.nulls(len(t), pa.binary()), pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], names)

        names = ["kind", "doc_id", "th", "n", "h1", "h2", "sketch", "token", "cnt"]
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            for i, j in chunks(off):
                sets = shingle_sets(texts_of(data, off, i, j))
                keys = [set_key(s) for s in sets]
                for s, key in zip(sets, keys):
                    if len(s) and key not in seen:
                        seen.add(key)
                        pool.append(s)
                size += int(off[j] - off[i])
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(j - i, np.int32)), b.column("doc_id").slice(i, j - i),
                     b.column("th").slice(i, j - i).cast(pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64()),
                     pa.array([sketch(x) for x in sets], pa.binary()), none, none], names)
                if size >= COUNT_BYTES and pool:
                    yield common()
                    pool, size = [], 0
        if pool:
            yield common()

    return docs.select("doc_id", "text", "th").mapInArrow(
        tidy(run), "kind int, doc_id long, th binary, n long, h1 long, h2 long, sketch binary, token long, cnt long")


def boundary(sizes: dict[int, int], scan: float) -> int:
    """The size up to which sets are light: least rows written and scanned.

    ``sizes``: classes by set size; ``scan``: mean entries of an inverted list.
    """
    best = None
    for x in range(0, MAX_LIGHT + 1):
        cost = 0.0
        for n, count in sizes.items():
            p = prefix_length(n, 2)
            if n <= x:
                cost += count * p * (p - 1) / 2
            if n > x or DEN * n >= NUM * (x + 1):
                cost += count * prefix_length(n) * scan
        if best is None or cost < best[0]:
            best = (cost, x)
    return best[1]


def mean_list(sampled: DataFrame, common: np.ndarray) -> float:
    """Mean number of entries in the list that an entry lies in, over the sampled elements; the
    common ones start no lists while a set has others."""
    far = F.array_contains(F.lit(common.view(np.int64)[common % np.uint64(SAMPLED) == 0].tolist())
                           .cast("array<bigint>"), F.col("token"))
    each = sampled.groupBy("token").agg(F.sum("cnt").cast("double").alias("c")).where(~far)
    got = each.agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("m")).first()["m"]
    return max(1.0, got or 1.0)


def signatures(s: np.ndarray, rank: np.ndarray, x: int) -> np.ndarray:
    """List keys of one set: prefix elements (heavy) and / or 2-subsets of the prefix (light)."""
    n = len(s)
    order = np.argsort((rank.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
    out = []
    if n > x or DEN * n >= NUM * (x + 1):
        out.append(s[order[:prefix_length(n)]])
    if n <= x:
        p = np.sort(s[order[:prefix_length(n, 2)]])
        i, j = np.triu_indices(len(p), 1)
        out.append(mix64(mix64(p[i] + _SALT) + p[j]))
    return np.concatenate(out)


def postings(docs: DataFrame, common: np.ndarray, common_rank: np.ndarray, x: int) -> DataFrame:
    """(token, cls, n): the list entries of every class (once per task that meets it)."""
    def run(batches):
        seen: set = set()
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            for i, j in chunks(off):
                toks, cls, ns = [], [], []
                for s in shingle_sets(texts_of(data, off, i, j)):
                    if not len(s):
                        continue
                    key = set_key(s)
                    if key in seen:
                        continue
                    seen.add(key)
                    rank = np.zeros(len(s), np.uint8)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        rank = np.where(common[at] == s, common_rank[at], 0).astype(np.uint8)
                    t = signatures(s, rank, x)
                    toks.append(t)
                    cls.append(np.full(len(t), key[0], np.int64))
                    ns.append(np.full(len(t), len(s), np.int32))
                if toks:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(cls)),
                         pa.array(np.concatenate(ns))], ["token", "cls", "n"])

    return docs.select("text").mapInArrow(tidy(run), "token long, cls long, n int")


def lists(entries: DataFrame) -> DataFrame:
    """Rows of kind 0: candidate links (cls, n) - (cls2, n2) of each list's first member with
    the others; kind 1: the entries of lists with three members or more.

    A task streams its lists in order and keeps two entries of the open one.
    """
    names = ["kind", "token", "cls", "n", "cls2", "n2"]

    def run(batches):
        held = None  # (token, cls, n) arrays of the open list while it has at most two entries
        open_list = None  # (token, first cls, first n, last cls, last n) once it has three
        sent: set = set()

        def emit(kind, t, c, n, c2, n2):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(t), kind, np.int32)), pa.array(t), pa.array(c), pa.array(n),
                 pa.array(c2), pa.array(n2)], names)

        def entries_of(t, c, n):
            return emit(1, t, c, n, np.zeros(len(c), np.int64), np.zeros(len(c), np.int32))

        def edges(c, n, c2, n2):
            ok = (c != c2) | (n != n2)
            ok &= DEN * np.minimum(n, n2).astype(np.int64) >= NUM * np.maximum(n, n2).astype(np.int64)
            pairs = list(dict.fromkeys(zip(c[ok].tolist(), n[ok].tolist(), c2[ok].tolist(), n2[ok].tolist())))
            new = [p for p in pairs if p not in sent]
            if len(sent) > 200_000:
                sent.clear()  # only saves rows: duplicates are removed later as well
            sent.update(new)
            if new:
                a = np.array(new, np.int64)
                return emit(0, np.zeros(len(a), np.int64), a[:, 0], a[:, 1].astype(np.int32),
                            a[:, 2], a[:, 3].astype(np.int32))
            return None

        for b in batches:
            t, c, n = (np.asarray(b.column(k)) for k in ("token", "cls", "n"))
            if not len(t):
                continue
            if open_list is not None:
                tok, fc, fn, lc, ln = open_list
                k = int(np.searchsorted(t, tok, "right"))  # rows that go on with the open list
                if k:
                    cc, nn = c[:k], n[:k]
                    new = np.ones(k, bool)
                    new[1:] = (cc[1:] != cc[:-1]) | (nn[1:] != nn[:-1])
                    new[0] = (cc[0] != lc) or (nn[0] != ln)
                    cc, nn = cc[new], nn[new]
                    e = edges(np.full(len(cc), fc), np.full(len(cc), fn, np.int32), cc, nn)
                    if e is not None:
                        yield e
                    if len(cc):
                        yield entries_of(np.full(len(cc), tok), cc, nn)
                        open_list = (tok, fc, fn, cc[-1], nn[-1])
                if k == len(t):
                    continue
                open_list, t, c, n = None, t[k:], c[k:], n[k:]
            if held is not None:
                t, c, n = (np.concatenate([x, y]) for x, y in zip(held, (t, c, n)))
                held = None
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
            t, c, n = t[new], c[new], n[new]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            size = np.diff(np.concatenate([start, [len(t)]]))
            head = np.repeat(start, size)
            last = int(start[-1])
            if size[-1] <= 2:
                held = (t[last:], c[last:], n[last:])
                use = np.arange(len(t)) < last
            else:
                open_list = (t[last], c[last], n[last], c[-1], n[-1])
                use = np.ones(len(t), bool)
            follow = use & (np.arange(len(t)) != head)
            if follow.any():
                e = edges(c[head[follow]], n[head[follow]], c[follow], n[follow])
                if e is not None:
                    yield e
            big = use & (np.repeat(size, size) >= 3)
            if big.any():
                yield entries_of(t[big], c[big], n[big])
        if held is not None and len(held[0]) == 2:
            e = edges(*[v[:1] for v in held[1:]], *[v[1:] for v in held[1:]])
            if e is not None:
                yield e

    ordered = entries.repartition("token").sortWithinPartitions("token", "cls", "n")
    return ordered.mapInArrow(tidy(run), "kind int, token long, cls long, n int, cls2 long, n2 int")


def _wanted(pairs: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(cls, n, rep, th) of the classes on a pair, written; as a side to join the documents
    with by ``rep`` and ``th`` (broadcast behind a check of its size); and their number."""
    ends = pairs.select("cls", "n").unionByName(pairs.select(F.col("cls2").alias("cls"), F.col("n2").alias("n")))
    wanted, got = cut_lineage_observed(ends.distinct().join(reps, ["cls", "n"]).select("cls", "n", "rep", "th"),
                                       [F.count(F.lit(1)).alias("m")])
    return wanted, F.broadcast(wanted) if got["m"] <= BROADCAST_IDS else wanted, got["m"]


def _sketches(rows: DataFrame, side: DataFrame, fold=None) -> DataFrame:
    """(cls, n, sketch) of the classes of ``side``; ``fold``: function of (sketch, n) that shortens it."""
    out = (rows.select(_rid().alias("rep"), "th", F.col("h1").alias("cls"), F.col("n").cast("int").alias("n"), "sketch")
           .join(side, ["rep", "th", "cls", "n"]).dropDuplicates(["cls", "n"]).select("cls", "n", "sketch"))
    if fold is None:
        return out

    def run(batches):
        for b in batches:
            made = [fold(x, n) for x, n in zip(b.column("sketch").to_pylist(), b.column("n").to_pylist())]
            yield b.set_column(2, "sketch", pa.array(made, pa.binary()))

    return out.mapInArrow(tidy(run), "cls long, n int, sketch binary")


def _at_most_short(x: bytes, n: int) -> bytes:
    return short_sketch(x)


def _class_texts(docs: DataFrame, side: DataFrame, count: int) -> DataFrame:
    """The columns of ``side`` (one row a class) with the class's text, written."""
    texts, got = cut_lineage_observed(docs.select(_rid().alias("rep"), "th", "text").join(side, ["rep", "th"]),
                                      [F.count(F.lit(1)).alias("m")])
    if got["m"] <= count:
        return texts
    once = cut_lineage(texts.dropDuplicates(["cls", "n"]))  # rows that repeat under one id
    drop_table(docs.sparkSession, table_path(texts))
    return once


def _both_ends(pairs: DataFrame, ends: DataFrame, col: str) -> DataFrame:
    """Pairs with ``col`` of both classes."""
    second = ends.select(F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col(col).alias(col + "2"))
    return (pairs.join(second, ["cls2", "n2"]).join(ends.select("cls", "n", col), ["cls", "n"])
            .select("cls", "n", col, "cls2", "n2", col + "2"))


def _may_link(pairs: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """The candidate pairs that the sketches do not rule out: light ones for all pairs, the whole
    ones for those that are left."""
    spark = rows.sparkSession

    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("sketch", "n", "sketch2", "n2")]
            yield b.select(["cls", "n", "cls2", "n2"]).filter(
                pa.array([may_link(*r) for r in zip(*cols)], pa.bool_()))

    for fold in (light_sketch, None):
        wanted, side, _ = _wanted(pairs, reps)
        left = cut_lineage(_both_ends(pairs, _sketches(rows, side, fold), "sketch").mapInArrow(
            tidy(run), "cls long, n int, cls2 long, n2 int"))
        drop_table(spark, table_path(wanted))
        if fold is None:
            drop_table(spark, table_path(pairs))
        release(spark)  # the shuffle files of this pass
        pairs = left
    return pairs


def _list_pairs(entries: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of members of one list in different components that the sketches do not rule out.

    ``entries``: (token, nb, cls, n, comp), ``nb`` the blocks of the list: a list of more than
    ``LIST_ROWS`` members is cut into blocks by hash, and every two blocks meet in a group of
    their own. ``sketches``: (cls, n, sketch), at most ``SHORT`` bytes each. A pair that shares several
    lists is a row of the smallest only, as far as the ``OWN_LISTS`` smallest lists of both tell; later ones
    may give it again.
    """
    # numbered by a window that keeps OWN_LISTS rows a class
    order = Window.partitionBy("cls", "n").orderBy("token")
    own = (entries.select("cls", "n", "token").withColumn("k", F.row_number().over(order))
           .where(F.col("k") <= OWN_LISTS).groupBy("cls", "n").agg(F.sort_array(F.collect_list("token")).alias("lists")))
    rows = (entries.join(sketches.join(own, ["cls", "n"]), ["cls", "n"])
            .withColumn("b", F.pmod(F.xxhash64("cls", "n"), F.col("nb")).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("token", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi"), "b",
                    "cls", "n", "comp", "sketch", "lists"))

    def run(batches):
        key, group = None, []

        def flush():
            side, cls, n, comp, sketches, lists = zip(*group)
            n, comp = np.array(n, np.int64), np.array(comp)
            if (comp == comp[0]).all():
                return None
            known = [set(x) for x in lists]
            whole = [x[-1] if len(x) == OWN_LISTS else 1 << 63 for x in lists]  # told up to here
            out = []
            for i, j in close_pairs(list(sketches), n, comp, np.array(side) if key[1] != key[2] else None):
                shared = known[i] & known[j]
                if min(shared, default=1 << 63) < min(key[0], whole[i] + 1, whole[j] + 1):
                    continue  # a row of that list
                a, b = sorted(((cls[i], int(n[i])), (cls[j], int(n[j]))))
                out.append((*a, *b))
            if not out:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int32()))],
                ["cls", "n", "cls2", "n2"])

        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in
                           ("token", "lo", "hi", "b", "cls", "n", "comp", "sketch", "lists")]):
                if r[:3] != key:
                    got = flush() if group else None
                    if got is not None:
                        yield got
                    key, group = r[:3], []
                group.append(r[3:])
        got = flush() if group else None
        if got is not None:
            yield got

    pairs = (rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
             .mapInArrow(tidy(run), "cls long, n int, cls2 long, n2 int"))
    return pairs.distinct()  # a pair may share several lists


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v) class keys of the candidate pairs that are links, checked on whole texts.

    ``reps``: (cls, n, rep, th), id and text key of one row of the class. Only texts of
    classes on a pair are gathered, one for each class.
    """
    wanted, side, count = _wanted(pairs, reps)
    texts = _class_texts(docs, side, count)

    def check(batches):
        known: dict = {}

        def sets_of(cls, text):
            missing = {k: x for k, x in zip(cls, text) if k not in known}
            if len(known) + len(missing) > 1024:
                known.clear()
                missing = dict(zip(cls, text))
            keys = list(missing)
            raw = [missing[k].encode() for k in keys]
            off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            for i, j in chunks(off):
                known.update(zip(keys[i:j], shingle_sets(raw[i:j])))
            return [known[k] for k in cls]

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256).to_pydict()
                a = sets_of([("a", c, n) for c, n in zip(part["cls"], part["n"])], part["text"])
                z = sets_of([("b", c, n) for c, n in zip(part["cls2"], part["n2"])], part["text2"])
                u, v = [], []
                for x, y, p, q in zip(a, z, part["cls"], part["cls2"]):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if DEN * both >= NUM * (len(x) + len(y) - both):
                        u.append(p)
                        v.append(q)
                if u:
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())],
                                                     ["u", "v"])

    out = cut_lineage(_both_ends(pairs, texts, "text").mapInArrow(tidy(check), "u long, v long").distinct())
    for t in (wanted, texts):
        drop_table(docs.sparkSession, table_path(t))
    release(docs.sparkSession)
    return out


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, th, n, h1, h2, sketch) of all documents; (h1, h2, n, size, best) of all classes,
    ``size`` their rows and ``best`` the smallest (id, text key) of the component; and
    (cls, n, rep, th, size, component) of the classes with links."""
    spark = docs.sparkSession
    docs = _keyed(docs)
    scan = cut_lineage(scan_sets(docs), partition_by=["kind"])
    rows = scan.where("kind = 0").select("doc_id", "th", "n", "h1", "h2", "sketch")
    classes = cut_lineage(rows.where("n > 0").groupBy("h1", "h2", "n")
                          .agg(F.min(F.struct(_rid().alias("rep"), "th")).alias("one"), F.count(F.lit(1)).alias("size")))
    reps = cut_lineage(classes.groupBy(F.col("h1").alias("cls"), F.col("n").cast("int").alias("n"))
                       .agg(F.min("one").alias("one"), F.sum("size").alias("size")).select("cls", "n", "one.*", "size"))

    top = (scan.where("kind = 1").groupBy("token").agg(F.sum("cnt").alias("cnt"))
           .orderBy(F.desc("cnt"), "token").limit(COMMON_MAX).toArrow())
    tok = top.column("token").to_numpy().astype(np.int64).view(np.uint64)
    cnt = top.column("cnt").to_numpy().astype(np.int64)
    order = np.argsort(tok)
    common = tok[order]
    common_rank = np.minimum(np.log2(np.maximum(cnt, 1)).astype(np.int64), 200).astype(np.uint8)[order]
    sizes = {int(r["n"]): int(r["count"]) for r in
             classes.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").count().collect()}
    x = boundary(sizes, mean_list(scan.where("kind = 2"), common))

    found = cut_lineage(lists(postings(docs, common, common_rank, x)), partition_by=["kind"])
    low = F.struct("cls", "n")
    high = F.struct(F.col("cls2").alias("cls"), F.col("n2").alias("n"))
    pair = [F.least(low, high).alias("a"), F.greatest(low, high).alias("b")]
    flat = [F.col("a.cls").alias("cls"), F.col("a.n").alias("n"), F.col("b.cls").alias("cls2"),
            F.col("b.n").alias("n2")]
    first = cut_lineage(found.where("kind = 0").select(*pair).distinct().select(*flat))
    release(spark)
    links = verify(_may_link(first, rows, reps), docs, reps)
    comp = connected_components(links)

    # members of different components in one list, not compared yet
    entries = found.where("kind = 1").select("token", "cls", "n")
    linked, got = cut_lineage_observed(
        reps.join(comp.withColumnRenamed("id", "cls"), "cls").select("cls", "n", "component"),
        [F.count(F.lit(1)).alias("m")])
    if got["m"] <= BROADCAST_IDS:
        linked = F.broadcast(linked)
    # a class without links is a component of its own, told apart by its key
    own = F.struct(F.coalesce("component", F.lit(-1)).alias("c"),
                   F.when(F.col("component").isNull(), F.col("cls")).alias("cls"),
                   F.when(F.col("component").isNull(), F.col("n")).alias("n"))
    entries = cut_lineage(entries.join(linked, ["cls", "n"], "left")
                          .select("token", "cls", "n", F.xxhash64(own).alias("comp")))
    # Lists with members of one component only have nothing to add, and of lists with
    # the same members one is enough.
    member = [F.bit_xor(F.xxhash64(F.lit(seed), "cls", "n")).alias(f"m{seed}") for seed in (1, 2)]
    mixed = (entries.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                          F.count(F.lit(1)).alias("size"), *member)
             .where("lo < hi").groupBy("m1", "m2", "size").agg(F.min("token").alias("token"))
             .select("token", F.ceil(F.col("size") / F.lit(LIST_ROWS)).cast("int").alias("nb")))
    entries, got = cut_lineage_observed(entries.join(mixed, "token").select("token", "nb", "cls", "n", "comp"),
                                        [F.count(F.lit(1)).alias("m")])
    rest = entries
    if got["m"]:
        members, side, _ = _wanted(entries.select("cls", "n", F.col("cls").alias("cls2"), F.col("n").alias("n2")), reps)
        rest = cut_lineage(_list_pairs(entries, _sketches(rows, side, _at_most_short))
                           .join(first, ["cls", "n", "cls2", "n2"], "left_anti"))
        links = links.unionByName(verify(rest, docs, reps))
        comp = connected_components(links)
        drop_table(spark, table_path(members))
        drop_table(spark, table_path(entries))
    for t in (found, rest, first):
        drop_table(spark, table_path(t))
    release(spark)

    grouped = cut_lineage(reps.join(comp.withColumnRenamed("id", "cls"), "cls"))
    low = grouped.groupBy("component").agg(F.min(F.struct("rep", "th")).alias("low"))
    best = grouped.join(low, "component").select(F.col("cls").alias("h1"), F.col("n").cast("long").alias("n"), "low")
    named = (classes.join(best, ["h1", "n"], "left")
             .select("h1", "h2", "n", "size", F.coalesce("low", "one").alias("best")))
    return rows, named, grouped


def link_counts(sets: list[np.ndarray], size: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """For every set the sizes of the sets linked with it (of the other side, if given), added up."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, size = n[order], np.asarray(size, np.int64)[order]
    side = None if side is None else np.asarray(side)[order]
    start = np.concatenate([[0], np.cumsum(n)])
    _, ids, cnt = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    shared = cnt[ids] > 1  # elements of one set only are in no intersection
    place = np.full(len(cnt), -1, np.int64)
    cuts = [0]
    while cuts[-1] < len(n):
        i = cuts[-1]
        j = int(np.searchsorted(start, start[i] + BLOCK_ELEMENTS, "right")) - 1
        cuts.append(min(max(j, i + 1), i + BLOCK_ROWS, len(n)))
    blocks = list(zip(cuts, cuts[1:]))
    total = np.zeros(len(n), np.int64)

    def dense(i, j, width):
        part = slice(start[i], start[j])
        row, at = np.repeat(np.arange(j - i), n[i:j]), place[ids[part]]
        out = np.zeros((j - i, width), np.float32)
        out[row[at >= 0], at[at >= 0]] = 1
        return out

    for k, (i, j) in enumerate(blocks):
        mine = ids[start[i]:start[j]]
        mine = np.unique(mine[shared[start[i]:start[j]]])
        if not len(mine):
            continue
        place[mine] = np.arange(len(mine))
        x = dense(i, j, len(mine))
        for a, b in blocks[k:]:
            if DEN * n[j - 1] < NUM * n[a]:
                break  # all further sets are too large
            both = (x if a == i else dense(a, b, len(mine))) @ x.T
            either = n[a:b, None] + n[None, i:j] - both.astype(np.int64)
            ok = DEN * both.astype(np.int64) >= NUM * either
            if side is not None:
                ok &= side[a:b, None] != side[None, i:j]
            if a == i:
                np.fill_diagonal(ok, False)
            total[a:b] += ok @ size[i:j]
            if a != i:
                total[i:j] += size[a:b] @ ok
        place[mine] = -1
    out = np.empty_like(total)
    out[order] = total
    return out


def count_links(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """(cls, n, links): the rows of other classes linked with a row of each class with links.

    Two classes alone in a component are linked. The classes of a larger component are cut into
    blocks by hash, and every two blocks meet in a group of their own with their whole texts.
    """
    all_of = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("all"),
                                              F.sum(F.col("n").cast("long")).alias("elements"))
    grouped = grouped.join(all_of, "component")
    pairs = grouped.where("m = 2").select("cls", "n", (F.col("all") - F.col("size")).alias("links"))
    nb = F.ceil(F.greatest(F.col("m") / F.lit(LIST_ROWS), F.col("elements") / F.lit(GROUP_ELEMENTS))).cast("int")
    side, got = cut_lineage_observed(grouped.where("m > 2").select("cls", "n", "rep", "th", "size", "component",
                                                                   nb.alias("nb")), [F.count(F.lit(1)).alias("m")])
    if not got["m"]:
        return pairs
    texts = _class_texts(docs, F.broadcast(side) if got["m"] <= BROADCAST_IDS else side, got["m"])
    rows = (texts.withColumn("b", F.pmod(F.xxhash64("cls", "n"), F.col("nb")).cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("component", F.least("b", "j").alias("lo"), F.greatest("b", "j").alias("hi"), "b",
                    "cls", "n", "size", "text"))

    def run(batches):
        key, group = None, []

        def flush():
            b, cls, n, size, sets = zip(*group)
            links = link_counts(list(sets), np.array(size), np.array(b) if key[1] != key[2] else None)
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(links)],
                                              ["cls", "n", "links"])

        for batch in batches:
            data, off, _ = utf8(batch.column("text"))
            cols = [batch.column(c).to_pylist() for c in ("component", "lo", "hi", "b", "cls", "n", "size")]
            for i, j in chunks(off):
                for *r, s in zip(*[c[i:j] for c in cols], shingle_sets(texts_of(data, off, i, j))):
                    if tuple(r[:3]) != key:
                        if group:
                            yield flush()
                        key, group = tuple(r[:3]), []
                    group.append((*r[3:], s))
        if group:
            yield flush()

    counted = cut_lineage(rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
                          .mapInArrow(tidy(run), "cls long, n int, links long"))
    for t in (side, texts):
        drop_table(docs.sparkSession, table_path(t))
    release(docs.sparkSession)
    return pairs.unionByName(counted.groupBy("cls", "n").agg(F.sum("links").alias("links")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): one row per document.

    ``n_links`` counts the other rows that are linked with the row, those of equal sets included.
    """
    rows, named, grouped = _groups(docs)
    links = count_links(_keyed(docs), grouped).select(F.col("cls").alias("h1"), F.col("n").cast("long").alias("n"), "links")
    named = named.join(links, ["h1", "n"], "left").select(
        "h1", "h2", "n", "best", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return (rows.drop("sketch", "th").join(named, ["h1", "h2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("best.rep", "doc_id"))
                    .alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, one_row: bool = False) -> DataFrame:
    """Of each component the document with the smallest id stays (and every document without
    a component). Different texts of one id are judged apart.

    ``one_row``, the pipeline's form: exactly one row of each component stays, so rows that
    repeat and rows without doc_id (after all others) are copies too. Otherwise rows that
    share an id are one document and rows without doc_id stay. All columns of ``docs`` come back
    as they are, whatever their names.
    """
    rows, named, _ = _groups(docs)
    judged = rows.where("n > 0").join(named, ["h1", "h2", "n"]).select("doc_id", _rid().alias("rid"), "th", "best")
    first = F.col("rid") == F.col("best.rep")
    if one_row:
        first &= F.col("th") == F.col("best.th")
    gone = judged.where(~first) if one_row else judged.where(~first & F.col("doc_id").isNotNull())
    rid, th = free_name(docs.columns, "rid"), free_name(docs.columns, "th")
    keyed = docs.withColumn(rid, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))) \
        .withColumn(th, text_key("text"))

    def side(keys):
        keys = keys.select(F.col("rid").alias(rid), F.col("th").alias(th))
        keys, got = cut_lineage_observed(keys, [F.count(F.lit(1)).alias("m")])
        return (F.broadcast(keys) if got["m"] <= BROADCAST_IDS else keys), got["m"]

    dropped, _ = side(gone.select("rid", "th").distinct())
    kept = keyed.join(dropped, [rid, th], "left_anti")
    if one_row:
        repeats, m = side(judged.where(first).groupBy("rid", "th").count().where("count > 1"))
        if m:
            kept = kept.join(repeats, [rid, th], "left_anti").unionByName(
                kept.join(repeats, [rid, th], "left_semi").dropDuplicates([rid, th]))
    return kept.select(*[f"`{c}`" for c in docs.columns])
