"""Repeated passages by a run-length suffix index.

A byte goes if it lies in a string of ``length`` bytes that also starts
somewhere else in the table. The work is dealt by content and indexed locally:

1. *Anchors.* Every string of ``length`` bytes has an anchor, the smallest hash
   of its 32-byte substrings (the first one on ties). Neighbouring strings with
   the same anchor form a segment. Equal strings have equal anchors, so only
   segments of one anchor need comparing. A native aggregate drops anchors seen
   once; segments that occur twice as a whole are repeated throughout.
2. *Index.* The other segments of repeated anchors, one text for each
   different segment, are gathered by anchor and indexed in batches of about
   ``INDEX_BYTES``: suffix ranks by doubling, the Burrows-Wheeler transform, its runs, and
   the suffix positions at both ends of every run. The longest match of a
   position with its lexicographic neighbours is computed at the run ends only; between
   two samples it falls by one per byte (equal transform characters mean
   neighbours one step earlier), so one pass in text order streams the matching
   statistics of all positions. Matches of ``length`` or more are marked.
3. *Hot anchors.* An anchor whose different segments exceed ``HOT_BYTES`` is not
   gathered: blocks of 16 neighbouring strings are compared by the hash of the bytes
   they share, then single strings where blocks differ, as counts by key.
4. *Spans* are merged per document and cut out of its text.

Texts that several rows have go whole without being compared; one row of each is cut into segments, which
mark other texts. Anchors and segments that very many texts share meet their lookup as broadcast rows, all
others through a shuffle.

Defined cases: a null text reads as empty; texts shorter than ``length`` lose
nothing; rows that repeat (also under one id) are repeats of each other, and
so are passages inside one text; a null doc_id is kept as such; very long texts are handled whole in one
task; an empty table gives an empty result; further columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import hot_keys_from_counts, split_join
from ..session import cut_lineage, cut_lineage_observed, drop_table, table_path
from .common import chunks, free_name, mix64, texts_of, tidy, utf8
from .textstats import ByteSpans

LENGTH = 400
GRAM = 32
INDEX_BYTES = 768 << 10
HOT_BYTES = 1 << 20
STEP = 16
BROADCAST_IDS = 200_000  # rows of three numbers (some 10 MB as a lookup)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_LOW32 = np.uint64(0xFFFFFFFF)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at every position of ``buf`` (by doubling from 8 bytes)."""
    u = buf.astype(np.uint64)
    u = u[:-1] | (u[1:] << np.uint64(8))
    u = u[:-2] | (u[2:] << np.uint64(16))
    u = u[:-4] | (u[4:] << np.uint64(32))
    u = u * _A
    u ^= u >> np.uint64(29)
    for step in (8, 16):
        u = (u[:-step] * _B) ^ (u[step:] * _A)
        u ^= u >> np.uint64(31)
    return u * _B


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours (block prefix and suffix minima)."""
    n = len(v) - w + 1
    pad = -len(v) % w
    block = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def segments(texts: list[bytes], length: int = LENGTH):
    """(text index, start, bytes, anchor hash, segment hash, anchor offset) of all segments."""
    keep = [i for i, t in enumerate(texts) if len(t) >= length]
    none = np.zeros(0, np.int64)
    if not keep:
        return none, none, none, none, none, none
    buf = np.frombuffer(b"".join(texts[i] for i in keep), np.uint8)
    lens = np.array([len(texts[i]) for i in keep], np.int64)
    base = np.cumsum(lens) - lens
    h = gram_hashes(buf)
    at = (h & ~_LOW32) | np.arange(len(h), dtype=np.uint64)
    anchor = (sliding_min(at, length - GRAM + 1) & _LOW32).astype(np.int64)  # per string start
    n = len(anchor)
    inside = np.zeros(n + 1, np.int64)  # string starts whose string lies in one text
    inside[base] += 1
    np.add.at(inside, np.minimum(base + lens - length + 1, n), -1)
    valid = np.cumsum(inside[:n]) > 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first[base] = True
    s = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    e = np.flatnonzero(last) + length
    p = anchor[s]
    doc = np.searchsorted(base, s, "right") - 1
    return (np.array(keep)[doc], s - base[doc], e - s, mix64(h[p]).view(np.int64),
            ByteSpans(buf).hash(s, e).view(np.int64), p - s)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with suffix positions at run ends."""

    CHARS = 4  # first ranking: 4 symbols of 9 bits (0 is the end of a text)
    BITS = 21  # below 2^21 symbols a key of two ranks and the position fit one integer

    def __init__(self, texts: list[bytes]):
        lens = np.array([len(t) + 1 for t in texts], np.int64)
        self.start = np.cumsum(lens) - lens
        n = int(lens.sum())
        self.small = n < (1 << self.BITS) - 1
        sym = np.zeros(n + 8, np.int64)
        body = np.ones(n, bool)
        body[self.start + lens - 1] = False
        sym[:n][body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        self.sym, self.n, self.first = sym, n, np.zeros(n, bool)
        self.first[self.start] = True
        self.left = np.repeat(self.start + lens, lens) - np.arange(n)  # symbols up to the end mark, included
        key = np.zeros(n, np.int64)
        open_ = np.ones(n, bool)
        for i in range(self.CHARS):
            c = np.where(open_, sym[i:n + i], 0)
            key = (key << 9) | c
            open_ &= c > 0
        self.levels = []
        rank, order, distinct = self._rank(key)
        h = self.CHARS
        while True:
            self.levels.append((h, rank))
            if distinct == n or h > int(lens.max()):
                break
            nxt = np.zeros(n, np.int64)
            more = self.left > h
            nxt[more] = rank[np.flatnonzero(more) + h] + 1
            rank, order, distinct = self._rank(rank.astype(np.int64) * (1 << self.BITS if self.small else n + 1) + nxt)
            h *= 2
        self.suffix = order  # suffixes equal up to their end marks: the earlier text first
        before = np.where(self.first[order], -1 - np.arange(n), sym[order - 1])  # each text's start is unique
        cut = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.heads = np.concatenate([[0], cut])  # first row of each run
        self.tails = np.concatenate([cut - 1, [n - 1]])
        self.symbol = before[self.heads]

    def _rank(self, key: np.ndarray):
        """(rank of each position, positions in order, different ranks); ties by position."""
        if self.small:
            both = np.sort((key << self.BITS) | np.arange(self.n))
            order, k = both & ((1 << self.BITS) - 1), both >> self.BITS
        else:
            order = np.argsort(key, kind="stable")
            k = key[order]
        cls = np.empty(self.n, np.int32)
        cls[0] = 0
        np.cumsum(k[1:] != k[:-1], out=cls[1:])
        rank = np.empty(self.n, np.int32)
        rank[order] = cls
        return rank, order, int(cls[-1]) + 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b`` (end marks never match)."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        ends = np.minimum(self.left[a], self.left[b]) - 1
        for h, rank in reversed(self.levels):
            ok = (out + h <= ends) & (a < self.n) & (b < self.n)
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            a[ok] += h
            b[ok] += h
            out[ok] += h
        for _ in range(self.CHARS):
            ok = (out < ends) & (self.sym[a] == self.sym[b])
            a[ok] += 1
            b[ok] += 1
            out[ok] += 1
        return out

    def matching(self) -> np.ndarray:
        """For every position the length of its longest match at another position."""
        best = np.zeros(self.n, np.int64)
        sa, pos = self.suffix, np.arange(self.n)
        inner_heads, inner_tails = self.heads[1:], self.tails[:-1]
        lcp = self.common(sa[inner_tails], sa[inner_heads])  # the row before a head is a tail
        for rows, edge in ((inner_heads, sa[0]), (inner_tails, sa[self.n - 1])):
            reach = np.full(self.n, -1, np.int64)
            reach[sa[rows]] = lcp + sa[rows]
            reach[edge] = edge  # no neighbour on this side
            best = np.maximum(best, np.maximum.accumulate(reach) - pos)
        return best


def repeated_spans(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Maximal spans of each text covered by strings that start twice among the texts."""
    if not texts:
        return []
    index = RunIndex(texts)
    hit = np.flatnonzero(index.matching() >= length)
    return _spans_by_text(hit, index.start, len(texts), length)


def _spans_by_text(hit: np.ndarray, start: np.ndarray, n: int, length: int):
    out: list = [[] for _ in range(n)]
    if len(hit):
        text = np.searchsorted(start, hit, "right") - 1
        new = np.concatenate([[True], (hit[1:] > hit[:-1] + length) | (text[1:] != text[:-1])])
        s = hit[new]
        e = hit[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(hit) - 1]])] + length
        for t, a, b in zip(text[new].tolist(), s.tolist(), e.tolist()):
            out[t].append((a - int(start[t]), b - int(start[t])))
    return out


def _keys(text: str, doc_id: str = "doc_id") -> list:
    """(did, th, th2) of a row: two 64-bit hashes of the text, and one of the text and the id. (th, th2)
    tell texts apart, (did, th) rows that are not equal in id and text."""
    t, n = F.col(f"`{text}`"), F.octet_length(F.col(f"`{text}`"))
    return [F.xxhash64(F.lit(1), F.col(f"`{doc_id}`").cast("long"), n, t), F.xxhash64(t), F.xxhash64(F.lit(2), n, t)]


def _keyed(docs: DataFrame) -> DataFrame:
    """(did, th, th2, text) of (doc_id, text) rows; a null text reads as empty."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return docs.select(*[c.alias(n) for c, n in zip(_keys("text"), ("did", "th", "th2"))], "text")


def _joined(big: DataFrame, small: DataFrame, rows: int, keys: list, how: str) -> DataFrame:
    """Join with a table of ``rows`` rows of a few numbers: broadcast under a bound."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_IDS else small, keys, how)


def _copies(keyed: DataFrame, length: int):
    """(rows long enough: did, th, th2, size; texts that several rows have: th, th2, rep; their number).
    ``rep`` is the smallest ``did`` of a text's rows."""
    rows = cut_lineage(keyed.select("did", "th", "th2", F.octet_length("text").alias("size"))
                       .where(F.col("size") >= length))
    copies, got = cut_lineage_observed(
        rows.groupBy("th", "th2").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("rep"))
        .where("n > 1").select("th", "th2", "rep"), [F.count(F.lit(1)).alias("m")])
    return rows, copies, got["m"]


def _segment_table(keyed: DataFrame, copies: DataFrame, n_copies: int, length: int) -> DataFrame:
    """Segments of one row of every text; ``dup``: the text has several rows (they go whole, its segments
    only mark other texts)."""
    def run(batches):
        seen: set = set()  # rows equal in id and text: once a task
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            did, th, th2 = (np.asarray(b.column(c)) for c in ("did", "th", "th2"))
            rep = np.asarray(b.column("rep").is_valid()) if n_copies <= BROADCAST_IDS else np.ones(len(did), bool)
            for i, j in chunks(off):
                texts = texts_of(data, off, i, j)
                for k in np.flatnonzero(rep[i:j]).tolist():
                    row = (did[i + k], th[i + k])
                    if row in seen:
                        texts[k] = b""
                    elif len(texts[k]) >= length:
                        seen.add(row)
                doc, start, size, anchor, seg, _ = segments(texts, length)
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(did[i + doc]), pa.array(th[i + doc]), pa.array(th2[i + doc]),
                         pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor),
                         pa.array(seg)], ["did", "th", "th2", "start", "size", "anchor", "seg"])

    one = F.col("rep").isNull() | (F.col("rep") == F.col("did"))
    rows, few = keyed, n_copies <= BROADCAST_IDS
    if few:  # copies are left out before anything is hashed
        rows = rows.join(F.broadcast(copies), ["th", "th2"], "left").where(one)
    else:
        rows = rows.withColumn("rep", F.lit(None).cast("long"))
    seg = rows.select("did", "th", "th2", "rep", "text").mapInArrow(
        tidy(run), "did long, th long, th2 long, start int, size int, anchor long, seg long")
    seg = _joined(seg, copies, n_copies, ["th", "th2"], "left").where(one)
    return seg.withColumn("dup", F.col("rep").isNotNull()).drop("rep", "th2")


def _segment_texts(reps: DataFrame, keyed: DataFrame) -> DataFrame:
    """Text of one occurrence of each different segment (anchor, seg, cnt, did, th, start, text)."""
    per_doc = reps.groupBy("did", "th").agg(F.collect_list(
        F.struct("anchor", "seg", "cnt", "start", "size")).alias("want"))  # bounded by the document
    per_doc, got = cut_lineage_observed(per_doc, [F.count(F.lit(1)).alias("m")])
    docs = keyed.select("did", "th", F.col("text").alias("whole"))
    if got["m"] <= BROADCAST_IDS:  # keep only the texts that are asked for, before any shuffle
        docs = docs.join(F.broadcast(per_doc.select("did", "th")), ["did", "th"], "left_semi")

    def run(batches):
        names = ["anchor", "seg", "cnt", "did", "th", "start", "text"]
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
        seen: set = set()  # equal rows lie in one task (the join is by their key): one of them is read
        for b in batches:
            data, off, _ = utf8(b.column("whole"))
            did, th = b.column("did").to_pylist(), b.column("th").to_pylist()
            rows, size = [], 0
            for r in range(b.num_rows):
                if (did[r], th[r]) in seen:
                    continue
                seen.add((did[r], th[r]))
                t = bytes(data[off[r]:off[r + 1]])
                for w in b.column("want")[r].as_py():
                    piece = t[w["start"]:w["start"] + w["size"]]
                    rows.append((w["anchor"], w["seg"], w["cnt"], did[r], th[r], w["start"], piece))
                    size += len(piece)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    out = cut_lineage(docs.join(per_doc, ["did", "th"]).select("did", "th", "want", "whole").mapInArrow(
        tidy(run), "anchor long, seg long, cnt long, did long, th long, start int, text binary"))
    drop_table(reps.sparkSession, table_path(per_doc))
    return out


_SPAN = "did long, th long, s int, e int"


def _span_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["did", "th", "s", "e"])


def _indexed_spans(texts: DataFrame, length: int) -> DataFrame:
    """Marked spans of segments that occur once, from run-length indexes over whole anchors."""
    def run(batches):
        group: list = []  # rows of whole anchors
        size = 0
        current, tail = None, []

        def mark(rows):
            rows = list({(r[0], r[1]): r for r in rows}.values())  # one text for each segment
            out = []
            for r, spans in zip(rows, repeated_spans([r[6] for r in rows], length)):
                if r[2] == 1:
                    out += [(r[3], r[4], r[5] + s, r[5] + e) for s, e in spans]
            return out

        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in
                           ("anchor", "seg", "cnt", "did", "th", "start", "text")]):
                if r[0] != current:
                    group += tail
                    tail, current = [], r[0]
                    if size >= INDEX_BYTES:
                        out = mark(group)
                        if out:
                            yield _span_batch(out)
                        group, size = [], 0
                tail.append(r)
                size += len(r[6])
        out = mark(group + tail)
        if out:
            yield _span_batch(out)

    rows = texts.repartition("anchor").sortWithinPartitions("anchor", "seg")
    return rows.mapInArrow(tidy(run), _SPAN)


def _hot_spans(texts: DataFrame, length: int) -> DataFrame:
    """Marked spans of hot anchors' segments, by counting hashes of blocks and of strings."""
    texts = texts.dropDuplicates(["anchor", "seg"])

    def blocks(batches):
        names = ["anchor", "seg", "cnt", "did", "th", "s", "e", "lo", "hi", "k1", "k2"]
        for b in batches:
            rows = []
            for anchor, seg, cnt, did, th, start, t in zip(*[b.column(c).to_pylist() for c in (
                    "anchor", "seg", "cnt", "did", "th", "start", "text")]):
                p = int(segments([t], length)[5][0])  # offset of the anchor in the segment
                lo, last = -p, len(t) - length - p  # first and last string start, seen from the anchor
                while lo <= last:
                    hi = min(last, lo // STEP * STEP + STEP - 1)
                    grid = lo // STEP * STEP
                    shared = t[grid + STEP - 1 + p:grid + length + p]
                    tag = f"{anchor}:{grid}:".encode()
                    k1 = xxhash.xxh3_64_intdigest(tag + shared)
                    k2 = xxhash.xxh3_64_intdigest(f"{lo}:{hi}:".encode() + t[lo + p:hi + length + p], seed=1)
                    rows.append((anchor, seg, cnt, did, th, start + lo + p, start + hi + p + length, lo, hi,
                                 k1 - (1 << 63), k2 - (1 << 63)))
                    lo = hi + 1
            if rows:
                kinds = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = cut_lineage(texts.mapInArrow(
        tidy(blocks), "anchor long, seg long, cnt long, did long, th long, s int, e int, lo int, hi int, "
                "k1 long, k2 long"))
    shared = rows.groupBy("k1").agg(F.count(F.lit(1)).alias("n1")).where("n1 > 1").select("k1")
    near = rows.join(shared, "k1")
    spans = near.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n2"),
                                         F.min(F.struct("anchor", "seg", "lo")).alias("one"))
    near = cut_lineage(near.join(spans, ["k1", "k2"]))
    whole = near.where("n2 > 1 and cnt = 1").select("did", "th", "s", "e")
    # one segment of each different span goes on string by string
    single = near.where("(anchor, seg, lo) = (one.anchor, one.seg, one.lo)") \
        .groupBy("anchor", "seg").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))

    def strings(batches):
        for b in batches:
            keys, rows_ = [], []
            for anchor, cnt, did, th, start, t, parts in zip(*[b.column(c).to_pylist() for c in (
                    "anchor", "cnt", "did", "th", "start", "text", "parts")]):
                p = int(segments([t], length)[5][0])
                for part in parts:
                    for o in range(part["lo"], part["hi"] + 1):
                        keys.append(xxhash.xxh3_64_intdigest(f"{anchor}:{o}:".encode() + t[o + p:o + p + length])
                                    - (1 << 63))
                        rows_.append((did, th, start + o + p, start + o + p + length, cnt))
            if keys:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows_), [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()])]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())] + cols,
                                                 ["k", "did", "th", "s", "e", "cnt"])

    each = cut_lineage(texts.join(single, ["anchor", "seg"]).select(
        "anchor", "cnt", "did", "th", "start", "text", "parts").mapInArrow(
        tidy(strings), "k long, did long, th long, s int, e int, cnt long"))
    twice = each.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    return whole.unionByName(each.where("cnt = 1").join(twice, "k").select("did", "th", "s", "e"))


def _hot(counts: DataFrame, key: str, parts: int) -> list:
    """Keys that alone would fill more than half a shuffle partition: at most 2 x ``parts``."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return hot_keys_from_counts(counts, key, "n", total, parts)


def removed_spans(docs: DataFrame, length: int = LENGTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(did, th, spans): the spans of every row (doc_id, text) with repeats, not merged yet. Texts that several rows have
    go whole; one row of each is compared with all other texts."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs)
    rows, copies, n_copies = _copies(keyed, length)
    entire = (_joined(rows, copies, n_copies, ["th", "th2"], "left_semi").select("did", "th", "size").distinct()
              .select("did", "th", F.lit(0).alias("s"), F.col("size").alias("e")))

    seg = cut_lineage(_segment_table(keyed, copies, n_copies, length))
    again = cut_lineage(seg.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("lo"),
                                                  F.max("seg").alias("hi")).where("n > 1")
                        .select("anchor", "n", (F.col("lo") < F.col("hi")).alias("differ")))
    found = cut_lineage(split_join(seg, again.drop("n"), "anchor", _hot(again, "anchor", parts)))
    for t in (seg, again):
        drop_table(spark, table_path(t))
    end = (F.col("start") + F.col("size")).alias("e")
    whole = found.where("not differ and not dup").select("did", "th", F.col("start").alias("s"), end)
    some = found.where("differ").withColumn("key", F.struct("anchor", "seg"))
    # cnt 1: the segment occurs once, in a text of one row, so its own strings are to be marked
    kinds = cut_lineage(some.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) + F.max(F.col("dup").cast("int"))).alias("cnt"),
        F.min(F.struct("did", "th", "start", "size")).alias("rep")))
    twice = kinds.where("n > 1").select("key", "n")
    whole2 = split_join(some.where("not dup"), twice.drop("n"), "key", _hot(twice, "key", parts)).select(
        "did", "th", F.col("start").alias("s"), end)
    hot = (kinds.groupBy("key.anchor").agg(F.sum(F.col("rep.size").cast("long")).alias("bytes"))
           .where(F.col("bytes") > hot_bytes).select("anchor"))
    hot, got = cut_lineage_observed(hot, [F.count(F.lit(1)).alias("m")])
    reps = kinds.select("key.anchor", "key.seg", "cnt", "rep.*")
    texts = _segment_texts(reps, keyed)
    spans, indexed = whole.unionByName(whole2), texts
    if got["m"]:
        spans = spans.unionByName(_hot_spans(texts.join(hot, "anchor", "left_semi"), length))
        indexed = texts.join(hot, "anchor", "left_anti")
    spans = spans.unionByName(_indexed_spans(indexed, length)).unionByName(entire)
    out = cut_lineage(spans.groupBy("did", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    for t in (rows, copies, found, kinds, hot, texts):
        drop_table(spark, table_path(t))
    return out


def merge(spans: list) -> list[tuple[int, int]]:
    out: list = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    return b"".join(parts + [text[at:]])


def _with_spans(docs: DataFrame, spans: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the spans of every row as column ``out``; ``text``: column without nulls."""
    did, th = free_name([*docs.columns, out], "did"), free_name([*docs.columns, out], "th")
    keyed = docs.withColumn(did, _keys(text)[0]).withColumn(th, _keys(text)[1])
    named = spans.select(F.col("did").alias(did), F.col("th").alias(th), F.col("spans").alias(out))
    return keyed.join(named, [did, th], "left").drop(did, th)


def repeated_passages(docs: DataFrame, length: int = LENGTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            size, gone, n, sha = [], [], [], []
            for r in range(b.num_rows):
                t = bytes(data[off[r]:off[r + 1]])
                spans = merge(b.column("spans")[r].as_py())
                size.append(len(t))
                gone.append(sum(e - s for s, e in spans))
                n.append(len(spans))
                sha.append(hashlib.sha256(cut(t, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, removed_spans(docs, length, hot_bytes), "text", "spans").mapInArrow(
        tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_passages(docs: DataFrame, length: int = LENGTH, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Pipeline form: ``docs`` with the repeated bytes cut out of ``text`` and ``n_chars`` (where
    present) counted anew. A character that loses some of its bytes goes whole. Helper columns
    take names that ``docs`` does not have."""
    columns = docs.columns
    whole, marks = free_name(columns, "whole"), free_name(columns, "spans")

    def run(batches):
        for b in batches:
            data, off, valid = utf8(b.column("text"))
            texts = []
            for r in range(b.num_rows):
                spans = merge(b.column(marks)[r].as_py())
                t = cut(bytes(data[off[r]:off[r + 1]]), spans)
                texts.append(t.decode("utf-8", "ignore") if valid[r] else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == "text" else
                 pa.array([None if t is None else len(t) for t in texts], pa.int64()) if c == "n_chars"
                 else b.column(c) for c in columns], columns)

    schema = ", ".join(f"`{f.name}` " + ("long" if f.name == "n_chars" else f.dataType.simpleString())
                       for f in docs.schema.fields)
    spans = removed_spans(docs.select(F.col("doc_id"), "text"), length, hot_bytes)
    filled = docs.withColumn(whole, F.coalesce("text", F.lit("")))
    return _with_spans(filled, spans, whole, marks).select(
        *[f"`{c}`" for c in columns], f"`{marks}`").mapInArrow(tidy(run), schema)
