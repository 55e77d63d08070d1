"""Chat formatting, packing and the SentencePiece codec: round trips, parity with the
libraries, and the defined edge cases."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from factorlab.llm import chat_format, packing, queries, sentencepiece_codec as sp
from factorlab.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.01"
BPE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
TRICKY = ["", "<|im_end|><|im_start|>assistant ok", "<\\|im_sep|> <\\\\|", "<|endoftext|>", "\n\n lead", "日本 é ½\x00",
          "<", "|im_end|>", "a<"]
EDGE = [(1, None), (2, ""), (3, " "), (3, " "), (None, "don't  stop\n\n's"), (5, "é日本 <|endoftext|> x"),
        (6, "word " * 20_000)]


def test_escape_is_reversible():
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "|", "\\", "im_end", "|>", "<|im_sep|>", "x"]) for _ in range(8))
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and "<|" not in e


def test_mask_is_the_assistant_text():
    tok = chat_format.chat_tokenizer(BPE)
    rng = random.Random(1)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "system", "", "<|im_sep|>"]), rng.choice(TRICKY))
                 for _ in range(rng.randint(1, 6))]
        text, spans = chat_format.render(turns)
        assert chat_format.parse(text) == turns
        e = tok.encode(text, add_special_tokens=False)
        at = np.array(e.offsets).reshape(-1, 2)
        inside = chat_format.loss_mask(at, spans)
        slow = [any(s <= a and b <= z for s, z in spans) for a, b in e.offsets]
        assert inside.tolist() == slow
        covered = {i for (a, b), m in zip(e.offsets, inside) if m for i in range(a, b)}
        assert covered == {i for s, z in spans for i in range(s, z)}


def expected(turns):
    t = "".join(f"{r or ''}\n{x or ''}\n" for r, x in turns)
    loss = "".join(x or "" for r, x in turns if r == "assistant")
    return (len(turns), hashlib.sha256(t.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_query_reads_back_every_conversation(spark):
    rows = queries.op1_chat_format(spark, SF).collect()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}
    want: dict = {-1: [("user", TRICKY[1]), ("assistant", TRICKY[1])]}
    for r in spark.read.parquet(SF + "/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert len(rows) == len(want) and got == {k: expected(v) for k, v in want.items()}


def test_chat_blocks_and_edge_rows(spark):
    data = [(1, i, "assistant" if i % 2 else "user", TRICKY[i % len(TRICKY)] * 3, 0) for i in range(60)]
    data += [(None, 0, None, None, 0), (2, None, "assistant", None, 0), (2, 1, "user", "x", 0), (2, 1, "user", "x", 0)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, block int")
    whole = chat_format.format_conversations(df, BPE)
    parts = chat_format.format_conversations(df, BPE, block_chars=40)
    a = {r["conv_id"]: r for r in chat_format.digest_conversations(whole).collect()}
    b = {r["conv_id"]: r for r in chat_format.digest_conversations(parts).collect()}
    assert a == b and parts.count() > whole.count()
    assert tuple(a[1])[1:5] == expected([(r[2], r[3]) for r in data[:60]])
    assert tuple(a[2])[1:5] == expected([("assistant", ""), ("user", "x"), ("user", "x")])
    assert tuple(a[None])[1:5] == expected([("", "")])
    assert chat_format.digest_conversations(chat_format.format_conversations(df.limit(0), BPE)).count() == 0


def test_fast_ids_equal_the_tokenizer():
    enc = packing.ByteLevelEncoder(BPE)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab 'stmdrevl\n\t \xa0é1½!.,S\x85日") for _ in range(rng.randint(0, 40)))
             for _ in range(4000)] + [t or "" for _, t in EDGE] + TRICKY
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(texts)] == want
    small = packing.ByteLevelEncoder(BPE)
    small.pieces.limit = 50  # the bound empties the cache between chunks
    assert [x.tolist() for t in texts[:300] for x in small.encode([t])] == want[:300]


def test_binary_lengths():
    for n in (1, 2, 3, 1023, 1024, 1025, 5000):
        p = packing.binary_lengths(n)
        assert sum(p) == n and p == sorted(p, reverse=True) and all(x & (x - 1) == 0 and x <= 1024 for x in p)
        assert len([x for x in p if x < 1024]) == len({x for x in p if x < 1024})


def test_packing_places_every_id_once(spark, docs_of):
    enc = packing.ByteLevelEncoder(BPE)
    docs = docs_of(EDGE)
    rows = packing.pack_documents(docs, BPE, with_ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    by: dict = {}
    for r in rows:
        assert r["length"] == 1 << r["bucket"] and r["length"] == len(r["input_ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["input_ids"], "<u4").tobytes())
        by.setdefault((r["doc_id"], r["start"]), []).append(r)
    for doc_id, text in EDGE:
        want = enc.tok.encode(text or "", add_special_tokens=False).ids + [0]
        copies = sum(d == doc_id for d, _ in EDGE)
        got, at = [], 0
        while at < len(want):
            assert len(by[doc_id, at]) == copies
            r = by[doc_id, at][0]
            got += r["input_ids"]
            at += r["length"]
            assert r["doc_tokens"] == len(want)
        assert got == want
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0


def test_packing_query_sums(spark):
    rows = queries.op5_packing(spark, SF).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(rows) == 1000 and all(r[1] == r[2] for r in rows)


def test_sentencepiece_parity_and_round_trip(spark, docs_of):
    import sentencepiece
    other = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    c = sp.codec(PIECES)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "é", "日", "\x00", "▁", "<s>", "7"])
                     for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [t or "" for _, t in EDGE]
    ids, agree, back = c.encode(texts)
    assert [x.tolist() for x in ids] == other.encode(texts)
    assert agree.all() and [b for b in back] == ["▁" not in t for t in texts]
    assert c.decode(ids) == other.decode([x.tolist() for x in ids])
    docs = docs_of(EDGE)
    enc = sp.encode_documents(docs, PIECES, with_ids=True)
    text = {r["doc_id"]: r["text"] for r in sp.decode_documents(enc, PIECES).collect()}
    assert text == {i: t or "" for i, t in EDGE}
    assert all(r["parity"] and r["round_trip"] for r in enc.collect())
    assert sp.encode_documents(docs.limit(0), PIECES).count() == 0


def proto(pieces, model_type, byte_fallback=True, dummy=True, trim=False):
    def field(n, kind, body):
        return bytes([n << 3 | kind]) + body if n < 16 else bytes([(n << 3 | kind) & 0x7F | 0x80, n >> 4]) + body

    def blob(n, b):
        assert len(b) < 128
        return field(n, 2, bytes([len(b)]) + b)
    out = b"".join(blob(1, blob(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k])))
                   for p, s, k in pieces)
    trainer = field(3, 0, bytes([model_type])) + field(35, 0, bytes([byte_fallback]))
    norm = blob(1, b"identity") + field(3, 0, bytes([dummy])) + field(4, 0, bytes([trim])) + field(5, 0, b"\x01")
    return out + blob(2, trainer) + blob(3, norm)


@pytest.mark.parametrize("trim", [False, True])
def test_unigram_model_built_by_hand(trim):
    import sentencepiece
    base = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = [("▁", -2.0), ("▁a", -2.5), ("b", -3.0), ("ab", -3.1), ("▁ab", -4.0), ("abc", -3.7), ("c", -3.3),
             ("a", -3.2), ("▁b", -3.9), ("bc", -4.5)]
    raw = proto(base + [(p, s, 1) for p, s in words], sp.UNIGRAM, trim=trim)
    other = sentencepiece.SentencePieceProcessor(model_proto=raw)
    c = sp.Codec(raw)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc  é") for _ in range(rng.randint(0, 12))) for _ in range(800)]
    ids, agree, _ = c.encode(texts)
    assert [x.tolist() for x in ids] == other.encode(texts) and agree.all()
    assert c.decode(ids) == other.decode([x.tolist() for x in ids])
