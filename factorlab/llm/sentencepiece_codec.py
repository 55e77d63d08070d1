"""SentencePiece encoding and decoding on the tokenizers library.

``read_model`` parses the model file (protobuf wire format) into pieces with
score and type, the model type and the normaliser's settings.
``build_tokenizer`` rebuilds it from public parts: the normaliser (precompiled
character map, white-space rules, metaspace marker and its dummy prefix), a
unigram model with the pieces' scores or, for a BPE model, merges ranked by the
score of the merged piece; both with byte fallback; and the decoder.

A text is normalised whole; where no piece of the vocabulary continues past a
marker, it is cut before each run of markers, and each distinct part is encoded
once, in batches over ``THREADS`` threads (:mod:`.wordcache`). The SentencePiece
library itself encodes every whole, raw text as well, and ``parity`` says
whether the ids agree. Each distinct part goes back through the tokenizer's
decoder, and ``round_trip`` says whether all parts of the text come back and make up the
text (parts begin with a marker, so no decoding step crosses them).

Defined cases: a null text reads as empty; an empty text has no ids; equal
texts get equal ids; unknown characters become their bytes; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, texts_of, utf8
from .wordcache import PieceIds, code_points

MARKER = "▁"
THREADS = 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
UNIGRAM, BPE = 1, 2


def _fields(buf: bytes):
    """(field number, value) of one protobuf message; nested messages as bytes."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = buf[at:at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = buf[at:at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", buf[at:at + 4])[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def read_model(raw: bytes) -> Model:
    """Parse a serialised SentencePiece model."""
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = v
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.model_type = v
                elif n == 24:
                    m.suffix_marker = bool(v)
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.trim_spaces = bool(v)
                elif n == 5:
                    m.escape_spaces = bool(v)
    unknown = [i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN]
    m.unk_id = unknown[0] if unknown else 0
    return m


def build_tokenizer(m: Model):
    """The tokenizers-library twin of a SentencePiece model."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers
    if m.suffix_marker or not m.escape_spaces:
        raise ValueError("models with a suffix marker or without escaped spaces are not supported")
    if m.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback)
    elif m.model_type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        score = {p: s for p, s, k in m.pieces if k in (NORMAL, USER, UNUSED)}
        merges = sorted(((-score[p], len(p[:i]), p[:i], p[i:]) for p in score for i in range(1, len(p))
                         if p[:i] in score and p[i:] in score), key=lambda t: (t[0], t[1], t[2]))
        model = models.BPE(vocab, [(a, b) for _, _, a, b in merges], unk_token=m.pieces[m.unk_id][0],
                           fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model type {m.model_type} is not supported")
    tok = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.trim_spaces:
        from tokenizers import Regex
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    steps.append(normalizers.Replace(" ", MARKER))
    tok.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if m.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tok.decoder = decoders.Sequence(back)
    tok.add_special_tokens([AddedToken(p, special=True, normalized=False)
                            for p, _, k in m.pieces if k in (CONTROL, UNKNOWN)])
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    tok.add_tokens([AddedToken(p, normalized=False) for p, _, k in m.pieces if k == USER])
    return tok


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, raw: bytes, check: bool = True, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = read_model(raw)
        self.tok = build_tokenizer(self.model)
        self.parts = build_tokenizer(self.model)
        self.parts.normalizer = None  # parts are cut from normalised text
        texts = [p for p, _, k in self.model.pieces if k in (NORMAL, USER, UNUSED)]
        self.cuttable = not any(MARKER in p.lstrip(MARKER) for p in texts) and \
            not any(k == USER for _, _, k in self.model.pieces)
        kind = {i: k for i, (_, _, k) in enumerate(self.model.pieces)}
        self.is_byte = np.array([kind[i] == BYTE for i in range(len(kind))])
        self.other = None
        if check:
            import sentencepiece
            self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.cache = PieceIds(self._encode_parts)

    def _encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each distinct part, a batch over all threads, after one number: 1 if the decoder
        gives the part back."""
        got = [e.ids for e in self.parts.encode_batch_fast(parts, add_special_tokens=False)]
        plain = [p[1:].replace(MARKER, " ") if p.startswith(MARKER) else p.replace(MARKER, " ") for p in parts]
        back = self.tok.decode_batch(got, skip_special_tokens=False)
        return [[int(d == t)] + g for g, d, t in zip(got, back, plain)]

    def _agree(self, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """Does the SentencePiece library give the same ids for each whole, raw text?"""
        if self.other is None or not texts:
            return np.ones(len(texts), bool)
        return np.array([i.tolist() == w for i, w in zip(ids, self.other.encode(texts))], bool)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(ids, do both libraries agree, does decoding give the text back) of each text."""
        out: list = [np.zeros(0, np.int32)] * len(texts)
        back = np.ones(len(texts), bool)
        if not (self.cuttable and self.model.dummy_prefix and not self.model.trim_spaces):
            enc = self.tok.encode_batch_fast(texts, add_special_tokens=False)
            for i, e in enumerate(enc):
                out[i] = np.array(e.ids, np.int32)
            back = np.array([a == t for a, t in zip(self.decode(out), texts)], bool)
            return out, self._agree(texts, out), back
        if self.model.charsmap:
            norm = [self.tok.normalizer.normalize_str(t) if t else "" for t in texts]
        else:  # the same two steps: the marker in front, and in place of spaces
            norm = [MARKER + t.replace(" ", MARKER) if t else "" for t in texts]
        full = [i for i, t in enumerate(norm) if t]
        if not full:
            return out, self._agree(texts, out), back
        joined = "".join(norm[i] for i in full)
        cp = code_points(joined)
        lens = np.array([len(norm[i]) for i in full])
        first = np.cumsum(lens) - lens
        mark = cp == ord(MARKER)
        begin = mark.copy()
        begin[1:] &= ~mark[:-1]
        begin[first] = True
        s = np.flatnonzero(begin)
        e = np.concatenate([s[1:], [len(cp)]])
        ids, n = self.cache.ids(joined, cp, s, e)
        head = np.cumsum(n) - n  # position of each part's flag
        exact = ids[head] > 0
        keep = np.ones(len(ids), bool)
        keep[head] = False
        ids = ids[keep]
        done = np.concatenate([[0], np.cumsum(n - 1)])
        at = np.searchsorted(s, np.concatenate([first, [len(cp)]]))
        lost = np.concatenate([[0], np.cumsum(~exact)])
        for k, i in enumerate(full):
            out[i] = ids[done[at[k]]:done[at[k + 1]]]
            back[i] = (lost[at[k + 1]] == lost[at[k]] and MARKER not in texts[i]
                       and norm[i] == MARKER + texts[i].replace(" ", MARKER))
        return out, self._agree(texts, out), back

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tok.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)


_CODECS: dict = {}


def codec(path: str, check: bool = True) -> Codec:
    """One codec per worker and file."""
    if (path, check) not in _CODECS:
        with open(path, "rb") as f:
            _CODECS[path, check] = Codec(f.read(), check)
    return _CODECS[path, check]


CODEC_SCHEMA = ("doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, parity boolean, "
                "round_trip boolean")


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False,
                     check: bool = True) -> DataFrame:
    """One row per document: id count, ids that stand for single bytes, crc32 of the ids
    (little-endian unsigned 32-bit), parity with the SentencePiece library, exact decoding."""
    schema = CODEC_SCHEMA + (", input_ids array<int>" if with_ids else "")

    def run(batches):
        c = codec(model_path, check)
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            for i, j in chunks(off):
                texts = [t.decode("utf-8") for t in texts_of(data, off, i, j)]
                ids, agree, back = c.encode(texts)
                cols = [b.column("doc_id").slice(i, j - i),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(c.is_byte[x].sum()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        pa.array(agree), pa.array(back)]
                names = ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "parity", "round_trip"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names = names + ["input_ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, input_ids); null ids give a null text."""
    def run(batches):
        c = codec(model_path, False)
        for b in batches:
            ids = b.column("input_ids").to_pylist()
            text = c.decode([np.array(x or [], np.int32) for x in ids])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([None if x is None else t for x, t in zip(ids, text)],
                                              pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "input_ids").mapInArrow(run, "doc_id long, text string")
