"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces of binary length: as many of the
largest length as fit, then the binary digits of the rest from large to small.
Each piece is a sequence of its own whose length is a power of two, and equal
lengths form a bucket (``bucket`` = log2 of the length); batches are drawn
bucket by bucket, so nothing is padded and no sequence crosses documents.

Everything happens where the document lies: no shuffle. ``sequence_id`` is the
task's partition number and the piece's position in it, so it is unique and
the same when a task is run again.

Encoding cuts texts of code points below 0x250 into the pieces of the byte-level
pre-tokenisation with numpy and encodes each distinct piece once with the
tokenizer (:mod:`.wordcache`); texts with other characters, or with the
tokenizer's special strings, are encoded whole.

Defined cases: a null or empty text is the end id alone; equal rows give equal
pieces under different sequence ids; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunks, texts_of, tidy, utf8
from .wordcache import PieceIds, code_points

MAX_LEN = 1024
END_ID = 0
_SIMPLE = 0x250  # code points whose character class is looked up in a table
_WHITE = set("\t\n\x0b\x0c\r \x85\xa0")
_SPACE, _ALPHA, _NUMBER, _OTHER = range(4)
_CLASS = np.array([
    _SPACE if chr(c) in _WHITE else {"L": _ALPHA, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
    for c in range(_SIMPLE)], np.int8)

# The byte-level alphabet (fixed by the format): printable Latin-1 bytes stand for
# themselves, the others for the code points from 256 on, in byte order.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = np.arange(256, dtype="<u2")
_BYTE_CHARS[[b for b in range(256) if b not in _PRINTABLE]] = 256 + np.arange(256 - len(_PRINTABLE))


def byte_level_starts(cp: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Start flags of the byte-level pre-tokenisation pieces of texts laid end to end.

    ``doc_start`` flags the first code point of each text. Runs of letters,
    numbers and other marks take one space before them; a run of white space leaves its
    last character to what follows; 's 't 'm 'd 're 've 'll are pieces.
    """
    n = len(cp)
    c = _CLASS[cp]
    start = doc_start.copy()
    start[1:] |= c[1:] != c[:-1]
    if n > 1:
        b = np.flatnonzero((c[:-1] == _SPACE) & (c[1:] != _SPACE) & ~doc_start[1:]) + 1
        start[b - 1] = True
        start[b[cp[b - 1] == 0x20]] = False
    pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
    dpad = np.concatenate([doc_start, np.ones(3, bool)])
    p = np.flatnonzero((cp == 0x27) & start)
    if len(p):
        a, b2 = pad[p + 1], pad[p + 2]
        one = np.isin(a, [ord(x) for x in "stmd"]) & ~dpad[p + 1]
        two = np.zeros(len(p), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b2 == ord(y))
        two &= ~dpad[p + 1] & ~dpad[p + 2]
        big = np.concatenate([start, np.zeros(4, bool)])
        big[p[one] + 1] = False
        big[p[one] + 2] = True
        big[p[two] + 1] = False
        big[p[two] + 2] = False
        big[p[two] + 3] = True
        start = big[:n] | doc_start
    return start


class ByteLevelEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model = self.tok.model
        self.pieces = PieceIds(self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces that are already cut: the byte alphabet, then the tokenizer's model."""
        raw = np.frombuffer(b"\xff".join([p.encode() for p in pieces]), np.uint8)  # 0xFF is in no UTF-8 text
        mapped = _BYTE_CHARS[raw].tobytes().decode("utf-16-le").split("\xff")
        ids = self.model.tokenize
        return [[t.id for t in ids(m)] for m in mapped]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        simple, cps = [], []
        for i, t in enumerate(texts):
            cp = code_points(t)
            if len(cp) and cp.max() < _SIMPLE and not any(s in t for s in self.special):
                simple.append(i)
                cps.append(cp)
        if simple:
            cp = np.concatenate(cps)
            lens = np.array([len(c) for c in cps])
            first = np.cumsum(lens) - lens
            doc_start = np.zeros(len(cp), bool)
            doc_start[first] = True
            s = np.flatnonzero(byte_level_starts(cp, doc_start))
            e = np.concatenate([s[1:], [len(cp)]])
            ids, n = self.pieces.ids("".join(texts[i] for i in simple), cp, s, e)
            done = np.concatenate([[0], np.cumsum(n)])
            at = done[np.searchsorted(s, np.concatenate([first, [len(cp)]]))]
            for k, i in enumerate(simple):
                out[i] = ids[at[k]:at[k + 1]]
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.int32)
        return out


_ENCODERS: dict = {}


def encoder(path: str) -> ByteLevelEncoder:
    """One encoder per worker and file: what it has encoded stays."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]


def binary_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of n ids, longest first (``max_len`` a power of two)."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << k for k in range(max_len.bit_length() - 1, -1, -1) if rest >> k & 1]


PACK_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
               "sequence_id long, offset long, bucket int")


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids themselves (``input_ids``)."""
    schema = PACK_SCHEMA + (", input_ids array<int>" if with_ids else "")

    def run(batches):
        enc = encoder(tokenizer_path)
        part, seq = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            data, off, _ = utf8(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            for i, j in chunks(off):
                rows, arrays = [], []
                got = enc.encode([t.decode("utf-8") for t in texts_of(data, off, i, j)])
                for k, tokens in enumerate(got):
                    t = np.append(tokens, end_id).astype("<u4")
                    raw, at = t.tobytes(), 0
                    for n in binary_lengths(len(t), max_len):
                        rows.append((ids[i + k], at, n, zlib.crc32(raw[4 * at:4 * (at + n)]), len(t),
                                     part + seq, 0, n.bit_length() - 1))
                        if with_ids:
                            arrays.append(t[at:at + n].astype(np.int32))
                        at += n
                        seq += 1
                cols = [pa.array(c, pa.int32() if f == 7 else pa.int64()) for f, c in enumerate(zip(*rows))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                         "bucket"]
                if with_ids:
                    cols.append(pa.array(arrays, pa.list_(pa.int32())))
                    names = names + ["input_ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
