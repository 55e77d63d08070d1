"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>`` per
turn. Control strings inside roles and texts are escaped reversibly: between
``<`` and ``|`` one backslash is added to those already there, so no control
string can arise from a text. The rendered conversation is encoded once with
offsets (control strings are special tokens, so no token crosses a turn's
border), and a binary search of the token spans in the sorted spans of the
assistant texts gives the loss mask.

Turns are sorted over all tasks by conversation and turn (range partitions), so a
conversation with very many turns is rendered and encoded by several tasks. A
conversation longer than ``BLOCK_CHARS``, or one that goes on in the next task, leaves in
several rows, in the order of ``block``, cut at turn borders, where the tokenizer
cuts anyway: the ids are those of the whole, and memory stays bounded by the
longest turn. Digests of conversations that lie in one task are taken there; of the others
only the decoded text goes on to be hashed in order.

Defined cases: a null text or role reads as empty; a null conv_id is a
conversation of its own; a null turn sorts first; equal turns are ordered by
role and text; repeated rows are repeated turns; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BLOCK_CHARS = 1 << 18
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, read back from a rendered conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def render(turns: list[tuple[str, str]], loss_role: str = "assistant"):
    """(formatted text, sorted spans of the texts under the loss)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        at += len(head)
        if role == loss_role and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def loss_mask(token_spans: np.ndarray, text_spans: list[tuple[int, int]]) -> np.ndarray:
    """Is each token span inside one of the sorted text spans (binary search)."""
    if not text_spans or not len(token_spans):
        return np.zeros(len(token_spans), bool)
    s = np.array(text_spans)
    k = np.searchsorted(s[:, 0], token_spans[:, 0], "right") - 1
    return (k >= 0) & (token_spans[:, 1] <= s[np.maximum(k, 0), 1])


def chat_tokenizer(path: str):
    """The tokenizer of the file with the control strings as special tokens."""
    from tokenizers import AddedToken, Tokenizer
    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (START, SEP, END)])
    return t


FORMAT_SCHEMA = ("conv_id long, block long, formatted string, input_ids array<int>, "
                 "token_start array<int>, token_end array<int>, loss_mask array<boolean>")


def _blocks(batches, block_chars: int):
    """(conv_id, block number, turns) in order, cut at turn borders; later tasks have larger numbers."""
    from pyspark import TaskContext
    base = TaskContext.get().partitionId() << 32
    current, turns, size, block, seen = None, [], 0, base, False
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "role", "text")]
        for conv, role, text in zip(*cols):
            if seen and conv != current:
                yield current, block, turns
                turns, size, block = [], 0, base
            elif size > block_chars:
                yield current, block, turns
                turns, size, block = [], 0, block + 1
            current, seen = conv, True
            turns.append((role or "", text or ""))
            size += len(turns[-1][1])
    if seen:
        yield current, block, turns


def format_conversations(turns: DataFrame, tokenizer_path: str, loss_role: str = "assistant",
                         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation (or block of one that is very long or lies in several tasks): text, ids,
    offsets, mask."""
    def flush(todo, tok):
        texts = [render(t, loss_role) for _, _, t in todo]
        enc = tok.encode_batch([f for f, _ in texts], add_special_tokens=False)
        starts, ends, masks, ids = [], [], [], []
        for (_, spans), e in zip(texts, enc):
            at = np.array(e.offsets, np.int32).reshape(-1, 2)
            starts.append(at[:, 0])
            ends.append(at[:, 1])
            masks.append(loss_mask(at, spans))
            ids.append(np.array(e.ids, np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _, _ in todo], pa.int64()), pa.array([k for _, k, _ in todo], pa.int64()),
             pa.array([f for f, _ in texts], pa.string()), pa.array(ids, pa.list_(pa.int32())),
             pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())),
             pa.array(masks, pa.list_(pa.bool_()))],
            ["conv_id", "block", "formatted", "input_ids", "token_start", "token_end", "loss_mask"])

    def run(batches):
        tok = chat_tokenizer(tokenizer_path)
        todo, size = [], 0
        for item in _blocks(batches, block_chars):
            todo.append(item)
            size += sum(len(t) for _, t in item[2])
            if size > block_chars:
                yield flush(todo, tok)
                todo, size = [], 0
        if todo:
            yield flush(todo, tok)

    ordered = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                            F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange("conv_id", "turn", "role", "text")
               .sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMAT_SCHEMA)


class _Sums:
    """Running digest of one conversation from its blocks in order."""

    def __init__(self, conv):
        self.conv, self.n, self.chars, self.length, self.tokens = conv, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, n, turns: bytes, chars, loss: bytes, length, tokens):
        self.n, self.chars = self.n + n, self.chars + chars
        self.length, self.tokens = self.length + length, self.tokens + tokens
        self.turns.update(turns)
        self.loss.update(loss)

    def row(self):
        return (self.conv, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.length, self.tokens)


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long, n_tokens long")
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_PART_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
_PART_NAMES = ["conv_id", "block", "n", "turns", "chars", "loss", "length", "tokens"]
HELD_CHARS = 4 * BLOCK_CHARS  # text of a conversation held until it is known to end in its task


def _read_block(text: str, mask: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(turns, their text, loss characters, loss text, characters, tokens) read back from a row."""
    turns = parse(text)
    loss = []
    start, end = start[mask], end[mask]
    if len(start):  # union of the masked spans, as maximal runs
        reach = np.maximum.accumulate(end)
        first = np.concatenate([[True], start[1:] > reach[:-1]])
        last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(start) - 1]])
        loss = [unescape(text[s:e]) for s, e in zip(start[first], reach[last])]
    return (len(turns), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), sum(map(len, loss)),
            "".join(loss).encode(), len(text), len(mask))


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Counts and hashes per conversation, read back from the formatted rows.

    The rows of a conversation must lie together in block order in every task, as
    :func:`format_conversations` leaves them. A task's first and last conversation may go on in
    another one: these, and long ones, leave as parts, which are hashed in the order of their blocks.
    """
    def run(batches):
        names = ["part"] + ["digest"]
        done, parts, size = [], [], 0

        def emit():
            kinds = [pa.struct(list(zip(_PART_NAMES, _PART_TYPES))),
                     pa.struct(list(zip([f.split()[0] for f in DIGEST.split(", ")], _DIGEST_TYPES)))]
            rows = [dict(zip(_PART_NAMES, p)) for p in parts], [dict(zip([f.name for f in kinds[1]], d)) for d in done]
            n, m = len(rows[0]), len(rows[1])
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0] + [None] * m, kinds[0]), pa.array([None] * n + rows[1], kinds[1])], names)

        first, current, held, held_chars, sums, seen = True, None, [], 0, None, False
        for b in batches:
            for r in range(b.num_rows):
                conv, block, text = (b.column(k)[r].as_py() for k in ("conv_id", "block", "formatted"))
                if seen and conv != current:
                    if sums is not None:
                        done.append(sums.row())
                    first, held, held_chars, sums = False, [], 0, None
                if not seen or conv != current:
                    sums = None if first else _Sums(conv)
                current, seen = conv, True
                got = _read_block(text, b.column("loss_mask")[r].values.to_numpy(zero_copy_only=False).astype(bool),
                                  b.column("token_start")[r].values.to_numpy(), b.column("token_end")[r].values.to_numpy())
                size += len(text)
                if sums is not None:
                    sums.add(*got)
                    held.append((conv, block, *got))
                    held_chars += len(text)
                    if held_chars > HELD_CHARS:
                        parts += held
                        held, sums = [], None
                else:
                    parts.append((conv, block, *got))
                if size > BLOCK_CHARS:
                    yield emit()
                    done, parts, size = [], [], 0
        if sums is not None:  # the last conversation
            parts += held
        if done or parts:
            yield emit()

    def join(batches):
        out, state = [], None
        kinds = [f.split()[0] for f in DIGEST.split(", ")]
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in _PART_NAMES]):
                if state is None or row[0] != state.conv:
                    if state is not None:
                        out.append(state.row())
                    state = _Sums(row[0])
                state.add(*row[2:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DIGEST_TYPES)], kinds)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(state.row(), _DIGEST_TYPES)], kinds)

    part = ("struct<conv_id:bigint,block:bigint,n:bigint,turns:binary,chars:bigint,loss:binary,length:bigint,"
            "tokens:bigint>")
    digest = "struct<" + DIGEST.replace("long", "bigint").replace(" ", ":").replace(",:", ",") + ">"
    read = cut_lineage(formatted.mapInArrow(run, f"part {part}, digest {digest}"))
    rest = (read.where("part is not null").select("part.*").repartition("conv_id")
            .sortWithinPartitions("conv_id", "block").mapInArrow(join, DIGEST))
    return read.where("digest is not null").select("digest.*").unionByName(rest)
