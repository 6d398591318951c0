"""Chat formatting with offset-aligned masks.

The template is <|turn|>ROLE<|text|>TEXT<|end|> for each turn. Its control strings, the tokenizer's special tokens and other
formats' control strings are escaped within roles and texts: a backslash is doubled, and one is put behind the first
character of a control string; unescape() undoes it exactly. The whole rendered conversation is encoded once, with offsets;
the template's control strings are special tokens of the encoder, so no token stands on both sides of one. Turn spans are
sorted, and so are token spans: a binary search finds the turn that each token stands in, and tokens of assistant texts make
the loss mask.

Rows are dealt by ranges of (conv_id, turn), so a conversation of any size is cut between turns into fragments of whole
turns (at partition borders, and where one exceeds FRAGMENT_CHARS); nothing is grouped by conversation for encoding.
Fragments of a conversation are in order by (part, piece). As control strings bound tokens, fragments encode as the whole does.

Nulls: a null text or role is empty; a null turn comes first; a null conv_id is a conversation. Ties between turns go by
role, then text; repeated rows are turns each. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
FRAGMENT_CHARS = 1 << 20

#: Openings of control strings, ours and those of common formats.
CONTROL = re.compile(r"<(?=\||/?s>|<SYS>|</SYS>|start_of_turn>|end_of_turn>|/?think>)|\[(?=/?INST\])|\\")
ESCAPED = re.compile(r"([<\[\\])\\")
TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of assistant texts in it, ascending."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


_encoders: dict = {}


def encoder(path: str):
    from tokenizers import AddedToken, Tokenizer, processors

    if path not in _encoders:
        t = Tokenizer.from_file(path)
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
        _encoders[path] = t
    return _encoders[path]


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (by their offsets) stand in one of the sorted spans."""
    if not spans:
        return np.zeros(len(starts), bool)
    low, high = np.array(spans).T
    at = np.searchsorted(low, starts, "right") - 1
    return (at >= 0) & (starts < high[at]) & (ends > low[at])


SCHEMA = "conv_id long, part int, piece int, n_turns long, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>"


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """Fragments of conversations of rows(conv_id, turn, role, text): SCHEMA."""

    def encoded(conv_id, part, piece, turns):
        formatted, spans = render(turns)
        e = encoder(path).encode(formatted, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
        mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
        return conv_id, part, piece, len(turns), formatted, np.array(e.ids, np.int32), offsets[:, 0], offsets[:, 1], mask

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches):
        part, now, piece, turns, size, out, held = TaskContext.get().partitionId(), (), 0, [], 0, [], 0
        for b in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = (conv_id,) != now
                if turns and (new or size >= FRAGMENT_CHARS):
                    out.append(encoded(now[0], part, piece, turns))
                    held += size
                    piece, turns, size = piece + 1, [], 0
                    if held >= FRAGMENT_CHARS:
                        yield batch(out)
                        out, held = [], 0
                if new:
                    now, piece = (conv_id,), 0
                turns.append((role or "", text or ""))
                size += len(text or "")
        if turns:
            out.append(encoded(now[0], part, piece, turns))
        if out:
            yield batch(out)

    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(C.tidy(run), SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in TURNS.findall(formatted)]


def read_loss(formatted: str, starts, ends, mask) -> list[str]:
    """The texts under the mask, unescaped: one for each run of masked tokens that stand end to end."""
    mask = np.asarray(mask, bool)
    starts, ends = np.asarray(starts)[mask], np.asarray(ends)[mask]
    if not len(starts):
        return []
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > np.maximum.accumulate(ends)[:-1]]))
    last = np.append(first[1:], len(starts)) - 1
    return [unescape(formatted[a:b]) for a, b in zip(starts[first], np.maximum.accumulate(ends)[last], strict=True)]


def digests(fragments: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from fragments."""

    def run(batches):
        now, done, state = (), [], None

        def close():
            turns, loss, n, chars, formatted = state
            done.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        for b in batches:
            for conv_id, formatted, starts, ends, mask in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv_id,) != now:
                    if state:
                        close()
                    now, state = (conv_id,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, text in read_turns(formatted):
                    state[0].update(f"{role}\n{text}\n".encode())
                    state[2] += 1
                for text in read_loss(formatted, starts, ends, mask):
                    state[1].update(text.encode())
                    state[3] += len(text)
                state[4] += len(formatted)
        if state:
            close()
        if done:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = fragments.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return rows.select("conv_id", "formatted", "token_start", "token_end", "loss_mask").mapInArrow(C.tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
