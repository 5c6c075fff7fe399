r"""Operator 10: chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole: each turn is `<|turn|>`, the role, a line end, the text, `<|end|>`, a line end.
Control strings inside roles and texts are broken by a backslash after their first character and backslashes are
doubled, so that the rendering can be read back. The rendering is encoded once, with byte offsets. The sorted spans of
the assistant's texts are intersected with the sorted token spans by binary search; the mask holds, for each token
under it, the part of its bytes that belongs to the text.

Results for odd input: a missing role or text counts as empty; rows of a conversation are in the order of turn (a
missing turn first), role and text, so ties and repeated rows stay, in a fixed order; rows without a conversation id
are one conversation; an empty table gives an empty table. Other columns don't pass. A conversation is read as a
stream of rows in order and is the largest thing in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.llm.common import per_batch
from agorametric.llm.pieces import encoder

# The markers of this template and the control strings of common templates.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = (TURN, END, "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

_BREAK = re.compile(r"\\|" + "|".join(f"{re.escape(text[0])}(?={re.escape(text[1:])})" for text in CONTROL))
_BROKEN = re.compile(r"\\(\\|n)?", re.S)
_RENDERED = re.compile(f"{re.escape(TURN)}([^\n]*)\n(.*?){re.escape(END)}\n", re.S)

SPOKEN_BY = "assistant"


def escape(text: str) -> str:
    return _BREAK.sub(lambda found: "\\\\" if found[0] == "\\" else f"{found[0]}\\", text)


def unescape(text: str) -> str:
    return _BROKEN.sub(lambda found: {"\\": "\\", "n": "\n"}.get(found[1], ""), text)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The formatted conversation, and role, first byte and byte after the last of each text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = TURN + escape(role or "").replace("\n", "\\n") + "\n"
        body = escape(text or "")
        start = at + len(head.encode())
        at = start + len(body.encode())
        spans.append((role or "", start, at))
        parts += (head, body, END, "\n")
        at += len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _RENDERED.findall(formatted)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Rows of token, first byte and byte after the last for every token that shares bytes with a span.

    Token and span borders are sorted. Empty tokens, parts of a character, go with the place where they stand.
    """
    found = [np.empty((3, 0), np.int32)]
    for start, end in spans:
        if start == end:
            continue
        first = int(np.searchsorted(starts, start))
        if first and ends[first - 1] > start:
            first -= 1
        last = int(np.searchsorted(starts, end))
        clipped = np.maximum(starts[first:last], start), np.minimum(ends[first:last], end)
        found.append(np.stack([np.arange(first, last), *clipped]))
    return np.concatenate(found, axis=1).T.astype(np.int32)


_LIST = pa.list_(pa.int32())
_SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_LOSS = pa.list_(pa.struct([("token", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_OUT = pa.schema(
    [("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", _LIST), ("starts", _LIST), ("ends", _LIST), ("spans", _SPANS), ("loss", _LOSS)]
)
_SCHEMA = (
    "conv_id bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, "
    "spans array<struct<role: string, start: int, end: int>>, loss array<struct<token: int, start: int, end: int>>"
)


def _lists(parts: list, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), values)


def _batch(done: list[tuple]) -> pa.RecordBatch:
    """Conversations as columns; no object is made per token."""
    ids, texts, *numbers, spans, loss = zip(*done)
    named = [pa.array(column, kind) for column, kind in zip(zip(*[span for part in spans for span in part]), (pa.string(), pa.int32(), pa.int32()))]
    masked = [pa.array(column) for column in np.concatenate(loss).T.copy()]
    columns = [
        pa.array(ids, pa.int64()),
        pa.array(texts, pa.string()),
        *[_lists(parts, pa.array(np.concatenate(parts).astype(np.int32))) for parts in numbers],
        _lists(spans, pa.StructArray.from_arrays(named, ["role", "start", "end"])),
        _lists(loss, pa.StructArray.from_arrays(masked, ["token", "start", "end"])),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def format_conversations(conversations: DataFrame, model: str, spoken_by: str = SPOKEN_BY) -> DataFrame:
    """One row per conversation: the formatted text, token ids with their byte spans, turn spans and the loss mask."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def one(id: int | None, turns: list[tuple[str | None, str | None]]) -> tuple:
        formatted, spans = render(turns)
        ids, starts, ends = encoder(model, False).encode(formatted.encode())
        loss = mask(starts, ends, [(start, end) for role, start, end in spans if role == spoken_by])
        return id, formatted, ids, starts, ends, spans, loss

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size, held, turns = [], 0, None, []
        for batch in batches:
            ids, _, roles, texts = (column.to_pylist() for column in batch.columns)
            for id, role, text in zip(ids, roles, texts):
                if turns and id != held:
                    done.append(one(held, turns))
                    size += len(done[-1][1])
                    turns = []
                    if size > 1 << 20:
                        yield _batch(done)
                        done, size = [], 0
                held = id
                turns.append((role, text))
        if turns:
            done.append(one(held, turns))
        if done:
            yield _batch(done)

    return dealt.mapInArrow(run, _SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What reads back from the formatted conversations and their masks."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def one(id: int | None, text: str, starts: np.ndarray, ends: np.ndarray) -> dict:
        turns, data = parse(text), text.encode()
        spoken = unescape(b"".join([data[start:end] for start, end in zip(starts.tolist(), ends.tolist())]).decode())
        return {
            "conv_id": id,
            "n_turns": len(turns),
            "turns_sha256": hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest(),
            "loss_chars": len(spoken),
            "loss_sha256": hashlib.sha256(spoken.encode()).hexdigest(),
            "formatted_chars": len(text),
        }

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        loss = batch.column("loss")
        borders, parts = loss.offsets.to_numpy(), loss.values
        starts, ends = parts.field("start").to_numpy(), parts.field("end").to_numpy()
        rows = [
            one(id.as_py(), text.as_py(), starts[first:last], ends[first:last])
            for id, text, first, last in zip(batch.column("conv_id"), batch.column("formatted"), borders, borders[1:])
        ]
        yield pa.RecordBatch.from_pylist(rows, schema)

    shape = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return per_batch(formatted.select("conv_id", "formatted", "loss"), shape, run)
