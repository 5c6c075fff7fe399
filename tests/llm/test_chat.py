from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from agorametric.llm import chat
from agorametric.llm.common import prepare
from agorametric.llm.queries import piece_model, queries

MARKUP = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\n", "n", "<", "[", "é", "🎉", " ok "])).map("".join)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(turns):
    spoken = "".join(text or "" for role, text in turns if role == "assistant")
    said = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    return len(turns), sha(said), len(spoken), sha(spoken)


@settings(max_examples=300, deadline=None)
@given(MARKUP, MARKUP)
def test_escapes_read_back(role, text):
    for control in chat.CONTROL:
        assert control not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text
    formatted, spans = chat.render([(role, text), ("assistant", text)])
    assert chat.parse(formatted) == [(role, text), ("assistant", text)]
    assert [chat.unescape(formatted.encode()[start:end].decode()) for _, start, end in spans] == [text, text]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), MARKUP), max_size=4))
def test_mask_covers_each_text_once(turns):
    formatted, spans = chat.render(turns)
    data = formatted.encode()
    _, starts, ends = chat.encoder(piece_model(), False).encode(data)
    chosen = [(start, end) for role, start, end in spans if role == "assistant"]
    loss = chat.mask(starts, ends, chosen)
    assert b"".join(data[start:end] for _, start, end in loss) == b"".join(data[start:end] for start, end in chosen)
    slow = [at for at, (a, b) in enumerate(zip(starts, ends)) if any(max(a, s) < min(b, e) or a == b and s <= a < e for s, e in chosen)]
    assert [token for token, _, _ in loss] == slow


def test_whole_table(spark):
    turns = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for row in sorted(pq.read_table(Path(SMALL) / "conversations.parquet").to_pylist(), key=lambda row: row["turn"]):
        turns.setdefault(row["conv_id"], []).append((row["role"], row["text"]))
    rows = queries()["op10_chat_masks"](spark, SMALL).collect()
    assert sorted(row["conv_id"] for row in rows) == sorted(turns)
    for row in rows:
        assert tuple(row[1:5]) == plain(turns[row["conv_id"]])


def test_odd_rows(spark):
    long = "word </s> " * 50_000
    rows = [(None, 0, "user", "a"), (1, None, "assistant", None), (1, 0, None, "\\"), (1, 0, None, "\\"), (2, 1, "assistant", long), (2, 0, "us\ner", "")]
    frame = prepare(spark).createDataFrame([(*row, "x") for row in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {row["conv_id"]: tuple(row[1:5]) for row in chat.digests(chat.format_conversations(frame, piece_model())).collect()}
    assert found == {
        None: plain([("user", "a")]),
        1: plain([("assistant", None), (None, "\\"), (None, "\\")]),
        2: plain([("us\ner", ""), ("assistant", long)]),
    }
    assert chat.format_conversations(frame.limit(0), piece_model()).count() == 0


@pytest.mark.parametrize("spans", [[], [(3, 3)]])
def test_nothing_under_the_mask(spans):
    _, starts, ends = chat.encoder(piece_model(), False).encode(b"some text")
    assert chat.mask(starts, ends, spans).shape == (0, 3)
