from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import SMALL

from agorametric.llm import line_dedup
from agorametric.llm.common import prepare, table
from agorametric.session import temporary_settings

_BLANKS = "\t\n\x0b\x0c\r "


def key_of(line):
    return re.sub("[A-Z]", lambda found: found[0].lower(), line.strip(_BLANKS))


def plain(rows):
    """Kept text, number of lines and of dropped lines, per row (id, text)."""

    def place(id):
        return id is None, id or 0

    owners, holders = {}, {}
    for id, text in rows:
        for line in (text or "").split("\n"):
            key = key_of(line)
            owners[key] = min(owners.get(key, place(id)), place(id))
            holders.setdefault(key, set()).add(id)
    found = []
    for id, text in rows:
        lines = (text or "").split("\n")
        gone = [len(key_of(line)) >= 10 and len(holders[key_of(line)]) > 1 and owners[key_of(line)] != place(id) for line in lines]
        found.append((id, "\n".join(line for line, out in zip(lines, gone) if not out), len(lines), sum(gone)))
    return sorted(found, key=str)


def run(frame, tasks="4"):
    with temporary_settings(frame.sparkSession, {"spark.sql.shuffle.partitions": tasks}):
        bitmaps = line_dedup.keep_bitmaps(frame)
        cut = line_dedup._cut(frame, bitmaps, "text", "doc_id")
        found = [(row["row"]["doc_id"], row["kept"], row["n_lines"], row["n_dropped"]) for row in cut.collect()]
        kept = [tuple(row) for row in line_dedup.apply(frame, bitmaps).select("doc_id", "text").collect()]
    assert sorted(kept, key=str) == sorted([row[:2] for row in found], key=str)
    return sorted(found, key=str)


ODD = [
    (None, "a line of no document\nshared by many rows"),
    (None, "a line of no document"),
    (7, None),
    (7, ""),
    (8, "\n\n"),
    (3, " Shared By many rows\t\nown\nown line number three\nown line number three"),
    (5, "shared by many rows\nshared by many rows\r\nten chars!\nnine char"),
    (5, "shared by many rows\nshared by many rows\r\nten chars!\nnine char"),
    (5, "the same id, another text\nshared by many rows"),
    (6, "TEN CHARS!\nNINE CHAR\nthe same id, another text"),
    (9, "ÄÖÜäöüßéáñ\n shared by many rows"),
    (10, "äöüäöüßéáñ\nÄÖÜäöüßéáñ\nñññññññññİ"),
    (11, "ñññññññññİ\nñññññññññ"),
    (12, "ñññññññññ\n" + "long " * 100_000),
    (13, "long " * 100_000 + "\n" + "x"),
    (-4, "ten chars!"),
    (1 << 62, "ten chars!\nown line number three"),
]


@pytest.mark.parametrize("tasks", ["1", "3", "16"])
def test_odd_rows(spark, tasks):
    frame = prepare(spark).createDataFrame([(*row, 1, "x") for row in ODD], "doc_id long, text string, line int, missing string")
    assert run(frame, tasks) == plain(ODD)
    assert line_dedup.apply(frame, line_dedup.keep_bitmaps(frame)).columns == frame.columns


def test_empty_table(spark):
    frame = prepare(spark).createDataFrame([], "doc_id long, text string")
    assert run(frame) == []


def test_frequent_line_over_many_tasks(spark):
    """A line in all documents and more tasks than other lines: what a task cannot know is settled by the others."""
    drawn = random.Random(4)
    rows = [(drawn.randrange(-500, 500), "\n".join(drawn.choice(["a frequent line", "another line %d" % drawn.randrange(9), "x"]) for _ in range(drawn.randrange(6)))) for _ in range(600)]
    rows += [(900 + at, "a frequent line\n" * 300) for at in range(3)]
    frame = prepare(spark).createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(frame, "24") == plain(rows)


def test_whole_table(spark):
    frame = table(prepare(spark), SMALL, "documents").select("doc_id", "text")
    assert run(frame) == plain([tuple(row) for row in frame.collect()])


def test_bitmaps():
    for n, gone in ((1, []), (1, [0]), (9, [0, 8]), (1000, list(range(500)))):
        bits = line_dedup.unpacked(line_dedup.packed(n, np.array(gone, int)), n)
        assert np.flatnonzero(~bits).tolist() == gone and len(bits) == n
