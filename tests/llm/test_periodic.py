from __future__ import annotations

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from agorametric.llm import periodic
from agorametric.llm.common import prepare
from agorametric.llm.queries import planted_repeats, queries


def plain_runs(words, least=12):
    """Every lag at every place."""
    found = {}
    for lag in range(1, len(words) // 2 + 1):
        at = 0
        while at + lag < len(words):
            end = at
            while end + lag < len(words) and words[end] == words[end + lag]:
                end += 1
            length = end - at + lag
            if end > at and length >= max(least, 2 * lag):
                found.setdefault((at, length), lag)
            at = max(end, at) + 1
    return sorted((start, length, lag) for (start, length), lag in found.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(id, text):
    """The contract, word by word."""
    words = [word for word in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if word]
    h, n = zlib.crc32(str(id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = min(((-length, start, period) for start, length, period in runs), default=None)
    one = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    return (id, len(runs), *one, sha(listed), sha(" ".join(word for i, word in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_random_texts(seed):
    """Small alphabets, periods inside periods, and prose around them."""
    drawn = random.Random(seed)
    texts = []
    for _ in range(12):
        words = []
        while len(words) < drawn.choice([0, 11, 12, 40, 150, 400]):
            kind = drawn.random()
            some = [b"%d" % drawn.randrange(drawn.choice([1, 2, 3, 8, 500])) for _ in range(drawn.randrange(1, 30))]
            words += some if kind < 0.4 else (some * 20)[: drawn.randrange(1, 90)]
        texts.append(words)
    assert periodic.runs_of_texts(texts) == [plain_runs(words) for words in texts]


@pytest.mark.parametrize("period", [1, 2, 3, 5, 6, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100])
def test_shortest_run_of_each_period(period):
    unit = [b"u%d" % at for at in range(period)]
    for length in (max(12, 2 * period) - 1, max(12, 2 * period), max(12, 2 * period) + 1):
        for before in range(5):
            words = [b"x%d" % at for at in range(before)] + (unit * 14)[:length] + [b"y"]
            assert periodic.runs_of_texts([words]) == [plain_runs(words)]


def test_long_text_of_one_word_and_of_prose():
    assert periodic.runs_of_texts([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    drawn = random.Random(1)
    prose = [b"w%d" % drawn.randrange(50) for _ in range(3000)]
    texts = [prose + prose, prose]
    assert periodic.runs_of_texts(texts) == [plain_runs(words) for words in texts]


def test_splitting_leaves_little_of_prose():
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column(0).to_pylist()
    words = [word for text in rows[:50] for word in (text or "").split()]
    numbers = {word: at for at, word in enumerate(dict.fromkeys(words))}
    import numpy as np

    ids = np.array([numbers[word] for word in words])
    segment = np.repeat(np.arange(50), [len((text or "").split()) for text in rows[:50]])
    left = periodic.surviving(ids, segment)
    assert sum(high - low for low, high in left) < 0.4 * len(words)
    assert all(segment[low] == segment[high - 1] and high - low >= 12 for low, high in left)


def test_whole_table(spark):
    found = queries()["op11_periodic_runs"](spark, SMALL)
    assert [name for name, _ in found.dtypes] == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    rows = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    exact = [plain_row(row["doc_id"], row["text"]) for row in rows]
    assert sorted(map(tuple, found.collect())) == sorted(exact)
    assert sum(row[1] > 0 for row in exact) > 10


def test_odd_rows(spark):
    rows = [(None, "a b " * 9, 1), (3, None, 1), (3, "", 2), (4, "x " * 30, 3), (4, "x " * 30, 3), (5, " ".join("ab") + " " + "é é " * 14, 4)]
    frame = prepare(spark).createDataFrame(rows, "doc_id long, text string, runs int")
    found = [(row["doc_id"], row["n_words"], [tuple(run) for run in row["runs"]], row["collapsed"]) for row in periodic.find_runs(frame).collect()]
    assert found == [
        (None, 18, [(0, 18, 2)], "a b"),
        (3, 0, [], ""),
        (3, 0, [], ""),
        (4, 30, [(0, 30, 1)], "x"),
        (4, 30, [(0, 30, 1)], "x"),
        (5, 15, [(1, 14, 1)], "a b é é"),
    ]
    assert periodic.digests(periodic.find_runs(frame.limit(0))).count() == 0
    digests = periodic.digests(periodic.find_runs(frame, planted_repeats)).collect()
    assert digests[1]["start"] is None and digests[1]["runs_sha256"] == sha("")
