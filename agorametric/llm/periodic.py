"""Operator 11: periodic runs of words by recursive frequency splitting.

A run is a stretch of consecutive words in which words `period` apart are equal, at least `LEAST` words and two periods
long, that no neighbouring word extends; its period is the smallest such number. Two periods in a run mean that each of
its words stands there at least twice. So a word that occurs fewer times within a segment belongs to no run of it: it
splits the segment, and since the parts hold fewer words, counting and splitting repeat until nothing changes. Parts
shorter than a run go. In prose nearly everything is gone after a few rounds.

The segments that survive are scanned lag by lag. Words and then groups of 2, 4, 8, … words get numbers, equal ones the
same. A stretch that repeats at a lag covers a whole tile of half the lag's power of two, so only tiles are compared:
in all about two comparisons a word for each doubling of the lag. The matching tiles are extended to both sides by the
groups' numbers. The work is n log n for any text, and a segment of n words takes about 4 log2(n) bytes a word.

One narrow pass; many texts are split and scanned together. Results for odd input: a missing or empty text has no words
and no runs; runs of different periods may overlap and each counts; repeated rows give repeated results; a missing id
stays missing; an empty table gives an empty table. Only the id column passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.llm.common import per_batch, slices

# Fewest words of a run.
LEAST = 12
# Occurrences of each word of a run: it spans two periods.
_TIMES = 2
# Tiles compared in one step.
_STEP = 1 << 20

Rewrite = Callable[[object, list[bytes]], list[bytes]]
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def surviving(ids: np.ndarray, segment: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of places that may hold runs; `ids` are words as numbers, `segment` rises from text to text."""
    size = int(ids.max(initial=0)) + 1
    # A word that stands once among all texts is rare in its own.
    often = np.bincount(ids, minlength=1)[ids] >= _TIMES if len(ids) else np.zeros(0, bool)
    places, segment = _long_enough(np.flatnonzero(often), segment[often], least)
    while len(places):
        _, which, times = np.unique(segment * size + ids[places], return_inverse=True, return_counts=True)
        often = times[which] >= _TIMES
        if often.all():
            break
        places, segment = _long_enough(places[often], segment[often], least)
    borders = np.flatnonzero(np.diff(segment)) + 1
    return [(int(part[0]), int(part[-1]) + 1) for part in np.split(places, borders) if len(part)]


def _long_enough(places: np.ndarray, segment: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that are left, with new numbers of their segments, without segments that are too short."""
    fresh = np.ones(len(places), bool)
    fresh[1:] = (np.diff(places) != 1) | (np.diff(segment) != 0)
    number = np.cumsum(fresh) - 1
    kept = np.bincount(number, minlength=1)[number] >= least if len(places) else fresh
    return places[kept], number[kept]


def lag_scan(segments: list[np.ndarray], least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """Runs (segment, start, length, period) of the segments, whose words are numbers from zero."""
    order = sorted(range(len(segments)), key=lambda at: -len(segments[at]))
    sizes = np.array([len(segments[at]) for at in order])
    if not len(sizes):
        return []
    # A separator of its own follows each segment: nothing that holds one occurs twice.
    above = max(int(part.max()) for part in segments) + 1
    words = np.concatenate([np.append(segments[at], above + place) for place, at in enumerate(order)])
    ends = np.cumsum(sizes + 1)

    def reach(length: int) -> int:
        """Words of the segments that are so long; they stand first."""
        count = int((sizes >= length).sum())
        return int(ends[count - 1]) if count else 0

    groups = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
    while (stop := reach(2 << len(groups) - 1)) >= 2 << len(groups) - 1:
        half, last = 1 << len(groups) - 1, groups[-1]
        count = min(stop - 2 * half + 1, len(last) - half)
        pairs = last[:count].astype(np.int64) * (int(last.max()) + 1) + last[half : half + count]
        groups.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    found = []
    lag = 1
    while lag <= sizes[0] // 2:
        # Lags below 8 match over six words at least, others over as many words as the lag.
        level = 1 if lag < 8 else lag.bit_length() - 2
        after = min(8 if lag < 8 else 2 * lag, int(sizes[0]) // 2 + 1)
        found.append(_matches(groups, level, lag, after, reach(max(least, 2 * lag)), least))
        lag = after
    start, length, period = np.concatenate(found, axis=1)
    # The same words with several periods: the smallest counts.
    ranked = np.lexsort((period, length, start))
    start, length, period = start[ranked], length[ranked], period[ranked]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, period = start[first], length[first], period[first]
    place = np.searchsorted(ends, start, side="right")
    offset = start - (ends[place] - sizes[place] - 1)
    return [(order[at], *rest) for at, *rest in zip(place.tolist(), offset.tolist(), length.tolist(), period.tolist())]


def _matches(groups: list[np.ndarray], level: int, first: int, after: int, stop: int, least: int) -> np.ndarray:
    """Runs (start, length, lag) for the lags from `first` to before `after`, from matching tiles of 2^level words."""
    numbers, tile = groups[level], 1 << level
    places = np.arange(0, min(stop, len(numbers)), tile)
    found = [np.zeros((3, 0), np.int64)]
    step = max(1, _STEP // max(1, len(places)))
    for low in range(first, after, step):
        lags = np.arange(low, min(low + step, after))
        other = places[None, :] + lags[:, None]
        equal = other < len(numbers)
        equal &= numbers[places][None, :] == numbers[np.minimum(other, len(numbers) - 1)]
        # Tiles in a row belong to one stretch.
        equal[:, 1:] &= ~equal[:, :-1]
        which, at = np.nonzero(equal)
        lag = lags[which]
        begin, end = _extended(groups, places[at], lag, tile)
        length = end - begin + lag
        kept = length >= np.maximum(least, 2 * lag)
        found.append(np.unique(np.stack([begin[kept], length[kept], lag[kept]]), axis=1))
    return np.concatenate(found, axis=1)


def _extended(groups: list[np.ndarray], at: np.ndarray, lag: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of places that equal the place `lag` later, around tiles known to match."""
    begin, end = at.copy(), at + tile

    def grown(level: int, forward: bool) -> bool:
        numbers, width = groups[level], 1 << level
        left = end if forward else begin - width
        inside = np.flatnonzero((left >= 0) & (left + lag < len(numbers)))
        same = inside[numbers[left[inside]] == numbers[left[inside] + lag[inside]]]
        if forward:
            end[same] += width
        else:
            begin[same] -= width
        return len(same) > 0

    for forward in (True, False):
        while grown(len(groups) - 1, forward):
            pass
        for level in range(len(groups) - 2, -1, -1):
            grown(level, forward)
    return begin, end


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Per text, a list of words, its runs (start, length, period) in order."""
    counts = np.array([len(words) for words in texts], np.int64)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not counts.sum():
        return found
    every = pa.array([word for words in texts for word in words], pa.large_binary())
    ids = every.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    ranges = surviving(ids, np.repeat(np.arange(len(texts)), counts), least)
    for at, start, length, period in lag_scan([ids[low:high] for low, high in ranges], least):
        low = ranges[at][0]
        # Of texts that begin at the same place all but the last are empty.
        text = int(np.searchsorted(starts, low, side="right")) - 1
        found[text].append((low - int(starts[text]) + start, length, period))
    return [sorted(runs) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return list(compress(words, np.cumsum(change[:-1]) == 0))


def find_runs(
    documents: DataFrame, rewrite: Rewrite | None = None, text: str = "text", id: str = "doc_id", least: int = LEAST
) -> DataFrame:
    """Per document doc_id, n_words, `runs` (start, length, period) in order, and `collapsed`, the text without repeats.

    Words are split at ASCII blanks. `rewrite` gets a document's id and words and gives the words to work on.
    """
    rows = documents.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for start, stop in slices(texts):
            words = [(data or b"").split() for data in texts[start:stop]]
            own = ids.slice(start, stop - start)
            if rewrite:
                words = [rewrite(*pair) for pair in zip(own.to_pylist(), words)]
            found = runs_of_texts(words, least)
            columns = [
                own,
                pa.array(map(len, words), pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), run)) for run in runs] for runs in found], _RUNS),
                pa.array([b" ".join(collapsed(*pair)) for pair in zip(words, found)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    runs = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return per_batch(rows, f"doc_id {kind}, n_words bigint, runs {runs}, collapsed string", run)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    longest = F.array_min(F.transform("runs", lambda run: F.struct((-run["length"]).alias("shortness"), run["start"].alias("start"), run["period"].alias("period"))))
    listed = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    start, length, period = longest["start"], -longest["shortness"], longest["period"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        ((1000 * length - (1000 * length) % period) / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
