"""Operator 4: license scans by template markup.

A template is wording with regions: `<<optional>>…<</optional>>` may be left out, and `<<words a..b>>` or
`<<words a..b match>>` stands for that many words, each of which the pattern matches in full. Templates are compiled
into automata over words, which are made deterministic as texts need it. A place is accepted where all mandatory
wording stands, word by word. Phrases without regions are templates too.

Results for odd input: a missing or empty text has no words and no match, and scores zero; places may overlap, and
each counts; repeated rows give repeated results; an empty table gives an empty table. Only the id column passes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.llm.common import per_batch, slices

# Label and wording of the base phrases.
BASE = {
    "cc-by": ["cc by"],
    "gpl": ["general public license"],
    "reserved": ["all rights reserved"],
}

# Notices and grants, by label.
TEMPLATES = {
    "apache-2.0": [
        "licensed under <<optional>>the terms of<</optional>> <<optional>>the<</optional>> apache license "
        "<<optional>>version<</optional>> 2 0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ],
    "cc-by-nc": [
        "licensed under <<optional>>a<</optional>> cc by nc <<optional>>sa<</optional>> <<words 0..2 [0-9]+>>",
        "licensed under <<optional>>a<</optional>> creative commons attribution noncommercial "
        "<<optional>>sharealike<</optional>> <<words 0..2 [0-9]+>> <<optional>>international<</optional>> license",
    ],
    "copyright": [
        "copyright <<optional>>c<</optional>> <<words 1..3 [0-9]{4}>> <<words 1..8>> all rights reserved",
    ],
    "gpl-3.0": [
        "licensed under the <<optional>>terms of the<</optional>> gnu general public license "
        "<<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> "
        "version 3 <<optional>>of the license<</optional>>",
    ],
    "mit": [
        "under <<optional>>the terms of<</optional>> the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of <<words 1..8>> "
        "<<optional>>and associated documentation files<</optional>> <<optional>>the software<</optional>> "
        "to deal in the software without restriction",
    ],
}

_TAG = re.compile(r"<<(optional|/optional|words (\d+)\.\.(\d+)(?: ([^>]+))?)>>")
# Letters become small, what is no letter, digit or byte beyond ASCII becomes a blank.
_FOLD = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte > 127 else 32
    for byte in range(256)
)
_STATES_KEPT = 20_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Accepts the word sequences of one template."""

    def __init__(self, template: str) -> None:
        # Per state: word to next states; patterns with next states; states reached without a word.
        self._by_word: list[dict[bytes, list[int]]] = [defaultdict(list)]
        self._by_class: list[list[tuple[re.Pattern | None, int]]] = [[]]
        self._free: list[list[int]] = [[]]
        self.mandatory: list[bytes] = []
        self._final = self._compile(template)
        self._alphabet = {word for edges in self._by_word for word in edges}
        self._classes = [pattern for edges in self._by_class for pattern, _ in edges if pattern]
        self._steps: dict[tuple, frozenset[int]] = {}
        self.start = self._closed({0})
        self.firsts = {word for state in self.start for word in self._by_word[state]}
        if not self.mandatory or any(self._by_class[state] for state in self.start) or self._final in self.start:
            raise ValueError("a template starts with wording")
        self.rarest = max(self.mandatory, key=len)

    def _state(self) -> int:
        self._by_word.append(defaultdict(list))
        self._by_class.append([])
        self._free.append([])
        return len(self._free) - 1

    def _compile(self, template: str) -> int:
        at, opened, end = 0, [], 0
        for tag in [*_TAG.finditer(template), None]:
            for word in words_of(template[end : tag.start() if tag else None].encode()):
                after = self._state()
                self._by_word[at][word].append(after)
                at = after
                if not opened:
                    self.mandatory.append(word)
            if tag is None:
                break
            end = tag.end()
            if tag[1] == "optional":
                opened.append(at)
            elif tag[1] == "/optional":
                self._free[opened.pop()].append(at)
            else:
                least, most = int(tag[2]), int(tag[3])
                pattern = re.compile(tag[4].encode()) if tag[4] else None
                last, skipped = at, []
                for count in range(most):
                    if count >= least:
                        skipped.append(last)
                    after = self._state()
                    self._by_class[last].append((pattern, after))
                    last = after
                for state in skipped:
                    self._free[state].append(last)
                at = last
        if opened:
            raise ValueError("an optional region is not closed")
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        found, rest = set(states), list(states)
        while rest:
            for state in self._free[rest.pop()]:
                if state not in found:
                    found.add(state)
                    rest.append(state)
        return frozenset(found)

    def _step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        # Words outside the wording behave alike if the same patterns match them.
        kind = word if word in self._alphabet else tuple(bool(pattern.fullmatch(word)) for pattern in self._classes)
        found = self._steps.get((states, kind))
        if found is None:
            reached = {after for state in states for after in self._by_word[state].get(word, ())}
            reached |= {
                after
                for state in states
                for pattern, after in self._by_class[state]
                if pattern is None or pattern.fullmatch(word)
            }
            if len(self._steps) >= _STATES_KEPT:
                self._steps.clear()
            found = self._steps[states, kind] = self._closed(reached)
        return found

    def places(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """First word and word after the last of each accepted place; the longest from each start."""
        for start, word in enumerate(words):
            if word not in self.firsts:
                continue
            states, end, at = self.start, None, start
            while states and at < len(words):
                states = self._step(states, words[at])
                at += 1
                if self._final in states:
                    end = at
            if end:
                yield start, end


class Scanner:
    """All templates over one text."""

    def __init__(self, templates: dict[str, list[str]]) -> None:
        self._automata = [(label, Automaton(text)) for label, texts in templates.items() for text in texts]

    def __call__(self, text: bytes | None) -> tuple[int, list[tuple[str, int, int]]]:
        """The number of words, and label, first word and word after the last of every place."""
        folded = (text or b"").translate(_FOLD)
        words = folded.split()
        found = [
            (label, start, end)
            for label, automaton in self._automata
            if automaton.rarest in folded
            for start, end in automaton.places(words)
        ]
        return len(words), sorted(found, key=lambda place: (place[1], place[2], place[0]))


def covered(places: list[tuple[str, int, int]]) -> int:
    """Words in at least one place; the places are in order of their starts."""
    total = reached = 0
    for _, start, end in places:
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total


_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(documents: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document doc_id, n_words, n_covered and `places` (label, start, end in words). One narrow pass."""
    templates = {**BASE, **TEMPLATES} if templates is None else templates
    rows = documents.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanners: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not scanners:
            scanners.append(Scanner(templates))
        texts = batch.column(1).to_pylist()
        for start, stop in slices(texts):
            found = [scanners[0](data) for data in texts[start:stop]]
            columns = [
                batch.column(0).slice(start, stop - start),
                pa.array([count for count, _ in found], pa.int64()),
                pa.array([covered(places) for _, places in found], pa.int64()),
                pa.array([[dict(zip(("label", "start", "end"), place)) for place in places] for _, places in found], _PLACES),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_covered", "places"])

    places = "array<struct<label: string, start: bigint, end: bigint>>"
    return per_batch(rows, f"doc_id {kind}, n_words bigint, n_covered bigint, places {places}", run)


def digests(scanned: DataFrame) -> DataFrame:
    """Counts, first and last base place, labels, and the share of words in any place."""
    base = F.filter("places", lambda place: place["label"].isin(*BASE))
    starts = F.transform(base, lambda place: place["start"])

    def joined(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda place: place["label"]))), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(0.0).alias("score"),
    )
