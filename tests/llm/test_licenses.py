from __future__ import annotations

import re
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from agorametric.llm import licenses
from agorametric.llm.common import prepare
from agorametric.llm.queries import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(letter.lower() if "A" <= letter <= "Z" else letter for letter in text or ""))


def plain_pattern(template):
    """The same template as a regular expression over words that each end in a blank."""

    def region(tag):
        if tag[1] == "optional":
            return " (?: "
        if tag[1] == "/optional":
            return " )? "
        return f" (?:(?:{tag[4] or '[^~]+'})~){{{tag[2]},{tag[3]}}} "

    marked = licenses._TAG.sub(region, template)
    parts = [part if part[0] in "()" else f"{part}~" for part in marked.split()]
    return re.compile("".join(parts).replace("[^~]", "\\S").replace("~", " "))


def plain_scan(text):
    words = plain_words(text)
    line = "".join(f"{word} " for word in words)
    starts = [0]
    for word in words:
        starts.append(starts[-1] + len(word) + 1)
    found = []
    for label, templates in {**licenses.BASE, **licenses.TEMPLATES}.items():
        for template in templates:
            pattern = plain_pattern(template)
            for at, start in enumerate(starts[:-1]):
                if match := pattern.match(line, start):
                    found.append((label, at, starts.index(match.end())))
    base = [place for place in found if place[0] in licenses.BASE]
    in_place = {at for _, start, end in found for at in range(start, end)}
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((start for _, start, _ in base), default=None),
        "last_word": max((start for _, start, _ in base), default=None),
        "base_labels": ",".join(sorted({label for label, _, _ in base})),
        "labels": ",".join(sorted({label for label, _, _ in found})),
        "score": len(in_place) / len(words) if words else 0.0,
    }


def test_whole_table_against_regular_expressions(spark):
    texts = {row["doc_id"]: row["text"] for row in pq.read_table(Path(SMALL) / "documents.parquet").to_pylist()}
    rows = [row.asDict() for row in queries()["op4_license_templates"](spark, SMALL).collect()]
    assert len(rows) == len(texts) and any(row["labels"] for row in rows)
    for row in rows:
        assert row == {"doc_id": row["doc_id"], **plain_scan(texts[row["doc_id"]])}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("licensed under Apache License 2.0", "apache-2.0"),
        ("licensed under the Apache License, Version 3.0", ""),
        ("Copyright (c) 2019, 2020 A. N. Author\nAll rights reserved.", "copyright,reserved"),
        ("Copyright (c) Author. All rights reserved.", "reserved"),
        ("Licensed under a CC BY-NC-SA 4.0", "cc-by,cc-by-nc"),
        ("Licensed under the GNU General Public License, version 3 of the License", "gpl,gpl-3.0"),
        ("ALL RIGHTS RESERVED", ""),
        ("xcc by", ""),
        ("cc by cc by", "cc-by"),
    ],
)
def test_notices(text, labels):
    assert plain_scan(text)["labels"] == labels
    _, places = licenses.Scanner({**licenses.BASE, **licenses.TEMPLATES})(text.encode())
    assert ",".join(sorted({label for label, _, _ in places})) == labels


def test_odd_rows(spark):
    long = "cc by " * 100_000
    rows = [(1, None), (1, ""), (None, "CC-BY"), (4, long), (4, long), (5, "...")]
    frame = prepare(spark).createDataFrame([(id, text, 1) for id, text in rows], "doc_id int, text string, n_words int")
    found = licenses.digests(licenses.scan(frame)).collect()
    assert [row["n_base"] for row in found] == [0, 0, 1, 100_000, 100_000, 0]
    assert [row["score"] for row in found] == [0, 0, 1, 1, 1, 0]
    assert licenses.digests(licenses.scan(frame.limit(0))).count() == 0


@pytest.mark.parametrize("template", ["", "<<optional>>a<</optional>> b", "<<words 0..2>> b", "a <<optional>> b"])
def test_templates_that_do_not_start_with_wording_or_end(template):
    if template.startswith("<<optional>>"):
        assert list(licenses.Automaton(template).places([b"b"])) == [(0, 1)]
    else:
        with pytest.raises(ValueError):
            licenses.Automaton(template)
