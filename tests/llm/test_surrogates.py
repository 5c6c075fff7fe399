from __future__ import annotations

import re
from pathlib import Path

import pyarrow.parquet as pq
from conftest import SMALL, plan_of
from pyspark.sql import functions as F

from agorametric.llm import surrogates
from agorametric.llm.common import prepare
from agorametric.llm.queries import queries

# The planted kinds, as plain patterns.
PLAIN = {
    "mail": r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+",
    "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "network": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d])",
    "secret": r"\b[0-9a-f]{40}\b",
    "card": r"(?<!\d)\d{16}(?!\d)",
}
ANY = re.compile("|".join(PLAIN.values()))


def kind(entity):
    return next(name for name, pattern in PLAIN.items() if re.fullmatch(pattern, entity, re.A))


def changed(spark, texts, key="k"):
    frame = prepare(spark).createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [row["text"] for row in surrogates.replace_entities(frame, key).orderBy("doc_id").collect()]


def test_whole_table(spark):
    """Each planted entity is replaced by one of its kind, always the same, no two alike; all else stays."""
    before = {row["doc_id"]: row["text"] for row in pq.read_table(Path(SMALL) / "documents.parquet").to_pylist()}
    found = queries()["op6_surrogates"](spark, SMALL)
    assert "Python" not in plan_of(found) and "Arrow" not in plan_of(found)
    given, n_found = {}, 0
    for row in found.collect():
        old = before[row["doc_id"]]
        assert ANY.split(old) == ANY.split(row["text"])
        entities, replaced = ANY.findall(old), ANY.findall(row["text"])
        assert row["n_entities"] == len(entities) == len(replaced)
        n_found += len(entities)
        for one, other in zip(entities, replaced):
            assert kind(one) == kind(other) and one != other and len(one) == len(other) or kind(one) == "network"
            assert given.setdefault(one, other) == other
    assert n_found > 5 and len(set(given.values())) == len(given) and not set(given) & set(given.values())


def test_spellings_of_one_entity_match(spark):
    one, two, three = changed(spark, ["Call +1 (487) 555-7209 or A.b@Mail.org", "+1 487-555-7209", "to a.B@mail.org."])
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two)
    assert one.split()[-1].lower() == three.split()[-1].rstrip(".").lower() and one.endswith(".org")
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or [A-Z]\.[a-z]@[A-Z][a-z]{3}\.org", one)
    assert changed(spark, ["1.2.3.4"], "k") != changed(spark, ["1.2.3.4"], "other")


def test_names_keep_title_gender_and_script(spark):
    one, two, three, four = changed(spark, ["Mrs. Anna Smith said", "Frau Anna Smith", "Herr Anna Smith", "Госпожа Анна Белова тут"])
    assert re.fullmatch(r"Mrs\. [A-Z][a-z]+na [A-Z][a-z]+r said", one) and two.split()[1:] == one.split()[1:3]
    assert re.fullmatch(r"Herr [A-Z][a-z]+n [A-Z][a-z]+r", three)
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+на [А-Я][а-я]+р тут", four)


def test_collisions_are_drawn_again(spark):
    """Far more names than there are names of three syllables."""
    texts = [f"Mr {chr(65 + a)}{chr(97 + b)}{chr(97 + c)} here" for a in range(12) for b in range(20) for c in range(20)]
    found = changed(spark, [*texts, texts[0], texts[1]])
    assert len(set(found)) == len(texts) and not set(found) & set(texts)
    assert found[-2:] == found[:2]


def test_collisions_are_found_and_drawn_again_over_all_spellings(spark):
    """More names than there are of three syllables, and mails that fill much of their layout, in several spellings."""
    names = [chr(65 + a) + chr(97 + b) + chr(97 + c) for a in range(12) for b in range(20) for c in range(20)]
    titles = ["Mr ", "Mr. ", "Herr ", "Господин "]
    mails = [f"{chr(97 + a)}@{chr(97 + b)}.org" for a in range(12) for b in range(12)]
    # Every entity begins with another spelling than its neighbour; every third has only one.
    people = [[titles[(at + n) % 4] + name for n in range(1 + at % 3)] for at, name in enumerate(names)]
    people += [[mail, mail.title()][at % 2 :] for at, mail in enumerate(mails)]
    found = iter(changed(spark, [text for spellings in people for text in spellings]))
    given = [{next(found).split(" ")[-1].lower() for _ in spellings} for spellings in people]
    assert all(len(forms) == 1 for forms in given)
    assert len(set.union(*given)) == len(people)
    assert not set.union(*given) & {name.lower() for name in [*names, *mails]}


def test_a_small_space_of_replacements_ends(spark):
    """Most of all addresses of one layout: there are not enough others of that length."""
    mails = [f"{chr(97 + at // 26)}@{chr(97 + at % 26)}.de" for at in range(500)]
    found = changed(spark, mails)
    assert len(set(found)) == 500 and not set(found) & set(mails)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.de", mail) for mail in found)


def test_whole_names(spark):
    """Inner capitals, apostrophes and hyphens belong to a name, a possessive ending does not; titles of either gender."""
    [found] = changed(spark, ["Mr McDonald and Frau Meyer-Schulz met Mr O'Brien, Dr Smith and Prof. Lee; Dr Smith's car"])
    assert re.fullmatch(r"Mr (\p{L})".replace("\\p{L}", "[A-Z][a-z]+r") + r" and Frau [A-Z][a-z]+r met Mr [A-Z][a-z]+r, Dr ([A-Z][a-z]+r) and Prof\. [A-Z][a-z]+r; Dr \2's car", found)
    [one, two] = changed(spark, ["a.b@x.com", "ab@x.com"])
    assert one.replace(".", "") != two.replace(".", "")


def test_clean_texts_stay(spark):
    texts = [None, "", "plain 2023 and 4.0, version 2.0.", "Mr", "a@b", "1.2.3", "0x12", "9" * 17, "x " * 200_000, "12345678901234567890123456789012345678901"]
    assert changed(spark, texts) == texts


def test_odd_rows(spark):
    frame = prepare(spark).createDataFrame(
        [(None, "1.2.3.4", 7, "e"), (1, "1.2.3.4 1.2.3.4", 0, "e"), (1, "1.2.3.4 1.2.3.4", 0, "e")],
        "doc_id long, text string, n_chars int, entity string",
    )
    found = surrogates.replace_entities(frame, "k")
    assert found.columns == frame.columns
    one, *rest = found.select("text").orderBy(F.length("text")).collect()
    assert [row["text"] for row in rest] == [f"{one['text']} {one['text']}"] * 2
    assert surrogates.replace_entities(frame.limit(0), "k").count() == 0
