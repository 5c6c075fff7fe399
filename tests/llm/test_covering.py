from __future__ import annotations

import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import SMALL

from agorametric.llm import covering
from agorametric.llm.common import prepare
from agorametric.llm.components import components
from agorametric.llm.queries import queries

SCHEMA = "doc_id long, text string, fp string"


def plain_print(text):
    words = [word for word in "".join(map(chr_lower, text or "")).translate(BLANKS).split(" ") if word]
    shingles = [" ".join(words[at : at + 4]) for at in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


BLANKS = {code: " " for code in (0x20, *range(9, 14))}


def chr_lower(letter):
    return letter.lower() if "A" <= letter <= "Z" else letter


def plain_components(rows, radius=4):
    prints = [plain_print(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for left, right in combinations(range(len(rows)), 2):
        if (prints[left] ^ prints[right]).bit_count() <= radius:
            parent[find(left)] = find(right)
    ids = {}
    for at, (id, _) in enumerate(rows):
        known = ids.get(find(at))
        ids[find(at)] = known if id is None else id if known is None else min(known, id)
    return [(id, f"{prints[at]:016x}", ids[find(at)]) for at, (id, _) in enumerate(rows)]


def ordered(rows):
    return sorted((tuple(row) for row in rows), key=str)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_every_pair_within_the_radius_shares_a_bucket(seed):
    masks = covering.covering_masks(4, seed)
    assert len(masks) == 31
    drawn = random.Random(seed)
    for _ in range(3000):
        changed = sum(1 << at for at in drawn.sample(range(64), 4))
        assert any(mask & changed == 0 for mask in masks)


def test_whole_table_against_all_pairs(spark):
    rows = [(row["doc_id"], row["text"]) for row in pq.read_table(Path(SMALL) / "documents.parquet").to_pylist()]
    found = queries()["op3_covering_simhash"](spark, SMALL)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert ordered(found.collect()) == ordered(plain_components(rows))


def test_odd_rows(spark):
    prepare(spark)
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (4, "one TWO"), (None, "one two"), (None, "é"), (7, long), (8, long + "x")]
    frame = spark.createDataFrame([(id, text, "clash") for id, text in rows], SCHEMA)
    found = covering.digests(covering.near_duplicates(frame)).collect()
    assert ordered(found) == ordered(plain_components(rows))
    kept = covering.representatives(frame)
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((row["doc_id"] or 0) for row in kept.collect()) == [0, 1, 4, 7]
    assert covering.near_duplicates(frame.limit(0)).count() == 0
    assert covering.representatives(frame.limit(0)).count() == 0


def test_representatives_go_by_row_not_by_id(spark):
    far = ["all of one kind of words here", "something wholly else is told there", "a third and last text follows now"]
    # Column names of the operator's own; texts one and two share an id, texts three are there without an id only.
    rows = [(1, far[0], 1, 1), (1, far[1], 1, 1), (5, far[1], 1, 1), (None, far[1], 1, 1), *[(None, far[2], 1, 1)] * 3, (None, far[2], 1, 2)]
    frame = prepare(spark).createDataFrame(rows, "doc_id long, text string, row int, copies int")
    found = covering.representatives(frame)
    assert found.columns == frame.columns
    listed = [tuple(row) for row in found.collect()]
    assert sorted(row[:2] for row in listed if row[0]) == [(1, far[0]), (1, far[1])]
    assert [row[1] for row in listed if row[0] is None] == [far[2]]
    mixed = covering.representatives(frame.repartition(3)).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, found.collect()))


@pytest.mark.parametrize("bucket", [24, 2048])
def test_large_buckets_are_split_without_losing_a_link(spark, bucket):
    """Chains and dense groups of fingerprints, with buckets that hold far fewer rows than the groups."""
    drawn = random.Random(bucket)
    prints = set()
    for _ in range(2):
        value = drawn.getrandbits(64)
        for _ in range(60):
            value ^= sum(1 << at for at in drawn.sample(range(64), drawn.choice([1, 2, 4, 5])))
            prints.add(value)
        prints |= {value ^ 1 << left ^ 1 << right for left, right in combinations(range(9), 2)}
    signed = [value - (1 << 64) if value >> 63 else value for value in prints]
    frame = prepare(spark).createDataFrame([(value,) for value in signed], "fp long")
    parts = covering.near_links(frame, 4, bucket)
    links = parts[0]
    for part in parts[1:]:
        links = links.union(part)
    found = {row["node"]: row["root"] for row in components(links).collect()}
    parent = {value: value for value in signed}

    def find(value):
        while parent[value] != value:
            value = parent[value]
        return value

    for left, right in combinations(signed, 2):
        if ((left ^ right) % (1 << 64)).bit_count() <= 4:
            parent[max(find(left), find(right))] = min(find(left), find(right))
    assert {value: found.get(value, value) for value in signed} == {value: find(value) for value in signed}


def test_the_sign_bit_counts_as_one_in_larger_buckets(spark):
    """Three fingerprints in one bucket; the first two differ in bits 63 and 1 only."""
    one, two, three = 5, (5 ^ 2) - (1 << 63), 5 ^ 0x3FF0
    rows = np.array([(0, 0, value) for value in (one, two, three)], np.int64)
    found = covering._linked(rows, np.array([0, 3]), 4).to_pylist()
    assert [{row["a"], row["b"]} for row in found] == [{one, two}]
    frame = prepare(spark).createDataFrame([(value,) for value in (one, two, one ^ 1, three)], "fp long")
    parts = covering.near_links(frame, 4)
    links = parts[0]
    for part in parts[1:]:
        links = links.union(part)
    assert {row["node"] for row in components(links).collect()} == {one, two, one ^ 1}


def test_a_long_chain_is_one_component(spark):
    links = prepare(spark).range(60).selectExpr("id AS a", "id + 1 AS b")
    found = components(links).collect()
    assert {row["root"] for row in found} == {0} and sorted(row["node"] for row in found) == list(range(61))
    assert components(links.where("a < 0")).count() == 0
