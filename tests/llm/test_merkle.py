from __future__ import annotations

import random

import pytest

from agorametric.llm import merkle
from agorametric.llm.common import prepare

SCHEMA = "file string, offset long, length long, sha256 string, kind string"


def plain(left, right):
    """Both replicas place by place."""
    sides = []
    for rows in (left, right):
        places = {}
        for file, offset, length, sha256, _ in rows:
            if file is not None and offset is not None:
                places.setdefault((file, offset), set()).add((length, sha256))
        sides.append(places)
    found = []
    for place in sides[0].keys() | sides[1].keys():
        one, other = (side.get(place, set()) for side in sides)
        if one != other:
            kind = "missing" if not other else "extra" if not one else "changed"
            length = max((length for length, _ in one or other if length is not None), default=None)
            hashes = [",".join(sorted({sha256 for _, sha256 in side if sha256})) for side in (one, other)]
            found.append((*place, length, kind, *hashes))
    return sorted(found, key=str)


def replica(spark, rows):
    return prepare(spark).createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("leaf_bytes", "fanout"), [(50, 2), (1000, 4)])
def test_against_a_direct_comparison(spark, leaf_bytes, fanout):
    drawn = random.Random(leaf_bytes)
    left, right = [], []
    for file in ("a", "b", "c", "only left", "same"):
        offset = 0
        for _ in range(60):
            length = drawn.randrange(1, 90)
            row = (file, offset, length, f"{drawn.random()}", "clash")
            offset += length
            left.append(row)
            chance = 1 if file == "same" else drawn.random()
            if file != "only left" and chance > 0.05:
                right.append((*row[:3], "rot", "") if chance < 0.1 else row)
            if chance < 0.02:
                right.append((file, offset - 1, 1, "new", ""))
    right.append(("only right", 7, 7, "x", ""))
    found = merkle.audit(replica(spark, left), replica(spark, right), leaf_bytes, fanout)
    assert sorted(map(tuple, found.collect()), key=str) == plain(left, right)


def test_few_shuffles_however_many_levels(spark, monkeypatch):
    shuffles, stored = [], merkle.stored

    def counted(frame, name):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        shuffles.append(0 if "Coalesce" in plan else plan.count("Exchange "))
        return stored(frame, name)

    monkeypatch.setattr(merkle, "stored", counted)
    pages = [(id, f"u{id}", "x" * (id % 7)) for id in range(40)]
    rows = merkle.records_of(prepare(spark).createDataFrame(pages, "page_id long, url string, html string"))
    assert rows.count() == 40
    # The rows that repeat are counted; a shuffle each for the shares' sums, the files', and the two sides of the join.
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sum(shuffles) == 1 and plan.split("Initial Plan")[-1].count("Exchange ") <= 4
    rows = stored(rows, "warc")
    one, other = (side.select("file", "offset", "length", "sha256") for side in (rows, rows.where("page_id <> 9")))
    shuffles.clear()
    assert [row["kind"] for row in merkle.audit(one, other, 100, 2).collect()] == ["missing"]
    # Only leaves are hashed in as many tasks as there are partitions, of both replicas at once.
    assert sum(shuffles) == 1 and len(shuffles) > 5


def test_levels_built_together_are_those_built_one_by_one(spark, monkeypatch):
    left = [(file, at * 10, 10, f"{file}{at}", "") for file in "ab" for at in range(70)]
    right = [row for row in left if row[1] % 170]
    both = [replica(spark, side) for side in (left, right)]
    together = merkle.trees(*both, 10, 2)
    monkeypatch.setattr(merkle, "LEVELS_AT_ONCE", 1)
    for levels, records in zip(together, both):
        alone = merkle.tree(records, 10, 2)
        assert len(levels) == len(alone) == 8
        for level, same in zip(levels, alone):
            columns = "file", "node", "hash"
            assert sorted(level.select(*columns).collect()) == sorted(same.select(*columns).collect())


def test_only_differing_branches_are_descended(spark):
    rows = [("a", at * 10, 10, str(at), "") for at in range(64)]
    whole, cut = (merkle.tree(replica(spark, part), 10, 4) for part in (rows, rows[:-1]))
    assert [level.count() for level in whole] == [64, 16, 4, 1]
    assert [tuple(row) for row in merkle.differing_leaves(whole, cut, 4).collect()] == [("a", 63)]
    assert merkle.differing_leaves(whole, merkle.tree(replica(spark, rows[::-1]), 10, 4), 4) is None


def test_nothing_below_equal_roots_is_read(spark, monkeypatch):
    rows = replica(spark, [(file, at * 10, 10, f"{file}{at}", "") for file in "ab" for at in range(64)])
    one, other = merkle.tree(rows, 10, 4), merkle.tree(rows, 10, 4)
    unread = spark.range(1).selectExpr("raise_error('read')::string AS file", "1L AS node", "'' AS hash")
    assert merkle.differing_leaves([unread] * 3 + one[-1:], [unread] * 3 + other[-1:], 4) is None
    monkeypatch.setattr(merkle, "differing_places", None)
    assert merkle.audit(rows, rows, 10, 4).count() == 0


def test_replicas_of_different_heights(spark):
    rows = [("a", 0, 10, "x", ""), ("b", 0, 10, "y", "")]
    more = [*rows, ("b", 10_000, 10, "z", "")]
    for one, other in ((rows, more), (more, rows)):
        found = merkle.audit(replica(spark, one), replica(spark, other), 10, 4)
        assert sorted(map(tuple, found.collect()), key=str) == plain(one, other)


def test_records_are_compared_only_under_differing_leaves(spark):
    rows = [("a", at * 10, 10, str(at), "") for at in range(64)]
    rotten = [("a", at * 10, 10, "rot" if at == 9 else str(at), "") for at in range(64)]
    one, other = replica(spark, rows), replica(spark, rotten)
    leaves = merkle.differing_leaves(merkle.tree(one, 20, 4), merkle.tree(other, 20, 4), 4)
    assert [tuple(row) for row in leaves.collect()] == [("a", 4)]
    plan = merkle.differing_places(one, other, leaves, 20)._jdf.queryExecution().optimizedPlan().toString()
    # Each replica meets the leaves before anything is grouped.
    assert plan.count("Join LeftSemi") == 2 and plan.index("Aggregate") < plan.index("Join LeftSemi")


def test_copies_of_one_page_take_their_places(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES_AT_ONCE", 4)
    drawn = random.Random(3)
    pages = [(id, f"u{url}", "x" * drawn.randrange(5)) for id in (None, 1, 2, 600) for url in range(3) for _ in range(drawn.randrange(1, 12))]
    rows = merkle.records_of(prepare(spark).createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == len(pages)
    files = {}
    for row in sorted(rows, key=lambda row: row["offset"]):
        files.setdefault(row["file"], []).append(row)
    for listed in files.values():
        assert [row["offset"] for row in listed] == [sum(row["length"] for row in listed[:at]) for at in range(len(listed))]
        order = [(row["page_id"] or 0, row["sha256"]) for row in listed]
        assert order == sorted(order)


def test_odd_rows(spark):
    left = [("a", 0, 5, "x", ""), ("a", 0, 5, "x", ""), (None, 0, 5, "x", ""), ("a", None, 5, "y", ""), ("a", 9, None, None, "")]
    right = [("a", 0, 5, "x", ""), ("a", 0, 6, "z", ""), ("b", 1 << 40, 1, "far", "")]
    found = merkle.audit(replica(spark, left), replica(spark, right))
    assert sorted(map(tuple, found.collect()), key=str) == plain(left, right)
    assert merkle.audit(replica(spark, []), replica(spark, [])).count() == 0
    assert merkle.audit(replica(spark, left), replica(spark, [])).count() == 2


def test_pages_without_ids_or_contents(spark):
    pages = prepare(spark).createDataFrame([(None, None, None, 1), (3, "u", None, 1), (3, "u", None, 1), (4, "u", "é" * 100_000, 1)], "page_id int, url string, html string, length int")
    rows = merkle.records_of(pages).orderBy("file", "offset").collect()
    assert [row["offset"] for row in rows if row["file"] == "pages-0"] == [0, rows[1]["length"], 2 * rows[1]["length"]]
    assert rows[-1]["length"] > 200_000 and merkle.records_of(pages.limit(0)).count() == 0
