from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from agorametric.llm import postings, vantage
from agorametric.llm.common import prepare
from agorametric.llm.queries import queries


def plain(rows, asked, k, measure):
    """Every query against every candidate."""
    known = {(id, tuple(vector)) for id, vector in rows if id is not None and vector is not None}
    usable = [(id, vector) for id, vector in known if all(x is not None and math.isfinite(x) for x in vector)]
    found = []
    for id, vector in usable:
        if not asked(id):
            continue
        scored = [(-measure(vector, other), at) for at, other in usable if at != id and len(other) == len(vector)]
        found += [(id, rank, at, -score) for rank, (score, at) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found)


def inner(left, right):
    total = 0.0
    for a, b in zip(left, right):
        total += a * b
    return total


def whole(left, right):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(left, right))


def table():
    return [(row["vec_id"], row["embedding"]) for row in pq.read_table(Path(SMALL) / "embeddings.parquet").to_pylist()]


def test_postings_whole_table(spark):
    found = queries()["op9_postings_search"](spark, SMALL)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect())) == plain(table(), lambda id: id % 50 == 0, 5, whole)


def test_vantage_whole_table(spark):
    """Recall of the registered query; with factor one the result is exact."""
    exact = plain(table(), lambda id: id % 20 == 0, 20, inner)
    found = sorted(map(tuple, queries()["op1_vantage_search"](spark, SMALL).collect()))
    assert len(found) == len(exact)
    shared = {row[::2] for row in found} & {row[::2] for row in exact}
    assert len(shared) >= 0.9 * len(exact)
    scores = {row[::2]: row[3] for row in exact}
    assert all(scores.get(row[::2], row[3]) == row[3] for row in found)
    vectors = prepare(spark).read.parquet(f"{SMALL}/embeddings.parquet")
    trees = vantage.index(vectors, shard=100)
    assert trees[1] == 5
    assert sorted(map(tuple, vantage.search(trees, vectors.where("vec_id % 20 = 0"), factor=1.0).collect())) == exact


@pytest.mark.parametrize("leaf", [4, 64])
def test_exact_trees_over_clusters_and_copies(leaf):
    drawn = np.random.default_rng(leaf)
    centres = drawn.normal(size=(8, 6))
    vectors = np.concatenate([centres[drawn.integers(0, 8, 300)] + 0.05 * drawn.normal(size=(300, 6)), np.tile(centres[:1], (80, 1))])
    vectors *= drawn.choice([0.5, 1.0, 3.0], size=(380, 1))
    ids = drawn.permutation(380)
    tree = vantage.Tree(ids, vectors, leaf)
    query, id, score = tree.search(ids[:60], vectors[:60], 7, 1.0)
    rows = list(zip(ids.tolist(), vectors.tolist()))
    exact = plain(rows, lambda at: at in set(ids[:60].tolist()), 7, inner)
    assert sorted(zip(query.tolist(), id.tolist(), score.tolist())) == sorted((a, c, d) for a, _, c, d in exact)


ODD = [
    (0, [1.0, 2.0]),
    (0, [1.0, 2.0]),
    (None, [1.0, 2.0]),
    (20, None),
    (40, [None, 1.0]),
    (60, [float("nan"), 1.0]),
    (80, [float("inf"), 1.0]),
    (100, [1.0, 2.0]),
    (1, [1.0, 2.0]),
    (2, [2.0, 1.0, 0.0]),
    (200, [0.5, 0.5, 0.5]),
    (3, [-1.0, -2.0]),
]


def test_odd_rows(spark):
    frame = prepare(spark).createDataFrame([(id, vector, 7) for id, vector in ODD], "vec_id long, embedding array<double>, score int")
    found = vantage.search(vantage.index(frame), frame.where("vec_id % 20 = 0"), factor=1.0)
    assert sorted(map(tuple, found.collect())) == plain(ODD, lambda id: id % 20 == 0, 20, inner)
    zeros = [*ODD, (300, [0.0, 0.0]), (4, [0.0, 0.0])]
    more = frame.union(spark.createDataFrame([(300, [0.0, 0.0], 7), (4, [0.0, 0.0], 7)], frame.schema))
    found = postings.search(more, more.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, found.collect())) == plain(zeros, lambda id: id % 50 == 0, 5, whole)
    ignored = vantage.search(vantage.index(more), more.where("vec_id % 20 = 0"), factor=1.0)
    assert sorted(map(tuple, ignored.collect())) == plain(ODD, lambda id: id % 20 == 0, 20, inner)
    none = frame.limit(0)
    assert vantage.search(vantage.index(none), none).count() == 0
    assert postings.search(none, none).count() == 0


def test_numbers_beyond_a_long():
    vectors = np.array([[1e300, 1.0], [1e18, 1.0], [-1e300, 1.0], [1e-3, 1.0]])
    query, id, score = postings.block_best(np.arange(4), vectors, np.array([1]), vectors[1:2], 5, 256)
    assert id.tolist() == [0, 3, 2] and score.tolist() == [2**63 - 1, 65536, -(2**63)]
    tree = vantage.Tree(np.arange(4), vectors)
    assert tree.exhaustive or np.isfinite(tree.radius)
