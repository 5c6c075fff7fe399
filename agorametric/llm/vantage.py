"""Operator 1: approximate nearest neighbours by inner product, with a vantage-point tree per shard.

A shard lifts its vectors to one norm by one more component, which makes the largest inner product the smallest
Euclidean distance; the vantage-point tree splits them at the median distance from a chosen vector until a leaf is
small. A search goes to the nearer child first and leaves a child out if the triangle inequality, with the gap
multiplied by `factor`, shows nothing nearer than the k-th best so far. Factor one is exact. Queries go down the tree
in groups. Every vector is indexed; each shard gives its k best for each query, and these are merged.

Results for odd input: vectors that are missing, zero or not finite take no part, nor do rows without an id; a row that
repeats another counts once; vectors of different lengths never meet; ties go to the smaller id; with fewer candidates
than k all are found; an empty table gives an empty table. Other columns don't pass.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agorametric.llm.blocks import CANDIDATES, QUERIES, best_of, blocked, count_blocks, matrix, merged, searched, usable
from agorametric.llm.common import stored

NEAREST = 20
# Measured recall is in the README. A gap counts `FACTOR` fold before it is held against a child.
FACTOR = 4.0
LEAF = 256


class Tree:
    """A vantage-point tree over the distinct vectors of one shard; each has the ids of its rows, in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 0) -> None:
        distinct, of = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, of.ravel()))
        self.ids = ids[order]
        self.bounds = np.searchsorted(of.ravel()[order], np.arange(len(distinct) + 1))
        self.vectors = distinct
        with np.errstate(over="ignore"):
            norms = (distinct**2).sum(axis=1)
            self.radius = norms.max(initial=0)
            lifted = np.column_stack([distinct, np.sqrt(np.maximum(0, self.radius - norms))])
        self.exhaustive = not np.isfinite(self.radius) or self.radius == 0
        drawn = np.random.default_rng(seed)
        self.root = self._grow(np.arange(len(distinct)), lifted, leaf, drawn)

    def _grow(self, rows: np.ndarray, lifted: np.ndarray, leaf: int, drawn) -> tuple:
        """Leaves are arrays of rows; inner nodes are the vantage point and, per child, its distances and its node."""
        if self.exhaustive or len(rows) <= leaf:
            return (rows,)
        point = lifted[drawn.choice(rows)]
        far = np.sqrt(((lifted[rows] - point) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        children = []
        for part in (order[:half], order[half:]):
            children.append((far[part[0]], far[part[-1]], self._grow(rows[part], lifted, leaf, drawn)))
        return point, *children

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        """Flat rows (query id, vector id, inner product) with the k best per query that were found."""
        # One more than k distinct vectors: the query's own may be among them.
        best = np.full((len(queries), min(k + 1, len(self.vectors))), -np.inf)
        norms = (queries**2).sum(axis=1)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # Products differ by rounding with their place in a block; what is this near to the limit is kept.
        slack = 1e-12 * np.sqrt(np.maximum(norms, 1e-300) * max(self.radius, 1e-300))

        def visit(node: tuple, active: np.ndarray) -> None:
            if not len(active):
                return
            if len(node) == 1:
                products = queries[active] @ self.vectors[node[0]].T
                joined = np.concatenate([best[active], products], axis=1)
                best[active] = np.partition(joined, -best.shape[1], axis=1)[:, -best.shape[1] :]
                limit = best[active].min(axis=1) - slack[active]
                at, row = np.nonzero(products >= limit[:, None])
                found.append((active[at], node[0][row], products[at, row]))
                return
            point, *children = node
            # From the lifted query, whose last component is zero, to the vantage point.
            far = np.sqrt(np.maximum(0, norms[active] + self.radius - 2 * queries[active] @ point[:-1]))
            nearer = (far > children[0][1]) * (np.abs(far - children[0][1]) > np.abs(far - children[1][0]))
            for first in (0, 1):
                group, away = active[nearer == first], far[nearer == first]
                for turn in (first, 1 - first):
                    low, high, child = children[turn]
                    gap = np.maximum(0, np.maximum(low - away, away - high))
                    reach = np.sqrt(np.maximum(0, norms[group] + self.radius - 2 * (best[group].min(axis=1) - slack[group])))
                    visit(child, group[~(factor * gap > reach * (1 + 1e-9))])

        with np.errstate(over="ignore", invalid="ignore"):
            visit(self.root, np.arange(len(queries)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, row, product = map(np.concatenate, zip(*found))
        near = ~(product < best.min(axis=1)[query] - slack[query])
        query, row = query[near], row[near]
        # The measure itself: one sum in the order of the components.
        score = np.zeros(len(query))
        for at in range(queries.shape[1]):
            score = score + queries[query, at] * self.vectors[row, at]
        # Of equal vectors only the smallest ids can be among the best; one of them may be the query's own.
        counts = np.minimum(np.diff(self.bounds)[row], k + 1)
        spread = np.repeat(np.arange(len(row)), counts)
        place = np.arange(len(spread)) - np.repeat(np.cumsum(counts) - counts, counts)
        id = self.ids[self.bounds[row[spread]] + place]
        query, score = ids[query[spread]], score[spread]
        other = id != query
        return best_of(query[other], id[other], score[other], k)


def index(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", shard: int = CANDIDATES) -> tuple[DataFrame, int]:
    """A table with one tree per shard of about `shard` rows, and the number of shards."""
    rows = stored(usable(vectors, id, vector, zero=False), "vectors")
    shards = count_blocks(rows.count(), shard)

    def build(table: pa.Table) -> pa.Table:
        tree = Tree(table.column("vec_id").to_numpy(), matrix(table.column("vector")))
        return pa.table({"size": table.column("size")[:1], "block": table.column("block")[:1], "tree": [pickle.dumps(tree)]})

    trees = blocked(rows, shards, "block").groupBy("size", "block").applyInArrow(build, "size int, block int, tree binary")
    return stored(trees, "trees"), shards


def search(
    trees: tuple[DataFrame, int],
    queries: DataFrame,
    k: int = NEAREST,
    factor: float = FACTOR,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k nearest found, without candidates of the query's own id."""
    table, shards = trees
    asked = stored(usable(queries, id, vector, zero=False), "queries")
    parts = count_blocks(asked.count(), QUERIES)

    def run(block: pa.Table, ids: np.ndarray, vectors: np.ndarray):
        return pickle.loads(block.column("tree")[0].as_py()).search(ids, vectors, k, factor)

    found = searched(table, blocked(asked, parts, "part"), (shards, parts), run, "double")
    return merged(found, k)

