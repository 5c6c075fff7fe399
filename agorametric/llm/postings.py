"""Operator 9: exact top-k search by term-at-a-time accumulation.

Components are scaled and rounded down to whole numbers. A block of candidates is turned into postings: per component
the rows where it is not zero, with their weights. The non-zero components of a group of queries scatter their weighted
postings, one component after the other, into dense arrays of scores; each query's best are selected by partition, and
the blocks' results are merged. All candidates are scored.

Results for odd input: vectors that are missing or hold a missing or non-finite component take no part, nor do rows
without an id; zero vectors score zero; a row that repeats another counts once; vectors of different lengths never
meet; ties go to the smaller id; with fewer candidates than k all are found; numbers beyond a long's range are held at
its ends; an empty table gives an empty table. Other columns don't pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from agorametric.llm.blocks import CANDIDATES, QUERIES, best_of, blocked, count_blocks, matrix, merged, searched, usable
from agorametric.llm.common import stored

BEST = 5
SCALE = 256
_LONG = np.iinfo(np.int64)
# Queries that share one dense array of scores.
_GROUP = 128


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Scaled components rounded down, as longs; as Python numbers where sums could leave a long's range."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * vectors)
    if np.abs(scaled).max(initial=0) < 2**28:
        return scaled.astype(np.int64)
    held = np.clip(scaled, -(2.0**63), 2.0**63)
    return np.array([[min(max(int(value), _LONG.min), _LONG.max) for value in row] for row in held], object).reshape(held.shape)


def postings(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per component: the rows that have it, and their weights."""
    rows = [np.flatnonzero(column) for column in vectors.T]
    return [(at, vectors[at, term]) for term, at in enumerate(rows)]


def accumulate(queries: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Scores (row, query)."""
    scores = np.zeros((rows, len(queries)), queries.dtype)
    for weights, (at, values) in zip(queries.T, terms):
        asking = np.flatnonzero(weights)
        if len(asking) == 0 or len(at) == 0:
            continue
        added = np.multiply.outer(values, weights)
        if len(at) == rows:
            scores += added
        else:
            scores[at] += added
    return scores


def block_best(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, scale: float):
    """Flat rows (query id, vector id, score) with the k best of the block per query."""
    held, asked = whole(vectors, scale), whole(queries, scale)
    if object in (held.dtype, asked.dtype):
        held, asked = held.astype(object), asked.astype(object)
    order = np.argsort(ids, kind="stable")
    ids, terms, parts = ids[order], postings(held[order]), []
    for at in range(0, len(asked), _GROUP):
        scores = accumulate(asked[at : at + _GROUP], terms, len(ids)).T
        if scores.dtype == object:
            scores = np.clip(scores, _LONG.min, _LONG.max).astype(np.int64)
        for query, row in zip(query_ids[at : at + _GROUP], scores):
            # The query's own rows may be among the best; they are as many as share its id.
            own = ids == query
            most = min(len(row), k + int(own.sum()))
            least = np.partition(row, len(row) - most)[len(row) - most] if most else 0
            # Rows are in order of id, so of equal scores at the border the smallest ids come first.
            above = np.flatnonzero(row > least)
            chosen = np.concatenate([above, np.flatnonzero(row == least)[: most - len(above)]])
            chosen = chosen[~own[chosen]]
            parts.append((np.full(len(chosen), query), ids[chosen], row[chosen]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return best_of(*map(np.concatenate, zip(*parts)), k)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = BEST, scale: float = SCALE, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k best candidates, without those of the query's own id."""
    rows = stored(usable(vectors, id, vector, zero=True), "vectors")
    asked = stored(usable(queries, id, vector, zero=True), "queries")
    sizes = count_blocks(rows.count(), CANDIDATES), count_blocks(asked.count(), QUERIES)

    def run(block: pa.Table, ids: np.ndarray, asked: np.ndarray):
        return block_best(block.column("vec_id").to_numpy(), matrix(block.column("vector")), ids, asked, k, scale)

    found = searched(blocked(rows, sizes[0], "block"), blocked(asked, sizes[1], "part"), sizes, run, "long")
    return merged(found, k)
