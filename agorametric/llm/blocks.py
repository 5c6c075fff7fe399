"""Vectors in bounded blocks: every block of queries meets every block of candidates once, then results are merged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of a block of candidates and of a block of queries.
CANDIDATES = 8192
QUERIES = 2048


def usable(vectors: DataFrame, id: str, vector: str, zero: bool) -> DataFrame:
    """Rows (vec_id, vector, size) whose vector has finite components only, and with `zero` false not only zeros.

    Rows without an id take no part, and a row that repeats another counts once.
    """
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))

    def finite(value: Column) -> Column:
        return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))

    kept = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    if not zero:
        kept = kept.where(F.exists("vector", lambda value: value != 0))
    return kept.dropDuplicates(["vec_id", "vector"]).withColumn("size", F.size("vector"))


def blocked(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Block numbers by a hash of the row: the rows of a frequent vector or id are spread evenly."""
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int"))


def count_blocks(rows: int, most: int) -> int:
    return max(1, -(-rows // most))


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: highest score, then smallest id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """List values of one length as rows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def searched(candidates: DataFrame, queries: DataFrame, sizes: tuple[int, int], search: Callable, score: str) -> DataFrame:
    """`search` on each pair of blocks: it gets the candidates' rows and the queries' ids and matrix.

    `candidates` has the columns size, block and what `search` reads; `queries` has vec_id, vector, size and part. A
    task holds one block of each. Vectors of different lengths never meet.
    """
    n_blocks, n_parts = sizes
    left = candidates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    kind = pa.int64() if score == "long" else pa.float64()
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], kind)})

    def run(block: pa.Table, part: pa.Table) -> pa.Table:
        if not block.num_rows or not part.num_rows:
            return empty
        query, id, value = search(block, part.column("vec_id").to_numpy(), matrix(part.column("vector")))
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(id, pa.int64()), "score": pa.array(value, kind)})

    keys = ["size", "block", "part"]
    grouped = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return grouped.applyInArrow(run, f"query_id long, vec_id long, score {score}")


def best_of(query: np.ndarray, id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flat rows the k best per query."""
    # The complement of a long falls as the long grows and does not overflow.
    falling = ~score if score.dtype == np.int64 else -score
    order = np.lexsort((id, falling, query))
    query, id, score = query[order], id[order], score[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    kept = place < k
    return query[kept], id[kept], score[kept]
