"""Operator 12: ranked lexical search over impact vectors in buckets of like length.

A document's vector has one impact for each query term it holds, a whole number that grows with the term's frequency and
falls with the document's length; a query's vector has the terms' weights. A score is their inner product. To bound it,
both sides take the square root of the weight, and a document's length is measured in those coordinates.

Vectors are dealt by ranges of their length and stored longest first; a batch of rows is a bucket. For each query the
threshold is the k-th best score known so far; it starts from an exact search of the longest vectors and rises as a task
goes on. Three tests follow. By Cauchy-Schwarz, a bucket is left out for a query when its longest vector cannot reach the
threshold, and within a bucket so is the tail of shorter ones. Inside, the greatest impact of each coordinate tells which
coordinates a document must share: those whose bounds are needed to reach the threshold are summed up, and the rest of
the score is bounded by their greatest impacts and by the length that is left. Survivors are scored again in whole
numbers, over all their coordinates. Bounds are only ever too large, so nothing is lost.

Queries are taken in blocks of a bounded number of terms, whatever their number; each block is one pass over the texts.

Results for odd input: a missing or blank text has no terms and is never found, and does not count among the documents;
repeated rows are found each; a missing document id comes last among equal scores; items that repeat another in id and
text count once, others with the same id are ranked apart; an item without terms has no rows; empty tables give an empty
table. Other columns don't pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agorametric.llm.common import per_batch, stored

BEST = 50
# Terms of one block of queries, which every task holds.
BLOCK_TERMS = 1 << 18
# The longest vectors, about so many, give the first thresholds.
FIRST = 4096
# Above all ids, for rows without one.
_LAST = (1 << 63) - 1
# Bounds are in doubles; they are held to be so much larger than they come out.
_SLACK = 1 + 1e-9
_COPIES = 4096

_FOLD = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte > 127 else 32
    for byte in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all bytes beyond ASCII, with small ASCII letters."""
    return (text or b"").translate(_FOLD).split()


class Block(NamedTuple):
    """Items, each a list of term numbers, and the numbers of the terms."""

    items: list[tuple[int | None, list[int]]]
    terms: dict[bytes, int]


def blocks_of(items: DataFrame, text: str, id: str, most: int) -> Iterator[Block]:
    """The items in blocks of about so many terms at most; one item is never divided."""
    rows = items.select(F.col(id).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        terms = [sorted(set(terms_of(data))) for data in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    found = per_batch(rows.distinct(), "item_id long, terms array<binary>", run).where(F.size("terms") > 0)
    found = stored(found, "items")
    total = found.agg(F.sum(F.size("terms"))).first()[0] or 0
    count = -(-total // most)
    for at in range(count):
        terms: dict[bytes, int] = {}
        chosen = found.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(count)) == at)
        rows_of = sorted(chosen.collect(), key=lambda row: (row["item_id"] is None, row["item_id"] or 0, row["terms"]))
        listed = [(row["item_id"], [terms.setdefault(bytes(term), len(terms)) for term in row["terms"]]) for row in rows_of]
        if listed:
            yield Block(listed, terms)


def vectors(documents: DataFrame, terms: dict[bytes, int], text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document with at least one term: its number of terms, and number and frequency of those it shares with `terms`."""
    rows = documents.select(
        F.coalesce(F.col(id).cast("long"), F.lit(_LAST)).alias("doc_id"),
        F.col(id).isNull().alias("missing"),
        F.col(text).cast("binary").alias("text"),
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count, which, times, size = [], [], [], []
        for data in batch.column(2).to_pylist():
            words = terms_of(data)
            shared = [(terms[word], n) for word, n in Counter(words).items() if word in terms]
            count.append(len(words))
            size.append(len(shared))
            which += [term for term, _ in shared]
            times += [n for _, n in shared]
        offsets = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array(count, pa.int64()),
            pa.ListArray.from_arrays(offsets, pa.array(which, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "missing", "n", "terms", "times"])

    schema = "doc_id long, missing boolean, n long, terms array<int>, times array<bigint>"
    return per_batch(rows, schema, run).where("n > 0")


class Rows(NamedTuple):
    """Sparse rows: coordinates and values of all rows, one after the other, and where each row starts."""

    coordinates: np.ndarray
    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, coordinates: pa.ListArray, values: pa.ListArray) -> Rows:
        sizes = np.diff(coordinates.offsets.to_numpy())
        return cls(coordinates.flatten().to_numpy(), values.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes))))

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def impacts(frequencies: DataFrame, weights: np.ndarray, documents: int, terms: int) -> DataFrame:
    """Rows (doc_id, missing, norm, terms, impacts) of the vectors that can score above zero."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = Rows.of(batch.column(3), batch.column(4))
        damping = np.array([50 + 50 * n * documents // terms for n in batch.column(2).to_pylist()], np.int64)
        impact = 1_000_000_000 * rows.values // (1000 * rows.values + 20 * np.repeat(damping, np.diff(rows.starts)))
        squares = weights[rows.coordinates] * impact.astype(np.float64) ** 2
        norm = np.sqrt(np.bincount(rows.owners(), squares, minlength=batch.num_rows))
        columns = [
            batch.column(0),
            batch.column(1),
            pa.array(norm),
            batch.column(3),
            pa.ListArray.from_arrays(pa.array(rows.starts.astype(np.int32)), pa.array(impact)),
            pa.array((np.arange(batch.num_rows) % _COPIES).astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "missing", "norm", "terms", "impacts", "copy"])

    schema = "doc_id long, missing boolean, norm double, terms array<int>, impacts array<bigint>, copy int"
    return per_batch(frequencies, schema, run).where("norm > 0")


class Search:
    """The k best rows per query of the buckets it is given."""

    def __init__(self, queries: list[list[int]], weights: np.ndarray, k: int, thresholds: np.ndarray) -> None:
        self.k, self.weights = k, weights
        self.queries = [np.array(terms) for terms in queries]
        self.norms = np.sqrt([weights[terms].sum() for terms in self.queries])
        self.thresholds = thresholds.copy()
        empty = np.zeros(0, np.int64)
        self.best = [(empty, empty, np.zeros(0, bool)) for _ in queries]
        self.rescored = 0

    def bucket(self, ids: np.ndarray, missing: np.ndarray, norms: np.ndarray, rows: Rows) -> None:
        longest = norms.max(initial=0.0)
        open_queries = np.flatnonzero((self.norms * longest * _SLACK >= self.thresholds) & (self.norms > 0))
        if not len(open_queries):
            return
        # Postings by coordinate, and the greatest impact of each.
        owners = rows.owners()
        order = np.argsort(rows.coordinates, kind="stable")
        held, impact = owners[order], rows.values[order]
        sizes = np.bincount(rows.coordinates, minlength=len(self.weights))
        starts = np.concatenate(([0], np.cumsum(sizes)))
        greatest = np.zeros(len(self.weights), np.int64)
        present = np.flatnonzero(sizes)
        greatest[present] = np.maximum.reduceat(impact, starts[present])
        asked = np.zeros(len(self.weights), np.int64)
        for query in open_queries:
            terms, threshold = self.queries[query], self.thresholds[query]
            bounds = self.weights[terms] * greatest[terms].astype(np.float64)
            ranked = np.argsort(-bounds, kind="stable")
            terms, bounds = terms[ranked], bounds[ranked]
            left = np.append(np.cumsum(bounds[::-1])[::-1], 0.0)
            if left[0] * _SLACK < max(threshold, 1):
                continue
            # Without one of the first coordinates the others' bounds fall short.
            needed = int(np.searchsorted(-left * _SLACK, -max(threshold, 1), side="right"))
            focus, rest = terms[:needed], terms[needed:]
            spans = [slice(starts[term], starts[term + 1]) for term in focus]
            at = np.concatenate([held[span] for span in spans])
            value = np.concatenate([impact[span] for span in spans]).astype(np.float64)
            weight = np.repeat(self.weights[focus], sizes[focus]).astype(np.float64)
            known = np.bincount(at, weight * value, minlength=len(ids))
            squares = np.bincount(at, weight * value * value, minlength=len(ids))
            # What is left of the squares is rounded by parts of the whole.
            length = np.sqrt(np.maximum(norms * norms * _SLACK - squares, 0))
            more = np.minimum(left[needed], np.sqrt(self.weights[rest].sum()) * length) if len(rest) else 0.0
            chosen = (known > 0) & ((known + more) * _SLACK >= threshold) & (self.norms[query] * norms * _SLACK >= threshold)
            found = np.flatnonzero(chosen)
            if len(found):
                asked[terms] = self.weights[terms]
                self._take(query, ids[found], missing[found], _scores(rows, found, asked))
                asked[terms] = 0

    def _take(self, query: int, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        self.rescored += len(ids)
        kept = (scores > 0) & (scores >= self.thresholds[query])
        joined = [np.concatenate(pair) for pair in zip(self.best[query], (scores[kept], ids[kept], missing[kept]))]
        # The complement of a long falls as the long grows and does not overflow.
        order = np.lexsort((joined[1], joined[2], ~joined[0]))[: self.k]
        self.best[query] = tuple(column[order] for column in joined)
        if len(order) == self.k:
            self.thresholds[query] = max(self.thresholds[query], self.best[query][0][-1])

    def rows(self) -> pa.RecordBatch:
        sizes = [len(scores) for scores, _, _ in self.best]
        score, id, missing = (np.concatenate(columns) for columns in zip(*self.best))
        columns = [pa.array(np.repeat(np.arange(len(sizes)), sizes)), pa.array(id), pa.array(missing), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "missing", "score"])


def _scores(rows: Rows, found: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Exact scores, in longs, of the chosen rows; `asked` has the query's weights by coordinate. No row is empty."""
    sizes = rows.starts[found + 1] - rows.starts[found]
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.arange(sizes.sum()) + np.repeat(rows.starts[found] - begins, sizes)
    return np.add.reduceat(asked[rows.coordinates[at]] * rows.values[at], begins)


def _searched(ordered: DataFrame, block: Block, weights: np.ndarray, k: int, thresholds: np.ndarray) -> DataFrame:
    """Rows (item, rank, doc_id, missing, score) of each item's k best."""
    queries = [terms for _, terms in block.items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(queries, weights, k, thresholds)
        for batch in batches:
            if batch.num_rows:
                columns = [batch.column(at).to_numpy(zero_copy_only=False) for at in range(3)]
                search.bucket(*columns, Rows.of(batch.column(3), batch.column(4)))
        yield search.rows()

    found = ordered.mapInArrow(run, "item long, doc_id long, missing boolean, score long")
    best = Window.partitionBy("item").orderBy(F.desc("score"), "missing", "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block_search(documents: DataFrame, block: Block, k: int, text: str, id: str) -> DataFrame:
    spark = documents.sparkSession
    frequencies = stored(vectors(documents, block.terms, text, id), "frequencies")
    count, total = frequencies.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(block.terms), np.int64)
    # A row for each term of the block at most.
    for term, held in frequencies.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(1000 * math.log((2 * count + 2) / (2 * held + 1)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("norm"), F.col("missing"), F.col("doc_id"), F.col("copy")]
    lengths = impacts(frequencies, weights, count, total).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered = stored(lengths.drop("copy"), "norm-order")
    longest = ordered.agg(F.percentile_approx("norm", max(0.0, 1 - FIRST / max(1, count)), 1000)).first()[0]
    first = _searched(ordered.where(F.col("norm") >= (longest or 0.0)), block, weights, k, np.zeros(len(block.items), np.int64))
    thresholds = np.zeros(len(block.items), np.int64)
    # A row for each item of the block at most.
    for item, score in first.where(F.col("rank") == k).select("item", "score").collect():
        thresholds[item] = score
    found = _searched(ordered, block, weights, k, thresholds)
    names = spark.createDataFrame([(at, item_id) for at, (item_id, _) in enumerate(block.items)], "item long, item_id long")
    named = found.join(F.broadcast(names), "item")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id"), "score")


def search(
    documents: DataFrame,
    items: DataFrame,
    k: int = BEST,
    text: str = "text",
    id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's k best documents with a score above zero."""
    found = [_block_search(documents, block, k, text, id) for block in blocks_of(items, item_text, item_id, block_terms)]
    if not found:
        return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.union, found)
