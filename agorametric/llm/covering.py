"""Operator 3: SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has, for each of 64 positions, the majority bit of the XXH64 hashes of its four-word shingles.
Fingerprints link where at most `radius` bits differ. Each of 2^(radius+1)-1 bit masks keeps about half the positions;
the masks are the inner products of one vector per position with every non-zero vector, so that the positions in which
a pair within the radius differs are left out together by at least one mask: every such pair shares a bucket.

Buckets of two are checked by built-in functions, larger ones in Arrow batches. A bucket over `BUCKET` fingerprints is
split again by a second family of masks within the first mask, and so on: the guarantee holds at each level, and after
a few levels hardly any free bit is left. No bucket is cut off and no list of all pairs is made: a bucket yields a
spanning star for each of its connected parts.

Results for odd input: a missing or blank text has fingerprint zero and links like any other; texts of fewer than four
words are one shingle; equal fingerprints are one class, so repeated rows and copies cost nothing more; rows without an
id get a fingerprint and their component, whose id is the smallest id in it (null if it has none); an empty table
gives an empty table. Only the id column passes, from `representatives` all columns.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametric.llm.common import per_batch, stored
from agorametric.llm.components import components

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42

# Fingerprints that are compared with each other in one step.
BUCKET = 2048
_BLOCK = 1 << 15


def fingerprint(text: bytes | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number."""
    from xxhash import xxh64_digest

    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    words = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(spans), _BLOCK):
        hashes = b"".join([xxh64_digest(joined[start:end], seed) for start, end in spans[at : at + _BLOCK]])
        ones += _ones(np.frombuffer(hashes, np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big", signed=True)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """Set bits per position; sums of up to 255 rows stay in bytes."""
    bits = np.unpackbits(hashes, axis=1)
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        total += np.add.reduce(bits[:whole].reshape(-1, 255, BITS), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprints(documents: DataFrame, text: str = "text", id: str = "doc_id", row: Column | None = None) -> DataFrame:
    """Rows (doc_id, fp) of every document, with the number `row` if it is given; one narrow pass over whole texts."""
    passed = [F.col(id).cast("long").alias("doc_id")] + ([] if row is None else [row.alias("row")])
    rows = documents.select(*passed, F.col(text).cast("binary").alias("text"))
    names = [*rows.columns[:-1], "fp"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        *kept, texts = batch.columns
        prints = pa.array([fingerprint(data) for data in texts.to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*kept, prints], names=names)

    return per_batch(rows, ", ".join(f"{name} long" for name in names), run)


def covering_masks(radius: int = RADIUS, seed: int = 0) -> list[int]:
    """Signed 64-bit masks. Every set of up to `radius` positions is left out by one of them."""
    size = 1 << radius + 1
    vectors = [1 + at % (size - 1) for at in range(BITS)]
    random.Random(seed).shuffle(vectors)
    masks = []
    for chosen in range(1, size):
        kept = sum(1 << at for at, vector in enumerate(vectors) if (vector & chosen).bit_count() % 2)
        masks.append(kept - (1 << BITS) if kept >> BITS - 1 else kept)
    return masks


def differing(left: str, right: str):
    return F.bit_count(F.col(left).bitwiseXOR(F.col(right)))


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> list[DataFrame]:
    """Tables of links (a, b) between the distinct fingerprints in column fp.

    They connect two fingerprints, directly or over others, just if chains of steps of at most `radius` bits do.
    """
    found, level = [], 0
    rows = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        masks = F.array(*[F.lit(mask).cast("long") for mask in covering_masks(radius, level)])
        rows = rows.select("fp", "mask", F.explode(masks).alias("more"))
        rows = rows.select("fp", F.col("mask").bitwiseOR(F.col("more")).alias("mask"))
        if level:
            rows = rows.distinct()
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        shared = stored(sizes.where("n > 1"), "buckets")
        found.append(shared.where(F.expr("n = 2") & (differing("a", "b") <= radius)).select("a", "b"))
        larger = shared.where("n > 2").select("mask", "key", "n")
        sized = stored(rows.join(larger, ["mask", "key"]).select("mask", "key", "fp", "n"), "larger")
        found.append(_stars(sized.where(F.col("n") <= bucket), radius))
        rows = sized.where(F.col("n") > bucket).select("fp", "mask")
        level += 1
        if rows.isEmpty():
            return found


def _stars(rows: DataFrame, radius: int) -> DataFrame:
    """Stars over the connected parts of each bucket, a bounded group of rows."""
    dealt = rows.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([column.to_numpy() for column in batch.columns], axis=1)))
            borders = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
            if len(borders):
                yield _linked(held[: borders[-1]], np.append(0, borders), radius)
                held = held[borders[-1] :]
        if len(held):
            yield _linked(held, np.array([0, len(held)]), radius)

    return dealt.mapInArrow(run, "a long, b long")


def _linked(rows: np.ndarray, borders: np.ndarray, radius: int) -> pa.RecordBatch:
    pairs = [np.empty((0, 2), np.int64)]
    for start, stop in zip(borders, borders[1:]):
        prints = rows[start:stop, 2]
        # Unsigned: of a negative number numpy counts the bits of the absolute value.
        near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= radius
        root = np.arange(len(prints))
        while True:
            # The least root within reach, then the root of that root.
            least = np.where(near, root[None, :], len(prints)).min(axis=1)
            least = least[least]
            if (least == root).all():
                break
            root = least
        moved = root != np.arange(len(prints))
        pairs.append(np.stack([prints[moved], prints[root[moved]]], axis=1))
    found = np.concatenate(pairs)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per distinct fp its component: root, a fingerprint of it, and component_id, the smallest doc_id in it."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = None
    for part in near_links(distinct, radius):
        links = part if links is None else links.union(part)
    members = components(links).join(distinct, F.col("node") == F.col("fp"))
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = members.join(least, "root").select("fp", "root", "component_id")
    return distinct.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("first")).alias("component_id"),
    )


def near_duplicates(documents: DataFrame, text: str = "text", id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Per document doc_id, fp and component_id, the smallest id that is linked to it over any chain."""
    prints = stored(fingerprints(documents, text, id), "prints")
    named = classes(prints, radius).select("fp", "component_id")
    # Joined from a stored table, a frequent fingerprint's documents can be split over tasks.
    return prints.join(stored(named, "named"), "fp").select("doc_id", "fp", "component_id")


def digests(found: DataFrame) -> DataFrame:
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def representatives(documents: DataFrame, text: str = "text", id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, that with the smallest id.

    Rows are told apart by id and by a hash of all their columns, so unlinked texts stay whatever their ids. A row
    without an id stays only where no row of its component has one; of rows that tie, the one with the smallest hash,
    once.
    """
    hashed = F.xxhash64(*[F.col(name) for name in documents.columns])
    prints = stored(fingerprints(documents, text, id, hashed), "prints")
    different = prints.groupBy("fp", "doc_id", "row").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("is_last"), "doc_id", "row", "copies")
    first = different.groupBy("fp").agg(F.min(order).alias("kept"))
    roots = stored(classes(prints, radius).select("fp", "root"), "named")
    kept = stored(first.join(roots, "fp").groupBy("root").agg(F.min("kept").alias("kept")).select("kept.*"), "kept")

    def named(chosen: DataFrame) -> DataFrame:
        same = F.col(f"all.{id}").cast("long").eqNullSafe(F.col("chosen.doc_id")) & (F.col("all.hashed") == F.col("chosen.row"))
        slim = chosen.select("doc_id", "row").alias("chosen")
        rows = documents.select(F.col(id), F.struct(*[F.col(name) for name in documents.columns]).alias("whole"), hashed.alias("hashed"))
        return rows.alias("all").join(slim, same, "left_semi")

    # A row of which the table holds more copies is reduced to one; others need no grouping.
    single = named(kept.where("copies = 1")).select("whole.*")
    repeated = kept.where("copies > 1")
    if repeated.isEmpty():
        return single
    once = named(repeated).groupBy(F.col(id).alias("of"), "hashed").agg(F.min("whole").alias("whole"))
    return single.union(once.select("whole.*"))
