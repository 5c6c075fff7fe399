"""Operator 13: line deduplication by sorted hashes, with a compressed keep bitmap per document.

A line's key is the line without ASCII blanks at its ends, in small ASCII letters. A key of `LEAST` code points or more
that stands in two documents stays only in the one with the smallest id; all other lines stay.

The keys' 128-bit hashes are dealt by ranges of (hash, document, position) and sorted, so a line that millions of
documents share is spread over many tasks. Each task streams its rows and remembers one hash and its first document.
What a task cannot know is whether the hash it begins with began in an earlier one: rows of that hash in the task's
first document are left open, each task reports its first and last hash with the first document, and the open rows are
settled by these reports, of which there are two for each task whatever the input.

The result is a bitmap per document, one bit a line, compressed; texts are not moved until `apply` joins them with
their bitmaps. Documents are told apart by id and a 64-bit hash of the text.

Results for odd input: a missing or empty text is one empty line; a missing id comes after all others, and rows without
one are one document, as are rows with the same id; repeated rows have one bitmap, and a number dealt to them keeps
them apart while they are sorted; a document's own repeats of a line stay or go together; a text that is one very long
line is one row; an empty table gives an empty table. `apply` passes all columns, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.llm.common import per_batch, slices, stored

# Fewest code points of a key.
LEAST = 10
# Above all ids, for rows without one.
_LAST = (1 << 63) - 1
_KEY = ["high", "low", "missing", "doc_id", "print", "line"]
# Repeated rows are dealt over so many places of the sorted order.
_COPIES = 4096


def line_keys(text: bytes | None, least: int = LEAST) -> tuple[int, list[int], list[bytes]]:
    """Number of lines, and the places and 16-byte hashes of the lines with a key that is long enough."""
    from xxhash import xxh3_128_digest

    lines = (text or b"").lower().split(b"\n")
    places, hashes = [], []
    for at, line in enumerate(lines):
        if len(line) < least:
            continue
        key = line.strip()
        # A code point takes up to four bytes.
        if len(key) >= 4 * least or (len(key) >= least and (key.isascii() or len(key.decode()) >= least)):
            places.append(at)
            hashes.append(xxh3_128_digest(key))
    return len(lines), places, hashes


def keyed_lines(documents: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """A row for each line with a long enough key, and one per document with its number of lines and no hash."""
    rows = documents.select(
        F.coalesce(F.col(id).cast("long"), F.lit(_LAST)).alias("doc_id"),
        F.col(id).isNull().alias("missing"),
        F.xxhash64(text).alias("print"),
        F.col(text).cast("binary").alias("text"),
    )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(3).to_pylist()
        for start, stop in slices(texts):
            found = [line_keys(data, least) for data in texts[start:stop]]
            counts = np.array([len(places) for _, places, _ in found])
            who = np.concatenate((np.arange(start, stop), np.repeat(np.arange(start, stop), counts)))
            hashes = np.frombuffer(b"".join([digest for _, _, digests in found for digest in digests]), ">i8").reshape(-1, 2)
            head = np.zeros(stop - start, np.int64)
            line = np.concatenate([np.array([n for n, _, _ in found], np.int64), *[np.array(places, np.int64) for _, places, _ in found]])
            columns = [
                pa.array(np.concatenate((head, hashes[:, 0])).astype(np.int64)),
                pa.array(np.concatenate((head, hashes[:, 1])).astype(np.int64)),
                *[batch.column(at).take(pa.array(who)) for at in (1, 0, 2)],
                pa.array(line),
                pa.array((who % _COPIES).astype(np.int32)),
                pa.array(np.arange(len(who)) < stop - start),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*_KEY, "copy", "is_count"])

    schema = "high long, low long, missing boolean, doc_id long, print long, line long, copy int, is_count boolean"
    return per_batch(rows, schema, run)


# What a row of the sorted scan says.
_DROP, _OPEN, _EDGE = 0, 1, 2


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the sorted rows of one range: dropped rows, open rows, and the reports on the range's first and last hash."""
    first = last = None
    columns: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [column.to_numpy(zero_copy_only=False) for column in batch.columns]
        high, low, missing, doc = columns[:4]
        fresh = np.ones(len(high), bool)
        fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        goes_on = last is not None and (int(high[0]), int(low[0])) == last[:2]
        # Per row the first document of its hash in this range.
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(high)), 0))
        owner, owner_missing = doc[begin], missing[begin]
        if goes_on:
            carried = begin == 0
            owner, owner_missing = np.where(carried, last[3], owner), np.where(carried, last[2], owner_missing)
        first = first or (int(high[0]), int(low[0]), bool(missing[0]), int(doc[0]))
        last = int(high[-1]), int(low[-1]), bool(owner_missing[-1]), int(owner[-1])
        later = (doc != owner) | (missing != owner_missing)
        unsure = ~later & (high == first[0]) & (low == first[1])
        yield _said(batch, later, _DROP)
        yield _said(batch, unsure, _OPEN)
    if first:
        edges = list(zip(*[(*edge, 0, 0, _EDGE) for edge in {first, last}]))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(edges, kinds)], names=[*_KEY, "said"])


def _said(batch: pa.RecordBatch, chosen: np.ndarray, kind: int) -> pa.RecordBatch:
    picked = batch.take(pa.array(np.flatnonzero(chosen)))
    return pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.full(picked.num_rows, kind, np.int32))], names=[*_KEY, "said"])


def repeated_lines(keyed: DataFrame) -> DataFrame:
    """Rows (missing, doc_id, print, line) of the lines that an earlier document holds."""
    spark = keyed.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*_KEY[:4], "line", "print", "copy"]
    rows = keyed.where("NOT is_count").select(*_KEY, "copy")
    ranged = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).drop("copy")
    schema = "high long, low long, missing boolean, doc_id long, print long, line long, said int"
    said = stored(ranged.mapInArrow(_scan, schema), "line-scan")
    owner = F.min(F.struct("missing", "doc_id")).alias("owner")
    # Two rows a task at most.
    edges = F.broadcast(said.where(F.col("said") == _EDGE).groupBy("high", "low").agg(owner))
    settled = said.where(F.col("said") == _OPEN).join(edges, ["high", "low"]).where("struct(missing, doc_id) > owner")
    place = ["missing", "doc_id", "print", "line"]
    return said.where(F.col("said") == _DROP).select(*place).union(settled.select(*place))


def packed(n_lines: int, dropped: np.ndarray) -> bytes:
    """A bit a line, one for a line that stays; compressed."""
    kept = np.ones(n_lines, bool)
    kept[dropped] = False
    return zlib.compress(np.packbits(kept).tobytes(), 1)


def unpacked(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (missing, doc_id, print, is_count, line): a document's number of lines, then its dropped lines."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        values = [column.to_numpy() for column in table.columns]
        changes = np.logical_or.reduce([values[at][1:] != values[at][:-1] for at in range(3)])
        borders = np.append(0, np.flatnonzero(changes) + 1)
        yield _packed_rows(values, borders)
        held = table.slice(int(borders[-1])).combine_chunks().to_batches()[0]
    if held is not None:
        yield _packed_rows([column.to_numpy(zero_copy_only=False) for column in held.columns], np.array([0, held.num_rows]))


def _packed_rows(values: list[np.ndarray], borders: np.ndarray) -> pa.RecordBatch:
    missing, doc, text, counts, line = values
    heads = borders[:-1]
    gone = [line[low + 1 : high] for low, high in zip(borders[:-1], borders[1:])]
    columns = [
        pa.array(missing[heads]),
        pa.array(doc[heads]),
        pa.array(text[heads]),
        pa.array(line[heads]),
        pa.array([len(places) for places in gone], pa.int64()),
        pa.array([packed(n, places) for n, places in zip(line[heads].tolist(), gone)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["missing", "doc_id", "print", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(documents: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Per document `missing`, doc_id, `print`, n_lines, n_dropped and `keep`, the compressed bitmap of its lines."""
    keyed = stored(keyed_lines(documents, text, id, least), "line-keys")
    order = ["missing", "doc_id", "print", "is_count", "line"]
    counts = keyed.where("is_count").select("missing", "doc_id", "print", "is_count", "line")
    gone = repeated_lines(keyed).withColumn("is_count", F.lit(False)).select(*counts.columns)
    # Repeated rows say the same; their sayings combine before the shuffle.
    said = counts.union(gone).distinct()
    placed = said.repartition("missing", "doc_id", "print").sortWithinPartitions(*order[:3], F.desc("is_count"), "line")
    schema = "missing boolean, doc_id long, print long, n_lines long, n_dropped long, keep binary"
    return stored(placed.mapInArrow(_bitmaps, schema), "line-bitmaps")


def _decoded(bitmaps: DataFrame) -> DataFrame:
    """The bitmaps of documents that lose lines, as arrays of booleans."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            n_lines, n_dropped, keep = (row.column(place)[0].as_py() for place in (3, 4, 5))
            stays = pa.array([unpacked(keep, n_lines) if n_dropped else None], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*row.columns[:5], stays], names=[*row.schema.names[:5], "stays"])

    schema = "missing boolean, doc_id long, print long, n_lines long, n_dropped long, stays array<boolean>"
    return per_batch(bitmaps, schema, run)


def _cut(documents: DataFrame, bitmaps: DataFrame, text: str, id: str) -> DataFrame:
    """Per document `row` with its columns, n_lines, n_dropped, and `kept`, the lines that stay."""
    sides = documents.select(
        F.col(id).isNull().alias("missing"),
        F.coalesce(F.col(id).cast("long"), F.lit(_LAST)).alias("doc_id"),
        F.xxhash64(text).alias("print"),
        F.struct("*").alias("row"),
    )
    joined = sides.join(_decoded(bitmaps), ["missing", "doc_id", "print"])
    whole = F.coalesce(F.col("row")[text], F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line, at: F.get("stays", at))
    kept = F.when(F.col("n_dropped") == 0, whole).otherwise(F.array_join(lines, "\n"))
    return joined.select("row", "n_lines", "n_dropped", kept.alias("kept"))


def apply(documents: DataFrame, bitmaps: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents, all columns, with only the lines that stay; a missing text becomes an empty one."""
    return _cut(documents, bitmaps, text, id).select(F.col("row").withField(text, F.col("kept")).alias("row")).select("row.*")


def digests(documents: DataFrame, bitmaps: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Counts of lines and the hash of the kept text, per document."""
    cut = _cut(documents, bitmaps, text, id)
    return cut.select(F.col("row")[id].alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
