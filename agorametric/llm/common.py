"""What the operators share: session settings, stored intermediate tables, batch helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from agorametric.session import configure, scratch_path

# Rows of one Arrow batch to or from a Python worker; long texts are bounded by bytes as well.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the session that keep the memory of Python workers bounded."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends there, and the size is known to the planner."""
    spark = frame.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def per_batch(
    frame: DataFrame, schema: str, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]
) -> DataFrame:
    """`function` over each Arrow batch of the rows; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return frame.mapInArrow(run, schema)


def slices(texts: list[bytes | None], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of the texts with about so many bytes each."""
    start = size = 0
    for at, text in enumerate(texts):
        size += len(text or b"")
        if size >= most:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)
