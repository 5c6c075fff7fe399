"""Primary-key checks; Spark tables enforce none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Keys of a batch that are broadcast, some 16 MB of them.
BROADCAST_KEYS = 1 << 20


class KeyViolation(ValueError):
    """A key is missing or occurs more than once."""


def key_violations(frame: DataFrame, key: str) -> DataFrame:
    """Keys that are NULL or repeated. Counts combine before the shuffle, so a hot key costs one row per task."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))


def key_clashes(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys of the batch that are stored already, each once.

    The stored side is one column of the row groups within the batch's range of keys. It stays where it is for a batch
    of up to `BROADCAST_KEYS` keys; a larger one is joined by hash, behind the planner's own Bloom filter.
    """
    present = batch.select(F.col(key).alias("key")).where("key IS NOT NULL")
    # Repeated keys count here, which saves a shuffle of them all.
    low, high, count = present.agg(F.min("key"), F.max("key"), F.count("key")).first()
    keys = present.distinct()
    # A literal range reaches the Parquet reader.
    near = stored.where(F.col(key).between(F.lit(low), F.lit(high))) if low is not None else stored.limit(0)
    asked = F.broadcast(keys) if count <= BROADCAST_KEYS else keys
    found = near.select(F.col(key).alias("key")).join(asked, "key", "left_semi").distinct()
    return found.select(F.col("key").alias(key))


def require_key(frame: DataFrame, key: str) -> None:
    """The smallest violation is told. An aggregate looks at all partitions at once; `head` goes on to the next few
    after it has found none in some, and a good key has none in any."""
    found = key_violations(frame, key).agg(F.min(F.struct(F.col(key), F.col("n")))).first()[0]
    if found:
        raise KeyViolation(f"{key}={found[0]} occurs {found['n']} time(s); it must be unique and not NULL")
