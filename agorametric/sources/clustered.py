"""A clean table for filters on any of several columns, and for single posts by id.

The layout by year serves filters on the year. Here rows lie in the order of a curve that interleaves the bits of several
columns, so rows that are near in each of them share row groups, and the row groups' least and greatest values rule
most of them out for a filter on any one column, or on several at once. Bloom filters do the same for the id.

Each column is first cut into ranges that hold about equally many rows, by approximate percentiles. Only these bounds
reach the driver, a few dozen numbers for each column, whatever the rows. They decide the layout and never a result.
Rows are dealt over files by ranges of (curve, id), so rows that are equal in all columns of the curve are split too.

Missing values are in the first range. Text is ranged by its first six bytes. All columns and rows pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampType

from agorametric.session import temporary_settings
from agorametric.sources.tables import CODEC, FILE_BYTES

# The columns of the curve, in the order in which their bits are taken.
BY = ("tweet_timestamp", "topic", "lat", "lng")
# Each column is cut into two to the power of this many ranges.
BITS = 5
# A filter skips whole row groups; smaller ones are skipped more often, larger ones compress better.
GROUP_BYTES = 32 << 20
# Different ids of a row group that its Bloom filter is made for, about a megabyte of it.
GROUP_IDS = 1 << 20


def _number(frame: DataFrame, column: str) -> Column:
    """A double in the order of the column's values."""
    kind, value = frame.schema[column].dataType, F.col(column)
    if isinstance(kind, StringType):
        digits = F.rpad(F.hex(F.substring(value.cast("binary"), 1, 6)), 12, "0")
        return F.conv(digits, 16, 10).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(value).cast("double")
    return value.cast("double")


def _range(value: Column, bounds: Sequence[float], first: int = 0) -> Column:
    """How many bounds are below the value, found by halving: an expression of that depth, inside generated code."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    low, high = _range(value, bounds[:half], first), _range(value, bounds[half + 1 :], first + half + 1)
    return F.when(value <= F.lit(bounds[half]), low).otherwise(high)


def curve(frame: DataFrame, by: Sequence[str] = BY, bits: int = BITS) -> Column:
    """A row's place on the curve. One scan of the columns finds the bounds."""
    if not 0 < bits * len(by) < 63:
        raise ValueError(f"{len(by)} columns of {bits} bits do not fit into a place of 62 bits")
    shares = [at / (1 << bits) for at in range(1, 1 << bits)]
    found = frame.agg(*[F.percentile_approx(_number(frame, name), shares, 1000).alias(name) for name in by]).first()
    place = F.lit(0).cast("bigint")
    for at, name in enumerate(by):
        bounds = sorted({bound for bound in found[name] or []})
        number = _number(frame, name)
        rank = F.when(number.isNull(), 0).otherwise(_range(number, bounds)).cast("bigint")
        for bit in range(bits):
            one = F.shiftright(rank, bit).bitwiseAND(F.lit(1).cast("bigint"))
            place = place + F.shiftleft(one, bit * len(by) + len(by) - 1 - at)
    return place


def write_clustered(
    clean: DataFrame, path: str, by: Sequence[str] = BY, id: str = "tweet_id", file_bytes: str = FILE_BYTES, group_bytes: int = GROUP_BYTES
) -> None:
    """Replaces the table at the path. `clean` is read twice, and shuffled once."""
    names = clean.columns
    placed = clean.select(*[F.col(f"`{name}`").alias(f"column {at}") for at, name in enumerate(names)], curve(clean, by).alias("place"))
    key = f"column {names.index(id)}"
    with temporary_settings(clean.sparkSession, {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": file_bytes}):
        rows = placed.repartitionByRange("place", F.col(f"`{key}`")).sortWithinPartitions("place", F.col(f"`{key}`"))
        (
            rows.select(*[F.col(f"`column {at}`").alias(name) for at, name in enumerate(names)])
            .write.mode("overwrite")
            .option("compression", CODEC)
            .option("parquet.block.size", group_bytes)
            .option(f"parquet.bloom.filter.enabled#{id}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{id}", GROUP_IDS)
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(path)
        )
