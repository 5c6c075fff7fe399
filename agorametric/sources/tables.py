"""Parquet tables: staging, clean posts, cells and marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agorametric.schemas import CLEAN, RAW
from agorametric.session import temporary_settings

# Shuffled bytes behind one file of the clean table; Parquet stores them in about a third.
FILE_BYTES = "768MB"

# Half the size of the default codec at the same speed, both ways.
CODEC = "zstd"


def write_raw(raw: DataFrame, path: str) -> None:
    raw.write.mode("overwrite").option("compression", CODEC).parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).parquet(path)


def write_clean(clean: DataFrame, path: str, gather: bool = True, file_bytes: str = FILE_BYTES) -> None:
    """Partitioned by year and sorted inside files by the other filter columns.

    The rebalance hint gathers each year's rows into files of about that size. A year with most of the rows is split
    over many tasks, and a small one is a single file. Input files that are in time order already hold few years each;
    `gather=False` saves the shuffle for those.
    """
    # Without adaptive execution the hint would do nothing.
    gathering = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": file_bytes}
    with temporary_settings(clean.sparkSession, gathering):
        rows = clean.hint("rebalance", "tweet_year") if gather else clean
        (
            rows.sortWithinPartitions("tweet_year", "topic", "continent")
            .write.mode("overwrite")
            .option("compression", CODEC)
            .partitionBy("tweet_year")
            .parquet(path)
        )


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """The clean table in its declared column order; a year filter prunes folders."""
    return spark.read.schema(CLEAN).parquet(path).select(*CLEAN.names)
