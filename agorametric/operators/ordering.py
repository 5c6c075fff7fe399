"""Result order with missing values last when ascending and first when descending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_keys(*names: str) -> list[Column]:
    """A leading minus sign means descending."""
    return [
        F.col(name[1:]).desc_nulls_first() if name.startswith("-") else F.col(name).asc_nulls_last() for name in names
    ]


def in_order(frame: DataFrame, *names: str) -> DataFrame:
    return frame.orderBy(*sort_keys(*names))


def top(frame: DataFrame, rows: int, *names: str) -> DataFrame:
    """First rows in this order; name enough keys to make it total."""
    return in_order(frame, *names).limit(rows)
