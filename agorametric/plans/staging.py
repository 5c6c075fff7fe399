"""Checks on freshly staged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.operators.ordering import top
from agorametric.settings import DEFAULTS, Settings


def row_count(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count(F.lit(1)).alias("total_imported_rows"))


def preview(raw: DataFrame, settings: Settings = DEFAULTS, by_id: bool = False) -> DataFrame:
    """A few rows: the first at hand, or with `by_id` always the same ones, which reads the whole table."""
    return top(raw, settings.preview_rows, "id") if by_id else raw.limit(settings.preview_rows)
