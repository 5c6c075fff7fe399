"""Share of each group in the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.functions.ratios import percent


def with_share(groups: DataFrame, count: str, share: str, digits: int = 2) -> DataFrame:
    """Adds each row's percentage of the column total.

    The total is a one-row subquery over the already grouped rows, so they are not all moved to one task.
    """
    # The mark reads every column, so that the subquery groups the same columns and its exchange is shared.
    mark = F.max(F.xxhash64(*groups.columns))
    total = groups.agg(F.struct(F.sum(count).alias("total"), mark.alias("mark"))).scalar()
    return groups.withColumn(share, percent(F.col(count), total["total"], digits))
