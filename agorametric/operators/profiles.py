"""Profiles of text columns that should hold numbers, and of category columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametric.functions.ratios import percent
from agorametric.functions.text import is_blank, is_number, nearest_number
from agorametric.operators.wide_numbers import sum_and_average, total_of, with_mantissas, with_sort_key


def tally(condition: Column) -> Column:
    """Rows for which the condition is true; NULL when there are no rows at all."""
    return F.sum(F.when(condition, 1).otherwise(0))


def number_profile(
    frame: DataFrame,
    column: str,
    suffix: str,
    valid_range: tuple[int, int] | None = None,
    average_digits: int | None = None,
) -> DataFrame:
    """One row: total, blank, malformed and (with a range) out-of-range texts, least and greatest number, average."""
    text = F.col("text")
    nearest = F.col("nearest")
    parsed = frame.select(F.col(column).alias("text")).select(
        text, is_number(text).alias("shaped"), nearest_number(text).alias("nearest")
    )
    measures = [
        F.count(F.lit(1)).alias("total"),
        tally(is_blank(text)).alias("null_or_blank"),
        tally(~is_blank(text) & ~F.col("shaped")).alias("non_numeric"),
    ]
    if valid_range is not None:
        # The nearest double of a number beyond the edge of the range may be the edge.
        at_edge = nearest.isin(*map(float, valid_range))
        wide = text.try_cast("decimal(38,24)")
        outside = F.when(at_edge, ~wide.between(*valid_range)).otherwise(~nearest.between(*valid_range))
        measures.append(tally(F.col("shaped") & outside).alias("out_of_range"))
    # Extremes are rounded to doubles; `exact_numbers` has them as they stand.
    measures += [F.min("nearest").alias(f"min_{suffix}"), F.max("nearest").alias(f"max_{suffix}")]
    if average_digits is None:
        return parsed.agg(*measures)
    numbers = parsed.withColumn("number", F.when(F.col("shaped"), text))
    found = with_totals(numbers, measures)
    average = sum_and_average(F.col("totals"), F.col("filled"), average_digits)["average"]
    return found.select(
        *found.columns[: len(measures)], average.try_cast(f"decimal(38,{average_digits})").alias(f"avg_{suffix}")
    )


def _with_each_mantissa(numbers: DataFrame) -> DataFrame:
    """Each row once without a power, and once for each mantissa of its `number`."""
    row = F.array(F.struct(F.lit(None).cast("int").alias("power"), F.lit(None).cast("bigint").alias("value")))
    none = F.array().cast("array<struct<power: int, value: bigint>>")
    every = with_mantissas(numbers, F.col("number")).withColumn("mantissas", F.concat(row, F.coalesce("mantissas", none)))
    return every.select("*", F.explode("mantissas").alias("part")).select("*", "part.power", "part.value").drop("mantissas", "part")


def _collected() -> Column:
    """Totals by power in one array. As many as there are powers of ten in the column, whatever its rows."""
    return F.collect_list(F.when(F.col("power").isNotNull(), F.struct("power", F.col("power_total").alias("total"))))


def with_totals(numbers: DataFrame, measures: list[Column]) -> DataFrame:
    """The measures of all rows in one row, then `filled`, how many have a `number`, and `totals` by power of ten.

    One scan: each row is followed by its mantissas. Groups are the powers, and one without a power, the rows.
    """
    filled = F.count("number").alias("filled")
    groups = _with_each_mantissa(numbers).groupBy("power").agg(*measures, filled, total_of(F.col("value")).alias("power_total"))
    names = groups.columns[1:-1]
    found = {name: F.max(F.when(F.col("power").isNull(), F.col(name))) for name in names}
    for name in (names[0], "filled"):
        found[name] = F.coalesce(found[name], F.lit(0).cast("bigint"))
    return groups.agg(*(value.alias(name) for name, value in found.items()), _collected().alias("totals"))


def exact_numbers(frame: DataFrame, columns: Sequence[str], average_digits: int = 4) -> DataFrame:
    """Per column how many texts are numbers, and their least, greatest, sum and average, exact whatever their width.

    Figures are plain texts, since no type holds them all. Of equal numbers written in several ways the first in text
    order is the least, the last the greatest. Two scans: sums group by power of ten, extremes by column only.
    """
    pairs = ", ".join(f"'{name}', CAST({name} AS STRING)" for name in columns)
    stacked = frame.select(F.expr(f"stack({len(columns)}, {pairs}) AS (col, text)"))
    numbers = stacked.select("col", F.when(is_number(F.col("text")), F.col("text")).alias("number"))
    groups = _with_each_mantissa(numbers).groupBy("col", "power")
    groups = groups.agg(F.count("number").alias("n"), total_of(F.col("value")).alias("power_total"))
    sums = groups.groupBy("col").agg(
        F.max(F.when(F.col("power").isNull(), F.col("n"))).alias("n_numbers"), _collected().alias("totals")
    )
    keyed = with_sort_key(numbers, F.col("number")).where("number IS NOT NULL")
    ends = keyed.select("col", F.struct("key", "number").alias("end")).groupBy("col").agg(F.min("end").alias("low"), F.max("end").alias("high"))
    # A row for each of the columns asked for.
    named = F.broadcast(ends.select("col", F.col("low.number").alias("least"), F.col("high.number").alias("greatest")))
    settled = sum_and_average(F.col("totals"), F.col("n_numbers"), average_digits)
    found = sums.select("col", "n_numbers", settled.alias("settled")).join(named, "col", "left")
    return found.select("col", "n_numbers", "least", "greatest", "settled.total", "settled.average")


def stacked_counts(frame: DataFrame, columns: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Column name, value and count for several columns, in one scan and one aggregate."""
    pairs = ", ".join(f"'{name}', {name}" for name in columns)
    stacked = frame.select(
        *(F.col(name) for name in columns), (F.lit(1).cast("bigint") if weight is None else weight).alias("weight")
    ).select("weight", F.expr(f"stack({len(columns)}, {pairs}) AS (col, val)"))
    return stacked.groupBy("col", "val").agg(F.sum("weight").alias("n"))


def category_profile(frame: DataFrame, columns: Sequence[str], share_digits: int = 4) -> DataFrame:
    """Stacked counts with each value's share of its column.

    A column may hold any number of values, so its total is an aggregate joined back, not a window in one task. The
    totals are broadcast: they have one row for each of `columns`.
    """
    counts = stacked_counts(frame, columns)
    totals = counts.groupBy("col").agg(F.sum("n").alias("rows"))
    return counts.join(F.broadcast(totals), "col").select(
        "col",
        F.coalesce("val", F.lit("NULL")).alias("val"),
        "n",
        percent(F.col("n"), F.col("rows"), share_digits).alias("pct"),
    )
