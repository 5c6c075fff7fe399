"""Exact quotients of counts and totals. Division by zero gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT = "decimal(19,0)"
TOTAL = "decimal(24,7)"
UNITS_PER_ONE = 10_000_000


def units(measure: Column) -> Column:
    """A measure as whole ten-millionths, its last decimal place."""
    return (measure * F.lit(UNITS_PER_ONE)).cast("bigint")


def steps_down(count: Column, width: int) -> Column:
    """Whole steps of this width in a whole number, rounded down also below zero."""
    return ((count - F.pmod(count, F.lit(width))) / F.lit(width)).cast("bigint")


def quotient(total: Column, count: Column) -> Column:
    """Unrounded quotient with 21 decimal places.

    The built-in average of a short decimal adds up doubles, which stops being exact at about a billion rows.
    """
    return F.try_divide(total.cast(TOTAL), count.cast(COUNT))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(F.lit(100) * part.cast(COUNT), whole.cast(COUNT)), digits)


def divisiveness(believers: Column, deniers: Column) -> Column:
    """1 for an even split, 0 when all are on one side; 1 also when a group has neither.

    One minus twice the distance of the believers' share from one half is twice the smaller share.
    """
    share = F.try_divide(F.lit(2) * F.least(believers, deniers).cast(COUNT), (believers + deniers).cast(COUNT))
    return F.round(F.coalesce(share, F.lit(1).cast("decimal(38,15)")), 4)


def two_way_ratio(part: Column, other: Column, digits: int = 3) -> Column:
    """Share of `part` in the two counts, NULL if both are zero."""
    return F.round(F.try_divide(part.cast(COUNT), (part + other).cast(COUNT)), digits)


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as a decimal."""
    return F.round(value.cast("decimal(24,12)"), digits)
