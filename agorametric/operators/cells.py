"""One vocabulary of measures for single posts and for cells that stand for many posts.

A report written against `Cells` runs over the clean table (one scan, one partial and one final aggregate) and just as
well over the small pre-aggregated table that `merge` makes, so that a dashboard's marts cost a single scan together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from agorametric.functions.ratios import COUNT, TOTAL, UNITS_PER_ONE, quotient, rounded, units

MEASURES = ("sentiment_score", "temperature_avg")

# The dimensions of the stored cell table. All but the topic have small fixed domains.
DIMENSIONS = (
    "tweet_year",
    "tweet_month",
    "topic",
    "continent",
    "stance",
    "gender",
    "aggressiveness",
    "is_aggressive",
    "sentiment_category",
    "has_coordinates",
    "has_sentiment",
    "has_temperature",
)

_LOW_BITS = 20
_LOW_MASK = (1 << _LOW_BITS) - 1

# Whole numbers as wide as they come.
WHOLE = "decimal(38,0)"


@dataclass(frozen=True)
class Cells:
    frame: DataFrame
    merged: bool = False

    @classmethod
    def of_rows(cls, clean: DataFrame) -> Cells:
        return cls(
            clean.withColumns(
                {
                    "has_sentiment": F.col("sentiment_score").isNotNull(),
                    "has_temperature": F.col("temperature_avg").isNotNull(),
                }
            )
        )

    def where(self, condition: Column) -> Cells:
        return Cells(self.frame.where(condition), self.merged)

    def by(self, *keys: str | Column) -> GroupedData:
        return self.frame.groupBy(*keys)

    def merge(self, *dimensions: str) -> Cells:
        """Cells with these dimensions only. Catalyst drops the measures a report does not read."""
        measures = [self.count().alias("n")]
        for name in MEASURES:
            measures += [
                self.filled(name).alias(f"{name}_n"),
                self.total(name).alias(f"{name}_sum"),
                self.squares(name).alias(f"{name}_squares"),
                self.low(name).alias(f"{name}_low"),
                self.high(name).alias(f"{name}_high"),
            ]
        measures += [
            self.products().alias("products"),
            self.earliest().alias("earliest"),
            self.latest().alias("latest"),
        ]
        return Cells(self.by(*dimensions).agg(*measures), merged=True)

    def count(self, condition: Column | None = None) -> Column:
        """Posts, or posts for which the condition is true."""
        if not self.merged:
            return F.count(F.lit(1)) if condition is None else F.count_if(condition)
        return F.coalesce(F.sum(_only(condition, F.col("n"))), F.lit(0).cast("bigint"))

    def tally(self, condition: Column) -> Column:
        """As `count`, but NULL when there are no posts at all."""
        weight = F.col("n") if self.merged else F.lit(1)
        return F.sum(F.when(condition, weight).otherwise(0))

    def filled(self, measure: str, condition: Column | None = None) -> Column:
        """Posts that have the measure."""
        if not self.merged:
            return F.count(_only(condition, F.col(measure)))
        return F.coalesce(F.sum(_only(condition, F.col(f"{measure}_n"))), F.lit(0).cast("bigint"))

    def total(self, measure: str, condition: Column | None = None) -> Column:
        """Exact sum.

        Posts are added up as whole ten-millionths in two long sums, upper and lower bits apart: several times faster
        than a decimal sum, and neither part can overflow below 8 trillion posts.
        """
        if self.merged:
            return F.sum(_only(condition, F.col(f"{measure}_sum"))).cast(TOTAL)
        whole = _only(condition, units(F.col(measure)))
        return (_exact_sum(whole) * F.lit("0.0000001").cast("decimal(7,7)")).cast(TOTAL)

    def squares(self, measure: str, condition: Column | None = None) -> Column:
        """Exact sum of the measure's squares, in squared ten-millionths."""
        if self.merged:
            return F.sum(_only(condition, F.col(f"{measure}_squares"))).cast(WHOLE)
        value = units(F.col(measure))
        return _exact_products(_only(condition, value), value)

    def products(self, condition: Column | None = None) -> Column:
        """Exact sum of the two measures' product over posts that have both, in squared ten-millionths."""
        if self.merged:
            return F.sum(_only(condition, F.col("products"))).cast(WHOLE)
        first, second = (units(F.col(name)) for name in MEASURES)
        return _exact_products(_only(condition, first), second)

    def whole(self, measure: str, condition: Column | None = None) -> Column:
        """Exact sum in ten-millionths; zero without posts."""
        if self.merged:
            total = self.total(measure, condition) * F.lit(UNITS_PER_ONE)
        else:
            total = _exact_sum(_only(condition, units(F.col(measure))))
        return F.coalesce(total.cast(WHOLE), F.lit(0).cast(WHOLE))

    def low(self, measure: str, condition: Column | None = None) -> Column:
        return F.min(_only(condition, F.col(f"{measure}_low" if self.merged else measure)))

    def high(self, measure: str, condition: Column | None = None) -> Column:
        return F.max(_only(condition, F.col(f"{measure}_high" if self.merged else measure)))

    def earliest(self) -> Column:
        return F.min("earliest" if self.merged else "tweet_timestamp")

    def latest(self) -> Column:
        return F.max("latest" if self.merged else "tweet_timestamp")

    def mean(self, measure: str) -> Column:
        """Unrounded average of the posts that have the measure."""
        return quotient(self.total(measure), self.filled(measure))

    def average(self, measure: str, digits: int = 4) -> Column:
        return F.round(self.mean(measure), digits)

    def deviation(self, measure: str, digits: int = 4) -> Column:
        """Sample standard deviation, NULL for fewer than two values."""
        n, total = self.filled(measure), self.whole(measure)
        spread = _spread(n, self.squares(measure), total, total)
        return rounded(F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1)) / UNITS_PER_ONE), digits)

    def flag_rate(self, flag: str) -> Column:
        """Unrounded share of true among the posts whose flag is known."""
        return quotient(self.count(F.col(flag)), self.count(F.col(flag).isNotNull()))

    def correlation(self, digits: int = 4) -> Column:
        """Pearson correlation of the two measures; NULL if either is constant."""
        first, second = MEASURES
        both = F.col("has_sentiment") & F.col("has_temperature")
        n = self.count(both)
        x, y = (self.whole(name, both) for name in MEASURES)
        varied = (self.low(first, both) < self.high(first, both)) & (self.low(second, both) < self.high(second, both))
        return _pearson(
            _spread(n, self.products(both), x, y),
            _spread(n, self.squares(first, both), x, x),
            _spread(n, self.squares(second, both), y, y),
            varied,
            digits,
        )

    def flag_correlation(self, measure: str, flag: str, digits: int = 4) -> Column:
        """Pearson correlation of a measure with a flag read as 0 or 1; NULL if either is constant."""
        present = F.col("has_sentiment" if measure == MEASURES[0] else "has_temperature")
        known = present & F.col(flag).isNotNull()
        marked = present & F.col(flag)
        n, hits = self.count(known), self.count(marked)
        x = self.whole(measure, known)
        varied = (self.low(measure, known) < self.high(measure, known)) & (hits > 0) & (hits < n)
        return _pearson(
            _spread(n, self.whole(measure, marked), x, hits.cast(WHOLE)),
            _spread(n, self.squares(measure, known), x, x),
            _spread(n, hits.cast(WHOLE), hits.cast(WHOLE), hits.cast(WHOLE)),
            varied,
            digits,
        )


def _only(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)


def _exact_sum(whole: Column) -> Column:
    """Sum of longs whose upper and lower bits are added up apart, so that neither sum can overflow."""
    upper = F.sum(F.shiftright(whole, _LOW_BITS)).cast(COUNT)
    lower = F.sum(whole.bitwiseAND(F.lit(_LOW_MASK))).cast(COUNT)
    return upper * F.lit(1 << _LOW_BITS) + lower


def _exact_products(first: Column, second: Column) -> Column:
    """Sum of the products of two whole measures, from the products of their upper and lower bits."""
    (a, b), (c, d) = (
        (F.shiftright(value, _LOW_BITS), value.bitwiseAND(F.lit(_LOW_MASK))) for value in (first, second)
    )
    scale = F.lit(1 << _LOW_BITS).cast("decimal(7,0)")
    high, middle, low = (_exact_sum(part).cast(WHOLE) for part in (a * c, a * d + b * c, b * d))
    return (((high * scale).cast(WHOLE) + middle).cast(WHOLE) * scale).cast(WHOLE) + low


def _spread(n: Column, products: Column, x: Column, y: Column) -> Column:
    """Sum of the products of deviations from the means, as a double.

    Whole numbers next to the means are taken off exactly, which is where large sums cancel; what is left of the means
    is about one unit.
    """
    count = F.greatest(n, F.lit(1).cast("bigint"))
    p, q = (F.round(total.cast("double") / count).cast("decimal(19,0)") for total in (x, y))
    # The sum of (a - p)(b - q) is the sum of ab, less p times the sum of b, less q times the sum of (a - p).
    x_left = (x - p * count.cast(COUNT)).cast(COUNT)
    shifted = products - (p * y).cast(WHOLE) - (q * x_left).cast(WHOLE)
    y_left = (y - q * count.cast(COUNT)).cast(COUNT)
    return shifted.cast("double") - x_left.cast("double") * y_left.cast("double") / count


def _pearson(covariance: Column, first: Column, second: Column, varied: Column, digits: int) -> Column:
    return rounded(F.when(varied, covariance / (F.sqrt(first) * F.sqrt(second))), digits)
