"""Numbers of any width, given as text: exact sums and averages, and exact extremes.

A number is a whole mantissa and a power of ten. Mantissas are added up by power, which is one hash aggregate with
map-side combine and as many groups as there are lengths of fractions; digits beyond `DIGITS` go to a power of their own.
The groups' totals meet once, in one row, where they are added and divided as Python's whole numbers. Nothing depends on
how wide the numbers or the sum are, up to the digits that the type `numeric` of the source system allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits of a mantissa; the upper and lower bits of mantissas are added up apart, without overflow below 2^38 numbers.
DIGITS = 15
_LOW_BITS = 25

# Most digits of a number before and after the point.
BEFORE_POINT, AFTER_POINT = 131_072, 16_383


def _with_parts(frame: DataFrame, text: Column) -> DataFrame:
    """Adds `_digits`, without leading zeros, and `_exponent`, the power of ten of the last one."""
    small = F.lower(F.ltrim(text, F.lit("-")))
    has_point = F.contains("_mantissa", F.lit("."))
    digits = F.ltrim(F.concat(F.substring_index("_mantissa", ".", 1), F.col("_fraction")), F.lit("0"))
    frame = frame.withColumns(
        {
            "_mantissa": F.substring_index(small, "e", 1),
            "_written": F.when(F.contains(small, F.lit("e")), F.substring_index(small, "e", -1)).otherwise("0"),
        }
    ).withColumn("_fraction", F.when(has_point, F.substring_index("_mantissa", ".", -1)).otherwise(""))
    frame = frame.select(
        "*", digits.alias("_digits"), (F.col("_written").try_cast("int") - F.length("_fraction")).alias("_exponent")
    ).drop("_mantissa", "_written", "_fraction")
    exponent, size = F.col("_exponent"), F.length("_digits")
    outside = exponent.isNull() | (exponent + size > BEFORE_POINT) | (exponent < -AFTER_POINT - size)
    bad = F.raise_error(F.concat(F.lit("[NUMERIC_VALUE_OUT_OF_RANGE] too many digits: "), F.left(text, F.lit(40)))).cast("int")
    return frame.withColumn("_exponent", F.when(F.col("_digits") == "", 0).when(outside, bad).otherwise(exponent))


def with_mantissas(frame: DataFrame, text: Column) -> DataFrame:
    """Adds `mantissas`, an array of (power, value) with the number's sign; empty for zero and NULL for no text."""
    digits, exponent, size = F.col("_digits"), F.col("_exponent"), F.length("_digits")
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)

    def cut(at: Column) -> Column:
        start = F.greatest(size - (at + 1) * DIGITS, F.lit(0))
        value = F.substring(digits, start + 1, size - at * DIGITS - start).cast("bigint")
        return F.struct((exponent + at * DIGITS).alias("power"), (sign * value).alias("value"))

    one = F.array(F.struct(exponent.alias("power"), (sign * digits.try_cast("bigint")).alias("value")))
    none = F.array().cast("array<struct<power: int, value: bigint>>")
    several = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / DIGITS).cast("int")), cut)
    found = F.when(digits == "", none).when(size <= DIGITS, one).otherwise(several)
    return _with_parts(frame, text).withColumn("mantissas", found).drop("_digits", "_exponent")


def total_of(value: Column) -> Column:
    """Exact total of mantissas, as text."""
    upper = F.sum(F.shiftright(value, _LOW_BITS)).cast("decimal(19,0)") * F.lit(1 << _LOW_BITS)
    lower = F.sum(value.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).cast("decimal(19,0)")
    return (upper + lower).cast("string")


def _plain(whole: int, digits: int) -> str:
    """The number `whole` / 10^digits."""
    text = str(abs(whole)).rjust(digits + 1, "0")
    point = len(text) - digits
    sign = "-" if whole < 0 else ""
    return sign + text[:point] + ("." + text[point:] if digits else "")


def _settled(powers: list[int], totals: list[str], count: int, digits: int) -> tuple[str, str]:
    """Sum, without needless zeros, and average, rounded half away from zero."""
    lowest = min(0, *powers) if powers else 0
    whole = sum(int(total) * 10 ** (power - lowest) for power, total in zip(powers, totals))
    unit = count * 10**-lowest
    size = (2 * abs(whole) * 10**digits + unit) // (2 * unit)
    shown = _plain(whole, -lowest)
    return shown.rstrip("0").rstrip(".") if "." in shown else shown, _plain(-size if whole < 0 else size, digits)


def sum_and_average(totals: Column, count: Column, digits: int) -> Column:
    """A struct of `total` and `average`, exact, as plain texts; NULL where the count is zero.

    `totals` is an array of (power, total), each power once. For single rows, such as a whole table's: this is Python.
    """

    @F.udf(returnType="total string, average string", useArrow=False)
    def settle(totals, count):
        import sys

        if not count:
            return None, None
        # Python's own limit guards against texts from outside.
        sys.set_int_max_str_digits(0)
        return _settled([part["power"] for part in totals], [part["total"] for part in totals], count, digits)

    return settle(totals, count)


def with_sort_key(frame: DataFrame, text: Column) -> DataFrame:
    """Adds `key`, a struct that orders well-formed numbers by value; equal numbers have equal keys."""
    lead = F.col("_exponent") + F.length("_digits")
    digits = F.rtrim("_digits", F.lit("0"))
    # Below zero greater digits come first, and a number goes before those it is a beginning of.
    turned = F.concat(F.translate(digits, "0123456789", "9876543210"), F.lit(":"))
    below, is_zero = F.startswith(text, F.lit("-")), F.col("_digits") == ""
    key = F.struct(
        F.when(is_zero, 0).when(below, -1).otherwise(1).alias("side"),
        F.when(is_zero, 0).when(below, -lead).otherwise(lead).alias("lead"),
        F.when(below & ~is_zero, turned).otherwise(digits).alias("digits"),
    )
    return _with_parts(frame, text).withColumn("key", F.when(text.isNotNull(), key)).drop("_digits", "_exponent")
