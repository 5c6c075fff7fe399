"""Data-quality audit of the staging table, one question per function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.functions.text import is_blank, is_number, strict_number
from agorametric.operators.ordering import in_order, top
from agorametric.operators.profiles import category_profile, exact_numbers, number_profile, tally, with_totals
from agorametric.operators.wide_numbers import sum_and_average
from agorametric.settings import DEFAULTS, Settings


def created_at_format(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Most frequent beginnings of the time text; ties in text order."""
    prefix = F.left("created_at", F.lit(settings.format_prefix)).alias("sample_format")
    counts = raw.groupBy(prefix).agg(F.count(F.lit(1)).alias("occurrences"))
    return top(counts, settings.format_top, "-occurrences", "sample_format")


def ids(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.count(F.lit(1)).alias("total"),
        tally(F.col("id").isNull()).alias("null_ids"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
    )


def latitude(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return number_profile(raw, "lat", "lat", valid_range=settings.latitude_range)


def longitude(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return number_profile(raw, "lng", "lng", valid_range=settings.longitude_range)


def temperature(raw: DataFrame) -> DataFrame:
    return number_profile(raw, "temperature_avg", "temp", average_digits=4)


def sentiment(raw: DataFrame) -> DataFrame:
    """Every row must be a number here: the least, greatest and average value are strict and fail on others."""
    text, number = F.col("sentiment"), strict_number(F.col("sentiment"))
    parsed = raw.select(text, number.alias("number"), number.cast("double").alias("nearest"))
    valid = tally(is_number(text))
    measures = [
        F.count(F.lit(1)).alias("total"),
        tally(is_blank(text)).alias("null_or_blank"),
        F.count(text).alias("non_null_rows"),
        valid.alias("valid_numeric"),
        (F.count(F.lit(1)) - valid).alias("problem_rows"),
        F.min("nearest").alias("min_sentiment"),
        F.max("nearest").alias("max_sentiment"),
    ]
    found = with_totals(parsed, measures)
    average = sum_and_average(F.col("totals"), F.col("filled"), 6)["average"]
    return found.select(
        "total",
        "null_or_blank",
        F.coalesce("non_null_rows", F.lit(0).cast("bigint")).alias("non_null_rows"),
        *("valid_numeric", "problem_rows", "min_sentiment", "max_sentiment"),
        average.try_cast("decimal(38,6)").alias("avg_sentiment"),
    )


def numbers(raw: DataFrame) -> DataFrame:
    """Exact least, greatest, sum and average of the well-formed numbers of each measure, as plain texts."""
    return exact_numbers(raw, ("lat", "lng", "temperature_avg", "sentiment"))


def categories(raw: DataFrame) -> DataFrame:
    """Values as found, before any standardising. Missing ones and the text 'NULL' stay two rows."""
    return in_order(category_profile(raw, ("stance", "gender", "aggressiveness")), "col", "-n", "val")


def topics(raw: DataFrame) -> DataFrame:
    counts = raw.groupBy("topic").agg(F.count(F.lit(1)).alias("occurrences"))
    return in_order(
        counts.select(F.coalesce("topic", F.lit("NULL")).alias("topic_value"), "occurrences"),
        "-occurrences",
        "topic_value",
    )


def duplicates(raw: DataFrame) -> DataFrame:
    """Exact; ids are spread by hash, and repeats of one id combine before the shuffle."""
    rows, distinct = F.count(F.lit(1)), F.countDistinct("id")
    return raw.agg(
        rows.alias("total_rows"), distinct.alias("distinct_ids"), (rows - distinct).alias("duplicate_rows")
    )
