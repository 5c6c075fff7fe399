"""Checks after cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.functions.ratios import percent
from agorametric.operators.cells import Cells
from agorametric.operators.ordering import in_order
from agorametric.operators.profiles import stacked_counts

_CATEGORIES = ("stance", "gender", "aggressiveness", "sentiment_category", "continent")


def reconcile(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Row counts of both tables and their difference, from two one-row aggregates."""
    none = F.lit(0).cast("bigint")
    counts = raw.agg(F.count(F.lit(1)).alias("raw_rows")).withColumn("clean_rows", none)
    counts = counts.unionByName(clean.agg(F.count(F.lit(1)).alias("clean_rows")).withColumn("raw_rows", none))
    return counts.agg(F.sum("raw_rows").alias("raw_rows"), F.sum("clean_rows").alias("clean_rows")).withColumn(
        "difference", F.col("raw_rows") - F.col("clean_rows")
    )


def year_distribution(cells: Cells) -> DataFrame:
    return in_order(cells.by("tweet_year").agg(cells.count().alias("tweets")), "tweet_year")


def completeness(cells: Cells) -> DataFrame:
    geotagged = cells.tally(F.col("has_coordinates"))
    return cells.frame.agg(
        cells.count().alias("total"),
        geotagged.alias("geotagged"),
        percent(geotagged, cells.count()).alias("pct_geotagged"),
        cells.tally(~F.col("has_sentiment")).alias("null_sentiment"),
        cells.tally(~F.col("has_temperature")).alias("null_temp"),
        *(
            cells.tally(F.col(name) == "Unknown").alias(f"unknown_{name}")
            for name in ("gender", "stance", "continent")
        ),
    )


def categories(cells: Cells) -> DataFrame:
    """All five columns have small fixed domains, so posts merge into their combinations before they are stacked."""
    combinations = cells.merge(*_CATEGORIES).frame
    return in_order(stacked_counts(combinations, _CATEGORIES, F.col("n")), "col", "-n", "val")


def coverage(cells: Cells) -> DataFrame:
    """Posts merge into years first, so counting the distinct ones costs nothing more."""
    years = cells.merge("tweet_year")
    return years.frame.agg(
        years.earliest().alias("earliest_tweet"),
        years.latest().alias("latest_tweet"),
        F.countDistinct("tweet_year").alias("total_years"),
    )
