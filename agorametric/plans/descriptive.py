"""Distributions and central tendencies of the clean table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorametric.functions.ratios import steps_down
from agorametric.functions.rules import bucket_edge, score_bin
from agorametric.operators.cells import Cells
from agorametric.operators.ordering import in_order
from agorametric.operators.quantiles import exact_median, median_by
from agorametric.operators.shares import with_share
from agorametric.plans.marts import mart
from agorametric.session import scratch_path
from agorametric.settings import DEFAULTS, Settings

# A multiple of ten: some two thousand bins, ten thousand possible scores in each.
BINS_PER_ONE = 1000


def kpis(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    return mart("vw_kpi_summary", cells, settings)


def _distribution(cells: Cells, key: str | Column, count: str, share: str = "pct") -> DataFrame:
    return with_share(cells.by(key).agg(cells.count().alias(count)), count, share)


def volume_by_year(cells: Cells) -> DataFrame:
    return in_order(_distribution(cells, "tweet_year", "tweets", "pct_of_total"), "tweet_year")


def score_bins(rows: Cells) -> Cells:
    """Posts merged by stance and narrow score bin: some thousand rows, worth storing next to the cells."""
    bin_number = score_bin(F.col("sentiment_score"), BINS_PER_ONE)
    return Cells(rows.frame.withColumn("bin", bin_number)).merge("stance", "bin")


def sentiment_histogram(cells: Cells) -> DataFrame:
    """From single posts or from score bins. Buckets are lower edges; posts without a score have their own."""
    tenths = steps_down(F.col("bin"), BINS_PER_ONE // 10) if cells.merged else score_bin(F.col("sentiment_score"), 10)
    bucket = bucket_edge(tenths)
    return in_order(_distribution(cells, bucket.alias("sentiment_bucket"), "tweet_count"), "sentiment_bucket")


def stances(cells: Cells) -> DataFrame:
    return in_order(_distribution(cells, "stance", "total"), "-total", "stance")


def aggressiveness(cells: Cells) -> DataFrame:
    return in_order(_distribution(cells, "aggressiveness", "total"), "-total", "aggressiveness")


def topics(cells: Cells) -> DataFrame:
    groups = cells.by("topic").agg(
        cells.count().alias("total_tweets"), cells.average("sentiment_score").alias("avg_sentiment")
    )
    shares = with_share(groups, "total_tweets", "pct").select("topic", "total_tweets", "pct", "avg_sentiment")
    return in_order(shares, "-total_tweets", "topic")


def genders(cells: Cells) -> DataFrame:
    return in_order(_distribution(cells, "gender", "total"), "-total", "gender")


def geolocation(cells: Cells) -> DataFrame:
    return _distribution(cells, "has_coordinates", "tweets")


def continents(cells: Cells) -> DataFrame:
    """Shares of the posts with a known region."""
    known = cells.where(F.col("continent") != "Unknown")
    return in_order(_distribution(known, "continent", "tweets"), "-tweets", "continent")


def _ranges(bins: Cells) -> DataFrame:
    """Score ranges by stance. Posts without a score make one without values."""
    return bins.frame.select(
        "stance",
        F.col("sentiment_score_n").alias("n"),
        F.col("sentiment_score_low").alias("low"),
        F.col("sentiment_score_high").alias("high"),
    )


def stored_bins(rows: Cells) -> Cells:
    """Score bins written to the shared folder: a small table that several parts of a report read."""
    spark, path = rows.frame.sparkSession, scratch_path(rows.frame.sparkSession, "bins")
    score_bins(rows).frame.write.parquet(path)
    return Cells(spark.read.parquet(path), merged=True)


def sentiment_by_stance(rows: Cells, bins: Cells | None = None) -> DataFrame:
    """Two scans of the posts, one for the bins if they are not given and one for the median; all else is from bins."""
    source = bins or stored_bins(rows)
    summary = source.by("stance").agg(
        source.count().alias("tweets"),
        F.round(source.low("sentiment_score"), 4).alias("min_sentiment"),
        F.round(source.high("sentiment_score"), 4).alias("max_sentiment"),
        source.average("sentiment_score").alias("avg_sentiment"),
        source.deviation("sentiment_score").alias("stddev_sentiment"),
    )
    medians = exact_median(rows.frame, _ranges(source), "stance", "sentiment_score", "median")
    joined = summary.join(medians, "stance", "left").select(
        *summary.columns, F.round("median", 4).alias("median_sentiment")
    )
    return in_order(joined, "-tweets", "stance")


def sentiment_by_place(rows: Cells) -> DataFrame:
    """Scored posts and their median score at each pair of coordinates; posts without coordinates are one place."""
    found = median_by(rows.frame, ["lat", "lng"], "sentiment_score", "median")
    named = found.select("lat", "lng", F.col("n").alias("scored_tweets"), F.round("median", 4).alias("median_sentiment"))
    return in_order(named, "lat", "lng")
