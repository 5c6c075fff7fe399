"""Reports that look for reasons: shifts over time, divisive topics, aggressive groups, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.functions.ratios import TOTAL, percent, quotient
from agorametric.functions.rules import event_period
from agorametric.operators.cells import Cells
from agorametric.operators.ordering import in_order, top
from agorametric.plans import marts
from agorametric.settings import DEFAULTS, Settings


def yearly_shift(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    rows = marts.yearly_trends(cells, settings).select(
        "tweet_year",
        "total_tweets",
        "avg_sentiment",
        "yoy_sentiment_change",
        "pct_believers",
        "pct_deniers",
        "pct_aggressive",
    )
    return in_order(rows, "tweet_year")


def yoy_direction(cells: Cells) -> DataFrame:
    """All years present, also those outside the study. The first year is 'Stable'."""
    groups = cells.by("tweet_year").agg(cells.mean("sentiment_score").alias("mean"))
    changes = groups.withColumn("change", marts.yearly_change(groups, "mean"))
    direction = F.when(F.col("change") > 0, "Improving").when(F.col("change") < 0, "Declining").otherwise("Stable")
    return in_order(
        changes.select(
            "tweet_year",
            F.round("mean", 4).alias("avg_sentiment"),
            F.round("change", 4).alias("yoy_change"),
            direction.alias("direction"),
        ),
        "tweet_year",
    )


def divisive_topics(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    rows = marts.topic_analysis(cells, settings).select(
        "topic",
        "total_tweets",
        "divisiveness_score",
        "pct_aggressive",
        "avg_sentiment",
        "sentiment_volatility",
        "believers",
        "deniers",
        "pct_believers",
        "pct_deniers",
    )
    return in_order(rows, "-divisiveness_score", "topic")


def aggressive_topics(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    rows = marts.topic_analysis(cells, settings)
    columns = ("topic", "total_tweets", "pct_aggressive", "avg_sentiment", "divisiveness_score")
    return in_order(rows.select(*columns), "-pct_aggressive", "topic")


def aggressive_regions(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    rows = marts.regional_analysis(cells, settings).select(
        "continent",
        "total_tweets",
        "pct_aggressive",
        "divisiveness_score",
        "avg_sentiment",
        "avg_temp_deviation",
    )
    return in_order(rows, "-pct_aggressive", "continent")


def aggression_by_stance(cells: Cells) -> DataFrame:
    cells = cells.where(F.col("stance").isin("Believer", "Denier", "Neutral"))
    aggressive = cells.tally(F.col("is_aggressive"))
    rows = cells.by("stance").agg(
        cells.count().alias("total_tweets"),
        aggressive.alias("aggressive"),
        percent(aggressive, cells.count()).alias("pct_aggressive"),
        cells.average("sentiment_score").alias("avg_sentiment"),
    )
    return in_order(rows, "-pct_aggressive", "stance")


def aggression_by_gender(cells: Cells) -> DataFrame:
    cells = cells.where(F.col("gender").isin("Male", "Female"))
    return cells.by("gender").agg(
        cells.count().alias("total_tweets"),
        percent(cells.tally(F.col("is_aggressive")), cells.count()).alias("pct_aggressive"),
        cells.average("sentiment_score").alias("avg_sentiment"),
    )


def correlations(cells: Cells) -> DataFrame:
    cells = cells.where(F.col("has_temperature") & F.col("has_sentiment"))
    return cells.frame.agg(
        cells.correlation().alias("temp_vs_sentiment"),
        cells.flag_correlation("temperature_avg", "is_aggressive").alias("temp_vs_aggression"),
        cells.flag_correlation("sentiment_score", "is_aggressive").alias("sentiment_vs_aggression"),
        cells.count().alias("sample_size"),
    )


def hotspots(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    cells = cells.where(marts.in_named_region())
    rows = cells.by("continent", "topic").agg(
        cells.count().alias("tweets"),
        percent(cells.tally(F.col("is_aggressive")), cells.count()).alias("pct_aggressive"),
        cells.average("sentiment_score").alias("avg_sentiment"),
    )
    frequent = rows.where(F.col("tweets") > settings.hotspot_above)
    return top(frequent, settings.hotspot_top, "-pct_aggressive", "continent", "topic")


def temperature_by_year(cells: Cells) -> DataFrame:
    """The rate counts posts with an unknown flag as not aggressive."""
    cells = cells.where(F.col("has_temperature"))
    rows = cells.by("tweet_year").agg(
        cells.average("temperature_avg", 3).alias("avg_temp_deviation"),
        cells.average("sentiment_score").alias("avg_sentiment"),
        F.round(quotient(cells.count(F.col("is_aggressive")), cells.count()), 4).alias("aggr_rate"),
        cells.count().alias("geotagged_tweets"),
    )
    return in_order(rows, "tweet_year")


def stance_by_region(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    return marts.mart("vw_stance_by_region", cells, settings)


def leading_topics(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    """Topics of the first ranks in each year; ties may make them more."""
    rows = marts.topic_yearly_trends(cells, settings).where(F.col("volume_rank") <= settings.topics_per_year)
    columns = ("tweet_year", "topic", "tweet_count", "volume_rank", "avg_sentiment", "pct_aggressive")
    return in_order(rows.select(*columns), "tweet_year", "volume_rank", "topic")


def seasons(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    """Aggregates the monthly mart again; its averages enter as published, rounded."""
    months = marts.monthly_trends(cells, settings)
    tweets = F.sum("total_tweets")
    rows = months.groupBy("season").agg(
        tweets.alias("tweets"),
        F.round(
            quotient(F.sum((F.col("avg_sentiment") * F.col("total_tweets")).cast(TOTAL)), tweets), 4
        ).alias("weighted_avg_sentiment"),
        percent(F.sum("aggressive_count"), tweets).alias("pct_aggressive"),
    )
    return in_order(rows, "-pct_aggressive", "season")


def event_periods(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    """In time order, by each period's first year, which is not shown."""
    rows = cells.by(event_period(F.col("tweet_year"), settings).alias("period")).agg(
        cells.count().alias("tweets"),
        cells.average("sentiment_score").alias("avg_sentiment"),
        percent(cells.tally(F.col("stance") == "Believer"), cells.count()).alias("pct_believers"),
        percent(cells.tally(F.col("is_aggressive")), cells.count()).alias("pct_aggressive"),
        F.min("tweet_year").alias("first_year"),
    )
    return in_order(rows, "first_year").drop("first_year")
