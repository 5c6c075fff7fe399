"""The eleven published views, each over single posts or over merged cells."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agorametric.functions import rules
from agorametric.functions.ratios import divisiveness, percent, two_way_ratio
from agorametric.operators.cells import Cells
from agorametric.operators.ordering import in_order
from agorametric.settings import DEFAULTS, Settings


def _believers(cells: Cells) -> Column:
    return cells.count(F.col("stance") == "Believer")


def _deniers(cells: Cells) -> Column:
    return cells.count(F.col("stance") == "Denier")


def _neutrals(cells: Cells) -> Column:
    return cells.count(F.col("stance") == "Neutral")


def _aggressive(cells: Cells) -> Column:
    """Posts with an unknown flag are not among them, but do count in the whole."""
    return cells.count(F.col("is_aggressive"))


def _share(cells: Cells, part: Column) -> Column:
    return percent(part, cells.count())


def _study(cells: Cells, settings: Settings) -> Cells:
    return cells.where(rules.in_study_years(F.col("tweet_year"), settings))


def kpi_summary(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    """One row. Posts merge first, so the two distinct counts run over a few cells, not over every post twice."""
    cells = cells.merge("tweet_year", "topic", "stance", "is_aggressive", "has_coordinates")
    geotagged = cells.count(F.col("has_coordinates"))
    return cells.frame.agg(
        cells.count().alias("total_tweets"),
        F.countDistinct("tweet_year").alias("years_covered"),
        F.min("tweet_year").alias("first_year"),
        F.max("tweet_year").alias("last_year"),
        cells.average("sentiment_score").alias("overall_avg_sentiment"),
        _believers(cells).alias("total_believers"),
        _deniers(cells).alias("total_deniers"),
        _neutrals(cells).alias("total_neutrals"),
        _share(cells, _believers(cells)).alias("pct_believers"),
        _share(cells, _deniers(cells)).alias("pct_deniers"),
        _aggressive(cells).alias("total_aggressive"),
        _share(cells, _aggressive(cells)).alias("overall_aggr_pct"),
        geotagged.alias("geotagged_tweets"),
        _share(cells, geotagged).alias("pct_geotagged"),
        F.countDistinct("topic").alias("distinct_topics"),
    )


def yearly_change(groups: DataFrame, mean: str) -> Column:
    """Unrounded change of a mean against the previous year present, posts without a year coming last.

    At most one row per year is in the window.
    """
    return F.col(mean) - F.lag(mean).over(Window.orderBy(F.col("tweet_year").asc_nulls_last()))


def yearly_trends(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    cells = _study(cells, settings)
    groups = cells.by("tweet_year").agg(
        cells.count().alias("total_tweets"),
        cells.mean("sentiment_score").alias("mean"),
        cells.deviation("sentiment_score").alias("sentiment_volatility"),
        _believers(cells).alias("believers"),
        _deniers(cells).alias("deniers"),
        _neutrals(cells).alias("neutrals"),
        _share(cells, _believers(cells)).alias("pct_believers"),
        _share(cells, _deniers(cells)).alias("pct_deniers"),
        _aggressive(cells).alias("aggressive_count"),
        _share(cells, _aggressive(cells)).alias("pct_aggressive"),
    )
    return groups.select(
        "tweet_year",
        "total_tweets",
        F.round("mean", 4).alias("avg_sentiment"),
        "sentiment_volatility",
        "believers",
        "deniers",
        "neutrals",
        "pct_believers",
        "pct_deniers",
        "aggressive_count",
        "pct_aggressive",
        F.round(yearly_change(groups, "mean"), 4).alias("yoy_sentiment_change"),
    )


def monthly_trends(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    cells = _study(cells, settings)
    groups = cells.by("tweet_year", "tweet_month").agg(
        cells.count().alias("total_tweets"),
        cells.average("sentiment_score").alias("avg_sentiment"),
        _aggressive(cells).alias("aggressive_count"),
        _share(cells, _aggressive(cells)).alias("pct_aggressive"),
    )
    first_day = F.make_date(F.col("tweet_year").cast("int"), F.col("tweet_month").cast("int"), F.lit(1))
    return groups.select(
        "tweet_year",
        "tweet_month",
        F.date_format(first_day, "yyyy-MM").alias("year_month"),
        rules.season(F.col("tweet_month")).alias("season"),
        "total_tweets",
        "avg_sentiment",
        "aggressive_count",
        "pct_aggressive",
    )


def topic_analysis(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    return cells.by("topic").agg(
        cells.count().alias("total_tweets"),
        cells.average("sentiment_score").alias("avg_sentiment"),
        cells.deviation("sentiment_score").alias("sentiment_volatility"),
        _believers(cells).alias("believers"),
        _deniers(cells).alias("deniers"),
        _neutrals(cells).alias("neutrals"),
        _share(cells, _believers(cells)).alias("pct_believers"),
        _share(cells, _deniers(cells)).alias("pct_deniers"),
        _aggressive(cells).alias("aggressive_tweets"),
        _share(cells, _aggressive(cells)).alias("pct_aggressive"),
        divisiveness(_believers(cells), _deniers(cells)).alias("divisiveness_score"),
    )


def topic_yearly_trends(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    cells = _study(cells, settings)
    groups = cells.by("tweet_year", "topic").agg(
        cells.count().alias("tweet_count"),
        cells.average("sentiment_score").alias("avg_sentiment"),
        _aggressive(cells).alias("aggressive_count"),
        _share(cells, _aggressive(cells)).alias("pct_aggressive"),
        _share(cells, _believers(cells)).alias("pct_believers"),
    )
    by_volume = Window.partitionBy("tweet_year").orderBy(F.desc("tweet_count"))
    return groups.withColumn("volume_rank", F.rank().over(by_volume))


def regional_analysis(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    """Keeps 'Other', unlike the two region reports that compare named regions."""
    cells = cells.where(F.col("continent") != "Unknown")
    return cells.by("continent").agg(
        cells.count().alias("total_tweets"),
        cells.average("sentiment_score").alias("avg_sentiment"),
        cells.deviation("sentiment_score").alias("sentiment_volatility"),
        _believers(cells).alias("believers"),
        _deniers(cells).alias("deniers"),
        _share(cells, _believers(cells)).alias("pct_believers"),
        _share(cells, _deniers(cells)).alias("pct_deniers"),
        _aggressive(cells).alias("aggressive_tweets"),
        _share(cells, _aggressive(cells)).alias("pct_aggressive"),
        cells.average("temperature_avg").alias("avg_temp_deviation"),
        divisiveness(_believers(cells), _deniers(cells)).alias("divisiveness_score"),
    )


def in_named_region() -> Column:
    return ~F.col("continent").isin("Unknown", "Other")


def stance_by_region(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    cells = cells.where(in_named_region())
    return cells.by("continent", "tweet_year").agg(
        _believers(cells).alias("believers"),
        _deniers(cells).alias("deniers"),
        _neutrals(cells).alias("neutrals"),
        cells.count().alias("total"),
        _share(cells, _believers(cells)).alias("pct_believers"),
        _share(cells, _deniers(cells)).alias("pct_deniers"),
        _share(cells, _aggressive(cells)).alias("pct_aggressive"),
    )


def gender_analysis(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    cells = cells.where(F.col("gender").isin("Male", "Female"))
    return cells.by("gender", "tweet_year").agg(
        cells.count().alias("total_tweets"),
        cells.average("sentiment_score").alias("avg_sentiment"),
        _aggressive(cells).alias("aggressive_count"),
        _share(cells, _aggressive(cells)).alias("pct_aggressive"),
        _believers(cells).alias("believers"),
        _deniers(cells).alias("deniers"),
        _share(cells, _believers(cells)).alias("pct_believers"),
    )


def temp_sentiment(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    """The rate is taken over posts with a known flag."""
    cells = _study(cells, settings).where(F.col("has_temperature") & F.col("has_sentiment"))
    return cells.by("tweet_year", "continent").agg(
        cells.average("temperature_avg").alias("avg_temp_deviation"),
        cells.average("sentiment_score").alias("avg_sentiment"),
        F.round(cells.flag_rate("is_aggressive"), 4).alias("aggr_rate"),
        cells.count().alias("tweet_count"),
    )


def aggressiveness_analysis(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    cells = _study(cells, settings)
    return cells.by("tweet_year", "topic", "continent", "stance", "gender").agg(
        cells.count().alias("total_tweets"),
        _aggressive(cells).alias("aggressive_count"),
        _share(cells, _aggressive(cells)).alias("pct_aggressive"),
        cells.average("sentiment_score").alias("avg_sentiment"),
    )


def executive_insights(cells: Cells, settings: Settings = DEFAULTS) -> DataFrame:
    """Both rates are taken over posts with a known flag; ratios are NULL for a topic without either side."""
    rate = cells.flag_rate("is_aggressive")
    return cells.by("topic").agg(
        cells.count().alias("total_tweets"),
        cells.average("sentiment_score", 3).alias("avg_sentiment"),
        cells.deviation("sentiment_score", 3).alias("sentiment_volatility"),
        F.round(rate, 3).alias("aggression_rate"),
        F.round(rate * F.lit(100), 2).alias("pct_aggressive"),
        two_way_ratio(_believers(cells), _deniers(cells)).alias("believer_ratio"),
        two_way_ratio(_deniers(cells), _believers(cells)).alias("denier_ratio"),
        _believers(cells).alias("believers"),
        _deniers(cells).alias("deniers"),
    )


class Mart(NamedTuple):
    build: Callable[..., DataFrame]
    order: tuple[str, ...]


# View name, how it is built, and the order its rows are shown in (ties in key order).
MARTS = {
    "vw_kpi_summary": Mart(kpi_summary, ()),
    "vw_yearly_trends": Mart(yearly_trends, ("tweet_year",)),
    "vw_monthly_trends": Mart(monthly_trends, ("tweet_year", "tweet_month")),
    "vw_topic_analysis": Mart(topic_analysis, ("-total_tweets", "topic")),
    "vw_topic_yearly_trends": Mart(topic_yearly_trends, ("tweet_year", "-tweet_count", "topic")),
    "vw_regional_analysis": Mart(regional_analysis, ("-total_tweets", "continent")),
    "vw_stance_by_region": Mart(stance_by_region, ("continent", "tweet_year")),
    "vw_gender_analysis": Mart(gender_analysis, ("tweet_year", "gender")),
    "vw_temp_sentiment": Mart(temp_sentiment, ("tweet_year", "continent")),
    "vw_aggressiveness_analysis": Mart(
        aggressiveness_analysis,
        ("-aggressive_count", "tweet_year", "topic", "continent", "stance", "gender"),
    ),
    "vw_executive_insights": Mart(executive_insights, ("-aggression_rate", "topic")),
}


def mart(name: str, cells: Cells, settings: Settings = DEFAULTS, ordered: bool = True) -> DataFrame:
    """A view's rows in their order; the sort drops out of plans that aggregate or sort the result again."""
    found = MARTS[name]
    rows = found.build(cells, settings)
    return in_order(rows, *found.order) if ordered and found.order else rows


def register_views(cells: Cells, settings: Settings = DEFAULTS) -> None:
    """Temporary views under the marts' names, for `spark.sql`."""
    for name in MARTS:
        mart(name, cells, settings).createOrReplaceTempView(name)
