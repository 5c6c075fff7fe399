"""From text-first staging rows to the typed, standardised table. Row by row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.functions import rules
from agorametric.functions.text import labelled, optional_measure, strict_measure, strict_time, title_words, within_length
from agorametric.schemas import CLEAN
from agorametric.session import STRICT, temporary_settings
from agorametric.settings import AGGRESSIVENESS_LABELS, DEFAULTS, GENDER_LABELS, STANCE_LABELS, Settings


def clean(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Strict where a value is required: a bad time, score or coordinate fails the job.

    Casts keep the strictness and time zone of the moment they are written, so the session's own settings don't matter.
    """
    with temporary_settings(raw.sparkSession, STRICT):
        return _clean(raw, settings)


def _clean(raw: DataFrame, settings: Settings) -> DataFrame:
    typed = raw.select(
        F.col("id").alias("tweet_id"),
        F.col("created_at").alias("created_at_raw"),
        strict_time(F.col("created_at")).alias("tweet_timestamp"),
        strict_measure(F.col("sentiment")).alias("sentiment_score"),
        *(optional_measure(F.col(name)).alias(name) for name in ("lat", "lng", "temperature_avg")),
        title_words(F.col("topic")).alias("topic"),
        labelled(F.col("stance"), STANCE_LABELS).alias("stance"),
        labelled(F.col("gender"), GENDER_LABELS).alias("gender"),
        labelled(F.col("aggressiveness"), AGGRESSIVENESS_LABELS).alias("aggressiveness"),
        (F.lower(F.trim("aggressiveness")) == "aggressive").alias("is_aggressive"),
    )
    at, lat, lng = F.col("tweet_timestamp"), F.col("lat"), F.col("lng")
    derived = typed.withColumns(
        {
            "tweet_date": F.to_date(at),
            "tweet_year": F.year(at).cast("smallint"),
            "tweet_month": F.month(at).cast("smallint"),
            "tweet_quarter": F.quarter(at).cast("smallint"),
            "tweet_day_of_week": (F.dayofweek(at) - 1).cast("smallint"),
            "has_coordinates": lat.isNotNull() & lng.isNotNull(),
            "sentiment_category": rules.sentiment_category(F.col("sentiment_score"), settings),
            "continent": rules.region(lat, lng, settings),
        }
    )
    # Derived labels are constants that fit; only the topic comes from the input.
    derived = derived.withColumn("topic", within_length(F.col("topic"), settings.topic_length, "topic"))
    return derived.select(*CLEAN.names)
