"""Bands, regions, seasons and periods derived from typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agorametric.functions.ratios import UNITS_PER_ONE, steps_down, units
from agorametric.settings import SEASON_MONTHS, Settings


def sentiment_category(score: Column, settings: Settings) -> Column:
    """A missing score is 'Neutral', as is the band with its edges."""
    band = settings.sentiment_band
    return F.when(score > F.lit(band), "Positive").when(score < F.lit(-band), "Negative").otherwise("Neutral")


def region(lat: Column, lng: Column, settings: Settings) -> Column:
    """Name of the first box that holds the point."""
    chain = F.when(lat.isNull() | lng.isNull(), "Unknown")
    for box in settings.region_boxes:
        inside = lat.between(box.lat_from, box.lat_to) & lng.between(box.lng_from, box.lng_to)
        chain = chain.when(inside, box.name)
    return chain.otherwise("Other")


def season(month: Column) -> Column:
    chain = F
    for name, months in SEASON_MONTHS.items():
        chain = chain.when(month.isin(*months), name)
    return chain.otherwise("Autumn")


def event_period(year: Column, settings: Settings) -> Column:
    """A missing year counts as after the event."""
    before, during, after = settings.period_labels
    return F.when(year < settings.event_year, before).when(year == settings.event_year, during).otherwise(after)


def in_study_years(year: Column, settings: Settings) -> Column:
    return year.between(settings.first_year, settings.last_year)


def score_bin(score: Column, per_one: int) -> Column:
    """Number of the score's bin when there are this many in 1. Whole numbers throughout; decimals are slow to floor."""
    return steps_down(units(score), UNITS_PER_ONE // per_one)


def bucket_edge(tenths: Column) -> Column:
    """Lower edge of a 0.1-wide bucket, given its number."""
    return (tenths.cast("decimal(6,0)") * F.lit("0.1").cast("decimal(1,1)")).cast("decimal(7,1)")
