"""Every threshold, label and range the pipeline uses, with its default."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import NamedTuple


class RegionBox(NamedTuple):
    """A latitude/longitude rectangle, edges included."""

    name: str
    lat_from: int
    lat_to: int
    lng_from: int
    lng_to: int


# Region rectangles. They overlap, and the first one that holds a point names it.
REGION_BOXES = (
    RegionBox("North America", 15, 72, -170, -50),
    RegionBox("South America", -60, 15, -90, -30),
    RegionBox("Europe", 35, 70, -25, 40),
    RegionBox("Africa", -35, 37, -20, 55),
    RegionBox("Asia", 5, 80, 40, 180),
    RegionBox("Oceania", -50, -5, 110, 180),
)

# Labels for the category columns; anything else becomes 'Unknown'.
STANCE_LABELS = {"believer": "Believer", "denier": "Denier", "neutral": "Neutral"}
GENDER_LABELS = {"male": "Male", "female": "Female"}
AGGRESSIVENESS_LABELS = {"aggressive": "Aggressive", "not aggressive": "Not Aggressive"}

# Seasons by month; every other month is 'Autumn'.
SEASON_MONTHS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8)}

# Fixed value: what counts as a number in a text column.
NUMBER_PATTERN = r"^-?[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?"
# What a strict cast takes: a plus, and a point before the first digit, too.
STRICT_NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


# Fixed value: what counts as a time: a full date, alone or with hours and minutes at least, and an offset from UTC.
TIME_PATTERN = (
    r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    r"([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]{1,9})?)?\s*(Z|UTC|[+-][0-9]{1,2}(:?[0-9]{2})?)?)?\s*"
)


@dataclass(frozen=True)
class Settings:
    region_boxes: tuple[RegionBox, ...] = REGION_BOXES
    sentiment_band: Decimal = Decimal("0.05")
    first_year: int = 2006
    last_year: int = 2019
    event_year: int = 2015
    # Labels for before, in and after the event year.
    period_labels: tuple[str, str, str] = (
        "Pre-Paris (2006-2014)",
        "Paris Agreement Year (2015)",
        "Post-Paris (2016-2022)",
    )
    latitude_range: tuple[int, int] = (-90, 90)
    longitude_range: tuple[int, int] = (-180, 180)
    format_prefix: int = 30
    format_top: int = 20
    preview_rows: int = 10
    hotspot_above: int = 500
    hotspot_top: int = 20
    topics_per_year: int = 3
    topic_length: int = 100


DEFAULTS = Settings()
