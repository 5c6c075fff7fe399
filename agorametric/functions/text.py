"""Expressions over raw text columns. All are built-ins that take part in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agorametric.schemas import MEASURE
from agorametric.settings import NUMBER_PATTERN, STRICT_NUMBER_PATTERN, TIME_PATTERN

_MARK = "\u0001 "


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def is_number(text: Column) -> Column:
    """Whole-text match; `\\z` because `$` would also match before a final line break."""
    return text.rlike(NUMBER_PATTERN + r"\z")


def nearest_number(text: Column) -> Column:
    """The number in `text` as a double, or NULL if it is none. No number is too large."""
    return F.when(is_number(text), text.cast("double"))


def strict_number(text: Column) -> Column:
    """The number in `text` without blanks around it and without a plus; any other text fails the job."""
    bare = F.trim(text)
    bad = F.raise_error(F.concat(F.lit("[CAST_INVALID_INPUT] malformed number: "), text)).cast("string")
    return F.when(text.isNull() | bare.rlike(STRICT_NUMBER_PATTERN + r"\z"), F.ltrim(bare, F.lit("+"))).otherwise(bad)


def strict_time(text: Column) -> Column:
    """Cast that fails the job on text that is no full date or time; the cast itself would fill in the current day."""
    bad = F.raise_error(F.concat(F.lit("[CAST_INVALID_INPUT] malformed time: "), text)).cast("timestamp")
    return F.when(text.isNull() | text.rlike(TIME_PATTERN + r"\z"), text.cast("timestamp")).otherwise(bad)


def strict_measure(text: Column) -> Column:
    """Cast that fails the job on text that is no number (also on blank text)."""
    return text.cast(MEASURE)


def optional_measure(text: Column) -> Column:
    """NULL for blank text, else a strict cast."""
    return F.when(F.trim(text) != "", text.cast(MEASURE))


def title_words(text: Column) -> Column:
    """Trimmed text, each run of letters and digits capitalised.

    The built-in `initcap` starts a word only after a blank, so every other separator is followed by a mark and a
    blank while it runs. Texts without such separators skip that step.
    """
    lowered = F.lower(F.trim(text))
    marked = F.regexp_replace(lowered, r"([^\p{L}\p{N} ])", "$1" + _MARK)
    return F.when(
        lowered.rlike(r"[^\p{L}\p{N} ]"), F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))
    ).otherwise(F.initcap(lowered))


def labelled(text: Column, labels: dict[str, str]) -> Column:
    """Label for the trimmed lower-case text, 'Unknown' if there is none."""
    key = F.lower(F.trim(text))
    chain = F
    for value, label in labels.items():
        chain = chain.when(key == value, label)
    return chain.otherwise("Unknown")


def within_length(text: Column, limit: int, name: str) -> Column:
    """Fails the job on text longer than the declared column."""
    return F.when(
        F.length(text) > limit, F.raise_error(F.lit(f"value too long for {name}: limit {limit}"))
    ).otherwise(text)
