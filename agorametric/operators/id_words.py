"""Exact distinct counts of whole numbers that merge: sets of ids as words of 64 bits.

A row stands for 64 neighbouring ids: `bucket` is the id without its last six bits, `word` has a bit for each of them
that occurs, and `n` counts rows. Dense ids take a 64th of the rows; an id without neighbours takes one row of three
numbers, where the built-in bitmaps would take four kilobytes. Counts of different ids cannot be added over loads or
groups, but words can: equal buckets are joined by OR. So each load stores its own words, and counts over all loads,
or over any coarser groups, read those instead of the posts. Words fit into hash aggregates, so they combine before
each shuffle, and a hot group is spread over its buckets.

Results for odd input: rows without an id are counted in `n` under a missing bucket; ids of either sign are told apart;
no rows give zero counts without groups, and no row with groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 6


def id_words(frame: DataFrame, id: str, *by: str) -> DataFrame:
    """Rows (*by, bucket, word, n) of a frame."""
    number = F.col(id).cast("bigint")
    place = number.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
    bit = F.expr("shiftleft(1L, place)")
    rows = frame.select(*by, F.shiftright(number, _BITS).alias("bucket"), place.alias("place"))
    return _joined(rows.select(*by, "bucket", bit.alias("word"), F.lit(1).cast("bigint").alias("n")), *by)


def _joined(words: DataFrame, *by: str) -> DataFrame:
    return words.groupBy(*by, "bucket").agg(F.bit_or("word").alias("word"), F.sum("n").alias("n"))


def merged(words: DataFrame, *by: str) -> DataFrame:
    """Words of several loads, or of finer groups, as one set of words per group."""
    return _joined(words.select(*by, "bucket", "word", "n"), *by)


def _none_if_empty(total: Column) -> Column:
    return F.coalesce(total, F.lit(0).cast("bigint"))


def counted(words: DataFrame, *by: str) -> DataFrame:
    """Per group all rows, different ids, and rows beyond the first of their id."""
    total, distinct = F.sum("n"), F.sum(F.bit_count("word").cast("bigint"))
    groups = merged(words, *by).groupBy(*by).agg(_none_if_empty(total).alias("total_rows"), _none_if_empty(distinct).alias("distinct_ids"))
    return groups.select("*", (F.col("total_rows") - F.col("distinct_ids")).alias("duplicate_rows"))


def repeated(words: DataFrame) -> DataFrame:
    """The buckets with an id that is missing or occurs twice; a key has none."""
    return merged(words).where(F.col("bucket").isNull() | (F.col("n") > F.bit_count("word")))
