"""The load over stored tables: stage, check, clean, merge, publish. Audits are separate queries.

Tables are replaced where they lie, one after the other. `plans.store` makes such a load take effect all at once.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

from pyspark.sql import SparkSession

from agorametric.operators.cells import DIMENSIONS, Cells
from agorametric.operators.id_words import id_words
from agorametric.operators.keys import require_key
from agorametric.plans import marts, validation
from agorametric.plans.cleaning import clean
from agorametric.plans.descriptive import score_bins
from agorametric.session import STRICT, temporary_settings, together
from agorametric.settings import DEFAULTS, Settings
from agorametric.sources import tables
from agorametric.sources.delimited import read_raw_csv


class Tables(NamedTuple):
    """Where a run's tables lie under its folder."""

    raw: str
    clean: str
    cells: str
    bins: str
    marts: str
    ids: str


def locations(folder: str) -> Tables:
    return Tables(*(f"{folder.rstrip('/')}/{name}" for name in Tables._fields))


def stage(spark: SparkSession, csv: str, folder: str, multi_line: bool = False) -> None:
    """Replaces the staging table by the files' rows, and their ids' words; any malformed row stops it."""
    at = locations(folder)
    tables.write_raw(read_raw_csv(spark, csv, multi_line), at.raw)
    words = id_words(tables.read_raw(spark, at.raw), "id")
    words.write.mode("overwrite").option("compression", tables.CODEC).parquet(at.ids)


def load_clean(spark: SparkSession, folder: str, settings: Settings = DEFAULTS, gather: bool = True) -> None:
    """Replaces the clean table. The key is checked first, on the one staged column, so a bad key writes nothing."""
    at = locations(folder)
    raw = tables.read_raw(spark, at.raw)
    require_key(raw, "id")
    tables.write_clean(clean(raw, settings), at.clean, gather)
    counts = validation.reconcile(raw, tables.read_clean(spark, at.clean)).head()
    if counts["difference"] != 0:
        raise ValueError(f"staged {counts['raw_rows']} rows but stored {counts['clean_rows']}")


def merge_cells(spark: SparkSession, folder: str) -> None:
    """One row per combination of dimensions, from which all marts are built, and one per stance and score bin."""
    at = locations(folder)
    rows = Cells.of_rows(tables.read_clean(spark, at.clean))

    def store(cells: Cells, path: str) -> None:
        cells.frame.write.mode("overwrite").option("compression", tables.CODEC).parquet(path)

    together(spark, partial(store, rows.merge(*DIMENSIONS), at.cells), partial(store, score_bins(rows), at.bins))


def read_cells(spark: SparkSession, folder: str) -> Cells:
    return Cells(spark.read.parquet(locations(folder).cells), merged=True)


def read_bins(spark: SparkSession, folder: str) -> Cells:
    return Cells(spark.read.parquet(locations(folder).bins), merged=True)


def publish_marts(cells: Cells, folder: str, settings: Settings = DEFAULTS) -> None:
    """Each mart as a Parquet table for dashboards, which order what they show. Each is a short job of its own."""

    def publish(name: str) -> None:
        rows = marts.mart(name, cells, settings, ordered=False)
        rows.write.mode("overwrite").option("compression", tables.CODEC).parquet(f"{locations(folder).marts}/{name}")

    together(cells.frame.sparkSession, *(partial(publish, name) for name in marts.MARTS))


def register(spark: SparkSession, folder: str, settings: Settings = DEFAULTS) -> None:
    """The stored tables and the marts as views for `spark.sql`, the marts computed from the cells."""
    at = locations(folder)
    tables.read_raw(spark, at.raw).createOrReplaceTempView("raw_tweets")
    tables.read_clean(spark, at.clean).createOrReplaceTempView("clean_tweets")
    marts.register_views(read_cells(spark, folder), settings)


def run(
    spark: SparkSession,
    csv: str,
    folder: str,
    settings: Settings = DEFAULTS,
    multi_line: bool = False,
    gather: bool = True,
) -> Tables:
    """From files to published marts, under the settings that decide results, whatever the session's own are."""
    with temporary_settings(spark, STRICT):
        stage(spark, csv, folder, multi_line)
        load_clean(spark, folder, settings, gather)
        merge_cells(spark, folder)
        publish_marts(read_cells(spark, folder), folder, settings)
    return locations(folder)
