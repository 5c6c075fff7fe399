"""Loads that take effect all at once, and loads that add to what is there.

Each load writes a part, a folder of its own with staging rows, clean posts, cells and bins, and marts over everything.
Only then a commit record names the parts that make up the tables from now on; it is one small file, which Spark's own
committer puts in place whole. Readers follow the last record, so a load that fails anywhere leaves the old tables as
they were, and a reader that has begun keeps its parts, which are never changed.

Cells are sums, so the cells of a new part are simply further rows: a load's cost is that of its own posts. Marts are
built from the cells, whose number does not grow with the posts. One load at a time; two that commit at once are told.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorametric.operators.cells import DIMENSIONS, Cells
from agorametric.operators.id_words import counted, merged
from agorametric.operators.keys import KeyViolation, key_clashes
from agorametric.plans import pipeline
from agorametric.session import STRICT, temporary_settings
from agorametric.settings import DEFAULTS, Settings
from agorametric.sources import tables

_RECORD = "number long, parts array<string>"


class Snapshot(NamedTuple):
    """The tables as of one commit."""

    spark: SparkSession
    number: int
    parts: list[str]

    def _union(self, read) -> DataFrame:
        return reduce(DataFrame.union, (read(pipeline.locations(part)) for part in self.parts))

    def raw(self) -> DataFrame:
        return self._union(lambda at: tables.read_raw(self.spark, at.raw))

    def clean(self) -> DataFrame:
        return self._union(lambda at: tables.read_clean(self.spark, at.clean))

    def cells(self) -> Cells:
        return Cells(self._union(lambda at: self.spark.read.parquet(at.cells)), merged=True)

    def bins(self) -> Cells:
        """One row per stance and bin again, as the median needs them."""
        return Cells(self._union(lambda at: self.spark.read.parquet(at.bins)), merged=True).merge("stance", "bin")

    def ids(self) -> DataFrame:
        """The words of all loads' ids, those of each load by themselves."""
        return self._union(lambda at: self.spark.read.parquet(at.ids))

    def duplicates(self) -> DataFrame:
        """The audit's counts of rows and ids over all loads, without reading the posts again."""
        return counted(self.ids())

    def mart(self, name: str) -> DataFrame:
        """As published by the last load."""
        return self.spark.read.parquet(f"{pipeline.locations(self.parts[-1]).marts}/{name}")


def _commits(root: str) -> str:
    return f"{root.rstrip('/')}/commits"


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The tables of the last commit; None before the first."""
    try:
        rows = spark.read.schema(_RECORD).json(_commits(root))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = rows.orderBy(F.desc("number")).first()
    return Snapshot(spark, last["number"], list(last["parts"])) if last else None


def _commit(spark: SparkSession, root: str, parts: list[str], before: Snapshot | None) -> Snapshot:
    number = before.number + 1 if before else 1
    # From constants, as rows of the driver's would start a Python worker.
    record = spark.range(0, 1, 1, 1).select(F.lit(number).cast("bigint").alias("number"), F.array(*map(F.lit, parts)).alias("parts"))
    record.write.mode("append").json(_commits(root))
    if spark.read.schema(_RECORD).json(_commits(root)).where(F.col("number") == number).count() != 1:
        raise RuntimeError(f"two loads committed number {number} at once; run the later one again")
    return Snapshot(spark, number, parts)


def _part(root: str) -> str:
    return f"{root.rstrip('/')}/parts/{uuid.uuid4().hex}"


def load(
    spark: SparkSession, csv: str, root: str, settings: Settings = DEFAULTS, multi_line: bool = False, gather: bool = True
) -> Snapshot:
    """The files' posts become all there is."""
    before, part = current(spark, root), _part(root)
    pipeline.run(spark, csv, part, settings, multi_line, gather)
    return _commit(spark, root, [part], before)


def append(
    spark: SparkSession, csv: str, root: str, settings: Settings = DEFAULTS, multi_line: bool = False, gather: bool = True
) -> Snapshot:
    """The files' posts are added. Their keys must be new, among themselves and to the tables."""
    before, part = current(spark, root), _part(root)
    if before is None:
        return load(spark, csv, root, settings, multi_line, gather)
    with temporary_settings(spark, STRICT):
        pipeline.stage(spark, csv, part, multi_line)
        staged = tables.read_raw(spark, pipeline.locations(part).raw)
        # All partitions at once, where `head` would go through them in turn.
        found = key_clashes(staged.select("id"), before.raw().select("id"), "id").agg(F.min("id")).first()[0]
        if found is not None:
            raise KeyViolation(f"id={found} is already stored")
        pipeline.load_clean(spark, part, settings, gather)
        pipeline.merge_cells(spark, part)
        after = Snapshot(spark, before.number + 1, [*before.parts, part])
        pipeline.publish_marts(after.cells(), part, settings)
    return _commit(spark, root, after.parts, before)


def compact(spark: SparkSession, root: str, settings: Settings = DEFAULTS, gather: bool = True) -> Snapshot:
    """Many small parts become one. The old parts stay until they are removed; running readers may need them."""
    before, part = current(spark, root), _part(root)
    if before is None:
        raise ValueError(f"nothing is stored under {root}")
    at = pipeline.locations(part)
    with temporary_settings(spark, STRICT):
        tables.write_raw(before.raw(), at.raw)
        tables.write_clean(before.clean(), at.clean, gather)
        for cells, path in ((before.cells().merge(*DIMENSIONS), at.cells), (before.bins(), at.bins)):
            cells.frame.write.option("compression", tables.CODEC).parquet(path)
        merged(before.ids()).write.option("compression", tables.CODEC).parquet(at.ids)
        pipeline.publish_marts(Cells(spark.read.parquet(at.cells), merged=True), part, settings)
    return _commit(spark, root, [part], before)
