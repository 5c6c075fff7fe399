"""Records of delimited files whose quoted fields hold line breaks, found in parallel within each file.

A line break ends a record just if an even number of quotes stands before it in the file, doubled quotes included. Files
are read in splits, line by line; each split's quotes are counted, a running sum over a file's splits gives the number
before each, and only lines of splits in which a record goes over several lines are put in order and regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agorametric.session import scratch_path

_SPLIT = ["file", "split"]


def _lines(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """Every line with its file, the start of its split, its place within that, and whether its quotes are odd in number.

    They are stored: later steps must find the same splits and places, however often they run and on whatever cluster.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    rows = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        # A task reads its splits one after the other, so numbers rise within each.
        F.monotonically_increasing_id().alias("place"),
        (quotes % 2).alias("odd"),
        "value",
    )
    at = scratch_path(spark, "csv-lines")
    rows.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def _splits(lines: DataFrame) -> DataFrame:
    """Per split the lines with an odd number of quotes before it and in it, and where its file's first record starts.

    A file has one row for each of its splits here.
    """
    filled = F.when(_without_return(F.col("value")) != "", F.col("place"))
    counts = lines.groupBy(*_SPLIT).agg(F.sum("odd").alias("odds"), F.min(filled).alias("first"))
    ordered = Window.partitionBy("file").orderBy("split")
    file = Window.partitionBy("file")
    starts = F.when(F.col("first").isNotNull(), F.struct("split", "first"))
    return counts.select(
        *_SPLIT,
        "odds",
        (F.sum("odds").over(ordered) - F.col("odds")).alias("before"),
        F.sum("odds").over(file).alias("all"),
        F.min(starts).over(file).alias("header"),
    )


def _without_return(line: Column) -> Column:
    """The line without the carriage return of a CRLF end."""
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """Column `value` with one record a row, without empty lines and without each file's first record, the header.

    Breaks inside quotes stay as they are. A quote that is never closed fails the job.
    """
    lines = _lines(spark, path, quote)
    bad = F.raise_error(F.concat(F.lit("[MALFORMED_RECORD] a quote is not closed in "), F.col("file"))).cast("boolean")
    placed = lines.join(_splits(lines), _SPLIT).where(F.when(F.col("all") % 2 == 0, True).otherwise(bad))
    # No record of a calm split goes over several lines.
    calm = (F.col("odds") == 0) & (F.col("before") % 2 == 0)
    busy = placed.where(~calm)
    ordered = Window.partitionBy(*_SPLIT).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = busy.withColumn("before", F.col("before") + F.sum("odd").over(ordered) - F.col("odd"))
    is_alone = (F.col("before") % 2 == 0) & (F.col("odd") == 0)
    place = F.struct("split", "place")
    # Lines of one record share half the number of odd lines before them, rounded down.
    records = counted.where(~is_alone).groupBy("file", F.expr("before div 2").alias("record"), "header").agg(
        F.array_sort(F.collect_list(F.struct("split", "place", "value"))).alias("parts")
    )
    parts = F.transform("parts", lambda part: part["value"])
    regrouped = records.select(
        F.struct(F.col("parts")[0]["split"].alias("split"), F.col("parts")[0]["place"].alias("place")).alias("start"),
        "header",
        F.array_join(parts, "\n").alias("value"),
    )

    def alone(rows: DataFrame, condition: Column) -> DataFrame:
        return rows.select(place.alias("start"), "header", F.when(condition, F.col("value")).alias("value"))

    found = alone(placed, calm).union(alone(counted, is_alone)).union(regrouped)
    record = _without_return(F.col("value"))
    is_header = (F.col("start.split") == F.col("header.split")) & (F.col("start.place") == F.col("header.first"))
    # A caller's strict parsing may be moved to before these conditions, so what is no record is NULL there.
    return found.select(F.when((record != "") & ~is_header, record).alias("value")).where(F.col("value").isNotNull())
