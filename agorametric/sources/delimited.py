"""Comma-separated staging files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from agorametric.schemas import RAW
from agorametric.sources.records import quoted_records

# Stands for a quoted empty field while reading, so that it stays apart from a missing one.
_EMPTY = "\u0001"


_FORMAT = {
    "sep": ",",
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "emptyValue": _EMPTY,
    "mode": "FAILFAST",
}


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Staging rows by column position. A malformed row fails the job.

    An unquoted empty field is NULL and a quoted one is ''. With `multi_line`, fields may hold line breaks: the lines
    are stored and records are found among them, in as many tasks as without; a quote always opens or closes a field.
    """
    as_text = StructType([StructField(field.name, StringType()) for field in RAW.fields])
    if multi_line:
        parsed = F.from_csv("value", ", ".join(f"{name} string" for name in as_text.names), _FORMAT)
        rows = quoted_records(spark, path).select(parsed.alias("row")).select("row.*")
    else:
        # Else a query of few columns would not see that a row is short.
        reader = spark.read.schema(as_text).options(**_FORMAT).option("header", True).option("columnPruning", False)
        rows = reader.csv(path)
    # A condition is evaluated whatever columns a query reads, so a bad id fails every query.
    number = F.expr("try_cast(id AS bigint)")
    bad = F.raise_error(F.concat(F.lit("[MALFORMED_RECORD] id is no number: "), F.col("id"))).cast("boolean")
    return rows.where(F.when(F.col("id").isNull() | number.isNotNull(), True).otherwise(bad)).select(
        *(
            number.alias("id")
            if f.name == "id"
            else F.when(F.col(f.name) == _EMPTY, "").otherwise(F.col(f.name)).alias(f.name)
            for f in RAW.fields
        )
    )


def write_raw_csv(raw: DataFrame, path: str) -> None:
    """Staging rows as files that `read_raw_csv` reads back unchanged."""
    (
        raw.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
