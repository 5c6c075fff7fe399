"""Declared schemas; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MEASURE = DecimalType(10, 7)

# Longitude stands before latitude in the source files, and columns are matched by position.
RAW = StructType(
    [
        StructField(name, LongType() if name == "id" else StringType())
        for name in (
            "created_at",
            "id",
            "lng",
            "lat",
            "topic",
            "sentiment",
            "stance",
            "gender",
            "temperature_avg",
            "aggressiveness",
        )
    ]
)

CLEAN = StructType(
    [
        StructField("tweet_id", LongType()),
        StructField("tweet_timestamp", TimestampType()),
        StructField("tweet_date", DateType()),
        StructField("tweet_year", ShortType()),
        StructField("tweet_month", ShortType()),
        StructField("tweet_quarter", ShortType()),
        StructField("tweet_day_of_week", ShortType()),
        StructField("lat", MEASURE),
        StructField("lng", MEASURE),
        StructField("has_coordinates", BooleanType()),
        StructField("topic", StringType()),
        StructField("sentiment_score", MEASURE),
        StructField("sentiment_category", StringType()),
        StructField("stance", StringType()),
        StructField("gender", StringType()),
        StructField("aggressiveness", StringType()),
        StructField("is_aggressive", BooleanType()),
        StructField("temperature_avg", MEASURE),
        StructField("continent", StringType()),
        StructField("created_at_raw", StringType()),
    ]
)


def schema_report(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Column names and types in column order."""
    rows = [(at, f.name, f.dataType.simpleString()) for at, f in enumerate(frame.schema.fields, start=1)]
    return spark.createDataFrame(rows, "ordinal_position int, column_name string, data_type string").orderBy(
        "ordinal_position"
    )
