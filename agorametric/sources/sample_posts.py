"""Staging rows projected from the `orders` table, for checks and benchmarks.

The expressions are plain SQL that Spark and DuckDB evaluate alike. They give every cleaning rule something to do:
missing, blank and scientific numbers, mixed case, stray blanks, unknown categories, years outside the study.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agorametric.schemas import RAW

_CREATED_AT = (
    "concat(CAST(2005 + o_orderkey % 16 AS VARCHAR(4)), '-', "
    "lpad(CAST(1 + o_custkey % 12 AS VARCHAR(2)), 2, '0'), '-', "
    "lpad(CAST(1 + (o_orderkey * 7) % 28 AS VARCHAR(2)), 2, '0'), ' ', "
    "lpad(CAST(o_orderkey % 24 AS VARCHAR(2)), 2, '0'), ':', "
    "lpad(CAST((o_orderkey * 13) % 60 AS VARCHAR(2)), 2, '0'), ':', "
    "lpad(CAST((o_orderkey * 17) % 60 AS VARCHAR(2)), 2, '0'), '+00:00')"
)


def _scaled(units: str, factor: str, factor_type: str) -> str:
    return f"CAST(CAST({units} AS DECIMAL(9,0)) * CAST({factor} AS {factor_type}) AS VARCHAR(20))"


_TOPICS = (
    "global stance",
    "Global Stance ",
    "Global stance",
    "Importance of Human Intervantion",
    "Importance of Human Intervantion",
    "importance of human intervantion",
    "Weather Extremes",
    " weather extremes",
    "Weather Extremes",
    "Politics",
    "politics",
    "Undefined / One Word Hashtags",
    "Undefined / One Word Hashtags",
    "Donald Trump versus Science",
    "Seriousness of Gas Emissions",
    "Seriousness of Gas Emissions",
    "Ideological Positions on Global Warming",
    "Impact of Resource Overconsumption",
)

EXPRESSIONS = {
    "created_at": _CREATED_AT,
    "id": "o_orderkey",
    "lng": "CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 3 = 2 THEN ' ' "
    "WHEN o_orderkey % 1011 = 0 THEN '-5.2199999999999995e-05' "
    f"ELSE {_scaled('(o_orderkey * 7919) % 360001 - 180000', '0.001', 'DECIMAL(4,3)')} END",
    "lat": "CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 3 = 2 THEN ' ' "
    f"ELSE {_scaled('(o_orderkey * 104729) % 150001 - 65000', '0.001', 'DECIMAL(4,3)')} END",
    "topic": "CASE (o_orderkey * 7 + o_custkey) % 20 "
    + " ".join(f"WHEN {at} THEN '{topic}'" for at, topic in enumerate(_TOPICS))
    + " ELSE 'Significance of Pollution Awareness Events' END",
    "sentiment": _scaled("(o_orderkey * 6151) % 19861 - 9930", "0.0001", "DECIMAL(5,4)"),
    "stance": "CASE WHEN (o_orderkey * 7 + o_custkey) % 20 = 17 THEN 'neutral' "
    "WHEN o_orderkey % 2003 = 0 THEN 'n/a' WHEN o_orderstatus = 'P' THEN 'believer' "
    "WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN ' Denier ' "
    "WHEN o_orderstatus = 'F' THEN 'Believer' ELSE 'neutral' END",
    "gender": "CASE WHEN o_custkey % 25 < 16 THEN 'male' WHEN o_custkey % 25 < 24 THEN 'FEMALE' "
    "ELSE 'undefined' END",
    "temperature_avg": "CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 3 = 2 THEN '' "
    "WHEN o_orderkey % 1017 = 0 THEN '-3.1493975e-05' "
    f"ELSE {_scaled('(o_orderkey * 3571) % 44001 - 23000', '0.001', 'DECIMAL(4,3)')} END",
    "aggressiveness": "CASE WHEN o_orderkey % 997 = 0 THEN NULL "
    "WHEN (o_orderkey * 31 + o_custkey) % 100 < 29 THEN 'aggressive' ELSE 'not aggressive' END",
}

SQL = "SELECT " + ", ".join(f"{text} AS {name}" for name, text in EXPRESSIONS.items()) + " FROM orders"


def project(orders: DataFrame) -> DataFrame:
    """Staging rows with the declared types."""
    named = orders.selectExpr(*(f"{text} AS {name}" for name, text in EXPRESSIONS.items()))
    return named.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW.fields))


def sample_raw(spark: SparkSession, folder: str) -> DataFrame:
    return project(spark.read.parquet(f"{folder}/orders.parquet"))
