from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from conftest import plan_of, rows_of
from pyspark.sql import functions as F

from agorametric.functions.rules import bucket_edge, score_bin
from agorametric.functions.text import title_words
from agorametric.operators.keys import KeyViolation, key_violations, require_key
from agorametric.plans.cleaning import clean
from agorametric.schemas import CLEAN


def _column(frame, name):
    return [row[name] for row in frame.orderBy("tweet_id").collect()]


def test_schema_is_the_declared_one(sample):
    found = [(f.name, f.dataType) for f in clean(sample).schema.fields]
    assert found == [(f.name, f.dataType) for f in CLEAN.fields]


@pytest.mark.parametrize(
    ("score", "category"),
    [("0.05", "Neutral"), ("0.0500001", "Positive"), ("-0.05", "Neutral"), ("-0.0500001", "Negative"), (None, "Neutral")],
)
def test_sentiment_bands(raw_rows, score, category):
    assert _column(clean(raw_rows({"sentiment": score})), "sentiment_category") == [category]


@pytest.mark.parametrize(
    ("lat", "lng", "region"),
    [
        ("15", "-80", "North America"),
        ("14.9999999", "-80", "South America"),
        ("36", "0", "Europe"),
        ("34.9999999", "0", "Africa"),
        ("10", "50", "Africa"),
        ("10", "55.0000001", "Asia"),
        ("-20", "130", "Oceania"),
        ("-80", "0", "Other"),
        ("72", "-170", "North America"),
        ("10", " ", "Unknown"),
        (None, "10", "Unknown"),
    ],
)
def test_regions(raw_rows, lat, lng, region):
    row = clean(raw_rows({"lat": lat, "lng": lng})).head()
    assert row["continent"] == region
    assert row["has_coordinates"] == (region != "Unknown")


def test_categories(raw_rows):
    frame = clean(
        raw_rows(
            {"stance": " Denier ", "gender": "FEMALE", "aggressiveness": "Aggressive"},
            {"stance": "\tdenier", "gender": "undefined", "aggressiveness": "calm"},  # only blanks are trimmed
            {"stance": None, "gender": None, "aggressiveness": None},
        )
    )
    assert _column(frame, "stance") == ["Denier", "Unknown", "Unknown"]
    assert _column(frame, "gender") == ["Female", "Unknown", "Unknown"]
    assert _column(frame, "aggressiveness") == ["Aggressive", "Unknown", "Unknown"]
    assert _column(frame, "is_aggressive") == [True, False, None]


@pytest.mark.parametrize(
    ("text", "titled"),
    [
        ("co-op o'neil a/b", "Co-Op O'Neil A/B"),
        ("  weather EXTREMES ", "Weather Extremes"),
        ("undefined / one word hashtags", "Undefined / One Word Hashtags"),
        ("3d maps\tand 4th", "3d Maps\tAnd 4th"),
        ("a  b-", "A  B-"),
        ("été à l'école", "Été À L'École"),
        ("", ""),
        (None, None),
    ],
)
def test_title_words(spark, text, titled):
    frame = spark.createDataFrame([(text,)], "topic string")
    assert frame.select(title_words(F.col("topic"))).head()[0] == titled


def test_calendar_parts(raw_rows):
    row = clean(raw_rows({"created_at": "2023-01-01 23:30:00+00:00"})).head()
    assert (row["tweet_year"], row["tweet_month"], row["tweet_quarter"], row["tweet_day_of_week"]) == (2023, 1, 1, 0)
    assert row["tweet_date"] == datetime.date(2023, 1, 1)
    assert row["created_at_raw"] == "2023-01-01 23:30:00+00:00"


def test_calendar_follows_utc_for_other_offsets(raw_rows):
    row = clean(raw_rows({"created_at": "2012-12-31 23:30:00-02:00"})).head()
    assert (row["tweet_year"], row["tweet_month"]) == (2013, 1)


def test_scientific_and_blank_numbers(raw_rows):
    frame = clean(raw_rows({"lat": "1", "lng": "-5.2199999999999995e-05", "temperature_avg": ""}, {"lng": "9e-05"}))
    assert _column(frame, "lng") == [Decimal("-0.0000522"), Decimal("0.0000900")]
    assert _column(frame, "temperature_avg") == [None, None]


@pytest.mark.parametrize(
    "row",
    [
        {"sentiment": ""},
        {"sentiment": "abc"},
        {"lat": "1000.5"},
        {"temperature_avg": "warm"},
        {"created_at": "yesterday at noon"},
        {"topic": "x" * 101},
    ],
)
def test_bad_values_fail_the_job(raw_rows, row):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|NUMERIC_VALUE_OUT_OF_RANGE|too long"):
        clean(raw_rows(row)).collect()


def test_histogram_buckets_go_down(spark):
    frame = spark.sql("SELECT CAST(x AS DECIMAL(10,7)) AS x FROM VALUES ('-0.05'), ('0.05'), ('0.1'), ('-1'), (NULL) t(x)")
    found = [row[0] for row in frame.select(bucket_edge(score_bin(F.col("x"), 10))).collect()]
    assert found == [Decimal("-0.1"), Decimal("0.0"), Decimal("0.1"), Decimal("-1.0"), None]


def test_keys(raw_rows):
    require_key(raw_rows({}, {}), "id")
    for bad in (({"id": 7}, {"id": 7}), ({"id": None},)):
        with pytest.raises(KeyViolation):
            require_key(raw_rows(*bad), "id")
    found = key_violations(raw_rows({"id": 7}, {"id": 7}, {"id": None}, {"id": 8}), "id")
    assert {(row["id"], row["n"]) for row in found.collect()} == {(7, 2), (None, 1)}


def test_cleaning_shuffles_nothing_and_stays_in_the_jvm(sample):
    plan = plan_of(clean(sample))
    assert "Exchange" not in plan and "Python" not in plan
    assert all("*(1)" in line for line in plan.splitlines() if "Project" in line)


def test_row_count_is_kept(sample):
    assert rows_of(clean(sample).selectExpr("count(*) AS n", "count(DISTINCT tweet_id) AS ids")) == [
        {"n": 1500, "ids": 1500}
    ]
