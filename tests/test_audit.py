from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import plan_of, rows_of

from agorametric.plans import audit, staging
from agorametric.schemas import RAW, schema_report

DIRTY = ["abc", ".5", "+3", "5.", "1e1", "91.0", "12\n", "NaN", "  ", None]


def test_number_profile_of_dirty_text(raw_rows):
    found = audit.latitude(raw_rows(*({"lat": text} for text in DIRTY))).head().asDict()
    assert found == {
        "total": 10,
        "null_or_blank": 2,
        "non_numeric": 5,
        "out_of_range": 1,
        "min_lat": Decimal(5),
        "max_lat": Decimal(91),
    }


def test_number_too_large_for_any_decimal_is_out_of_range(raw_rows):
    found = audit.longitude(raw_rows({"lng": "1e30"}, {"lng": "-180"}, {"lng": "180.0001"})).head()
    assert (found["non_numeric"], found["out_of_range"]) == (0, 2)


def test_profile_of_no_rows(raw_rows):
    found = audit.latitude(raw_rows({}).limit(0)).head()
    assert found["total"] == 0 and found["null_or_blank"] is None and found["min_lat"] is None


def test_temperature_average(raw_rows):
    found = audit.temperature(raw_rows(*({"temperature_avg": t} for t in ("1", "2", "2.00004", "x", "")))).head()
    assert (found["avg_temp"], found["non_numeric"], found["null_or_blank"]) == (Decimal("1.6667"), 1, 1)


def test_sentiment_profile(raw_rows):
    found = audit.sentiment(raw_rows({"sentiment": "0.5"}, {"sentiment": "-0.25"}, {"sentiment": None})).head()
    assert (found["total"], found["null_or_blank"], found["non_null_rows"]) == (3, 1, 2)
    assert (found["valid_numeric"], found["problem_rows"], found["avg_sentiment"]) == (2, 1, Decimal("0.125"))


def test_sentiment_profile_is_strict(raw_rows):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        audit.sentiment(raw_rows({"sentiment": ""})).collect()


def test_missing_values_and_the_text_null_stay_apart(raw_rows):
    frame = raw_rows({"stance": None}, {"stance": None}, {"stance": "NULL"}, {"stance": "believer"})
    found = [(row["val"], row["n"], row["pct"]) for row in audit.categories(frame).collect() if row["col"] == "stance"]
    assert found == [
        ("NULL", 2, Decimal("50.0000")),
        ("NULL", 1, Decimal("25.0000")),
        ("believer", 1, Decimal("25.0000")),
    ]
    topics = audit.topics(raw_rows({"topic": None}, {"topic": "NULL"}))
    assert [row["topic_value"] for row in topics.collect()] == ["NULL", "NULL"]


def test_category_profile_scans_once(sample):
    frame = audit.categories(sample)
    frame.collect()
    final = plan_of(frame).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert "Cartesian" not in final and "NestedLoop" not in final


def test_duplicates(raw_rows):
    found = audit.duplicates(raw_rows({"id": 1}, {"id": 1}, {"id": 1}, {"id": 2}, {"id": None})).head()
    assert tuple(found) == (5, 2, 3)


def test_most_frequent_formats_are_cut_and_ordered(raw_rows):
    times = [f"2012-01-{day:02d} 00:00:00+00:00 and more text" for day in range(1, 29)]
    found = audit.created_at_format(raw_rows(*({"created_at": t} for t in [*times, times[5]]))).collect()
    assert len(found) == 20 and found[0]["occurrences"] == 2
    assert found[0]["sample_format"] == times[5][:30]


def test_preview_and_count(raw_rows):
    frame = raw_rows(*({"id": at} for at in range(30, 0, -1)))
    assert [row["id"] for row in staging.preview(frame, by_id=True).collect()] == list(range(1, 11))
    assert staging.preview(frame).count() == 10
    assert staging.row_count(frame).head()["total_imported_rows"] == 30


def test_schema_report(spark, sample):
    found = rows_of(schema_report(spark, sample))
    assert [row["column_name"] for row in found] == RAW.names
    assert [row["data_type"] for row in found] == ["string", "bigint"] + ["string"] * 8
