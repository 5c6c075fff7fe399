from __future__ import annotations

import pytest
from conftest import plan_of, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agorametric.operators.id_words import counted, id_words, merged, repeated

EDGES = [0, 1, -1, 63, 64, 65, -63, -64, -65, 2**31, -(2**31), 2**63 - 1, -(2**63), -(2**63) + 1]


def exact(rows):
    known = {id for id in rows if id is not None}
    return len(rows), len(known), len(rows) - len(known)


@given(st.lists(st.lists(st.none() | st.sampled_from(EDGES) | st.integers(-200, 200), max_size=30), min_size=1, max_size=3))
@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_loads_merge(spark, loads):
    frames = [spark.createDataFrame([(id,) for id in load], "id long") for load in loads]
    words = id_words(frames[0], "id")
    for frame in frames[1:]:
        words = words.union(id_words(frame, "id"))
    rows = [id for load in loads for id in load]
    assert [tuple(row) for row in counted(words).collect()] == [exact(rows)]
    keyed = exact(rows)[2] == 0
    assert (repeated(words).count() == 0) == keyed


def test_groups_roll_up(spark):
    rows = [(id, group, part) for at, id in enumerate(EDGES * 3 + [None, None]) for group, part in [(f"g{at % 3}", at % 2), (None, 0)]]
    frame = spark.createDataFrame(rows, "id long, g string, p int")
    words = id_words(frame, "id", "g", "p")
    for by in (["g", "p"], ["g"], ["p"], []):
        plain = frame.groupBy(*by).agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.countDistinct("id").alias("distinct_ids"),
            (F.count(F.lit(1)) - F.countDistinct("id")).alias("duplicate_rows"),
        )
        assert rows_of(counted(words, *by), *by) == rows_of(plain, *by)
    assert merged(merged(words, "g"), "g").exceptAll(merged(words, "g")).count() == 0


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, g string")
    assert [tuple(row) for row in counted(id_words(none, "id")).collect()] == [(0, 0, 0)]
    assert counted(id_words(none, "id", "g"), "g").count() == 0


def test_dense_ids_take_few_rows_and_words_combine_before_the_shuffle(spark):
    words = id_words(spark.range(-6400, 6400), "id")
    assert words.count() == 200
    plan = plan_of(words)
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


@pytest.mark.parametrize("kind", ["int", "smallint"])
def test_narrow_ids(spark, kind):
    frame = spark.range(-100, 100).select(F.col("id").cast(kind).alias("id"))
    assert counted(id_words(frame.union(frame), "id")).first()["distinct_ids"] == 200
