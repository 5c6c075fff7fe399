from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from agorametric.plans.cleaning import clean
from agorametric.session import temporary_settings
from agorametric.sources import tables
from agorametric.sources.clustered import curve, write_clustered


@pytest.fixture(scope="module")
def written(spark, sample, tmp_path_factory):
    """Posts in both layouts: 24 files along the curve, and one a year."""
    folder = tmp_path_factory.mktemp("clustered")
    rows = clean(sample).withColumn("tweet_id", F.col("tweet_id") * 7919 % 1_000_003)
    # So few rows would become one file.
    with temporary_settings(spark, {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        write_clustered(rows, str(folder / "curve"))
    tables.write_clean(rows, str(folder / "years"))
    return rows, spark.read.parquet(str(folder / "curve")), tables.read_clean(spark, str(folder / "years"))


def rows_read(frame):
    """Rows that come out of the row groups a scan does not skip."""
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_all_rows_and_columns_pass(written):
    rows, clustered, _ = written
    assert clustered.columns == rows.columns and clustered.count() == rows.count() == 1500
    assert clustered.exceptAll(rows).count() == 0 and len(clustered.inputFiles()) > 12


def test_filters_on_several_columns_read_fewer_row_groups(written):
    _, clustered, years = written
    topic, _ = clustered.select("topic").groupBy("topic").count().orderBy(F.desc("count")).first()
    place = clustered.agg(F.percentile_approx("lat", [0.4, 0.6]).alias("lat")).first()["lat"]
    box = (F.col("topic") == topic) & F.col("lat").between(*place)
    assert clustered.where(box).exceptAll(years.where(box)).count() == 0 == years.where(box).exceptAll(clustered.where(box)).count()
    assert rows_read(clustered.where(box)) < 0.6 * rows_read(years.where(box))


def test_a_single_id_reads_hardly_any_row_group(written):
    _, clustered, _ = written
    ids = [row["tweet_id"] for row in clustered.select("tweet_id").orderBy("tweet_id").collect()][100:1400:100]
    read = [rows_read(clustered.where(F.col("tweet_id") == id)) for id in ids]
    assert all(1 <= n for n in read) and sum(read) / len(read) < 150
    assert rows_read(clustered.where(F.col("tweet_id") == ids[0] + 1_000_003)) <= 150


def test_missing_equal_and_no_rows(spark, tmp_path):
    schema = "id long, at timestamp, t string, x double, place string"
    rows = [(at, None, None, None, "p") for at in range(5)] + [(7, None, "é", float("nan"), None)] * 3 + [(None, None, "", -1.5, "q")]
    frame = spark.createDataFrame(rows, schema)
    for part in (frame, frame.limit(0)):
        write_clustered(part, str(tmp_path / "odd"), ("at", "t", "x"), "id")
        found = spark.read.schema(schema).parquet(str(tmp_path / "odd"))
        assert sorted(map(str, found.collect())) == sorted(map(str, part.collect()))
    with pytest.raises(ValueError):
        curve(frame, ["id"] * 7, bits=9)


def test_near_rows_are_near_on_the_curve(spark):
    grid = spark.range(64).select((F.col("id") % 8).alias("a"), F.floor(F.col("id") / 8).alias("b"))
    placed = grid.select("a", "b", curve(grid, ["a", "b"], bits=3).alias("place")).collect()
    assert len({row["place"] for row in placed}) == 64
    quarter = [row for row in placed if row["place"] < 16]
    assert max(row["a"] for row in quarter) <= 4 and max(row["b"] for row in quarter) <= 4
