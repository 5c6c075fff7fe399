from __future__ import annotations

import pytest
from conftest import rows_of

from agorametric.operators.keys import KeyViolation
from agorametric.plans import descriptive, marts, pipeline
from agorametric.sources.delimited import write_raw_csv


@pytest.fixture(scope="module")
def run(spark, sample, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    write_raw_csv(sample, str(folder / "csv"))
    pipeline.run(spark, str(folder / "csv"), str(folder / "out"))
    return str(folder / "out")


def test_every_mart_is_published(spark, run, posts):
    for name in marts.MARTS:
        found = spark.read.parquet(f"{pipeline.locations(run).marts}/{name}")
        expected = marts.mart(name, posts)
        assert rows_of(found, *found.columns) == rows_of(expected, *expected.columns)


def test_views_answer_sql(spark, run, posts):
    pipeline.register(spark, run)
    assert spark.sql("SELECT count(*) FROM raw_tweets").head()[0] == 1500
    assert spark.sql("SELECT count(*) FROM clean_tweets WHERE tweet_year = 2010").head()[0] > 0
    for name in marts.MARTS:
        assert spark.sql(f"SELECT * FROM {name}").collect() == marts.mart(name, posts).collect()
    again = spark.sql("SELECT season, sum(total_tweets) AS n FROM vw_monthly_trends GROUP BY season ORDER BY season")
    assert [row["season"] for row in again.collect()] == ["Autumn", "Spring", "Summer", "Winter"]


def test_stored_bins(spark, run, posts):
    bins = pipeline.read_bins(spark, run)
    assert descriptive.sentiment_by_stance(posts, bins).collect() == descriptive.sentiment_by_stance(posts).collect()


def test_a_bad_key_writes_nothing(spark, raw_rows, tmp_path):
    write_raw_csv(raw_rows({"id": 5}, {"id": 5}), str(tmp_path / "csv"))
    with pytest.raises(KeyViolation):
        pipeline.run(spark, str(tmp_path / "csv"), str(tmp_path / "out"))
    assert not (tmp_path / "out" / "clean").exists()


def test_running_again_replaces_the_tables(spark, raw_rows, tmp_path):
    for rows in (({}, {}, {}), ({},)):
        write_raw_csv(raw_rows(*rows), str(tmp_path / "csv"))
        at = pipeline.run(spark, str(tmp_path / "csv"), str(tmp_path / "out"))
        assert spark.read.parquet(at.clean).count() == len(rows)
