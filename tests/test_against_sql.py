"""Every registered query against its SQL counterpart, value by value."""

from __future__ import annotations

import shutil
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import SMALL

import __spark_entry__ as entry_points
import oracle_queries

STATEMENTS = oracle_queries.statements()
QUERIES = {name: query for name, query in entry_points.queries().items() if name in STATEMENTS}


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda at: names[at])
    picked = [tuple(row[at] for at in order) for row in rows]
    return sorted(names), sorted(picked, key=lambda row: tuple((value is None, str(value)) for value in row))


def test_every_query_has_a_statement():
    own = {*entry_points._STORED, *entry_points._ON_RAW, *entry_points._ON_CLEAN, *entry_points.marts.MARTS}
    assert set(QUERIES) == set(STATEMENTS) == own


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    result = duck.execute(STATEMENTS[name])
    names = [column[0] for column in result.description]
    assert frame.columns == names
    found, exact = frame.collect(), result.fetchall()
    assert comparable(frame.columns, found) == comparable(names, exact)
    if name in oracle_queries.ORDERS:
        assert [tuple(row) for row in found] == [tuple(row) for row in exact]


def test_entry(spark):
    assert entry_points.entry(spark).count() == 14


@pytest.fixture
def folder(tmp_path):
    """A small input of its own, and its query."""
    shutil.copyfile(f"{SMALL}/orders.parquet", tmp_path / "orders.parquet")
    return str(tmp_path)


def counted(spark, folder):
    return sum(row["tweets"] for row in QUERIES["clean_year_distribution"](spark, folder).collect())


def stored(spark, folder, name="clean"):
    return Path(entry_points._stored_at[spark.sparkContext.applicationId, folder, name][0])


def test_stored_table_is_rebuilt_when_it_is_not_whole(spark, folder):
    rows = counted(spark, folder)
    for spoil in (lambda at: shutil.rmtree(at), lambda at: [shutil.rmtree(year) for year in at.glob("tweet_year=*")], lambda at: shutil.rmtree(at / "tweet_year=2010")):
        spoil(stored(spark, folder))
        assert counted(spark, folder) == rows


def test_stored_table_is_rebuilt_when_the_input_is_replaced(spark, folder):
    rows = counted(spark, folder)
    pq.write_table(pq.read_table(f"{SMALL}/orders.parquet").slice(0, 100), f"{folder}/orders.parquet")
    assert rows > 100 == counted(spark, folder)


@pytest.mark.parametrize(("query", "name"), [("diag_correlations_cells", "cells"), ("desc_sentiment_by_stance_bins", "bins"), ("published_vw_monthly_trends", "published")])
def test_small_stored_tables_are_rebuilt_when_a_file_is_lost(spark, folder, query, name):
    rows = QUERIES[query](spark, folder).collect()
    largest = max(stored(spark, folder, name).rglob("*.parquet"), key=lambda file: file.stat().st_size)
    largest.unlink()
    assert QUERIES[query](spark, folder).collect() == rows


def test_repeated_queries_leave_one_copy(spark, folder):
    for _ in range(2):
        QUERIES["ingest_csv"](spark, folder).count()
    at = stored(spark, folder, "staging-csv")
    assert len([key for key in entry_points._stored_at if key[1:] == (folder, "staging-csv")]) == 1 and at.exists()
