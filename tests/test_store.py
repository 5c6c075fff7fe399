from __future__ import annotations

import threading

import pytest
from conftest import plan_of, rows_of
from pyspark.sql import functions as F

from agorametric.operators import keys
from agorametric.operators.cells import Cells
from agorametric.operators.keys import KeyViolation, key_clashes, require_key
from agorametric.plans import descriptive, diagnostic, marts, pipeline, store
from agorametric.plans.cleaning import clean
from agorametric.session import temporary_settings, together
from agorametric.sources.delimited import write_raw_csv


@pytest.fixture(scope="module")
def two_loads(spark, sample, tmp_path_factory):
    """The sample in two loads: two thirds, then the rest."""
    folder = tmp_path_factory.mktemp("store")
    for name, part in (("first", F.col("id") % 3 > 0), ("second", F.col("id") % 3 == 0)):
        write_raw_csv(sample.where(part), str(folder / name))
    root = str(folder / "tables")
    store.load(spark, str(folder / "first"), root)
    store.append(spark, str(folder / "second"), root)
    return root


def test_two_loads_equal_one(spark, two_loads, sample, posts):
    found = store.current(spark, two_loads)
    assert (found.number, len(found.parts)) == (2, 2)
    assert found.raw().exceptAll(sample).count() == 0 and found.raw().count() == 1500
    assert found.clean().exceptAll(clean(sample)).count() == 0
    for name in marts.MARTS:
        expected = marts.mart(name, posts)
        assert rows_of(found.mart(name), *expected.columns) == rows_of(expected, *expected.columns)
    assert diagnostic.correlations(found.cells()).collect() == diagnostic.correlations(posts).collect()
    assert tuple(found.duplicates().first()) == (1500, 1500, 0)
    assert sorted(file.rsplit("/ids/")[0].split("/")[-1] for file in found.ids().inputFiles())[0] in {part.split("/")[-1] for part in found.parts}
    clean_rows = Cells.of_rows(found.clean())
    assert descriptive.sentiment_by_stance(clean_rows, found.bins()).collect() == descriptive.sentiment_by_stance(posts).collect()


def test_an_increment_reads_only_its_own_posts(spark, two_loads):
    """The cells of the second part come from its posts; those of the first are untouched."""
    first, second = (Cells(spark.read.parquet(pipeline.locations(part).cells), merged=True) for part in store.current(spark, two_loads).parts)
    counts = [cells.frame.agg(F.sum("n")).first()[0] for cells in (first, second)]
    assert sum(counts) == 1500 and 0 < counts[1] < counts[0]


def test_compaction_changes_nothing(spark, two_loads, posts):
    before = store.current(spark, two_loads)
    after = store.compact(spark, two_loads)
    assert len(after.parts) == 1 and store.current(spark, two_loads).parts == after.parts
    assert after.clean().exceptAll(before.clean()).count() == 0 and after.clean().count() == 1500
    assert after.cells().frame.count() <= before.cells().frame.count()
    for name in ("vw_yearly_trends", "vw_executive_insights"):
        assert rows_of(after.mart(name), *marts.mart(name, posts).columns) == rows_of(before.mart(name), *marts.mart(name, posts).columns)
    assert before.raw().count() == 1500
    assert after.duplicates().collect() == before.duplicates().collect() and after.ids().count() <= before.ids().count()


@pytest.mark.parametrize("gather", [True, False])
@pytest.mark.parametrize("load", [store.load, store.append])
def test_a_failing_load_leaves_the_tables(spark, raw_rows, tmp_path, gather, load):
    """A bad score in the last row, found while the clean table is written."""
    root = str(tmp_path / "tables")
    write_raw_csv(raw_rows({"id": 1}, {"id": 2}), str(tmp_path / "good"))
    store.load(spark, str(tmp_path / "good"), root)
    write_raw_csv(raw_rows(*({"id": at} for at in range(10, 60)), {"id": 99, "sentiment": "bad"}), str(tmp_path / "bad"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load(spark, str(tmp_path / "bad"), root, gather=gather)
    found = store.current(spark, root)
    assert found.number == 1 and sorted(row["tweet_id"] for row in found.clean().collect()) == [1, 2]
    assert found.mart("vw_kpi_summary").count() == 1
    write_raw_csv(raw_rows({"id": 3}), str(tmp_path / "more"))
    assert store.append(spark, str(tmp_path / "more"), root, gather=gather).clean().count() == 3


def test_stored_keys_are_refused(spark, raw_rows, tmp_path):
    root = str(tmp_path / "tables")
    for name, ids in (("first", [1, 2, 3]), ("second", [4, 2])):
        write_raw_csv(raw_rows(*({"id": id} for id in ids)), str(tmp_path / name))
    store.append(spark, str(tmp_path / "first"), root)
    with pytest.raises(KeyViolation, match="id=2 "):
        store.append(spark, str(tmp_path / "second"), root)
    assert store.current(spark, root).number == 1


def test_commits_at_once_are_told(spark, raw_rows, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")
    write_raw_csv(raw_rows({"id": 1}), str(tmp_path / "csv"))
    store.load(spark, str(tmp_path / "csv"), root)
    with pytest.raises(RuntimeError, match="at once"):
        store._commit(spark, root, ["x"], None)


def test_nothing_stored(spark, tmp_path):
    assert store.current(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError, match="nothing is stored"):
        store.compact(spark, str(tmp_path / "none"))


def test_key_clashes(spark, tmp_path, monkeypatch):
    """As a full check says, without shuffling the stored side, and reading only what may clash."""
    path = str(tmp_path / "stored")
    spark.range(-5000, 5000).write.parquet(path)
    stored = spark.read.parquet(path)
    batch = spark.createDataFrame([(id,) for id in (7, 7, None, -4999, 5000, 9000)], "id long")
    found = key_clashes(batch, stored, "id")
    assert sorted(row["id"] for row in found.collect()) == [-4999, 7]
    plan = plan_of(key_clashes(batch, stored, "id"))
    assert "BroadcastHashJoin" in plan and "GreaterThanOrEqual(id,-4999)" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(keys, "BROADCAST_KEYS", 0)
    assert sorted(row["id"] for row in key_clashes(batch, stored, "id").collect()) == [-4999, 7]
    assert key_clashes(batch.limit(0), stored, "id").count() == 0


def test_key_checks_look_at_all_partitions_at_once(spark):
    """A good key has no violation in any partition; they are not searched a few at a time."""
    context = spark.sparkContext
    many = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with temporary_settings(spark, many):
        context.setJobGroup("one key check", "")
        try:
            require_key(spark.range(0, 1000, 1, 4), "id")
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
    # Two shuffles and the result.
    assert len(context.statusTracker().getJobIdsForGroup("one key check")) <= 3
    with pytest.raises(KeyViolation, match=r"id=None occurs 2 time"):
        require_key(spark.createDataFrame([(9,), (9,), (None,), (None,)], "id long"), "id")


def test_marts_are_published_side_by_side(spark, posts, tmp_path, monkeypatch):
    """Two have begun before either has ended; the tables are the same."""
    build, met, waiting = marts.mart, threading.Barrier(2), iter(range(2))

    def begun(name, *given, **options):
        if next(waiting, None) is not None:
            met.wait(timeout=60)
        return build(name, *given, **options)

    monkeypatch.setattr(marts, "mart", begun)
    pipeline.publish_marts(posts, str(tmp_path))
    for name in marts.MARTS:
        expected = build(name, posts)
        found = spark.read.parquet(f"{pipeline.locations(str(tmp_path)).marts}/{name}")
        assert rows_of(found, *expected.columns) == rows_of(expected, *expected.columns)


def test_a_failing_step_is_told_after_all_have_ended(spark):
    done = []

    def fail():
        raise ValueError("bad step")

    with pytest.raises(ValueError, match="bad step"):
        together(spark, fail, *(lambda at=at: done.append(spark.range(at).count()) for at in range(6)))
    assert sorted(done) == list(range(6))


def test_stored_tables_follow_the_input_files(spark, tmp_path):
    """Told by the files, of which some hold no rows; the rows are not read for it."""
    import __spark_entry__ as entry

    orders = str(tmp_path / "orders.parquet")
    spark.range(3).coalesce(1).write.parquet(orders)
    one = entry._identity(spark, str(tmp_path))
    assert one[0] == 1 and one == entry._identity(spark, str(tmp_path))
    spark.range(0).coalesce(1).write.mode("append").parquet(orders)
    assert entry._identity(spark, str(tmp_path))[0] == 2
