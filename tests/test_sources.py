from __future__ import annotations

import random
from pathlib import Path
from types import SimpleNamespace

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from agorametric.plans.cleaning import clean
from agorametric.schemas import CLEAN, RAW
from agorametric.session import scratch_path, temporary_settings
from agorametric.sources import tables
from agorametric.sources.delimited import read_raw_csv, write_raw_csv

HEADER = ",".join(RAW.names)


def _csv(tmp_path, *lines, header=HEADER):
    file = tmp_path / "posts.csv"
    file.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    return str(file)


def _difference(first, second):
    return first.exceptAll(second).count() + second.exceptAll(first).count()


def test_csv_round_trip(spark, sample, tmp_path):
    path = str(tmp_path / "csv")
    write_raw_csv(sample, path)
    found = read_raw_csv(spark, path)
    assert found.schema == RAW
    assert _difference(found, sample) == 0


def test_empty_and_missing_fields_differ(spark, tmp_path):
    path = _csv(tmp_path, 't,1,,"","say ""hi"", twice",0.1, Denier ,,,é')
    row = read_raw_csv(spark, path).head()
    assert (row["lng"], row["lat"], row["topic"]) == (None, "", 'say "hi", twice')
    assert (row["stance"], row["gender"], row["aggressiveness"]) == (" Denier ", None, "é")


def test_columns_go_by_position(spark, tmp_path):
    path = _csv(tmp_path, "t,1,2,3,x,0.1,s,g,5,a", header="a,b,c,d,e,f,g,h,i,j")
    row = read_raw_csv(spark, path).head()
    assert (row["id"], row["lng"], row["lat"]) == (1, "2", "3")


@pytest.mark.parametrize("line", ["t,1,2,3", "t,one,2,3,x,0.1,s,g,5,a"])
def test_malformed_rows_fail_the_load(spark, tmp_path, line):
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE"):
        read_raw_csv(spark, _csv(tmp_path, "t,1,2,3,x,0.1,s,g,5,a", line)).collect()


def test_line_breaks_in_fields_need_multi_line(spark, tmp_path):
    path = _csv(tmp_path, 't,1,2,3,"two\nlines",0.1,s,g,5,a')
    assert read_raw_csv(spark, path, multi_line=True).head()["topic"] == "two\nlines"


def _one_task(spark, path):
    """The same files read by Spark's own reader, each in one task."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "emptyValue": "\u0001", "mode": "FAILFAST"}
    text = spark.read.schema(", ".join(f"{name} string" for name in RAW.names)).options(**options).csv(path)
    values = [F.expr(f"try_cast({name} AS bigint)") if name == "id" else F.when(F.col(name) == "\u0001", "").otherwise(F.col(name)) for name in RAW.names]
    return text.select(*[value.alias(name) for value, name in zip(values, RAW.names)])


def _quoted(field):
    return field if field.isalnum() else '"' + field.replace('"', '""') + '"'


@pytest.mark.parametrize(("split", "breaks"), [(2_000, 0.3), (300, 0.9), (4_000, 0.002), (100_000_000, 0.3)])
def test_breaks_in_fields_in_many_tasks(spark, tmp_path, split, breaks):
    """Records over many lines and over several splits, files of several sizes, and splits without any."""
    drawn = random.Random(split)
    folder = tmp_path / "csv"
    folder.mkdir()
    at = 0
    for file, rows in enumerate((200, 0, 3, 80)):
        text = HEADER + "\n" if file % 2 else '"created\nat",' + HEADER.split(",", 1)[1] + "\n"
        for _ in range(rows):
            at += 1
            topic = "".join(drawn.choice(["word ", '"', "é", ",", "\n", "\n\n", '","', "\n1,2\n"]) for _ in range(drawn.randrange(400 if drawn.random() < 0.02 else 9)))
            if drawn.random() > breaks:
                topic = topic.replace("\n", " ")
            text += f't{at},{at},,"",{_quoted(topic)},0.1,s,"g ",,{drawn.choice(["", "a"])}\n' + "\n" * (drawn.random() < 0.1)
        (folder / f"{file}.csv").write_text(text[: -1 if file == 3 else None], encoding="utf-8", newline="")
    settings = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    with temporary_settings(spark, settings):
        found = read_raw_csv(spark, str(folder), multi_line=True)
        assert found.schema == RAW
        assert _difference(found, _one_task(spark, str(folder))) == 0
        assert found.count() == 283
        size = sum(file.stat().st_size for file in folder.iterdir())
        lines = spark.read.option("lineSep", "\n").text(str(folder))
        assert lines.rdd.getNumPartitions() >= min(size // split, 2)


def test_breaks_keep_their_form(spark, tmp_path):
    file = tmp_path / "posts.csv"
    file.write_bytes((HEADER + '\r\nt,1,2,3,"a\r\nb",0.1,s,g,5,a\r\n\r\nt,2,2,3,"c\n",0.1,s,g,5,""\r\n').encode())
    found = {row["id"]: (row["topic"], row["aggressiveness"]) for row in read_raw_csv(spark, str(file), multi_line=True).collect()}
    assert found == {1: ("a\r\nb", "a"), 2: ("c\n", "")}


def test_unclosed_quote_fails_the_load(spark, tmp_path):
    path = _csv(tmp_path, "t,1,2,3,x,0.1,s,g,5,a", 't,2,2,3,"x,0.1,s,g,5,a', "t,3,2,3,x,0.1,s,g,5,a")
    with pytest.raises(Exception, match="a quote is not closed"):
        read_raw_csv(spark, path, multi_line=True).count()


@pytest.mark.parametrize("line", ["t,1,2,3", "t,one,2,3,x,0.1,s,g,5,a"])
def test_malformed_records_fail_the_load(spark, tmp_path, line):
    path = _csv(tmp_path, 't,1,2,3,"x\n",0.1,s,g,5,a', line)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_raw_csv(spark, path, multi_line=True).select("topic").collect()


def test_clean_layout(spark, sample, tmp_path):
    path = str(tmp_path / "clean")
    rows = clean(sample)
    tables.write_clean(rows, path)
    found = tables.read_clean(spark, path)
    assert found.columns == CLEAN.names
    assert _difference(found, rows) == 0
    years = {folder.name for folder in Path(path).glob("tweet_year=*")}
    assert len(years) == 16
    assert all(len(list(folder.glob("*.parquet"))) == 1 for folder in Path(path).glob("tweet_year=*"))


def test_layout_without_gathering(spark, sample, tmp_path):
    path = str(tmp_path / "clean")
    rows = clean(sample)
    tables.write_clean(rows, path, gather=False)
    assert _difference(tables.read_clean(spark, path), rows) == 0


def test_a_hot_year_is_split_over_many_files(spark, sample, tmp_path):
    path = str(tmp_path / "clean")
    rows = clean(sample.withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(40)))).repartition(32))
    hot = rows.withColumn("tweet_year", F.when(F.col("tweet_id") <= 30, 2015).otherwise(2016).cast("smallint"))
    tables.write_clean(hot, path, file_bytes="400KB")
    files = {year: len(list(Path(path, f"tweet_year={year}").glob("*.parquet"))) for year in (2015, 2016)}
    assert files[2015] > 2 * files[2016] >= 2  # a year is split by the map tasks its rows come from
    assert spark.read.parquet(path).count() == 60_000


def test_year_filter_prunes_folders_and_reads_few_columns(spark, sample, tmp_path):
    path = str(tmp_path / "clean")
    tables.write_clean(clean(sample), path)
    frame = tables.read_clean(spark, path).where("tweet_year BETWEEN 2010 AND 2011 AND topic = 'Politics'")
    plan = plan_of(frame.groupBy("stance").count())
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(tweet_year" in scan and "EqualTo(topic,Politics)" in scan
    assert scan.rstrip().endswith("ReadSchema: struct<topic:string,stance:string>")


def test_settings_return_to_what_they_were(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    with pytest.raises(RuntimeError), temporary_settings(spark, {key: "1MB"}):
        assert spark.conf.get(key) == "1MB"
        raise RuntimeError
    assert spark.conf.get(key, None) == before


def test_scratch_paths_are_fresh(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def _session(master, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf.get("folder", default)),
        sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
    )


def test_scratch_paths_lie_in_the_shared_folder():
    assert scratch_path(_session("spark://host", folder="hdfs://shared/dir/"), "x").startswith("hdfs://shared/dir/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(_session("spark://host"), "x")
