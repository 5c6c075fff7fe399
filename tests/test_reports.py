from __future__ import annotations

import random
import statistics
from decimal import Decimal

import pytest
from conftest import plan_of, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agorametric.operators.cells import DIMENSIONS, Cells
from agorametric.operators.quantiles import exact_median, median_by
from agorametric.plans import descriptive, diagnostic, marts, validation
from agorametric.plans.cleaning import clean
from agorametric.schemas import RAW
from agorametric.settings import DEFAULTS


@pytest.fixture(scope="module")
def merged(spark, posts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "cells")
    posts.merge(*DIMENSIONS).frame.write.parquet(path)
    return Cells(spark.read.parquet(path), merged=True)


@pytest.mark.parametrize("name", sorted(marts.MARTS))
def test_marts_from_cells_equal_marts_from_posts(posts, merged, name):
    assert marts.mart(name, merged).collect() == marts.mart(name, posts).collect()


OTHER_REPORTS = [
    validation.year_distribution,
    validation.completeness,
    validation.categories,
    validation.coverage,
    descriptive.volume_by_year,
    descriptive.stances,
    descriptive.aggressiveness,
    descriptive.topics,
    descriptive.genders,
    descriptive.geolocation,
    descriptive.continents,
    diagnostic.yoy_direction,
    diagnostic.aggression_by_stance,
    diagnostic.aggression_by_gender,
    diagnostic.correlations,
    diagnostic.hotspots,
    diagnostic.temperature_by_year,
    diagnostic.leading_topics,
    diagnostic.seasons,
    diagnostic.event_periods,
]


@pytest.mark.parametrize("report", OTHER_REPORTS, ids=lambda report: report.__name__)
def test_reports_from_cells_equal_reports_from_posts(posts, merged, report):
    keys = report(posts).columns
    assert rows_of(report(merged), *keys) == rows_of(report(posts), *keys)


def test_reports_from_stored_bins(posts):
    bins = descriptive.score_bins(posts)
    assert descriptive.sentiment_histogram(bins).collect() == descriptive.sentiment_histogram(posts).collect()
    assert descriptive.sentiment_by_stance(posts, bins).collect() == descriptive.sentiment_by_stance(posts).collect()


def test_three_aggression_rates(cells_of):
    """A missing flag: not aggressive in shares of all posts, left out of the rate over known flags."""
    here = {"lat": "50", "lng": "10", "temperature_avg": "1"}
    cells = cells_of(
        {**here, "aggressiveness": "aggressive"},
        {**here, "aggressiveness": "not aggressive"},
        {**here, "aggressiveness": None},
    )
    insights = marts.executive_insights(cells).head()
    assert (insights["aggression_rate"], insights["pct_aggressive"]) == (Decimal("0.500"), Decimal("50.00"))
    assert marts.topic_analysis(cells).head()["pct_aggressive"] == Decimal("33.33")
    assert marts.temp_sentiment(cells).head()["aggr_rate"] == Decimal("0.5000")
    assert diagnostic.temperature_by_year(cells).head()["aggr_rate"] == Decimal("0.3333")


def test_group_without_sides(cells_of):
    cells = cells_of({"stance": "neutral"}, {"stance": "?"})
    assert marts.topic_analysis(cells).head()["divisiveness_score"] == Decimal(1)
    insights = marts.executive_insights(cells).head()
    assert insights["believer_ratio"] is None and insights["denier_ratio"] is None


@pytest.mark.parametrize(("believers", "deniers", "score"), [(1, 1, "1"), (3, 0, "0"), (2, 1, "0.6667"), (1, 7, "0.25")])
def test_divisiveness(cells_of, believers, deniers, score):
    cells = cells_of(*[{"stance": "believer"}] * believers, *[{"stance": "denier"}] * deniers)
    assert marts.topic_analysis(cells).head()["divisiveness_score"] == Decimal(score)


def test_change_looks_back_to_the_previous_year_present(cells_of):
    cells = cells_of(
        {"created_at": "2005-01-01 00:00:00+00:00", "sentiment": "0.9"},
        {"created_at": "2008-01-01 00:00:00+00:00", "sentiment": "0.1"},
        {"created_at": "2011-01-01 00:00:00+00:00", "sentiment": "0.3"},
        {"created_at": "2012-01-01 00:00:00+00:00", "sentiment": "0.3"},
    )
    yearly = marts.mart("vw_yearly_trends", cells).collect()
    assert [(row["tweet_year"], row["yoy_sentiment_change"]) for row in yearly] == [
        (2008, None),
        (2011, Decimal("0.2000")),
        (2012, Decimal("0.0000")),
    ]
    directions = [(row["tweet_year"], row["direction"]) for row in diagnostic.yoy_direction(cells).collect()]
    assert directions == [(2005, "Stable"), (2008, "Declining"), (2011, "Improving"), (2012, "Stable")]


def test_ranks_are_shared(cells_of):
    cells = cells_of(*({"topic": topic} for topic in ("A", "A", "B", "B", "C", "D", "E")))
    ranks = {row["topic"]: row["volume_rank"] for row in marts.topic_yearly_trends(cells).collect()}
    assert ranks == {"A": 1, "B": 1, "C": 3, "D": 3, "E": 3}
    assert len(diagnostic.leading_topics(cells).collect()) == 5


def test_one_row_and_constant_columns(cells_of):
    here = {"lat": "50", "lng": "10", "temperature_avg": "1", "sentiment": "0.3"}
    for cells in (cells_of(here), cells_of(here, here), cells_of(here, here).merge(*DIMENSIONS)):
        found = diagnostic.correlations(cells).head()
        assert found[0] is None and found[1] is None and found[2] is None
    one = cells_of(here)
    assert marts.topic_analysis(one).head()["sentiment_volatility"] is None
    assert marts.topic_analysis(one.merge(*DIMENSIONS)).head()["sentiment_volatility"] is None
    seven = cells_of(*[here] * 7).merge(*DIMENSIONS)
    assert marts.topic_analysis(seven).head()["sentiment_volatility"] == 0


def test_no_posts_at_all(cells_of):
    none = Cells(cells_of({}).frame.limit(0))
    kpis = marts.kpi_summary(none).head()
    assert kpis["total_tweets"] == 0 and kpis["pct_believers"] is None and kpis["overall_avg_sentiment"] is None
    assert validation.completeness(none).head()["geotagged"] is None
    assert descriptive.stances(none).collect() == []
    assert descriptive.sentiment_by_stance(none).collect() == []


def test_exact_totals_at_the_edges(cells_of):
    scores = ["999.9999999", "-999.9999999", "-0.0000001", "0.0000003", "-0.0000001"]
    cells = cells_of(*({"sentiment": score} for score in scores))
    total = cells.frame.agg(cells.total("sentiment_score").alias("total")).head()["total"]
    assert total == Decimal("0.0000001")


def test_missing_scores(cells_of):
    cells = cells_of({"sentiment": None, "stance": "denier"}, {"sentiment": "0.5"}, {"sentiment": None})
    found = {row["stance"]: row for row in descriptive.sentiment_by_stance(cells).collect()}
    assert found["Denier"]["median_sentiment"] is None and found["Denier"]["tweets"] == 1
    assert found["Believer"]["median_sentiment"] == Decimal("0.5") and found["Believer"]["tweets"] == 2
    buckets = [row["sentiment_bucket"] for row in descriptive.sentiment_histogram(cells).collect()]
    assert buckets == [Decimal("0.5"), None]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(
        st.sampled_from(["believer", "denier", "neutral", "other"]),
        st.lists(st.integers(-9_999_999, 9_999_999) | st.sampled_from([1234567, 1234568]), min_size=1, max_size=25),
        min_size=1,
    )
)
def test_median_equals_brute_force(cells_of, groups):
    rows = [
        {"stance": stance, "sentiment": str(Decimal(units).scaleb(-7))}
        for stance, scores in groups.items()
        for units in scores
    ]
    random.Random(1).shuffle(rows)
    cells = cells_of(*rows)
    found = exact_median(
        cells.frame, descriptive._ranges(descriptive.score_bins(cells)), "stance", "sentiment_score", "median"
    )
    expected = {
        stance.title() if stance != "other" else "Unknown": statistics.median(map(Decimal, scores)).scaleb(-7)
        for stance, scores in groups.items()
    }
    assert {row["stance"]: row["median"] for row in found.collect()} == expected


@pytest.mark.parametrize(("direct", "parts"), [(1, 16), (3, 100), (4096, 1024)])
def test_median_for_any_key_equals_brute_force(spark, direct, parts):
    """One key with a third of all rows, many keys of one or two rows, missing keys and values, scores far apart."""
    drawn = random.Random(direct)
    rows = [(None if key == 5 else key, drawn.choice("ab"), drawn.choice([None, 0, -1, drawn.randrange(-99, 99), drawn.randrange(-(10**9), 10**9)])) for key in (*range(60), *[1] * 40, *[5] * 9)]
    frame = spark.createDataFrame([(*keys, None if value is None else Decimal(value).scaleb(-7)) for *keys, value in rows], "n int, value string, score decimal(10,7)")
    groups = {}
    for *keys, value in rows:
        if value is not None:
            groups.setdefault(tuple(keys), []).append(Decimal(value).scaleb(-7))
    found = median_by(frame, ["n", "value"], "score", "median", direct, parts).toDF("one", "two", "n", "median")
    assert {(row["one"], row["two"]): (row["n"], row["median"]) for row in found.collect()} == {
        key: (len(values), statistics.median(values)) for key, values in groups.items()
    }


def test_median_of_wide_numbers_and_of_nothing(spark):
    ends = 10**17 - 1
    found = median_by(spark.createDataFrame([(1, ends), (1, ends - 1), (2, -ends), (2, ends)], "key int, value long"), ["key"], "value", "median", 1, 100)
    assert {row["key"]: row["median"] for row in found.collect()} == {1: Decimal(2 * ends - 1) / 2, 2: 0}
    tenth = spark.createDataFrame([(1, Decimal("0.99999999999999999")), (1, Decimal("0.99999999999999998"))], "key int, value decimal(17,17)")
    assert median_by(tenth, ["key"], "value", "median").first()["median"] == Decimal("0.999999999999999985")
    assert median_by(tenth.limit(0), ["key"], "value", "median").count() == 0
    assert median_by(tenth, [], "value", "median").first()["n"] == 2
    with pytest.raises(TypeError):
        median_by(spark.range(1).selectExpr("id", "1.5D AS value"), ["id"], "value", "median")


def test_a_third_of_all_posts_alike(spark, raw_rows):
    """One topic, year, stance and score hold a third of the posts; every figure agrees with built-in aggregates."""
    many = raw_rows({}).select(*(F.col(name) for name in RAW.names if name != "id"))
    many = many.withColumn("id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(60_000).cast("bigint"))))
    spread = F.col("id") % 3 != 0
    many = many.withColumns(
        {
            "sentiment": F.when(spread, ((F.col("id") * 7919) % 1_999_999 - 999_999).cast("decimal(9,0)") / 1_000_000)
            .otherwise(F.lit(0.1234567))
            .cast("decimal(10,7)")
            .cast("string"),
            "stance": F.when(spread, F.element_at(F.array(*map(F.lit, ("denier", "neutral", "x"))), (F.col("id") % 3 + 1).cast("int"))).otherwise("believer"),
            "created_at": F.when(spread, F.concat((2006 + F.col("id") % 14).cast("string"), F.lit("-05-05 00:00:00+00:00"))).otherwise(F.col("created_at")),
        }
    )
    cells = Cells.of_rows(clean(many.select(*RAW.names)))
    expected = {
        row["stance"]: (row["n"], row["median"], row["mean"])
        for row in cells.frame.groupBy("stance")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.expr("CAST(percentile(sentiment_score, 0.5) AS DECIMAL(20,9))"), 4).alias("median"),
            F.round(F.sum("sentiment_score") / F.count("sentiment_score"), 4).alias("mean"),
        )
        .collect()
    }
    found = {
        row["stance"]: (row["tweets"], row["median_sentiment"], row["avg_sentiment"])
        for row in descriptive.sentiment_by_stance(cells).collect()
    }
    assert found == expected
    assert marts.kpi_summary(cells).head()["total_tweets"] == 60_000


def test_shares_and_counts_add_up(posts):
    for report in (descriptive.stances, descriptive.genders, descriptive.continents, descriptive.topics):
        assert abs(sum(row["pct"] for row in report(posts).collect()) - 100) <= Decimal("0.05")
    for row in marts.topic_analysis(posts).collect():
        assert row["believers"] + row["deniers"] + row["neutrals"] <= row["total_tweets"]
        assert 0 <= row["divisiveness_score"] <= 1
    inside = posts.frame.where(F.col("tweet_year").between(DEFAULTS.first_year, DEFAULTS.last_year)).count()
    assert sum(row["tweets"] for row in diagnostic.seasons(posts).collect()) == inside
    assert sum(row["tweets"] for row in diagnostic.event_periods(posts).collect()) == 1500


def test_hotspot_threshold_and_limit(cells_of):
    here = {"lat": "50", "lng": "10"}
    cells = cells_of(*[here] * 501, *[{**here, "topic": "Rare"}] * 500, *[{**here, "lat": "-80"}] * 501)
    assert [(row["continent"], row["topic"]) for row in diagnostic.hotspots(cells).collect()] == [("Europe", "Politics")]


@pytest.mark.parametrize("name", sorted(marts.MARTS))
def test_marts_scan_once_without_python_or_cross_joins(posts, name):
    frame = marts.mart(name, posts)
    frame.collect()
    final = plan_of(frame).split("Initial Plan")[0]
    assert final.count("FileScan") == 1
    assert not any(word in final for word in ("Python", "Cartesian", "NestedLoop", "ObjectHashAggregate", "SortAggregate"))


def test_only_what_a_mart_reads_is_scanned(posts):
    plan = plan_of(marts.stance_by_region(posts))
    assert "ReadSchema: struct<tweet_year:smallint,stance:string,is_aggressive:boolean,continent:string>" in plan
    assert "Not(In(continent, [Other,Unknown]))" in plan or "Not(In(continent, [Unknown,Other]))" in plan


def test_kpis_do_not_expand_posts(posts):
    """Two distinct counts would triple every post; they run over merged cells, after the first exchange."""
    plan = plan_of(marts.kpi_summary(posts))
    # The last exchange in the text is the first to run; it has the merged cells' keys.
    assert plan.index("Expand") < plan.rindex("Exchange hashpartitioning(tweet_year")
