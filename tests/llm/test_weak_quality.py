from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
from conftest import DATA

from agorametric.llm import weak_quality as wq
from agorametric.llm.common import prepare
from agorametric.llm.queries import queries

FOLDER = str(DATA / "sf0.01")


def rows_of(name):
    return pq.read_table(Path(FOLDER) / f"{name}.parquet").to_pylist()


def test_held_out_labels(spark):
    """No label takes part in fitting; they only judge the result."""
    found = {row["doc_id"]: row for row in queries()["op8_weak_quality"](spark, FOLDER).collect()}
    assert len(found) == len(rows_of("documents"))
    labels = rows_of("labels")
    good = [row["doc_id"] for row in labels if row["quality"]]
    bad = [row["doc_id"] for row in labels if not row["quality"]]
    assert sum(found[id]["is_kept"] for id in good) >= 0.99 * len(good)
    assert sum(not found[id]["is_kept"] for id in bad) >= 0.9 * len(bad)


def test_votes_and_scores_against_a_plain_version(spark):
    documents = prepare(spark).read.parquet(f"{FOLDER}/documents.parquet")
    model = wq.fit(documents, train_rows=300)
    texts = {row["doc_id"]: row["text"] for row in rows_of("documents")}
    assert model.labels.posterior == wq.fit_labels(Counter(wq.votes(text, text.split()) for text in texts.values())).posterior
    kept = {row["doc_id"] for row in wq.keep_good(documents, model).select("doc_id").collect()}
    for row in wq.score(documents, model).collect():
        words = texts[row["doc_id"]].split()
        total = sum(model.weights[bucket] for word in words for bucket in wq.word_buckets(word))
        total += model.weights[wq._SAME] * sum(left == right for left, right in zip(words, words[1:]))
        plain = 1 / (1 + math.exp(-(total / (len(words) + wq.SMOOTH) + model.bias)))
        assert abs(plain - row["score"]) < 1e-9
        assert row["is_kept"] == (row["score"] >= 0.5) == (row["doc_id"] in kept)


def test_labellers_that_agree_are_trusted():
    kinds = "".join("-+"[kind] for kind, _ in wq.LABELLERS.values())
    silent = " " * len(kinds)
    clean = "".join(sign if sign == "+" else " " for sign in kinds)
    junk = "".join(sign if at < 3 else " " for at, sign in enumerate(kinds))
    model = wq.fit_labels({clean: 900, junk: 100, silent: 7})
    assert model.posterior[clean] > 0.99 and model.posterior[junk] < 0.01 and silent not in model.posterior
    assert abs(model.good - 0.9) < 0.02
    assert model.accuracy()["signs"] > 0.9


def plain_labels(patterns, rounds=50):
    """Expectation-maximisation pattern by pattern, in plain numbers."""
    kinds = [kind for kind, _ in wq.LABELLERS.values()]
    begin = {(kind, truth): wq.SPEAKS_UP[kind][kind != truth] for kind in (0, 1) for truth in (0, 1)}
    good, chance = wq.GOOD_SHARE, [[begin[kind, truth] for truth in (0, 1)] for kind in kinds]
    found = {}
    for _ in range(rounds):
        for pattern in patterns:
            like = [1 - good, good]
            for truth in (0, 1):
                for at, sign in enumerate(pattern):
                    like[truth] *= chance[at][truth] if sign != " " else 1 - chance[at][truth]
            found[pattern] = like[1] / sum(like)
        mass = [sum(n * (share if truth else 1 - share) for n, share in zip(patterns.values(), found.values())) for truth in (0, 1)]
        good = (mass[1] + wq.GOOD_SHARE * wq.START_WEIGHT) / (sum(mass) + wq.START_WEIGHT)
        for at, kind in enumerate(kinds):
            for truth in (0, 1):
                spoken = sum(patterns[name] * (found[name] if truth else 1 - found[name]) for name in patterns if name[at] != " ")
                chance[at][truth] = (spoken + begin[kind, truth] * wq.START_WEIGHT) / (mass[truth] + wq.START_WEIGHT)
    return good, found


def test_estimates_against_plain_expectation_maximisation():
    counted = Counter(wq.votes(row["text"], row["text"].split()) for row in rows_of("documents"))
    patterns = {name: count for name, count in sorted(counted.items()) if name.strip()}
    model, (good, found) = wq.fit_labels(counted), plain_labels(patterns)
    assert abs(model.good - good) < 1e-9 and model.posterior.keys() == found.keys()
    assert all(abs(model.posterior[name] - found[name]) < 1e-6 for name in found)


def test_the_model_does_not_depend_on_order_or_repeated_rows_of_the_sample(spark):
    documents = prepare(spark).read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    hot = documents.where("doc_id = 1").selectExpr("*", "explode(sequence(1, 10000))").drop("col")
    rows = documents.union(hot)
    models = [wq.fit(rows.repartition(parts, *by), train_rows=300) for parts, by in ((3, ["text"]), (7, ["doc_id"]))]
    assert models[0].labels.posterior == models[1].labels.posterior
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all()
    assert models[0].weights.any()


def test_the_sample_is_bounded_in_rows_and_features(spark, monkeypatch):
    words = [(at, " ".join(f"w{at}x{word}" for word in range(50))) for at in range(40)]
    rows = prepare(spark).createDataFrame(words, "row long, text string")
    whole = wq._sample(rows, 40, 40)
    assert [row["row"] for row in whole] == list(range(40))
    assert [row["row"] for row in wq._sample(rows, 40, 4)] == list(range(8))
    # Ten thousand copies of one row leave few different ones; more are drawn until there are enough.
    assert len(wq._sample(rows, 10_000, 20)) >= 10
    monkeypatch.setattr(wq, "TRAIN_ENTRIES", sum(len(row["buckets"]) for row in whole[:5]))
    assert [row["row"] for row in wq._sample(rows, 40, 40)] == list(range(5))


def test_scorer_learns_and_takes_no_rows():
    weights, bias = wq.fit_scorer([], np.array([]))
    assert not weights.any() and bias == 0
    features = wq.Features()
    texts = ["good words here.", "BAD BAD BAD"] * 20
    weights, bias = wq.fit_scorer([features.shares(text.split()) for text in texts], np.array([1.0, 0.0] * 20))
    scorer = wq.Features(weights)
    assert scorer.score(texts[0].split()) + bias > 0 > scorer.score(texts[1].split()) + bias


def test_odd_rows(spark):
    frame = prepare(spark).createDataFrame(
        [(1, None, 1.0), (2, "", 1.0), (None, "A plain text of words.", 1.0), (3, "x " * 300_000, 1.0), (3, "x " * 300_000, 1.0)],
        "doc_id long, text string, score double",
    )
    model = wq.fit(frame)
    rows = wq.score(frame, model).collect()
    assert [row["doc_id"] for row in rows] == [1, 2, None, 3, 3]
    assert [row["is_kept"] for row in rows[:2]] == [False, False] and [row["score"] for row in rows[:2]] == [0, 0]
    assert wq.keep_good(frame, model).columns == frame.columns
    empty = frame.limit(0)
    assert wq.score(empty, wq.fit(empty)).count() == 0
