from __future__ import annotations

import hashlib
from fractions import Fraction
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from agorametric.llm import budgets
from agorametric.llm.common import prepare
from agorametric.llm.queries import MIX_EPOCHS, MIX_WEIGHTS, queries


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def fill(share, children):
    """Shares by weight, exactly; a child that has less gives up the rest, round by round."""
    given, open_ = {}, {name: child for name, child in children.items() if child[1] > 0}
    given = {name: Fraction(0) for name in children}
    while open_:
        each = share / sum(weight for _, weight in open_.values())
        short = {name for name, (supply, weight) in open_.items() if supply <= weight * each}
        if not short:
            return given | {name: weight * each for name, (_, weight) in open_.items()}
        for name in short:
            given[name] = Fraction(open_.pop(name)[0])
            share -= given[name]
    return given


def plain_shares(supplies, budget, weights, levels):
    def weight(depth, value):
        return weights.get(levels[depth], {}).get(value, 1)

    usable = {leaf: supply if all(weight(at, value) for at, value in enumerate(leaf)) else 0 for leaf, supply in supplies.items()}
    shares = {(): Fraction(min(budget, sum(usable.values())))}
    for depth in range(len(levels)):
        below = {}
        for parent, share in shares.items():
            children = {}
            for leaf, supply in usable.items():
                if leaf[:depth] == parent:
                    held = children.get(leaf[: depth + 1], (0, 0))[0]
                    children[leaf[: depth + 1]] = held + supply, weight(depth, leaf[depth])
            below |= fill(share, children)
        shares = below
    return shares


def plain_mix(rows, levels, weights, budget, epochs, seed):
    """rows: (id, text, leaf, tokens). Rows taken, as (position, epoch)."""
    supplies, units = {}, {}
    for at, (id, text, leaf, tokens) in enumerate(rows):
        supplies[leaf] = supplies.get(leaf, 0) + tokens
        units.setdefault(leaf, {}).setdefault(f"{'' if id is None else id}|{md5(text or '')}", []).append(at)
    shares = plain_shares({leaf: supply * epochs for leaf, supply in supplies.items()}, budget, weights, levels)
    taken = []
    for leaf, share in shares.items():
        allotted, held = int(share), supplies[leaf]
        whole = allotted // held if held else 0
        left = allotted - whole * held
        taken += [(at, epoch) for epoch in range(whole) for ats in units[leaf].values() for at in ats]
        for _, ats in sorted((md5(f"{seed}|{whole}|{row}"), ats) for row, ats in units[leaf].items()):
            if whole == epochs:
                break
            left -= sum(rows[at][3] for at in ats)
            if left < 0:
                break
            taken += [(at, whole) for at in ats]
    return sorted(taken)


def test_whole_table(spark):
    documents = pq.read_table(Path(SMALL) / "documents.parquet").to_pylist()
    domain = {"src0": "web"} | {f"src{at}": "books" for at in range(1, 10)}
    rows = [
        (row["doc_id"], row["text"], (domain.get(row["source"], "notes"), row["lang"], row["source"]), (len(row["text"]) + 3) // 4)
        for row in documents
    ]
    held = sum(row[3] for row in rows)
    exact = [(documents[at]["doc_id"], epoch) for at, epoch in plain_mix(rows, ["domain", "lang", "source"], MIX_WEIGHTS, held, MIX_EPOCHS, 0)]
    found = queries()["op7_budgets"](spark, SMALL).collect()
    assert sorted((row["doc_id"], row["epoch"]) for row in found) == sorted(exact)
    assert {row["epoch"] for row in found} == {0, 1, 2}
    assert 0.6 * held < sum(row["n_tokens"] for row in found) <= held


@pytest.mark.parametrize(("budget", "epochs"), [(0, 1), (90, 1), (260, 3), (10_000, 2)])
def test_small_trees_with_shortages_and_epochs(spark, budget, epochs):
    rows = [
        (at, f"text {at % 7}" if at % 3 else None, (source[0], source), at % 5)
        for at, source in enumerate(["a1"] * 9 + ["a2"] * 3 + ["b1"] * 20 + ["b2"] + ["c1"] * 12 + ["c1"] * 2)
    ]
    rows += [(1, "text 1", ("a", "a1"), 1), (None, None, ("a", "a1"), 0), (None, "x", ("c", "c1"), 3)]
    weights = {"top": {"a": 5, "b": 1}, "low": {"b2": 3, "a2": 0}}
    frame = prepare(spark).createDataFrame(
        [(id, text, leaf[0], leaf[1], tokens, at) for at, (id, text, leaf, tokens) in enumerate(rows)],
        "doc_id int, text string, top string, low string, share int, at int",
    )
    taken = budgets.mix(
        frame, {"top": F.col("top"), "low": F.col("low")}, weights, F.lit(budget), F.col("share"), epochs, 3, epoch="epoch"
    )
    assert sorted((row["at"], row["epoch"]) for row in taken.collect()) == plain_mix(rows, ["top", "low"], weights, budget, epochs, 3)


def test_empty_and_missing(spark):
    schema = "doc_id long, text string, source string, total long"
    frame = prepare(spark).createDataFrame([(None, None, None, None), (2, "", None, 5), (3, "four", "s", 1)], schema)
    everything = {"levels": {"source": F.col("source")}, "weights": {}, "budget": F.col("total"), "tokens": F.length("text")}
    assert sorted(str(row["doc_id"]) for row in budgets.mix(frame, **everything).collect()) == ["2", "3", "None"]
    assert budgets.mix(frame.limit(0), **everything).count() == 0


def test_rows_without_tokens_are_in_no_epoch_beyond_the_last(spark):
    frame = prepare(spark).createDataFrame([(at, "" if at < 20 else "text", "s") for at in range(22)], "doc_id long, text string, source string")
    for epochs in (1, 2):
        taken = budgets.mix(frame, {"source": F.col("source")}, {}, F.col("total"), F.length("text"), epochs)
        assert sorted(row["doc_id"] for row in taken.collect()) == sorted([*range(22)] * epochs)


def test_columns_with_the_names_of_its_own(spark):
    own = ["epoch", "__row", "__whole", "__cut", "__tokens", "__source", "column 0", "row.name", "held", "total"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{name}` string" for name in own)
    frame = prepare(spark).createDataFrame([(at, f"text {at}", "s", *[f"{name}{at}" for name in own]) for at in range(3)], schema)
    tree = {"levels": {"source": F.col("source")}, "weights": {}, "budget": F.col("total"), "tokens": F.length("text")}
    found = budgets.mix(frame, **tree)
    assert found.columns == frame.columns and sorted(found.collect()) == sorted(frame.collect())
    named = budgets.mix(frame, **tree, epochs=2, epoch="epoch")
    assert sorted(named.columns) == sorted(frame.columns) and sorted((row["doc_id"], row["epoch"]) for row in named.collect()) == [(at, epoch) for at in range(3) for epoch in range(2)]
    assert {row["__row"] for row in named.collect()} == {f"__row{at}" for at in range(3)}
