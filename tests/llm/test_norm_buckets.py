from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from agorametric.llm import norm_buckets
from agorametric.llm.common import prepare, table
from agorametric.session import temporary_settings

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda found: found[0].lower(), term) for term in _TERM.findall(text or "")]


def plain(documents, items, k=50):
    """Every item against every document, in Python's whole numbers."""
    held = [(id, Counter(terms_of(text))) for id, text in documents if terms_of(text)]
    count, total = len(held), sum(sum(terms.values()) for _, terms in held)
    having = Counter(term for _, terms in held for term in terms)
    found = []
    for item_id, text in set(items):
        scored = []
        for id, terms in held:
            m = 100 - 50 + 50 * sum(terms.values()) * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * having[term] + 1))) * (10**9 * terms[term] // (1000 * terms[term] + 20 * m))
                for term in set(terms_of(text))
                if term in terms
            )
            if score > 0:
                scored.append((-score, id is None, id or 0))
        found += [(item_id, rank, None if none else id, -score) for rank, (score, none, id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def run(documents, items, **settings):
    return sorted(map(tuple, norm_buckets.search(documents, items, **settings).collect()), key=str)


def test_whole_table(spark):
    """In one block of queries and in many."""
    documents = table(prepare(spark), SMALL, "documents").select("doc_id", "text")
    items = table(spark, SMALL, "benchmark").select("item_id", "text")
    exact = plain([tuple(row) for row in documents.collect()], [tuple(row) for row in items.collect()])
    assert run(documents, items) == exact
    assert run(documents, items, block_terms=700) == exact


DOCUMENTS = [
    (1, "The cat sat. The CAT!"),
    (2, "the cat sat the cat"),
    (None, "the cat sat the cat"),
    (None, None),
    (3, ""),
    (4, " .,;-\n"),
    (5, "cat_2cat Äcat ärger 2"),
    (5, "cat_2cat Äcat ärger 2"),
    (6, "dog " * 50_000),
    (-9, "dog ärger"),
    (1 << 62, "the the the"),
]
ITEMS = [(1, "the cat"), (1, "the cat"), (1, "dog"), (2, None), (3, " .. "), (None, "Ärger ärger 2cat"), (4, "nowhere"), (5, "cat " * 1000)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_odd_rows(spark, k):
    documents = prepare(spark).createDataFrame([(*row, 1, "x") for row in DOCUMENTS], "doc_id long, text string, norm int, terms string")
    items = spark.createDataFrame([(*row, 1) for row in ITEMS], "item_id long, text string, item int")
    assert run(documents, items, k=k) == plain(DOCUMENTS, ITEMS, k)
    assert run(documents, items, k=k, block_terms=2) == plain(DOCUMENTS, ITEMS, k)


def test_empty_tables(spark):
    documents = prepare(spark).createDataFrame(DOCUMENTS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert run(documents.limit(0), items) == run(documents, items.limit(0)) == []
    assert run(documents.where("doc_id in (3, 4)"), items) == []


def test_ties_at_the_border_and_many_tasks(spark):
    """Groups of equal scores are cut by id, wherever their rows lie."""
    drawn = random.Random(7)
    documents = [(at, " ".join(drawn.choice("abcdef") for _ in range(drawn.choice([1, 2, 3])))) for at in drawn.sample(range(-999, 999), 700)]
    items = [(at, " ".join(drawn.sample("abcdefg", 3))) for at in range(9)]
    frame = prepare(spark).createDataFrame(documents, "doc_id long, text string").repartition(7)
    with temporary_settings(spark, {"spark.sql.shuffle.partitions": "13"}):
        assert run(frame, spark.createDataFrame(items, "item_id long, text string")) == plain(documents, items)


def test_buckets_are_pruned_and_nothing_is_lost():
    """Rows by falling length: once thresholds are known, few rows are scored."""
    drawn = np.random.default_rng(3)
    n, width = 20_000, 300
    weights = drawn.integers(1, 9000, width)
    sizes = drawn.integers(1, 40, n)
    rows = [np.sort(drawn.choice(width, size, replace=False)) for size in sizes]
    values = [drawn.integers(1, 900_000, len(row)) // drawn.integers(1, 30) for row in rows]
    norms = np.array([math.sqrt((weights[row] * value.astype(float) ** 2).sum()) for row, value in zip(rows, values)])
    order = np.argsort(-norms)
    queries = [drawn.choice(width, 20, replace=False).tolist() for _ in range(10)]
    search = norm_buckets.Search(queries, weights, 50, np.zeros(10, np.int64))
    for low in range(0, n, 1000):
        part = order[low : low + 1000]
        lists = [pa.array([source[at].tolist() for at in part], pa.list_(kind)) for source, kind in ((rows, pa.int32()), (values, pa.int64()))]
        search.bucket(part, np.zeros(len(part), bool), norms[part], norm_buckets.Rows.of(*lists))
    for query, terms in enumerate(queries):
        asked = np.zeros(width, np.int64)
        asked[terms] = weights[terms]
        scores = np.array([(asked[row] * value).sum() for row, value in zip(rows, values)])
        best = np.lexsort((np.arange(n), -scores))[:50]
        assert search.best[query][1].tolist() == best.tolist() and search.best[query][0].tolist() == scores[best].tolist()
    assert search.rescored < 0.1 * n * len(queries)
