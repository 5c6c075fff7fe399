"""Registered queries of the operators against their SQL counterparts."""

from __future__ import annotations

import pytest
from conftest import SMALL

from agorametric.llm.queries import queries, statements


def ordered(names, rows):
    order = sorted(range(len(names)), key=lambda at: names[at])
    return sorted(str([row[at] for at in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(statements()))
def test_same_result(spark, duck, name):
    found = queries()[name](spark, SMALL)
    result = duck.execute(statements()[name])
    names = [column[0] for column in result.description]
    assert sorted(found.columns) == sorted(names)
    rows = found.collect()
    assert rows and ordered(found.columns, rows) == ordered(names, result.fetchall())
