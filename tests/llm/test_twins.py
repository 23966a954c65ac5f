"""Text queries against their SQL twins, and what holds for all of them."""

from __future__ import annotations

import pytest
from compare import connect, difference
from places import SMALL

import __spark_entry__ as entry
from stockrisk.llm import queries


@pytest.fixture(scope="module")
def database():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_twin(spark, database, name):
    assert difference(spark, database, SMALL, name, queries.queries()[name], queries.SQL[name]) is None


def test_the_entry_has_them_all():
    numbers = {int(name[2:].split("_")[0]) for name in queries.queries()}
    assert numbers == set(range(1, 14)) and set(queries.SQL) <= set(queries.queries())
    assert {*queries.queries(), "pipeline"} <= set(entry.queries())
