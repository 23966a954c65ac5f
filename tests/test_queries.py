"""Every named query against its SQL twin, and the counts known for the test tables."""

from __future__ import annotations

import pytest
from compare import connect, difference
from places import MEDIUM, SMALL

import __spark_entry__ as entry
from oracle.sql import ORACLE_SQL
from stockrisk.plans import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="session")
def database():
    return connect(SMALL)


def test_every_query_of_the_catalog_has_a_twin():
    assert set(catalog.queries()) == set(ORACLE_SQL)
    assert set(catalog.queries()) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, database, name):
    assert difference(spark, database, SMALL, name, catalog.queries()[name], ORACLE_SQL[name]) is None


def counts(df, column):
    return {row[0]: row["count"] for row in df.groupBy(column).count().collect()}


def test_known_counts(spark):
    model = catalog.model(spark, MEDIUM)
    assert (model.inventory.count(), model.sales.count(), model.configs.count()) == (6069, 3748, 1913)
    analysis, tasks = model.written_results()
    assert counts(analysis, "stockout_risk_level") == {
        "critical": 361,
        "high": 651,
        "medium": 108,
        "low": 578,
        "unknown": 262,
    }
    assert counts(analysis, "overstock_risk_level") == {"high": 662, "medium": 699, "low": 599}
    assert counts(analysis, "data_quality_status") == {
        "complete": 1601,
        "missing_sales": 121,
        "missing_config": 77,
        "missing_inventory": 68,
        "invalid_sales": 49,
        "invalid_config": 44,
    }
    assert counts(tasks, "priority") == {"P0": 1369, "P1": 1070, "P2": 1379}
    assert counts(tasks, "impact_level") == {"high": 472, "medium": 1330, "low": 527, "none": 1489}
    assert counts(tasks, "approval_level") == {"manager": 354, "operator": 2265, "none": 1199}


def test_entry(spark):
    assert entry.entry(spark).count() == 196
