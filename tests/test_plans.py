"""Physical plans: no nested loops, no Python workers, pruned scans, map-side reduction."""

from __future__ import annotations

import re

import pytest
from places import SMALL

from stockrisk.operators.facts import sku_facts
from stockrisk.plans import catalog
from stockrisk.sources.tables import replace_bucketed


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = sorted(name for name in catalog.queries() if not name.startswith("stream_"))


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loop_and_no_python(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SMALL))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_scans_read_needed_columns_only(spark):
    plan = plan_of(catalog.queries()["analysis"](spark, SMALL))
    scans = re.findall(r"FileScan parquet \[(.*?)\]", plan)
    lines = [s for s in scans if "l_partkey" in s]
    assert lines and all("l_extendedprice" not in s and "l_orderkey" not in s for s in lines)
    assert all("p_name" not in s for s in scans)
    assert "PushedFilters" in catalog.queries()["analysis"](spark, SMALL)._jdf.queryExecution().toString()


def test_large_joins_share_the_window_partitioning(spark):
    """Without broadcasts, each of the four sources is shuffled by key once."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = plan_of(catalog.Model(spark, SMALL).analysis)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    by_key = re.findall(r"Exchange hashpartitioning\(seller_id#\d+, marketplace_id#\d+, seller_sku#\d+", plan)
    assert len(by_key) == 4
    assert plan.count("WindowGroupLimit") == 4  # stock and sales, before and after their shuffle


def test_bucketed_tables_are_joined_without_a_shuffle(spark):
    model = catalog.model(spark, SMALL)
    tables = {"b_products": model.products, "b_inventory": model.inventory, "b_sales": model.sales, "b_configs": model.configs}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name, frame in tables.items():
            replace_bucketed(frame, name, 4)
        facts = sku_facts(*[spark.table(name) for name in tables])
        assert "Exchange" not in plan_of(facts)
        assert facts.exceptAll(model.facts).count() == 0 and facts.count() == 196
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_top_list_is_a_top_k_and_reduces_the_large_tables(spark):
    plan = plan_of(catalog.queries()["top_risk_skus"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan and "LeftSemi" in plan


def test_tasks_are_fanned_out_in_one_pass(spark):
    plan = plan_of(catalog.model(spark, SMALL).tasks)
    # One unfolding each for the stock dates, the sales dates and the tasks; each source is read once.
    assert "Union" not in plan and plan.count("Generate explode(") == 3
    assert plan.count("FileScan parquet [l_") == 2


@pytest.mark.parametrize("name", ["analysis", "tasks", "enriched_analysis", "sales_windows", "explanations"])
def test_generated_methods_are_small_enough_for_the_jit(spark, name):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        frame = catalog.queries()[name](spark, SMALL)
        package = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        code = getattr(package, "MODULE$").codegenString(frame._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name", ["analysis", "enriched_analysis"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    """Not even while they are small: the size check knows the files, not the rows that a broadcast sends."""
    plan = plan_of(catalog.queries()[name](spark, SMALL))
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_buckets_of_keyed_tables_follow_the_products(spark, monkeypatch):
    model, asked = catalog.Model(spark, SMALL), []

    def write_keyed(frame, table, buckets, path):
        asked.append(buckets)
        return frame

    monkeypatch.setattr(catalog, "write_keyed", write_keyed)
    monkeypatch.setattr(catalog, "KEYED_ROWS", 10, raising=False)
    assert set(model.keyed) == {"products", "sales", "configs", "analysis", "history", "tasks"}
    assert set(asked) == {-(-model.products.count() // 10)} and asked[0] > catalog.KEYED_BUCKETS
    assert model.keyed["tasks"].exceptAll(model.tasks).count() == 0 == model.tasks.exceptAll(model.keyed["tasks"]).count()
