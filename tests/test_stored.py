"""Stored tables: keyed lookups, incremental newest rows, status overlays, write-back, removal of old attempts."""

from __future__ import annotations

import re
from datetime import date, datetime

import pytest
from places import SMALL
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockrisk.operators.facts import FOLDED, enriched_analysis, of_sku
from stockrisk.operators.latest import latest_inventory, refresh_latest_inventory
from stockrisk.operators.measures import months_of, trailing_sales_of_days
from stockrisk.operators.tasks import TaskTable
from stockrisk.plans import catalog, pipeline, reports
from stockrisk.schemas import INVENTORY, PRODUCTS, STATUS_UPDATES
from stockrisk.sources import order_history as oh
from stockrisk.sources.keyed import open_keyed, write_keyed
from stockrisk.sources.tables import full_refresh, source_tables, upsert_into
from stockrisk.sources.versions import VersionedTable, folders_below, key_bucket


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def model(spark):
    return catalog.model(spark, SMALL)


def setting(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, before)


@pytest.fixture
def no_broadcast(spark):
    yield from setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1")


@pytest.fixture
def shown_buckets(spark):
    """Plans name the opened buckets only if every scan of a bucketed table deals its tasks by bucket."""
    yield from setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")


# Keyed tables ----------------------------------------------------------------------------------------------------------


def test_keyed_tables_are_joined_without_a_shuffle(spark, model, no_broadcast):
    sources = [model.keyed[name] for name in ("products", "sales", "configs")]
    plan = plan_of(enriched_analysis(model.keyed["analysis"], *sources))
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3 and "lower(" not in plan


@pytest.mark.parametrize("name", ["history", "tasks"])
def test_a_lookup_opens_one_bucket_and_pushes_the_literal(model, shown_buckets, name):
    plan = plan_of(of_sku(model.keyed[name], "Sku-12"))
    assert f"SelectedBucketsCount: 1 out of {catalog.KEYED_BUCKETS}" in plan
    assert "EqualTo(seller_sku_folded,sku-12)" in plan


def test_detail_and_tasks_of_a_sku_read_its_buckets(model, shown_buckets):
    sources = [model.keyed[name] for name in ("products", "sales", "configs")]
    for frame in (
        reports.analysis_detail(model.keyed["history"], *sources, "SKU-12"),
        reports.tasks_by_sku(model.keyed["tasks"], "sku-12"),
    ):
        tables = [line for line in plan_of(frame).splitlines() if "FileScan parquet" in line and "keyed_" in line]
        assert tables and all("SelectedBucketsCount: 1 out of" in line for line in tables)
        assert frame.count() > 0


def test_a_top_list_reads_the_buckets_of_its_skus(spark, model, shown_buckets):
    sources = [model.keyed[name] for name in ("products", "sales", "configs")]
    plan = plan_of(reports.top_risk_skus(model.keyed["analysis"], *sources, 3))
    opened = re.findall(r"SelectedBucketsCount: (\d) out of 8", plan)
    assert len(opened) == 3 and all(int(count) <= 3 for count in opened)


def test_keys_compare_without_regard_to_case(spark, tmp_path, no_broadcast):
    analysis = spark.createDataFrame(
        [("s", "m", "Sku-É", "risk", 1), ("S", "M", "other", "risk", 1), ("s", "m", None, "risk", 1)],
        "seller_id string, marketplace_id string, seller_sku string, risk_reason string, total_replenishment_days int",
    )
    products = spark.createDataFrame([("S", "m", "SKU-é", 5.0)], "seller_id string, marketplace_id string, seller_sku string, current_price double")
    sales = spark.createDataFrame(
        [("s", "M", "sku-é", date(2024, 1, 1), 1, 10, 1), ("s", "m", "SKU-É", date(2024, 1, 2), 2, 20, 2)],
        "seller_id string, marketplace_id string, seller_sku string, stat_date date, id int, sales_7d int, sales_30d int",
    )
    configs = spark.createDataFrame([("S", "M", "OTHER", 9, 30)], "seller_id string, marketplace_id string, seller_sku string, moq int, target_stock_days int")
    plain = enriched_analysis(analysis, products, sales, configs)
    tables = [
        write_keyed(frame, f"case_{number}", 3, f"{tmp_path}/{number}")
        for number, frame in enumerate((analysis, products, sales, configs))
    ]
    try:
        stored = enriched_analysis(*tables)
        assert stored.columns == plain.columns
        rows = sorted(map(repr, stored.collect()))
        assert rows == sorted(map(repr, plain.collect())) and "Exchange" not in plan_of(stored)
        found = {row.seller_sku: (row.current_price, row.sales_7d, row.moq) for row in stored.collect()}
        assert found == {"Sku-É": (5.0, 20, None), "other": (None, None, 9), None: (None, None, None)}
        assert of_sku(tables[2], "Sku-É").count() == 2
    finally:
        for number in range(4):
            spark.sql(f"DROP TABLE IF EXISTS case_{number}")


def test_a_keyed_table_can_be_opened_by_another_session(spark, model, tmp_path, shown_buckets):
    stored = write_keyed(model.products, "first_session", 4, f"{tmp_path}/products")
    columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in stored.schema.fields)
    try:
        opened = open_keyed(spark, "second_session", f"{tmp_path}/products", columns, 4)
        assert opened.exceptAll(stored).count() == 0 and opened.count() == model.products.count()
        assert "SelectedBucketsCount: 1 out of 4" in plan_of(of_sku(opened, "SKU-7"))
    finally:
        spark.sql("DROP TABLE IF EXISTS first_session")
        spark.sql("DROP TABLE IF EXISTS second_session")


def test_buckets_by_all_keys_serve_a_common_name(spark, tmp_path, no_broadcast):
    rows = spark.range(600).selectExpr("concat('s', id) AS seller_id", "'m' AS marketplace_id", "'default' AS seller_sku", "id")
    try:
        spread = write_keyed(rows, "by_all", 4, f"{tmp_path}/all", by=FOLDED)
        sizes = [r["n"] for r in spread.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 300
        assert "Exchange" not in plan_of(spread.alias("a").join(spread.alias("b"), FOLDED))
        with pytest.raises(ValueError, match="bucket columns"):
            write_keyed(rows, "bad", 4, f"{tmp_path}/bad", by=["seller_sku"])
    finally:
        spark.sql("DROP TABLE IF EXISTS by_all")


# Newest rows, kept up to date --------------------------------------------------------------------------------------------


def test_newest_rows_follow_arrivals_whatever_their_order(spark, model, tmp_path):
    """Snapshots arrive with the newest first and corrections of old days last; each refresh equals the full recompute."""
    folder = f"{tmp_path}/arrivals"
    table = VersionedTable(spark, f"{tmp_path}/newest", INVENTORY, key_bucket(4))
    layout = T.StructType([*INVENTORY.fields, T.StructField("arrived_on", T.DateType())])
    for day, slot in enumerate((3, 1, 4, 2), 1):
        rows = model.inventory.where(f"id % 10 = {slot}")
        rows.write.parquet(f"{folder}/arrived_on=2001-07-0{day}")
        arrivals = spark.read.schema(layout).parquet(folder)
        fresh = plan_of(table.unread(arrivals, "arrived_on"))
        version = refresh_latest_inventory(table, arrivals)
        assert version.mark == f"2001-07-0{day}"
        if day > 1:  # the partitions before the mark are not in the scan
            assert f"arrived_on#" in fresh and re.search(r"PartitionFilters: \[isnotnull\(arrived_on#\d+\), \(arrived_on#\d+ > 2001-07-0", fresh)
            only = table.unread(arrivals, "arrived_on", VersionedTable(spark, table.root, INVENTORY, table.part).versions()[-2])
            assert {row[0].day for row in only.select("arrived_on").distinct().collect()} == {day}
        full = latest_inventory(arrivals.drop("arrived_on"))
        assert table.rows().exceptAll(full).count() == 0 and table.rows().count() == full.count()
    before = table.head()
    assert refresh_latest_inventory(table, arrivals).number == before.number  # nothing new


def test_a_refresh_stops_at_the_partition_it_is_told(spark, model, tmp_path):
    folder = f"{tmp_path}/arrivals"
    for day in (1, 2):
        model.inventory.where(f"id % 10 = {day}").write.parquet(f"{folder}/arrived_on=2001-07-0{day}")
    layout = T.StructType([*INVENTORY.fields, T.StructField("arrived_on", T.DateType())])
    arrivals = spark.read.schema(layout).parquet(folder)
    table = VersionedTable(spark, f"{tmp_path}/newest", INVENTORY, key_bucket(4))
    refresh_latest_inventory(table, arrivals, through=date(2001, 7, 1))
    assert {row.id % 10 for row in table.rows().collect()} == {1}
    refresh_latest_inventory(table, arrivals, through=date(2001, 7, 2))
    assert {row.id % 10 for row in table.rows().collect()} >= {2}


def test_windows_open_only_the_months_they_span(spark, tmp_path):
    assert months_of(date(2023, 11, 30), date(2024, 2, 1)) == ["2023-12", "2024-01", "2024-02"]
    assert months_of(date(2024, 1, 30), date(2024, 1, 31)) == ["2024-01"]
    layout = T.StructType.fromDDL("k string, sold_on date, units int, amount decimal(22,2)")
    daily = VersionedTable(spark, f"{tmp_path}/daily", layout, "date_format(sold_on, 'yyyy-MM')")
    days = spark.sql("SELECT 'k' AS k, explode(sequence(date'2023-01-01', date'2024-12-31')) AS sold_on, 1 AS units, cast(2 AS decimal(22,2)) AS amount")
    daily.replace(days)
    windows = trailing_sales_of_days(daily, ["k"], [date(2024, 3, 5), date(2024, 3, 20)])
    assert len(windows.inputFiles()) == 2  # February and March
    assert [(r.sales_units_1d, r.sales_units_30d, float(r.sales_amount_7d)) for r in windows.collect()] == [(1, 30, 14.0)] * 2


# Status changes ----------------------------------------------------------------------------------------------------------


def updates(spark, *rows):
    return spark.createDataFrame([(t, s, "u", "n", datetime(2024, 1, d)) for t, s, d in rows], STATUS_UPDATES)


def test_status_changes_fold_into_the_parts_of_their_tasks(spark, model, tmp_path):
    tasks = model.tasks
    table = TaskTable(spark, f"{tmp_path}/tasks", fold_every=2)
    table.replace(tasks)
    ids = [row.task_id for row in tasks.select("task_id").orderBy("task_id").limit(6).collect()]
    first = table.log.table.head()
    table.change(updates(spark, (ids[0], "resolved", 5), (ids[1], "ignored", 5), ("unknown", "resolved", 5)))
    assert table.statuses().where("NOT is_known").count() == 1
    table.change(updates(spark, (ids[0], "ignored", 6), (ids[2], "resolved", 6)))
    table.change(updates(spark, (ids[1], "resolved", 4), (ids[0], "pending", 7)))  # the first comes too late
    assert table.log.pending() == [2]
    second = table.log.table.head()
    changed = {part for part in second.folders if second.folders[part] != first.folders[part]}
    assert changed == {i[:2] for i in ids[:3]}
    now = {row.task_id: (row.task_status, row.resolved_at.day if row.resolved_at else None) for row in table.tasks().collect()}
    assert [now[i] for i in ids[:4]] == [("pending", 7), ("ignored", 5), ("resolved", 6), ("pending", None)]
    assert len(now) == tasks.count()
    others = table.tasks().where(~F.col("task_id").isin(ids[:3]))
    assert others.exceptAll(tasks).count() == 0
    table.replace(tasks)  # a new run: its tasks are pending again
    assert table.tasks().exceptAll(tasks).count() == 0


def test_a_status_list_shuffles_ids_and_statuses_only(spark, model):
    frame = catalog.queries()["apply_status_updates"](spark, SMALL)
    exchanged = [line for line in plan_of(frame).splitlines() if "Exchange hashpartitioning(task_id" in line]
    assert len(exchanged) == 2 and "SortMergeJoin" in plan_of(frame)
    assert "task_description" not in plan_of(frame) and "action_reason" not in plan_of(frame)


# Source tables -------------------------------------------------------------------------------------------------------------


def test_full_refresh_and_upsert_of_stored_products(spark, model, tmp_path):
    table = source_tables(spark, f"{tmp_path}/sources", buckets=16)["product_master"]
    full_refresh(model.products.drop("purchase_cost").withColumn("current_price", F.lit("n/a")), table, "product_master")
    assert {(row.current_price, row.purchase_cost) for row in table.rows().collect()} == {(0, 0)}
    table.replace(model.products)
    one = model.products.where("id = 7").withColumn("product_name", F.lit("changed"))
    before = table.head()
    upsert_into(table, one)
    after = table.head()
    assert sum(before.folders[p] != after.folders[p] for p in after.folders) == 1
    assert table.rows().schema == PRODUCTS
    assert {row.id for row in table.rows().exceptAll(model.products).collect()} == {7}
    assert table.rows().count() == model.products.count()


def test_superseded_attempts_are_removed(spark, model, tmp_path):
    out = f"{tmp_path}/results"
    for _ in range(2):
        pipeline.publish(out, "b1", oh.CREATED_AT, {"analysis": model.stored, "tasks": model.tasks})
    pipeline.publish(out, "b0", oh.PRIOR_CREATED_AT, {"analysis": model.prior_stored, "tasks": model.tasks.limit(3)})
    model.tasks.drop("analysis_batch_id").write.parquet(f"{out}/tasks/analysis_batch_id=b1/attempt=lost")
    model.tasks.drop("analysis_batch_id").write.parquet(f"{out}/tasks/analysis_batch_id=b1/attempt=now")
    before = [sorted(map(repr, frame.collect())) for frame in pipeline.read_results(spark, out)]
    gone = pipeline.remove_superseded(spark, out, running={"now"})
    assert len(gone) == 3 and any("attempt=lost" in folder for folder in gone)
    assert [sorted(map(repr, frame.collect())) for frame in pipeline.read_results(spark, out)] == before
    assert len(folders_below(spark, f"{out}/tasks/analysis_batch_id=b1")) == 2
    assert pipeline.remove_superseded(spark, out, running={"now"}) == []
