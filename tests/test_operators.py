"""Sources, sinks, latest rows, status changes and reports on small fixtures with known answers."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from places import SMALL
from pyspark.sql import functions as F

from stockrisk.operators.latest import latest_inventory, latest_per_key
from stockrisk.operators.measures import trailing_sales
from stockrisk.operators.tasks import apply_status_updates
from stockrisk.plans import catalog, pipeline, reports
from stockrisk.schemas import CONFIGS, INVENTORY, PRODUCTS, SOURCE_TABLES, STATUS_UPDATES, STORED_TASKS
from stockrisk.sources.align import align_to
from stockrisk.sources import order_history as oh
from stockrisk.sources import tables


def test_latest_per_key_with_a_hot_key(spark):
    """One key holds half of all rows; every key still gives exactly its newest row."""
    rows = spark.range(20_000).selectExpr(
        "id",
        "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('k', id % 500) END AS key",
        "cast(id % 97 AS int) AS at",
    )
    newest = latest_per_key(rows, ["key"], [F.desc("at"), F.desc("id")])
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
    expected: dict[str, tuple] = {}
    for number in range(20_000):
        key = "hot" if number % 2 == 0 else f"k{number % 500}"
        expected[key] = max(expected.get(key, (-1, -1)), (number % 97, number))
    assert {r.key: (r.at, r.id) for r in newest.collect()} == expected


def test_trailing_sales_against_brute_force(spark):
    rng = random.Random(3)
    end = date(2024, 3, 31)
    lines = [
        ("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 20)}", end - timedelta(days=rng.randint(-3, 45)),
         rng.randint(1, 9), rng.randint(1, 900) / 100)
        for _ in range(3000)
    ]
    frame = spark.createDataFrame(lines, "key string, sold_on date, units int, amount double").withColumn(
        "amount", F.col("amount").cast("decimal(12,2)")
    )
    ends = [end - timedelta(days=7), end]
    rows = trailing_sales(frame, ["key"], ends).collect()
    assert len(rows) == len({(r.key, r.stat_date) for r in rows})
    for r in rows:
        for n in (1, 3, 7, 14, 30):
            inside = [u for k, d, u, _ in lines if k == r.key and r.stat_date - timedelta(days=n) < d <= r.stat_date]
            assert r[f"sales_units_{n}d"] == sum(inside)
        amounts = [a for k, d, _, a in lines if k == r.key and r.stat_date - timedelta(days=7) < d <= r.stat_date]
        assert float(r.sales_amount_7d) == pytest.approx(sum(amounts), abs=1e-6)


def test_coerce_columns_cleans_bad_cells(spark):
    raw = spark.createDataFrame(
        [("1", "12", "x", "2024-01-05 10:00:00", "SKU-1"), ("2", None, " 7 ", "bad", None), ("3", "nan", "2.6", None, "S")],
        "id string, total_quantity string, fulfillable_quantity string, sync_time string, seller_sku string",
    )
    rows = tables.coerce_columns(raw, "inventory_snapshot").orderBy("id").collect()
    assert [(r.id, r.total_quantity, r.fulfillable_quantity) for r in rows] == [(1, 12, 0), (2, 0, 7), (3, 0, 3)]
    assert [r.sync_time for r in rows] == [datetime(2024, 1, 5, 10), None, None]
    assert [r.seller_sku for r in rows] == ["SKU-1", None, "S"]


def test_csv_import_and_full_refresh(spark, tmp_path):
    model = catalog.model(spark, SMALL)
    source = model.configs
    source.write.option("header", True).csv(f"{tmp_path}/configs.csv")
    raw = tables.read_raw_csv(spark, f"{tmp_path}/configs.csv", source.columns)
    for _ in range(2):
        pipeline.import_tables({"replenishment_config": raw}, f"{tmp_path}/tables")
    stored = tables.read_table(spark, f"{tmp_path}/tables/replenishment_config", CONFIGS)
    assert stored.count() == source.count()
    # Empty cells of measured columns become 0 on import.
    columns = [F.coalesce(F.col(n), F.lit(0)).alias(n) if n in ("moq", "carton_quantity", "max_stock_days", "case_pack_quantity") else F.col(n) for n in source.columns]
    assert stored.exceptAll(source.select(columns)).count() == 0


def test_ensure_columns_and_align(spark):
    old = spark.createDataFrame([("a", 5)], "seller_sku string, moq int")
    row = tables.ensure_columns(old, "replenishment_config").first()
    assert (row.moq, row.target_cover_days, row.safety_stock_days) == (5, 45, 7)
    aligned = align_to(old, CONFIGS)
    assert aligned.columns == CONFIGS.names and aligned.first().moq == 5
    assert aligned.first().supplier_name is None


def test_upsert_takes_the_newest_incoming_row(spark):
    def products(rows):
        frame = spark.createDataFrame(rows, "id long, seller_id string, marketplace_id string, seller_sku string, product_name string, updated_at timestamp_ntz")
        return frame.to(PRODUCTS)

    t = datetime(2024, 1, 1)
    current = products([(1, "s", "m", "A", "old", t + timedelta(days=9)), (2, "s", "m", "B", "kept", t)])
    incoming = products(
        [(3, "s", "m", "A", "first", t), (4, "s", "m", "A", "second", t + timedelta(days=1)), (5, "s", "m", "C", "new", t)]
    )
    merged = tables.upsert_products(current, incoming)
    assert {(r.seller_sku, r.product_name) for r in merged.collect()} == {("A", "second"), ("B", "kept"), ("C", "new")}


def test_status_updates_against_brute_force(spark):
    rng = random.Random(5)
    tasks = spark.createDataFrame([(f"t{i}", "pending") for i in range(50)], "task_id string, task_status string")
    tasks = tasks.to(STORED_TASKS)
    start = datetime(2024, 1, 1)
    updates = [
        ("t7" if rng.random() < 0.4 else f"t{rng.randint(0, 80)}", rng.choice(["resolved", "ignored"]),
         rng.choice([None, "op"]), f"note {i}", start + timedelta(minutes=i))
        for i in range(400)
    ]
    rng.shuffle(updates)
    frame = spark.createDataFrame(updates, STATUS_UPDATES)
    after, rejected = apply_status_updates(tasks, frame)
    newest = {}
    for update in updates:
        if update[0] not in newest or update[4] > newest[update[0]][4]:
            newest[update[0]] = update
    rows = {r.task_id: r for r in after.collect()}
    assert len(rows) == 50
    for task_id, row in rows.items():
        expected = newest.get(task_id, (task_id, "pending", None, None, None))
        assert (row.task_status, row.operator_id, row.operator_note, row.resolved_at) == expected[1:]
    assert {r.task_id for r in rejected.collect()} == {k for k in newest if int(k[1:]) >= 50}


def test_run_is_idempotent_and_keeps_other_batches(spark, tmp_path):
    model = catalog.model(spark, SMALL)
    sources = pipeline.Sources(model.products, model.inventory, model.sales, model.configs)
    out = str(tmp_path / "results")
    first = pipeline.run_analysis(sources, out, oh.BATCH_ID, oh.AS_OF, oh.CREATED_AT).first().asDict()
    assert first["analyzed_skus"] == 196 and first["generated_tasks"] == 365
    analysis, tasks = pipeline.read_results(spark, out)
    before = sorted(map(repr, tasks.collect()))
    other = pipeline.run_analysis(sources, out, "batch-2", oh.AS_OF, oh.CREATED_AT).first().asDict()
    again = pipeline.run_analysis(sources, out, oh.BATCH_ID, oh.AS_OF, oh.CREATED_AT).first().asDict()
    assert first == again == other
    analysis, tasks = pipeline.read_results(spark, out)
    assert analysis.count() == 2 * 196
    assert sorted(map(repr, tasks.filter(F.col("analysis_batch_id") == oh.BATCH_ID).collect())) == before
    # A batch that has become empty is emptied, not left over.
    empty = pipeline.Sources(model.products.limit(0), model.inventory, model.sales, model.configs)
    counts = pipeline.run_analysis(empty, out, "batch-2", oh.AS_OF, oh.CREATED_AT).first().asDict()
    assert counts["analyzed_skus"] == 0 and counts["generated_tasks"] == 0
    with pytest.raises(ValueError):
        tables.write_attempt(tasks, out, "../elsewhere", "a")


def test_readers_see_a_batch_only_when_it_is_published(spark, tmp_path):
    model = catalog.model(spark, SMALL)
    sources = pipeline.Sources(model.products, model.inventory, model.sales, model.configs)
    out = str(tmp_path / "results")
    pipeline.run_analysis(sources, out, "batch-1", oh.AS_OF, oh.CREATED_AT)
    before = [sorted(map(repr, frame.collect())) for frame in pipeline.read_current(spark, out)]
    # A newer run that fails between its tables.
    with pytest.raises(Exception, match="division|DIVIDE"):
        bad = model.tasks.withColumn("task_order", F.expr("cast(1 / (task_order - task_order) AS int)"))
        later = oh.CREATED_AT + timedelta(days=1)
        pipeline.publish(out, "batch-2", later, {"analysis": model.stored, "tasks": bad})
    assert [sorted(map(repr, frame.collect())) for frame in pipeline.read_current(spark, out)] == before
    # The newest batch only, and only its folder.
    pipeline.publish(out, "batch-2", later, {"analysis": model.stored.limit(5), "tasks": model.tasks.limit(3)})
    analysis, tasks = pipeline.read_current(spark, out)
    assert (analysis.count(), tasks.count()) == (5, 3)
    assert all("batch-2" in name for name in analysis.inputFiles())
    assert pipeline.read_results(spark, out)[0].count() == 196 + 5


def test_sources_round_trip_as_parquet(spark, tmp_path):
    model = catalog.model(spark, SMALL)
    frames = dict(zip(SOURCE_TABLES, (model.products, model.inventory, model.sales, model.configs), strict=True))
    for name, frame in frames.items():
        tables.replace_table(frame, f"{tmp_path}/{name}")
    facts = pipeline.Sources.read(spark, str(tmp_path)).facts()
    assert facts.exceptAll(model.facts).count() == 0 and facts.count() == 196


def test_search_text_keeps_wildcards_and_ignores_case(spark):
    names = spark.createDataFrame([("SKU-10",), ("SKU-1X",), ("sku-21",), ("SKU-1",)], "seller_sku string")

    def found(text):
        return sorted(r.seller_sku for r in reports.filtered(names, {}, text).collect())

    assert found("sku-1_") == ["SKU-10", "SKU-1X"]
    assert found("1") == ["SKU-1", "SKU-10", "SKU-1X", "sku-21"]
    assert found("K%1") == ["SKU-1", "SKU-10", "SKU-1X", "sku-21"]


def test_pages_follow_each_other(spark):
    rows = spark.range(200).selectExpr("concat('k', id % 3) AS a", "id AS b")
    whole = [tuple(r) for r in rows.orderBy("a", "b").collect()]
    assert [tuple(r) for r in reports.page(rows, ["a", "b"], 20, 40).collect()] == whole[40:60]
    after = reports.page_after(rows, ["a", "b"], whole[39], 20)
    assert [tuple(r) for r in after.collect()] == whole[40:60]


def test_dashboard_defaults_for_missing_columns(spark):
    model = catalog.model(spark, SMALL)
    analysis = model.stored.drop("estimated_lost_revenue", "decision_confidence")
    tasks = model.tasks.drop("impact_level")
    row = reports.dashboard_summary(model.products, analysis, tasks).first()
    assert (row.estimated_lost_revenue_total, row.high_impact_task_count) == (0, 0)
    assert row.avg_decision_confidence is None and row.stockout_risk_score_avg is not None
    empty = reports.dashboard_summary(model.products, model.stored.limit(0), model.tasks.limit(0)).first()
    assert (empty.critical_stockout_count, empty.total_tasks, empty.estimated_lost_revenue_total) == (0, 0, 0)
    assert empty.avg_decision_confidence is None


def test_latest_inventory_prefers_the_later_id_on_a_tie(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "s", "m", "A", 5, t), (2, "s", "m", "A", 6, t), (3, "s", "m", "A", 7, t - timedelta(days=1))]
    frame = spark.createDataFrame(
        rows, "id long, seller_id string, marketplace_id string, seller_sku string, total_quantity int, sync_time timestamp_ntz"
    ).to(INVENTORY)
    assert latest_inventory(frame).first().id == 2


def test_limits(spark):
    """Any positive limit works; a long list is the whole table in the same order."""
    model = catalog.model(spark, SMALL)
    with pytest.raises(ValueError):
        reports.open_tasks(model.tasks, 0)
    rows = reports.top_risk_skus(model.stored, model.products, model.sales, model.configs, 10**6).collect()
    first = reports.top_risk_skus(model.stored, model.products, model.sales, model.configs, 7).collect()
    assert len(rows) == 196 and rows[:7] == first
