"""Named queries over the order-history tables: one per operator, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date
from functools import cached_property, lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockrisk.functions import measures, rules
from stockrisk.operators import insights
from stockrisk.operators import measures as measure_jobs
from stockrisk.operators.analysis import analyse, evaluate_rules, stored_analysis
from stockrisk.operators.facts import (
    active_products,
    analysis_lineage,
    enriched_analysis,
    sales_values,
    config_values,
    sku_facts,
)
from stockrisk.operators.latest import latest_inventory, latest_sales, refresh_latest_inventory, refresh_latest_sales
from stockrisk.operators.tasks import (
    TaskTable,
    approval_level,
    generate_tasks,
    impact_level,
    overstock_value,
    priority,
    with_status_changes,
)
from stockrisk.plans import context, reports
from stockrisk.schemas import INVENTORY, KEY, LATER_COLUMNS, SALES
from stockrisk.session import shared_folder, written
from stockrisk.sources import order_history as oh
from stockrisk.sources.keyed import write_keyed
from stockrisk.sources.tables import (
    coerce_columns,
    ensure_columns,
    full_refresh,
    source_tables,
    upsert_into,
    upsert_products,
)
from stockrisk.sources.versions import VersionedTable, key_bucket
from stockrisk.streaming import jobs
from stockrisk.plans.pipeline import publish, read_current, read_results

Query = Callable[[SparkSession, str], DataFrame]
SEARCH = "ku-1"  # SKU search text of the list queries; letter case does not matter
ONE_SKU = "SKU-12"
KEYED_BUCKETS = 8  # at least
KEYED_ROWS = 20_000  # products in a bucket of the keyed tables


class Model:
    """Lazy frames of the inventory model; holds plans, no data."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return oh.raw_table(self.spark, self.folder, name)

    @cached_property
    def products(self) -> DataFrame:
        return oh.products(self.spark, self.folder)

    @cached_property
    def inventory(self) -> DataFrame:
        return oh.inventory_snapshots(self.spark, self.folder)

    @cached_property
    def sales(self) -> DataFrame:
        return oh.sales_summaries(self.spark, self.folder)

    @cached_property
    def configs(self) -> DataFrame:
        return oh.replenishment_configs(self.spark, self.folder)

    @cached_property
    def facts(self) -> DataFrame:
        return sku_facts(self.products, self.inventory, self.sales, self.configs)

    @cached_property
    def rule_rows(self) -> DataFrame:
        return evaluate_rules(self.facts, oh.AS_OF)

    @cached_property
    def analysis(self) -> DataFrame:
        return analyse(self.facts, oh.BATCH_ID, oh.AS_OF)

    @cached_property
    def stored(self) -> DataFrame:
        return stored_analysis(self.analysis, oh.CREATED_AT)

    @cached_property
    def tasks(self) -> DataFrame:
        return generate_tasks(self.analysis, oh.CREATED_AT)

    @cached_property
    def prior_analysis(self) -> DataFrame:
        """Analysis of the batch one week earlier, on the data known then."""
        inventory = oh.inventory_snapshots(self.spark, self.folder, oh.PRIOR_AS_OF)
        sales = oh.sales_summaries(self.spark, self.folder, oh.PRIOR_AS_OF)
        facts = sku_facts(self.products, inventory, sales, self.configs)
        return analyse(facts, oh.PRIOR_BATCH_ID, oh.PRIOR_AS_OF)

    @cached_property
    def prior_stored(self) -> DataFrame:
        return stored_analysis(self.prior_analysis, oh.PRIOR_CREATED_AT)

    @property
    def both_batches(self) -> DataFrame:
        return self.stored.unionByName(self.prior_stored)

    @cached_property
    def published(self) -> str:
        """Folder with two published batches of unequal data: this one and that of the week before."""
        out = shared_folder(self.spark, "results")
        for rows, batch, at in (
            (self.analysis, oh.BATCH_ID, oh.CREATED_AT),
            (self.prior_analysis, oh.PRIOR_BATCH_ID, oh.PRIOR_CREATED_AT),
        ):
            kept = written(rows, "analysis")
            publish(out, batch, at, {"analysis": stored_analysis(kept, at), "tasks": generate_tasks(kept, at)})
        return out

    @cached_property
    def keyed(self) -> dict[str, DataFrame]:
        """The source tables and the results of both batches as keyed tables.

        The number of their buckets follows the products, so that a task's share does not grow with the tables.
        """
        buckets = max(KEYED_BUCKETS, -(-self.products.count() // KEYED_ROWS))
        rows = written(self.analysis, "analysis")
        analysis = written(stored_analysis(rows, oh.CREATED_AT).unionByName(self.prior_stored), "stored-analysis")
        newest = analysis.where(F.col("analysis_batch_id") == oh.BATCH_ID)
        frames = {
            "products": self.products,
            "sales": self.sales,
            "configs": self.configs,
            "analysis": newest,
            "history": analysis,
            "tasks": generate_tasks(rows, oh.CREATED_AT),
        }
        name = f"keyed_{uuid.uuid4().hex}"
        return {
            key: write_keyed(frame, f"{name}_{key}", buckets, shared_folder(self.spark, f"keyed-{key}"))
            for key, frame in frames.items()
        }

    def current(self) -> tuple[DataFrame, DataFrame]:
        return read_current(self.spark, self.published)

    def written_results(self) -> tuple[DataFrame, DataFrame]:
        """Analysis and task tables over one written copy of the analysis rows, for reports that read them often."""
        rows = written(self.analysis, "analysis")
        return stored_analysis(rows, oh.CREATED_AT), generate_tasks(rows, oh.CREATED_AT)


@lru_cache(maxsize=8)
def model(spark: SparkSession, folder: str) -> Model:
    return Model(spark, folder.rstrip("/"))


QUERIES: dict[str, Callable[[Model], DataFrame]] = {}


def query(function: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def portable(df: DataFrame) -> DataFrame:
    """Decimals as doubles and text lists joined by ``|``, so that other engines can show the same values."""
    columns = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DecimalType):
            columns.append(f"cast({field.name} AS double) AS {field.name}")
        elif isinstance(field.dataType, T.ArrayType):
            columns.append(f"array_join({field.name}, '|') AS {field.name}")
        else:
            columns.append(field.name)
    return df.selectExpr(*columns)


# Sources -----------------------------------------------------------------------------------------------------------


@query
def source_scan(m: Model) -> DataFrame:
    return m.products.select(
        *KEY, "id", "asin", "product_name", "brand", "current_price", "purchase_cost", "landed_cost", "gross_margin"
    )


@query
def coerce_columns_(m: Model) -> DataFrame:
    texts = m.inventory.selectExpr(
        "id",
        *KEY,
        "CASE WHEN id % 11 = 0 THEN 'n/a' ELSE cast(total_quantity AS string) END AS total_quantity",
        "CASE WHEN id % 3 = 0 THEN NULL ELSE concat(' ', fulfillable_quantity, ' ') END AS fulfillable_quantity",
        "CASE WHEN id % 13 = 0 THEN 'soon' ELSE cast(sync_time AS string) END AS sync_time",
        "CASE WHEN id % 5 = 0 THEN double('NaN') ELSE 0.5D END AS note",
    )
    return coerce_columns(texts, "inventory_snapshot")


@query
def active_products_(m: Model) -> DataFrame:
    rows = active_products(m.products).select(*KEY, "id", "asin", "current_price")
    return rows.orderBy("seller_sku", "seller_id", "marketplace_id")


@query
def latest_inventory_(m: Model) -> DataFrame:
    return latest_inventory(m.inventory).select(
        *KEY, "id", "sync_time", "sync_batch_id", "fulfillable_quantity", "total_quantity"
    )


@query
def latest_sales_(m: Model) -> DataFrame:
    return latest_sales(m.sales).select(
        *KEY, "id", "stat_date", "sales_7d", "sales_30d", "sales_amount_7d", "sales_amount_30d", "sales_trend"
    )


@query
def config_scan(m: Model) -> DataFrame:
    return m.configs.select(
        *KEY,
        "id",
        "total_replenishment_days",
        "safety_stock_days",
        "target_cover_days",
        "carton_quantity",
        "moq",
        "config_status",
    )


def _legacy(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source tables as they were before later columns came."""
    return (
        m.products.drop("current_price", "landed_cost", "gross_margin"),
        m.sales.drop("sales_7d", "sales_30d", "sales_trend_rate"),
        m.configs.drop("total_replenishment_lead_time_days", "target_cover_days", "moq"),
    )


@query
def project_with_defaults(m: Model) -> DataFrame:
    rows = enriched_analysis(m.stored.drop("decision_confidence"), *_legacy(m))
    return rows.select(
        *KEY,
        "current_price",
        "landed_cost",
        "gross_margin",
        "sales_7d",
        "sales_30d",
        "sales_trend",
        "sales_trend_rate",
        "total_replenishment_lead_time_days",
        "target_cover_days",
        "moq",
        "decision_confidence",
    )


@query
def ensure_columns_(m: Model) -> DataFrame:
    names = list(LATER_COLUMNS["replenishment_config"])
    old = m.configs.drop("target_cover_days", "moq")
    return ensure_columns(old, "replenishment_config").select(*KEY, *names)


def _product_changes(m: Model) -> DataFrame:
    changed = m.products.filter("id % 10 = 0").withColumn(
        "current_price", F.expr("cast(current_price + 1 AS decimal(10,2))")
    )
    added = m.products.filter("id % 100 = 1").withColumns(
        {"id": F.col("id") + 1_000_000_000, "seller_sku": F.concat("seller_sku", F.lit("-B"))}
    )
    return changed.unionByName(added)


@query
def product_upsert(m: Model) -> DataFrame:
    return upsert_products(m.products, _product_changes(m)).select(*KEY, "id", "asin", "current_price")


@query
def stored_product_upsert(m: Model) -> DataFrame:
    """The same written back to the table that holds the products, twice: the second time changes nothing."""
    table = source_tables(m.spark, shared_folder(m.spark, "sources"), buckets=8)["product_master"]
    table.replace(m.products)
    incoming = written(_product_changes(m), "incoming")
    for _ in range(2):
        upsert_into(table, incoming)
    return table.rows().select(*KEY, "id", "asin", "current_price")


@query
def stored_full_refresh(m: Model) -> DataFrame:
    """Rows of the four stored source tables after two refreshes from raw texts, the first with half of the rows."""
    tables = source_tables(m.spark, shared_folder(m.spark, "sources"), buckets=8)
    frames = (m.products, m.inventory, m.sales, m.configs)
    counts = []
    for (name, table), frame in zip(tables.items(), frames):
        raw = written(frame.selectExpr(*[f"cast({column} AS string) AS {column}" for column in frame.columns]), "raw")
        full_refresh(raw.where("cast(id AS long) % 2 = 0"), table, name)
        full_refresh(raw, table, name)
        table.vacuum()
        stored = table.rows()
        numbers = f"'{name}' AS table_name", "count(1) AS row_count", "count(DISTINCT id) AS id_count", "sum(id) AS id_sum"
        counts.append(stored.selectExpr(*numbers))
    return reduce(DataFrame.unionByName, counts)


def _arrivals(m: Model, rows: DataFrame) -> DataFrame:
    """A source table stored by day of arrival; a third of the rows arrive on a later day than newer ones."""
    folder = shared_folder(m.spark, "arrivals")
    arrived = "date_add(date'2001-07-01', cast(id % 10 + 6 * pmod(hash(id), 3) AS int) % 4) AS arrived_on"
    rows.selectExpr("*", arrived).write.partitionBy("arrived_on").parquet(folder)
    layout = T.StructType([*rows.schema.fields, T.StructField("arrived_on", T.DateType())])
    return m.spark.read.schema(layout).parquet(folder)


@query
def stored_latest_inventory(m: Model) -> DataFrame:
    """Newest snapshots kept up to date over four days of arrival."""
    table = VersionedTable(m.spark, shared_folder(m.spark, "newest"), INVENTORY, key_bucket(8))
    arrivals = _arrivals(m, m.inventory)
    for day in range(1, 5):
        refresh_latest_inventory(table, arrivals, through=date(2001, 7, day))
    return table.rows().select(*KEY, "id", "sync_time", "sync_batch_id", "fulfillable_quantity", "total_quantity")


@query
def stored_latest_sales(m: Model) -> DataFrame:
    table = VersionedTable(m.spark, shared_folder(m.spark, "newest"), SALES, key_bucket(8))
    arrivals = _arrivals(m, m.sales)
    refresh_latest_sales(table, arrivals, through=date(2001, 7, 2))
    refresh_latest_sales(table, arrivals)
    return table.rows().select(
        *KEY, "id", "stat_date", "sales_7d", "sales_30d", "sales_amount_7d", "sales_amount_30d", "sales_trend"
    )


# Measures ----------------------------------------------------------------------------------------------------------


@query
def stock_position(m: Model) -> DataFrame:
    return measure_jobs.with_stock_total(m.inventory.drop("total_quantity")).select(
        *KEY, "id", "sync_time", "total_quantity"
    )


@query
def sales_windows(m: Model) -> DataFrame:
    return measure_jobs.trailing_sales(
        oh.order_lines(m.spark, m.folder), ["part"], oh.STAT_DATES, oh.MODEL_DAY, oh.SALES_HISTORY_DAYS
    )


PART_DAYS = "part bigint, sold_on date, units double, amount decimal(22,2)"


@query
def sales_windows_of_days(m: Model) -> DataFrame:
    """The same windows out of a stored table of daily totals."""
    daily = VersionedTable(m.spark, shared_folder(m.spark, "daily"), T.StructType.fromDDL(PART_DAYS), jobs.MONTH)
    daily.replace(measure_jobs.daily_totals(oh.order_lines(m.spark, m.folder), ["part"]))
    return measure_jobs.trailing_sales_of_days(daily, ["part"], oh.STAT_DATES, oh.MODEL_DAY, oh.SALES_HISTORY_DAYS)


@query
def avg_daily_sales(m: Model) -> DataFrame:
    return measure_jobs.with_sales_averages(sales_windows(m)).select(
        "part", "stat_date", "avg_daily_sales_3d", "avg_daily_sales_7d", "avg_daily_sales_30d"
    )


@query
def unit_margin(m: Model) -> DataFrame:
    return measure_jobs.with_unit_margin(m.products).select(
        *KEY, "current_price", "landed_cost", "gross_margin"
    )


@query
def lead_time_rollup(m: Model) -> DataFrame:
    stages = m.configs.drop(
        "total_replenishment_days", "total_replenishment_lead_time_days", "reorder_point_days"
    )
    return measure_jobs.with_lead_time(stages).select(
        *KEY, *measures.LEAD_TIME_STAGES, "total_replenishment_days", "reorder_point_days"
    )


@query
def sales_trend(m: Model) -> DataFrame:
    return measure_jobs.with_sales_averages(sales_windows(m)).select(
        "part", "stat_date", "sales_trend", "sales_trend_rate"
    )


# Joins -------------------------------------------------------------------------------------------------------------


@query
def sku_facts_(m: Model) -> DataFrame:
    return m.facts


@query
def first_present(m: Model) -> DataFrame:
    products, sales, configs = _legacy(m)
    rows = sales_values(sales).join(config_values(configs), KEY, "full")
    return rows.select(
        *KEY, "sales_7d", "sales_30d", "sales_trend", "target_cover_days", "total_replenishment_days", "moq"
    )


@query
def enriched_analysis_(m: Model) -> DataFrame:
    return enriched_analysis(m.stored, m.products, m.sales, m.configs)


@query
def analysis_lineage_(m: Model) -> DataFrame:
    analysis, tasks = m.written_results()
    return analysis_lineage(analysis, m.inventory, m.sales, m.configs, tasks)


# Rules -------------------------------------------------------------------------------------------------------------

RULE_COLUMNS = {
    "daily_sales": ["avg_daily_sales_7d", "avg_daily_sales_30d", "daily_sales"],
    "demand_signal": ["demand_signal", "demand_score", "demand_explanation"],
    "cover_days": ["available_days", "total_cover_days", "inbound_cover_days"],
    "effective_inbound": [
        "inbound_shipped_quantity",
        "inbound_receiving_quantity",
        "effective_inbound_quantity",
    ],
    "stockout_date": ["analysis_date", "available_days", "estimated_stockout_date"],
    "stockout_level": ["fulfillable_quantity", "available_days", "stockout_risk_level"],
    "lost_sales": ["estimated_lost_sales_units", "estimated_lost_revenue"],
    "overstock_level": ["total_quantity", "total_cover_days", "overstock_risk_level"],
    "overstock_score": ["overstock_risk_level", "overstock_risk_score"],
    "replenish_qty": [
        "target_days",
        "recommended_replenishment_quantity",
        "recommended_replenishment_days",
        "replenishment_explanation",
    ],
    "decision": [
        "recommended_action",
        "final_risk_level",
        "decision_confidence",
        "decision_approval_required",
        "decision_explanation",
    ],
    "data_quality": ["has_inventory", "has_sales", "has_config", "data_quality_status"],
    "urgency_confidence": ["replenishment_urgency", "confidence_score"],
    "explanations": ["action_reason", "stockout_explanation", "profitability_explanation", "risk_reason"],
}


def _rule_query(columns: list[str]) -> Callable[[Model], DataFrame]:
    return lambda m: m.rule_rows.select(*KEY, *columns)


QUERIES |= {name: _rule_query(columns) for name, columns in RULE_COLUMNS.items()}


@query
def stockout_score(m: Model) -> DataFrame:
    """With an inbound delivery for every second SKU, due in up to 40 days."""
    eta = "CASE WHEN has_inventory AND inventory_snapshot_id % 4 < 2 THEN date_add(date'{}', cast(inventory_snapshot_id DIV 10 % 40 AS int)) END"
    facts = m.facts.withColumn("inbound_eta_date", F.expr(eta.format(oh.AS_OF)))
    return evaluate_rules(facts, oh.AS_OF).select(
        *KEY, "inbound_eta_date", "base_stockout_level", "stockout_risk_level", "stockout_risk_score"
    )


@query
def carton_round(m: Model) -> DataFrame:
    return m.facts.selectExpr(
        *KEY,
        "total_quantity",
        "carton_quantity",
        f"{rules.carton_round('total_quantity', 'carton_quantity')} AS rounded_quantity",
    )


@query
def replenish_qty_basic(m: Model) -> DataFrame:
    missing = rules.missing_quantity(
        "target_cover_days", "avg_daily_sales_30d", "fulfillable_quantity", "effective_inbound_quantity"
    )
    return m.rule_rows.withColumn("missing", F.expr(missing)).selectExpr(
        *KEY, f"{rules.carton_round('missing', 'carton_quantity')} AS recommended_quantity"
    )


@query
def profitability(m: Model) -> DataFrame:
    return m.rule_rows.selectExpr(
        *KEY,
        "profitability_signal",
        "round(effective_margin, 4) AS margin",
        "recommended_replenishment_value",
        "profit_approval_required",
        "profitability_explanation",
    )


@query
def recommended_action(m: Model) -> DataFrame:
    action = rules.recommended_action(
        "stockout_risk_level",
        "overstock_risk_level",
        "recommended_replenishment_quantity",
        "nullif(data_quality_status, 'invalid_sales')",
    )
    return m.rule_rows.selectExpr(*KEY, f"{action} AS recommended_action")


@query
def manual_approval(m: Model) -> DataFrame:
    needed = rules.needs_manual_approval("recommended_action", "recommended_replenishment_quantity")
    return m.rule_rows.selectExpr(*KEY, f"{needed} AS action_needs_approval", "need_manual_approval")


@query
def data_quality_strict(m: Model) -> DataFrame:
    strict = rules.data_quality_strict(
        "has_inventory",
        "has_sales",
        "has_config",
        "avg_daily_sales_7d",
        "avg_daily_sales_30d",
        "sales_30d",
        "total_replenishment_days",
        "target_cover_days",
        "safety_stock_days",
        "config_status",
    )
    return m.facts.selectExpr(*KEY, f"{strict} AS data_quality_status")


@query
def analysis(m: Model) -> DataFrame:
    return m.analysis


# Tasks -------------------------------------------------------------------------------------------------------------


@query
def tasks(m: Model) -> DataFrame:
    return m.tasks


@query
def task_priority(m: Model) -> DataFrame:
    lost = "estimated_lost_revenue"
    return m.rule_rows.selectExpr(
        *KEY, "stockout_risk_level", lost, f"{priority('stockout_risk_level', lost)} AS priority"
    )


@query
def task_impact_approval(m: Model) -> DataFrame:
    lost = "estimated_lost_revenue"
    return m.rule_rows.selectExpr(
        *KEY,
        f"{impact_level(lost)} AS impact_level",
        f"{approval_level('need_manual_approval', lost)} AS approval_level",
    )


@query
def overstock_value_(m: Model) -> DataFrame:
    return m.facts.selectExpr(
        *KEY, f"{overstock_value('total_quantity', 'landed_cost')} AS estimated_overstock_value"
    )


@query
def task_payload(m: Model) -> DataFrame:
    return m.tasks.select("task_id", "action_parameters")


@query
def apply_status_updates_(m: Model) -> DataFrame:
    """Tasks after the changes, followed by the changes without a task."""
    return with_status_changes(m.tasks, oh.status_updates(m.spark, m.folder)).select(*STATUS_COLUMNS)


STATUS_COLUMNS = ["task_id", "task_status", "operator_id", "operator_note", "resolved_at", "is_known"]


@query
def stored_status_overlay(m: Model) -> DataFrame:
    """The same out of a stored task table: changes come in three folders, merged when the tasks are read."""
    table = TaskTable(m.spark, shared_folder(m.spark, "tasks"))
    table.replace(m.tasks)
    updates = written(oh.status_updates(m.spark, m.folder), "updates")
    for third in range(3):
        table.change(updates.where(f"pmod(hash(task_id, updated_at), 3) = {third}"))
    return table.statuses().select(*STATUS_COLUMNS)


@query
def stored_status_folded(m: Model) -> DataFrame:
    """Tasks alone, after every folder of changes but the last is folded into the parts of the table."""
    table = TaskTable(m.spark, shared_folder(m.spark, "tasks"), fold_every=2)
    table.replace(m.tasks)
    updates = written(oh.status_updates(m.spark, m.folder), "updates")
    for third in range(3):
        table.change(updates.where(f"pmod(hash(task_id, updated_at), 3) = {third}"))
    return table.tasks().select(*STATUS_COLUMNS[:-1])


# Reports -----------------------------------------------------------------------------------------------------------


@query
def dashboard_summary(m: Model) -> DataFrame:
    return reports.dashboard_summary(m.products, *m.written_results())


@query
def risk_distribution(m: Model) -> DataFrame:
    return reports.risk_distribution(m.stored)


@query
def top_risk_skus(m: Model) -> DataFrame:
    return reports.top_risk_skus(m.stored, m.products, m.sales, m.configs, 20)


@query
def analysis_list(m: Model) -> DataFrame:
    return reports.analysis_list(
        m.stored, m.products, m.sales, m.configs, stockout_risk_level="high", seller_sku=SEARCH
    )


@query
def analysis_detail(m: Model) -> DataFrame:
    return reports.analysis_detail(m.both_batches, m.products, m.sales, m.configs, ONE_SKU)


@query
def open_tasks(m: Model) -> DataFrame:
    return reports.open_tasks(m.tasks, 50)


@query
def tasks_by_sku(m: Model) -> DataFrame:
    return reports.tasks_by_sku(m.tasks, ONE_SKU)


@query
def task_list(m: Model) -> DataFrame:
    return reports.task_list(m.tasks, priority="P0", task_status="pending", seller_sku=SEARCH)


@query
def run_summary(m: Model) -> DataFrame:
    return reports.run_summary(*m.written_results())


@query
def batch_stats(m: Model) -> DataFrame:
    return reports.batch_stats(m.both_batches)


@query
def task_type_counts(m: Model) -> DataFrame:
    return reports.task_type_counts(m.tasks)


@query
def data_quality_report(m: Model) -> DataFrame:
    return reports.data_quality_report(m.rule_rows)


@query
def pending_today(m: Model) -> DataFrame:
    return reports.pending_on(m.tasks, oh.AS_OF)


@query
def latest_batch(m: Model) -> DataFrame:
    rows = reports.latest_batch(written(m.both_batches, "stored-analysis"))
    return rows.select("analysis_batch_id", *KEY, "stockout_risk_level", "created_at")


@query
def analysis_page(m: Model) -> DataFrame:
    rows = m.stored.select("seller_sku", "seller_id", "marketplace_id", "stockout_risk_level", "available_days")
    return reports.page(rows, ["seller_sku", "seller_id", "marketplace_id"], limit=25, offset=50)


# Reports over published results: two batches are stored, and the newest one counts -----------------------------------


@query
def current_dashboard_summary(m: Model) -> DataFrame:
    return reports.dashboard_summary(m.products, *m.current())


@query
def current_risk_distribution(m: Model) -> DataFrame:
    return reports.risk_distribution(m.current()[0])


@query
def current_top_risk_skus(m: Model) -> DataFrame:
    return reports.top_risk_skus(m.current()[0], m.products, m.sales, m.configs, 20)


@query
def current_open_tasks(m: Model) -> DataFrame:
    return reports.open_tasks(m.current()[1], 50)


@query
def current_insight_groups(m: Model) -> DataFrame:
    return insights.insight_groups(m.current()[1])


@query
def current_explain_context_sku(m: Model) -> DataFrame:
    analysis, tasks = m.current()
    return context.sku_contexts(analysis, m.products, m.sales, m.configs, tasks)


@query
def batch_replace(m: Model) -> DataFrame:
    """Batch counts of the published results, where the older batch was published last."""
    return reports.batch_stats(read_results(m.spark, m.published)[0])


# Reports over keyed tables: lookups reach the scan, joins need no shuffle ------------------------------------------------


def _keyed_sources(m: Model) -> list[DataFrame]:
    return [m.keyed[name] for name in ("products", "sales", "configs")]


@query
def stored_enriched_analysis(m: Model) -> DataFrame:
    return enriched_analysis(m.keyed["analysis"], *_keyed_sources(m))


@query
def stored_top_risk_skus(m: Model) -> DataFrame:
    return reports.top_risk_skus(m.keyed["analysis"], *_keyed_sources(m), 20)


@query
def stored_analysis_list(m: Model) -> DataFrame:
    return reports.analysis_list(m.keyed["analysis"], *_keyed_sources(m), stockout_risk_level="high", seller_sku=SEARCH)


@query
def stored_analysis_detail(m: Model) -> DataFrame:
    return reports.analysis_detail(m.keyed["history"], *_keyed_sources(m), ONE_SKU)


@query
def stored_tasks_by_sku(m: Model) -> DataFrame:
    return reports.tasks_by_sku(m.keyed["tasks"], ONE_SKU)


# Insights ----------------------------------------------------------------------------------------------------------


@query
def insight_groups(m: Model) -> DataFrame:
    return insights.insight_groups(m.tasks)


def _cards(m: Model) -> tuple[DataFrame, DataFrame]:
    """Cards over the open list, and the task table they belong to."""
    analysis, tasks = m.written_results()
    top = reports.top_risk_skus(analysis, m.products, m.sales, m.configs, context.TOP_OF_INSIGHTS)
    cards = insights.insight_cards(reports.open_task_rows(tasks, context.OPEN_OF_INSIGHTS), top)
    return cards, tasks


@query
def insight_cards(m: Model) -> DataFrame:
    return _cards(m)[0]


@query
def insight_cards_of_sellers(m: Model) -> DataFrame:
    """Cards of every seller; all groups that tasks can fall into occur."""
    analysis, tasks = m.written_results()
    return insights.seller_cards(tasks, analysis, size=10, top=context.TOP_OF_INSIGHTS)


@query
def insight_sku_lookup(m: Model) -> DataFrame:
    analysis, tasks = m.written_results()
    members = insights.insight_members(reports.open_task_rows(tasks, context.OPEN_OF_INSIGHTS))
    top = analysis.orderBy(*reports.risk_order()).limit(context.TOP_OF_INSIGHTS)
    return insights.sku_sentences(members, top)


@query
def insight_related_tasks(m: Model) -> DataFrame:
    return insights.related_tasks(*_cards(m)).select("insight_id", "task_id", "seller_sku", "task_type", "priority")


def _insights_and_tasks(m: Model) -> tuple[DataFrame, DataFrame]:
    """Cards and an insight that names unknown tasks only, with the related tasks."""
    cards, tasks = _cards(m)
    unknown = m.spark.sql("SELECT 'no_tasks' AS id, array('none') AS related_skus, array('none') AS related_task_ids")
    listed = written(cards.select("id", "related_skus", "related_task_ids").unionByName(unknown), "insights")
    return listed, insights.related_tasks(listed, tasks)


@query
def insight_rollup(m: Model) -> DataFrame:
    return insights.insight_rollup(*_insights_and_tasks(m))


@query
def insight_first_value(m: Model) -> DataFrame:
    return insights.insight_first_value(*_insights_and_tasks(m))


def sku_replies(tasks: DataFrame) -> DataFrame:
    """Model replies as test input: one per SKU, with an insight per problem group of its tasks.

    By reply number the text is plain, fenced, led in by prose or cut off, and some fields are missing or odd.
    """
    number = "cast(substr(seller_sku, 5) AS bigint)"
    grouped = (
        insights.classified(tasks)
        .withColumn("reply_id", F.expr(number))
        .groupBy("reply_id", "seller_sku", "insight_id")
        .agg(F.expr("array_sort(collect_list(task_id))").alias("ids"))
    )
    item = """named_struct(
        'id', CASE WHEN reply_id % 3 <> 0 THEN insight_id END,
        'title', CASE WHEN reply_id % 5 <> 0 THEN concat('Risk: ', insight_id, '!') END,
        'affected_sku_count', CASE WHEN reply_id % 7 = 0 THEN 'many' ELSE '1' END,
        'task_count', size(ids),
        'related_skus', array(seller_sku, ' ', NULL),
        'related_task_ids', ids)"""
    listed = grouped.groupBy("reply_id").agg(
        F.expr(f"array_sort(collect_list(struct(insight_id, {item} AS item)))").alias("placed")
    )
    json = "to_json(named_struct('insights', transform(placed, x -> x.item)))"
    return listed.withColumn("json", F.expr(json)).selectExpr(
        "reply_id",
        r"""CASE reply_id % 4
            WHEN 0 THEN json
            WHEN 1 THEN concat('```json\n', json, '\n```')
            WHEN 2 THEN concat('Here is the result:\n', json, '\nDone.')
            ELSE substr(json, 1, length(json) - 2) END AS raw_text""",
    )


@query
def insight_json_parse(m: Model) -> DataFrame:
    return insights.parse_insight_replies(sku_replies(m.tasks))


@query
def insight_json_repair(m: Model) -> DataFrame:
    """Replies that no JSON reader takes as they are: bare NaN and Infinity beside the same words in texts with quotes and
    backslashes, and keys that are given twice."""
    counted = m.tasks.groupBy("seller_sku").agg(F.count(F.lit(1)).alias("n"))
    quoted = r"""concat('"', seller_sku, r', NaN, \"\\\", -Infinity"')"""
    texts = counted.selectExpr(
        "cast(substr(seller_sku, 5) AS bigint) AS reply_id",
        f"""concat('{{"insights":[1], "insights":[{{"title":"first", "id":"nan_infinity", "summary":"[NaN]", "title":', {quoted},
            ', "affected_sku_count": -Infinity, "task_count":NaN, "task_count":', n, ', "risk_points":[], "solution":NaN,
            "related_skus":["', seller_sku, '"]}}]}}') AS raw_text""",
    )
    return insights.parse_insight_replies(texts)


@query
def explain_context(m: Model) -> DataFrame:
    analysis, tasks = m.written_results()
    return context.overview_contexts(m.products, analysis, tasks, m.sales, m.configs)


@query
def explain_context_sku(m: Model) -> DataFrame:
    analysis, tasks = m.written_results()
    return context.sku_contexts(analysis, m.products, m.sales, m.configs, tasks)


# Streams -----------------------------------------------------------------------------------------------------------


@query
def stream_sales_daily(m: Model) -> DataFrame:
    folder = shared_folder(m.spark, "sales-daily")
    events = (
        m.spark.readStream.schema(oh.RAW_TABLES["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(m.folder)
    )
    log = jobs.daily_sales_log(m.spark, folder)
    jobs.stream_sales_daily(oh.purchases(events, m.raw("part")), log, f"{folder}/checkpoint").awaitTermination()
    return log.current()


def _stream(m: Model, name: str, rows: DataFrame, files: int | None = None) -> DataFrame:
    """A table as a stream of files, all at once or some at a time."""
    folder = shared_folder(m.spark, name)
    (rows.repartition(files) if files else rows).write.parquet(folder)
    reader = m.spark.readStream.schema(rows.schema)
    return (reader.option("maxFilesPerTrigger", 1) if files else reader).parquet(folder)


@query
def stream_latest_inventory(m: Model) -> DataFrame:
    folder = shared_folder(m.spark, "latest-inventory")
    log = jobs.inventory_log(m.spark, folder, buckets=4)
    stream = _stream(m, "snapshots", m.inventory, files=5)
    jobs.stream_latest_inventory(stream, log, f"{folder}/checkpoint", fold_every=2).awaitTermination()
    return log.current().select(*KEY, "id", "sync_time", "sync_batch_id", "fulfillable_quantity", "total_quantity")


def _alerts(m: Model) -> jobs.FoldedLog:
    folder = shared_folder(m.spark, "stockout-alerts")
    log = jobs.alert_log(m.spark, folder, buckets=4)
    jobs.stream_stockout_alerts(
        _stream(m, "products", m.products),
        _stream(m, "snapshots", m.inventory),
        _stream(m, "sales", m.sales),
        _stream(m, "configs", m.configs),
        log,
        f"{folder}/checkpoint",
        oh.BATCH_ID,
        oh.AS_OF,
        oh.CREATED_AT,
    ).awaitTermination()
    return log


ALERT_COLUMNS = ["task_id", *KEY, "task_title", "priority", "risk_level", "estimated_impact_value"]


@query
def stream_stockout_alerts(m: Model) -> DataFrame:
    return jobs.current_alerts(_alerts(m)).select(*ALERT_COLUMNS)


@query
def stream_raised_alerts(m: Model) -> DataFrame:
    """Alerts raised by a run over all data, each once, read back from the table of raised alerts."""
    folder = shared_folder(m.spark, "raised-alerts")
    jobs.stream_raised_alerts(_alerts(m), f"{folder}/raised", f"{folder}/checkpoint").awaitTermination()
    return m.spark.read.parquet(f"{folder}/raised").select(*ALERT_COLUMNS)


def queries() -> dict[str, Query]:
    """All named queries; a trailing underscore only keeps function names apart."""

    def bound(function: Callable[[Model], DataFrame]) -> Query:
        return lambda spark, folder: portable(function(model(spark, folder)))

    return {name.rstrip("_"): bound(function) for name, function in QUERIES.items()}
