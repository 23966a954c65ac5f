"""Reports over the stored analysis and task tables."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockrisk.functions.ranks import OVERSTOCK_RANK, PRIORITY_RANK, STATUS_RANK, STOCKOUT_RANK
from stockrisk.operators.facts import active_products, enriched_analysis, of_sku, only_keys_of
from stockrisk.operators.latest import latest_per_key
from stockrisk.schemas import KEY
from stockrisk.session import written

# The columns of the views, in the order clients expect.
LIST_COLUMNS = [
    "seller_sku",
    "asin",
    "fulfillable_quantity",
    "total_quantity",
    "effective_inbound_quantity",
    "avg_daily_sales_7d",
    "avg_daily_sales_30d",
    "available_days",
    "total_cover_days",
    "estimated_stockout_date",
    "stockout_risk_level",
    "overstock_risk_level",
    "recommended_replenishment_quantity",
    "recommended_action",
    "action_reason",
    "data_quality_status",
    "created_at",
    "current_price",
    "landed_cost",
    "gross_margin",
    "sales_7d",
    "sales_30d",
    "sales_trend",
    "sales_trend_rate",
    "total_replenishment_lead_time_days",
    "target_cover_days",
    "safety_stock_days",
    "moq",
    "stockout_risk_score",
    "overstock_risk_score",
    "estimated_lost_revenue",
    "decision_confidence",
    "decision_explanation",
]
OPEN_TASK_COLUMNS = [
    "task_id",
    "seller_sku",
    "asin",
    "task_type",
    "task_title",
    "task_description",
    "priority",
    "risk_level",
    "suggested_action",
    "expected_impact",
    "approval_required",
    "task_status",
    "problem_type",
    "impact_level",
    "estimated_impact_value",
    "approval_level",
    "created_at",
]
TASK_LIST_COLUMNS = [
    "task_id",
    "seller_sku",
    "asin",
    "task_type",
    "task_title",
    "task_description",
    "priority",
    "risk_level",
    "suggested_action",
    "approval_required",
    "task_status",
    "created_at",
    "problem_type",
    "impact_level",
    "estimated_impact_value",
    "approval_level",
]

DASHBOARD_COLUMNS = [
    "total_skus",
    "critical_stockout_count",
    "high_stockout_count",
    "overstock_high_count",
    "data_missing_count",
    "pending_task_count",
    "total_tasks",
    "estimated_lost_revenue_total",
    "high_impact_task_count",
    "avg_decision_confidence",
    "stockout_risk_score_avg",
    "overstock_risk_score_avg",
]

def risk_order() -> list[Column]:
    """Worst first; unknown cover sorts before any number."""
    return [
        F.expr(STOCKOUT_RANK),
        F.expr(OVERSTOCK_RANK),
        F.col("available_days").asc_nulls_first(),
        F.col("seller_sku"),
        F.col("seller_id"),
        F.col("marketplace_id"),
    ]


def _creation(descending: bool) -> list[Column]:
    """Order in which tasks were created: SKU by SKU, then by position."""
    names = ["seller_sku", "seller_id", "marketplace_id", "task_order"]
    return [F.desc(name) if descending else F.asc(name) for name in names]


def open_order() -> list[Column]:
    return [F.expr(PRIORITY_RANK), F.col("created_at"), *_creation(descending=False)]


def newest_task_first() -> list[Column]:
    return [F.desc("created_at"), *_creation(descending=True)]


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Put one-row aggregates of several tables side by side: union them and keep the filled value per column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(name).alias(name) for name in stacked.columns])


def _aggregate(df: DataFrame, **expressions: str) -> DataFrame:
    return df.agg(*[F.expr(text).alias(name) for name, text in expressions.items()])


def dashboard_summary(products: DataFrame, analysis: DataFrame, tasks: DataFrame) -> DataFrame:
    """Twelve figures in one row; each table is aggregated once.  Figures of missing columns get a default."""

    def if_present(df: DataFrame, names: list[str], text: str, default: str) -> str:
        return text if set(names) <= set(df.columns) else default

    def average(name: str) -> str:
        return if_present(analysis, [name], f"avg({name})", "cast(max(NULL) AS double)")

    figures = _one_row(
        [
            _aggregate(active_products(products), total_skus="count(1)"),
            _aggregate(
                analysis,
                critical_stockout_count="count_if(stockout_risk_level = 'critical')",
                high_stockout_count="count_if(stockout_risk_level = 'high')",
                overstock_high_count="count_if(overstock_risk_level = 'high')",
                data_missing_count="count_if(data_quality_status <> 'complete')",
                estimated_lost_revenue_total=if_present(
                    analysis, ["estimated_lost_revenue"], "coalesce(sum(estimated_lost_revenue), 0)", "max(0)"
                ),
                avg_decision_confidence=average("decision_confidence"),
                stockout_risk_score_avg=average("stockout_risk_score"),
                overstock_risk_score_avg=average("overstock_risk_score"),
            ),
            _aggregate(
                tasks,
                pending_task_count="count_if(task_status = 'pending')",
                total_tasks="count(1)",
                high_impact_task_count=if_present(
                    tasks,
                    ["impact_level", "estimated_impact_value"],
                    """count_if(task_status = 'pending'
                        AND (impact_level = 'high' OR coalesce(estimated_impact_value, 0) >= 5000))""",
                    "max(0L)",
                ),
            ),
        ]
    )
    return figures.select(*DASHBOARD_COLUMNS)


def risk_distribution(analysis: DataFrame) -> DataFrame:
    levels = ["stockout_risk_level", "overstock_risk_level", "data_quality_status"]
    counted = analysis.groupBy(*levels).agg(F.count(F.lit(1)).alias("sku_count"))
    return counted.orderBy(F.desc("sku_count"), *levels)


def top_risk_skus(
    analysis: DataFrame, products: DataFrame, sales: DataFrame, configs: DataFrame, limit: int = 10
) -> DataFrame:
    """The worst SKUs with their current source columns.

    The order needs analysis columns only, so the rows are picked first.
    """
    picked = analysis.orderBy(*risk_order()).limit(_positive(limit))
    return enriched_for(picked, products, sales, configs).orderBy(*risk_order()).limit(limit)


def _positive(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be positive")
    return limit


def enriched_for(picked: DataFrame, products: DataFrame, sales: DataFrame, configs: DataFrame) -> DataFrame:
    """``enriched_analysis`` for a few picked rows.

    The large tables are reduced to the picked keys before the newest sales row is determined.  The picked rows, at most
    a list's limit, are written first: the lookups use them, and each would pick them again from the whole analysis table.
    So Spark also knows their size when it chooses the joins.
    """
    few = written(picked, "picked-rows")
    return enriched_analysis(few, *[only_keys_of(table, few) for table in (products, sales, configs)])


def _contains(name: str, text: str) -> Column:
    """SQL LIKE ``%text%`` without regard to case; ``%`` and ``_`` in the text stay wildcards."""
    return F.col(name).ilike(f"%{text}%")


def filtered(df: DataFrame, equal: dict[str, str | None], seller_sku: str | None) -> DataFrame:
    """Optional equality filters on coded columns (stored in one case) and an optional SKU search."""
    for name, value in equal.items():
        if value:
            df = df.filter(F.col(name) == value)
    return df.filter(_contains("seller_sku", seller_sku)) if seller_sku else df


def analysis_list(
    analysis: DataFrame,
    products: DataFrame,
    sales: DataFrame,
    configs: DataFrame,
    stockout_risk_level: str | None = None,
    overstock_risk_level: str | None = None,
    data_quality_status: str | None = None,
    seller_sku: str | None = None,
) -> DataFrame:
    equal = {
        "stockout_risk_level": stockout_risk_level,
        "overstock_risk_level": overstock_risk_level,
        "data_quality_status": data_quality_status,
    }
    wanted = filtered(analysis, equal, seller_sku)
    rows = enriched_analysis(wanted, products, sales, configs)
    # The further sort columns spread a SKU name that many sellers share over several sort partitions.
    return rows.orderBy("seller_sku", "seller_id", "marketplace_id", "created_at").select(*LIST_COLUMNS)


def analysis_detail(
    analysis: DataFrame, products: DataFrame, sales: DataFrame, configs: DataFrame, seller_sku: str
) -> DataFrame:
    """Newest analysis row of one SKU; empty if there is none."""
    picked = of_sku(analysis, seller_sku).orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    return enriched_for(picked, products, sales, configs).select(*LIST_COLUMNS)


def open_task_rows(tasks: DataFrame, limit: int = 30) -> DataFrame:
    """Pending tasks in working order, all columns."""
    return tasks.filter("task_status = 'pending'").orderBy(*open_order()).limit(_positive(limit))


def open_tasks(tasks: DataFrame, limit: int = 30) -> DataFrame:
    return open_task_rows(tasks, limit).select(*[n for n in OPEN_TASK_COLUMNS if n in tasks.columns])


def tasks_by_sku(tasks: DataFrame, seller_sku: str) -> DataFrame:
    return of_sku(tasks, seller_sku).orderBy(F.expr(STATUS_RANK), *newest_task_first()).select(*OPEN_TASK_COLUMNS)


def task_list(
    tasks: DataFrame,
    task_type: str | None = None,
    task_status: str | None = None,
    priority: str | None = None,
    seller_sku: str | None = None,
) -> DataFrame:
    equal = {"task_type": task_type, "task_status": task_status, "priority": priority}
    return filtered(tasks, equal, seller_sku).orderBy(*newest_task_first()).select(*TASK_LIST_COLUMNS)


def run_summary(analysis: DataFrame, tasks: DataFrame) -> DataFrame:
    return _one_row(
        [
            _aggregate(
                analysis,
                analyzed_skus="count(1)",
                critical_stockout_skus="count_if(stockout_risk_level = 'critical')",
                high_stockout_skus="count_if(stockout_risk_level = 'high')",
                overstock_high_skus="count_if(overstock_risk_level = 'high')",
            ),
            _aggregate(tasks, generated_tasks="count(1)"),
        ]
    )


def batch_stats(analysis: DataFrame) -> DataFrame:
    """Rows and critical rows per batch, newest batch first."""
    stats = analysis.groupBy("analysis_batch_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("stockout_risk_level") == "critical").alias("critical_count"),
        F.max("created_at").alias("created_at"),
    )
    return stats.orderBy(F.desc("created_at"), F.desc("analysis_batch_id"))


def task_type_counts(tasks: DataFrame) -> DataFrame:
    counted = tasks.groupBy("task_type", "priority").agg(F.count(F.lit(1)).alias("task_count"))
    return counted.orderBy("task_type", "priority")


def data_quality_report(rule_rows: DataFrame) -> DataFrame:
    """SKUs without stock, sales or settings, and whether the statuses add up; one pass over the rule rows."""
    counted = _aggregate(
        rule_rows,
        total_skus="count(1)",
        without_inventory="count_if(NOT has_inventory)",
        without_sales="count_if(NOT has_sales)",
        without_config="count_if(NOT has_config)",
        missing_any="count_if(NOT (has_inventory AND has_sales AND has_config))",
        invalid_values="count_if(data_quality_status LIKE 'invalid%')",
        not_complete="count_if(data_quality_status <> 'complete')",
    )
    return counted.withColumn("is_consistent", F.expr("not_complete = missing_any + invalid_values"))


def pending_on(tasks: DataFrame, day: date) -> DataFrame:
    """Pending tasks created on a given day."""
    same_day = F.col("created_at").cast("date") == F.lit(day)
    return tasks.filter("task_status = 'pending'").filter(same_day).agg(F.count(F.lit(1)).alias("pending_count"))


def latest_batch(analysis: DataFrame) -> DataFrame:
    """Rows of the newest batch."""
    newest = analysis.select(F.expr("max_by(analysis_batch_id, struct(created_at, analysis_batch_id))"))
    return analysis.filter(F.col("analysis_batch_id") == newest.scalar())


def newest_per_sku(analysis: DataFrame) -> DataFrame:
    """Newest analysis row of every key over all batches."""
    return latest_per_key(analysis, KEY, [F.desc("created_at"), F.desc("id")])


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, order: list[str], last: tuple, limit: int) -> DataFrame:
    """The page behind a known last row; unlike an offset it does not sort through the pages before it."""
    behind = F.struct(*[F.col(name) for name in order]) > F.struct(
        *[F.lit(value).alias(name) for name, value in zip(order, last, strict=True)]
    )
    return df.filter(behind).orderBy(*order).limit(limit)
