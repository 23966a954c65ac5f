"""JSON documents with the figures that an explanation of the results is based on.

Only the data part: lists are top lists of fixed length or the few tasks of one SKU, so no document grows with the
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockrisk.operators.facts import enriched_analysis
from stockrisk.operators.insights import OPEN_POSITION
from stockrisk.plans import reports
from stockrisk.schemas import KEY

TOP_OF_DASHBOARD, OPEN_OF_DASHBOARD = 10, 20
OPEN_OF_PRIORITY = 40
TOP_OF_INSIGHTS, OPEN_OF_INSIGHTS = 20, 50
RISK_POSITION = f"""struct({reports.STOCKOUT_RANK} AS r, {reports.OVERSTOCK_RANK} AS o, available_days AS d,
    seller_sku AS k, seller_id AS s, marketplace_id AS m)"""
_JSON = "map('ignoreNullFields', 'false')"


def _plain(df: DataFrame, names: list[str]) -> str:
    """A struct of the columns as JSON clients expect them: decimals as numbers, times in ISO form."""
    values = []
    for name in names:
        kind = df.schema[name].dataType
        if isinstance(kind, T.DecimalType):
            value = f"cast({name} AS double)"
        elif isinstance(kind, T.TimestampNTZType):
            value = f"date_format({name}, \"yyyy-MM-dd'T'HH:mm:ss\")"
        elif isinstance(kind, T.DateType):
            value = f"cast({name} AS string)"
        else:
            value = name
        values.append(f"'{name}', {value}")
    return f"named_struct({', '.join(values)})"


def _placed(df: DataFrame, position: str, names: list[str]) -> DataFrame:
    """A short frame as one row with its rows in order."""
    return df.agg(F.expr(f"array_sort(collect_list(struct({position} AS at, {_plain(df, names)} AS body)))").alias("placed"))


def _first(size: int) -> str:
    return f"to_json(transform(slice(placed, 1, {size}), x -> x.body), {_JSON})"


def _lists(df: DataFrame, position: str, names: list[str], sizes: dict[str, int]) -> DataFrame:
    """``name, json``: the first rows of a short frame as JSON lists of several lengths; the frame is computed once."""
    pieces = ", ".join(f"struct('{name}' AS name, {_first(size)} AS json)" for name, size in sizes.items())
    return _placed(df, position, names).selectExpr(f"inline(array({pieces}))")


def _document(pieces: dict[str, str]) -> str:
    """JSON object of pieces that are JSON already."""
    parts = [f"'{'{' if number == 0 else ','}\"{name}\":', {value}" for number, (name, value) in enumerate(pieces.items())]
    return f"concat({', '.join(parts)}, '}}')"


def _text_list(values: list[str]) -> str:
    return "to_json(array({}))".format(", ".join(f"'{value}'" for value in values))


# The fields that an explanation may rest on and what it must not do, per document.
DASHBOARD_FIELDS = [
    "estimated_lost_revenue_total",
    "high_impact_task_count",
    "avg_decision_confidence",
    "stockout_risk_score_avg",
    "overstock_risk_score_avg",
    "stockout_risk_score",
    "overstock_risk_score",
    "estimated_lost_revenue",
    "decision_confidence",
]
DASHBOARD_CONSTRAINTS = [
    "Do not recalculate risk scores.",
    "Do not recalculate replenishment quantity.",
    "Do not recalculate approval level or task priority.",
    "Only explain the existing rule Skill outputs.",
]
SKU_FIELDS = [
    "gross_margin",
    "sales_trend",
    "stockout_risk_score",
    "overstock_risk_score",
    "estimated_lost_revenue",
    "decision_confidence",
    "decision_explanation",
]
SKU_CONSTRAINTS = [
    "Do not recalculate risk scores.",
    "Do not change the recommended action.",
    "Do not change approval decisions.",
    "Only explain the evidence already provided by the rule Skill outputs.",
]
INSIGHT_FIELDS = [
    "problem_type",
    "impact_level",
    "estimated_impact_value",
    "approval_level",
    "stockout_risk_score",
    "overstock_risk_score",
    "estimated_lost_revenue",
    "decision_confidence",
]
INSIGHT_CONSTRAINTS = [
    "Do not recalculate task priority.",
    "Do not recalculate approval level.",
    "Do not invent new task ids or SKUs.",
    "Only group and explain the existing task and Skill outputs.",
]


def overview_contexts(
    products: DataFrame, analysis: DataFrame, tasks: DataFrame, sales: DataFrame, configs: DataFrame
) -> DataFrame:
    """The three documents over the whole shop: dashboard, task priority and task insights.

    Lists of one order are cut from the longest of them, so that there is one top-k pass over the analysis and one over the
    tasks, beside the aggregates of the figures.
    """
    figures = reports.dashboard_summary(products, analysis, tasks)
    summary = figures.selectExpr("'summary' AS name", f"to_json({_plain(figures, figures.columns)}, {_JSON}) AS json")
    counted = reports.risk_distribution(analysis)
    position = "struct(-sku_count AS n, stockout_risk_level AS s, overstock_risk_level AS o, data_quality_status AS d)"
    distribution = _lists(counted, position, counted.columns, {"distribution": 1 << 30})
    top = reports.top_risk_skus(analysis, products, sales, configs, max(TOP_OF_DASHBOARD, TOP_OF_INSIGHTS))
    top_lists = _lists(top, RISK_POSITION, top.columns, {"top_short": TOP_OF_DASHBOARD, "top_long": TOP_OF_INSIGHTS})
    sizes = {"open_short": OPEN_OF_DASHBOARD, "open_mid": OPEN_OF_PRIORITY, "open_long": OPEN_OF_INSIGHTS}
    open_rows = reports.open_task_rows(tasks, max(sizes.values()))
    open_lists = _lists(open_rows, OPEN_POSITION, reports.OPEN_TASK_COLUMNS, sizes)
    named = summary.unionByName(distribution).unionByName(top_lists).unionByName(open_lists)
    names = ["summary", "distribution", "top_short", "top_long", *sizes]
    pieces = named.agg(*[F.expr(f"max(json) FILTER (WHERE name = '{name}')").alias(name) for name in names])
    documents = {
        "dashboard_summary": {
            "dashboard_summary": "summary",
            "risk_distribution": "distribution",
            "top_risk_skus": "top_short",
            "open_tasks": "open_short",
            "skill_output_fields": _text_list(DASHBOARD_FIELDS),
            "ai_constraints": _text_list(DASHBOARD_CONSTRAINTS),
        },
        "task_priority": {"open_tasks": "open_mid"},
        "task_insights": {
            "open_tasks": "open_long",
            "top_risk_skus": "top_long",
            "risk_distribution": "distribution",
            "skill_output_fields": _text_list(INSIGHT_FIELDS),
            "ai_constraints": _text_list(INSIGHT_CONSTRAINTS),
        },
    }
    rows = ", ".join(f"struct('{name}' AS context, {_document(parts)} AS payload)" for name, parts in documents.items())
    return pieces.selectExpr(f"inline(array({rows}))")


def sku_contexts(
    analysis: DataFrame, products: DataFrame, sales: DataFrame, configs: DataFrame, tasks: DataFrame
) -> DataFrame:
    """One document per analysed SKU of a batch: its enriched row and its tasks (at most one per type)."""
    details = enriched_analysis(analysis, products, sales, configs)
    detail = details.selectExpr("id AS analysis_id", *KEY, f"{_plain(details, details.columns)} AS sku_detail")
    position = f"struct({reports.STATUS_RANK} AS r, -task_order AS t)"
    body = _plain(tasks, reports.OPEN_TASK_COLUMNS)
    listed = tasks.groupBy("analysis_id").agg(
        F.expr(f"array_sort(collect_list(struct({position} AS at, {body} AS body)))").alias("placed")
    )
    fields, constraints = (
        f"array({', '.join(repr(value) for value in values)})" for values in (SKU_FIELDS, SKU_CONSTRAINTS)
    )
    return detail.join(listed.hint("merge"), "analysis_id", "left").selectExpr(
        *KEY,
        f"""to_json(named_struct('sku_detail', sku_detail, 'sku_tasks',
            coalesce(transform(placed, x -> x.body), array()),
            'skill_output_fields', {fields}, 'ai_constraints', {constraints}), {_JSON}) AS payload""",
    )
