"""From SKU facts to analysis rows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockrisk.functions import rules
from stockrisk.functions.numeric import to_double
from stockrisk.schemas import ANALYSIS, KEY, STORED_ANALYSIS
from stockrisk.sources.align import align_to, misfits


def rule_steps(today: str, eta: str) -> list[dict[str, str]]:
    """Result columns and their expressions, in steps: a later rule names the result of an earlier one.

    The steps with number texts are not fused with their neighbours (see ``fixed_text``), which keeps every
    generated method below the 8,000 bytes up to which the JVM compiles it.
    """
    average_30d, quantity = "avg_daily_sales_30d", "recommended_replenishment_quantity"
    lead, safety, trend = "total_replenishment_days", "safety_stock_days", "sales_trend"
    fulfillable, available, inbound = "fulfillable_quantity", "available_days", "effective_inbound_quantity"
    level, action, overstock = "stockout_risk_level", "recommended_action", "overstock_risk_level"
    quality, profit = "data_quality_status", "profitability_signal"
    base_level, relief = "base_stockout_level", "delivery_relief"
    return [
        {
            "analysis_date": today,
            quality: rules.data_quality(
                "has_inventory", "has_sales", "has_config", "avg_daily_sales_7d", average_30d, lead
            ),
            "daily_sales": rules.daily_sales("avg_daily_sales_7d", average_30d),
            inbound: rules.effective_inbound("inbound_shipped_quantity", "inbound_receiving_quantity"),
            "total_cover_days": rules.cover_days("total_quantity", average_30d),
            "demand_signal": rules.demand_signal("sales_30d", trend, "sales_trend_rate"),
            "target_days": rules.replenish_target_days("target_cover_days", lead, safety, trend),
            "unit_cost": rules.unit_cost("landed_cost", "purchase_cost"),
            "lead_days": to_double(lead),
            "carton_size": to_double("carton_quantity"),
            "minimum_order": rules.minimum_order("moq"),
        },
        {
            available: rules.cover_days(fulfillable, "daily_sales"),
            "inbound_cover_days": rules.cover_days(inbound, average_30d),
            "demand_score": rules.demand_score("demand_signal", "sales_7d", "sales_trend_rate"),
            "demand_explanation": rules.demand_text("demand_signal"),
            overstock: rules.overstock_level("total_quantity", average_30d, "total_cover_days"),
            "missing_quantity": rules.missing_quantity("target_days", average_30d, fulfillable, inbound),
            "recommended_replenishment_days": rules.replenish_days("target_days"),
            "target_days_text": rules.target_days_text("target_days"),
            "effective_margin": rules.effective_margin("current_price", "unit_cost", "gross_margin"),
        },
        {
            base_level: rules.stockout_level(fulfillable, available, safety, "lead_days"),
            relief: rules.delivery_relief(available, today, eta),
            "overstock_risk_score": rules.overstock_score(
                overstock, "total_cover_days", average_30d, "gross_margin"
            ),
            "estimated_stockout_date": rules.stockout_date(today, available),
            "estimated_lost_sales_units": rules.lost_units(
                fulfillable, available, "lead_days", "daily_sales"
            ),
            "carton_rounded_quantity": rules.carton_round("missing_quantity", "carton_size"),
            profit: rules.profit_signal("current_price", "unit_cost", "effective_margin"),
        },
        {
            level: rules.relieved_level(base_level, relief),
            "stockout_risk_score": rules.stockout_score(base_level, trend, relief),
            "estimated_lost_revenue": rules.money("estimated_lost_sales_units", "current_price"),
            quantity: rules.lifted_to_minimum("carton_rounded_quantity", "minimum_order", "carton_size"),
            "profitability_explanation": rules.profit_text(profit),
        },
        {
            action: rules.decided_action(level, overstock, quantity, quality),
            "recommended_replenishment_value": rules.money(quantity, "unit_cost"),
            "profit_approval_required": rules.profit_approval(profit, quantity),
            "replenishment_urgency": rules.urgency(level),
            "confidence_score": rules.confidence(quality, "avg_daily_sales_7d"),
            "stockout_explanation": rules.stockout_text(
                level, fulfillable, "total_reserved_quantity", available, "lead_days"
            ),
            "action_reason": rules.action_reason("seller_sku", available, level, overstock, quantity),
            "replenishment_explanation": rules.replenish_text(
                quantity, "target_days_text", average_30d, fulfillable, inbound, "minimum_order"
            ),
        },
        {
            "final_risk_level": rules.decided_level(action, level),
            "decision_confidence": rules.decided_confidence(action, profit),
            "decision_approval_required": rules.decided_approval(action, "profit_approval_required"),
            "decision_explanation": rules.decision_text(
                "demand_signal", "stockout_risk_score", "overstock_risk_score", profit, action
            ),
        },
        {
            "need_manual_approval": "decision_approval_required OR "
            + rules.needs_manual_approval(action, quantity),
            "risk_reason": "concat_ws(' ', action_reason, decision_explanation, profitability_explanation, "
            "replenishment_explanation)",
        },
    ]


def evaluate_rules(facts: DataFrame, as_of: date) -> DataFrame:
    """Add every rule result to the facts; the optional column ``inbound_eta_date`` feeds the delivery relief."""
    eta = "inbound_eta_date" if "inbound_eta_date" in facts.columns else "cast(NULL AS date)"
    for step in rule_steps(f"date'{as_of}'", eta):
        facts = facts.selectExpr("*", *[f"{text} AS {name}" for name, text in step.items()])
    return facts


def analyse(facts: DataFrame, batch_id: str, as_of: date) -> DataFrame:
    """The 35 analysis columns in full precision, plus the five source values that task generation needs."""
    special = {
        "analysis_batch_id": F.lit(batch_id),
        # Unknown without settings, although the rules count it as zero.
        "safety_stock_days": F.expr("CASE WHEN has_config THEN safety_stock_days END"),
        "recommended_replenishment_date": F.lit(None).cast("date"),
    }
    return (
        evaluate_rules(facts, as_of)
        .withColumns(special)
        .select(
            *ANALYSIS.names,
            "total_unfulfillable_quantity",
            "current_price",
            "purchase_cost",
            "landed_cost",
            "gross_margin",
        )
    )


# Row id: a digest of batch and key, the same on every run.
ANALYSIS_ID = f"md5(concat_ws(';', analysis_batch_id, {', '.join(KEY)}))"


def stored_analysis(analysis: DataFrame, created_at: datetime) -> DataFrame:
    """The rows as the analysis table holds them: rounded to the table's types, with id and creation time."""
    rows = analysis.selectExpr("*", f"{ANALYSIS_ID} AS id", f"timestamp_ntz'{created_at}' AS created_at")
    return align_to(rows, STORED_ANALYSIS)


def rejected_values(analysis: DataFrame) -> DataFrame:
    """Values of analysis rows that the table's types cannot hold, with row id and column; the table has NULL there."""
    rows = analysis.selectExpr("*", f"{ANALYSIS_ID} AS id")
    return misfits(rows, STORED_ANALYSIS, ["id", "analysis_batch_id", *KEY])
