"""Measures of the source tables, as SQL expression text: stock totals, averages, margins, lead times, trends."""

from __future__ import annotations

from stockrisk.functions.numeric import to_double

# The parts of a stock position and the stages of a replenishment.
STOCK_PARTS = [
    "fulfillable_quantity",
    "inbound_working_quantity",
    "inbound_shipped_quantity",
    "inbound_receiving_quantity",
    "total_reserved_quantity",
    "total_unfulfillable_quantity",
    "total_researching_quantity",
]
LEAD_TIME_STAGES = [
    "purchase_lead_time_days",
    "domestic_shipping_days",
    "international_shipping_days",
    "customs_clearance_days",
    "amazon_receiving_days",
]


def _total(columns: list[str]) -> str:
    return " + ".join(f"coalesce({name}, 0)" for name in columns)


def stock_total() -> str:
    return _total(STOCK_PARTS)


def average_daily(units: str, days: int) -> str:
    return f"cast(round({units} / {days}D, 2) AS decimal(10,2))"


def unit_margin(price: str, landed_cost: str) -> str:
    price, cost = to_double(price), to_double(landed_cost)
    return f"cast(CASE WHEN {price} > 0 THEN ({price} - {cost}) / {price} ELSE 0D END AS decimal(10,4))"


def lead_time_total() -> str:
    return _total(LEAD_TIME_STAGES)


def reorder_point(total_days: str, safety_days: str) -> str:
    return f"{total_days} + coalesce({safety_days}, 0)"


def trend_rate(average_7d: str, average_30d: str) -> str:
    """Change of the 7-day against the 30-day average, 0 without a positive 30-day average."""
    recent, base = to_double(average_7d), to_double(average_30d)
    return f"CASE WHEN {base} > 0 THEN {recent} / {base} - 1D ELSE 0D END"


def trend_label(rate: str) -> str:
    return f"CASE WHEN {rate} >= 0.15D THEN 'rising' WHEN {rate} <= -0.15D THEN 'declining' ELSE 'stable' END"
