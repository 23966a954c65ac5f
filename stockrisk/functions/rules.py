"""The risk and replenishment rules as Spark SQL expression text.

Every function takes operand texts (usually column names) and returns the text of one native expression; nothing
needs a Python worker.  Operands may be NULL; unless said otherwise NULL counts as zero.  Arithmetic is done on
doubles in a fixed order because a different order can move a ``ceil`` by one unit.
"""

from __future__ import annotations

from stockrisk.functions.numeric import fixed_text, ratio, to_double

# Scores, cut-offs and sentences that results must reproduce.
LEVEL_SCORES = {"critical": 95, "high": 80, "medium": 55, "unknown": 40, "low": 20}
DEMAND_TEXT = {
    "no_sales": "No recent sales were provided, so demand is treated as no_sales.",
    "rising": "Recent demand is rising, so stockout and replenishment decisions should be more conservative.",
    "declining": "Recent demand is declining, so replenishment should avoid creating excess inventory.",
    "stable": "Demand is stable based on the current sales trend signal.",
}
PROFIT_TEXT = {
    "unknown": "Price or cost is missing, so replenishment profitability needs review.",
    "loss": "The SKU appears to be selling below landed cost.",
    "low_margin": "Margin is low, so replenishment should require manual review.",
    "high_margin": "Margin is healthy, so replenishment is financially attractive if demand exists.",
    "healthy": "Margin is acceptable for a normal replenishment decision.",
}
WEAK_PROFIT = "('loss', 'low_margin', 'unknown')"
COSTLY_ACTIONS = "('replenish_now', 'clearance_or_reduce_replenishment')"


def _texts(key: str, values: dict[str, str]) -> str:
    branches = " ".join(f"WHEN '{name}' THEN '{text}'" for name, text in values.items())
    return f"CASE {key} {branches} END"


def _whole(value: str) -> str:
    """Text of a quantity without decimals."""
    return f"cast(cast(rint({to_double(value)}) AS bigint) AS string)"


def _up(trend: str) -> str:
    return f"coalesce(lower({trend}) IN ('rising', 'up'), false)"


def _down(trend: str) -> str:
    return f"coalesce(lower({trend}) IN ('declining', 'down'), false)"


def level_score(level: str) -> str:
    branches = " ".join(f"WHEN '{name}' THEN {score}D" for name, score in LEVEL_SCORES.items())
    return f"CASE {level} {branches} ELSE 40D END"


def daily_sales(average_7d: str, average_30d: str) -> str:
    """The 7-day average when positive, else the 30-day average when positive, else zero."""
    return f"CASE WHEN {average_7d} > 0 THEN {average_7d} WHEN {average_30d} > 0 THEN {average_30d} ELSE 0D END"


def demand_signal(units_30d: str, trend: str, rate: str) -> str:
    return f"""CASE
        WHEN {to_double(units_30d)} <= 0 THEN 'no_sales'
        WHEN {_up(trend)} OR {to_double(rate)} >= 0.15D THEN 'rising'
        WHEN {_down(trend)} OR {to_double(rate)} <= -0.15D THEN 'declining'
        ELSE 'stable' END"""


def demand_score(signal: str, units_7d: str, rate: str) -> str:
    rate = to_double(rate)
    return f"""round(CASE {signal}
        WHEN 'no_sales' THEN 0D
        WHEN 'rising' THEN least(100D, 70D + greatest({rate}, 0D) * 100D)
        WHEN 'declining' THEN greatest(10D, 45D + {rate} * 100D)
        ELSE CASE WHEN {to_double(units_7d)} > 0 THEN 55D ELSE 35D END END, 4)"""


def demand_text(signal: str) -> str:
    return _texts(signal, DEMAND_TEXT)


def cover_days(quantity: str, sales_per_day: str) -> str:
    """Days a quantity lasts; NULL without positive sales."""
    return ratio(to_double(quantity), f"cast({sales_per_day} AS double)")


def effective_inbound(shipped: str, receiving: str) -> str:
    """Units that are certain to arrive: shipped and receiving, not those still being prepared."""
    return f"try_cast({to_double(shipped)} + {to_double(receiving)} AS int)"


def stockout_date(today: str, available_days: str) -> str:
    # No date for covers beyond the year 9999.
    days = f"CASE WHEN {available_days} < 2900000D THEN cast(floor({available_days}) AS int) END"
    return f"date_add({today}, {days})"


def stockout_level(fulfillable: str, available_days: str, safety_days: str, lead_days: str) -> str:
    return f"""CASE
        WHEN {to_double(fulfillable)} <= 0 THEN 'critical'
        WHEN {available_days} IS NULL THEN 'unknown'
        WHEN {available_days} <= {to_double(safety_days)} THEN 'critical'
        WHEN {available_days} <= {to_double(lead_days)} THEN 'high'
        WHEN {available_days} <= {to_double(lead_days)} + 7D THEN 'medium'
        ELSE 'low' END"""


def delivery_relief(available_days: str, today: str, inbound_eta: str) -> str:
    """True where a delivery is due at most three days after running out."""
    return f"coalesce(datediff({inbound_eta}, {today}) <= {available_days} + 3D, false)"


def relieved_level(level: str, relieved: str) -> str:
    return f"""CASE
        WHEN {relieved} AND {level} = 'critical' THEN 'high'
        WHEN {relieved} AND {level} = 'high' THEN 'medium'
        ELSE {level} END"""


def stockout_score(base_level: str, trend: str, relieved: str) -> str:
    """Score of the level before relief, raised for rising demand and lowered by a delivery."""
    urgent = f"{_up(trend)} AND {base_level} IN ('high', 'medium')"
    raised = f"least(100D, {level_score(base_level)} + CASE WHEN {urgent} THEN 8D ELSE 0D END)"
    return f"greatest({raised} - CASE WHEN {relieved} THEN 15D ELSE 0D END, 20D)"


def lost_units(fulfillable: str, available_days: str, lead_days: str, per_day: str) -> str:
    """Units that cannot be sold between running out and the next delivery."""
    lead, left = to_double(lead_days), to_double(available_days)
    return f"""CASE WHEN {per_day} > 0 THEN greatest(
        CASE WHEN {lead} > {left} THEN ceil(({lead} - {left}) * {per_day}) ELSE 0L END,
        CASE WHEN {to_double(fulfillable)} <= 0 THEN ceil({lead} * {per_day}) END)
        ELSE 0L END"""


def money(quantity: str, unit_value: str) -> str:
    return f"round({to_double(quantity)} * {to_double(unit_value)}, 2)"


def overstock_level(total: str, average_30d: str, total_cover: str) -> str:
    return f"""CASE
        WHEN {to_double(total)} <= 0 THEN 'low'
        WHEN {to_double(average_30d)} <= 0 THEN 'high'
        WHEN {total_cover} IS NULL THEN 'unknown'
        WHEN {total_cover} >= 180 THEN 'high'
        WHEN {total_cover} >= 90 THEN 'medium'
        ELSE 'low' END"""


def overstock_score(level: str, total_cover: str, average_30d: str, margin: str) -> str:
    """Level score with floors for very long cover and for no sales, raised for a thin margin."""
    # greatest() skips NULL, so each floor applies only where its condition holds.
    floored = f"""greatest({level_score(level)},
        CASE WHEN {total_cover} >= 180 THEN 88D END,
        CASE WHEN {to_double(average_30d)} <= 0 THEN 85D END)"""
    thin = f"{to_double(margin)} < 0.15D AND coalesce({level} IN ('high', 'medium'), false)"
    return f"least(100D, {floored} + CASE WHEN {thin} THEN 8D ELSE 0D END)"


def carton_round(quantity: str, carton: str) -> str:
    """Round a quantity up to whole cartons, or to whole units without a carton size."""
    quantity, carton = to_double(quantity), to_double(carton)
    return f"""CASE
        WHEN {quantity} <= 0 THEN 0L
        WHEN {carton} <= 0 THEN ceil({quantity})
        ELSE cast(ceil({quantity} / {carton}) * {carton} AS bigint) END"""


def missing_quantity(target_days: str, average_30d: str, available: str, inbound: str) -> str:
    """Units short of the target cover; negative when there is more than enough."""
    need = f"{to_double(target_days)} * {to_double(average_30d)}"
    return f"{need} - {to_double(available)} - {to_double(inbound)}"


def replenish_target_days(target: str, lead_days: str, safety_days: str, trend: str) -> str:
    """Days of cover to aim at: the set target, or lead plus safety time, stretched or shrunk by the trend."""
    target = to_double(target)
    fallback = f"{to_double(lead_days)} + {to_double(safety_days)}"
    factor = f"CASE WHEN {_up(trend)} THEN 1.15D WHEN {_down(trend)} THEN 0.8D ELSE 1D END"
    return f"(CASE WHEN {target} <= 0 THEN {fallback} ELSE {target} END) * {factor}"


def minimum_order(moq: str) -> str:
    return f"cast({to_double(moq)} AS bigint)"


def lifted_to_minimum(quantity: str, minimum: str, carton: str) -> str:
    """A positive quantity below the minimum order becomes that minimum in whole cartons."""
    return f"""CASE WHEN {quantity} > 0 AND {quantity} < {minimum}
        THEN {carton_round(minimum, carton)} ELSE {quantity} END"""


def replenish_days(target_days: str) -> str:
    return f"CASE WHEN {target_days} > 0 THEN cast(ceil({target_days}) AS int) ELSE 0 END"


def replenish_action(quantity: str) -> str:
    return f"CASE WHEN {to_double(quantity)} > 0 THEN 'replenish_now' ELSE 'keep_monitoring' END"


def target_days_text(target_days: str) -> str:
    return fixed_text(target_days, 1)


def replenish_text(
    quantity: str, target_text: str, average_30d: str, available: str, inbound: str, moq: str
) -> str:
    """The stored 30-day average has two places, so its text needs no rounding."""
    return f"""concat('Recommended quantity is ', {quantity},
        ', based on target cover days ', {target_text},
        ', 30-day average daily sales ', cast({to_double(average_30d)} AS decimal(20,2)),
        ', available inventory ', {_whole(available)},
        ', inbound inventory ', {_whole(inbound)},
        ', MOQ ', {minimum_order(moq)}, '.')"""


def unit_cost(landed: str, purchase: str) -> str:
    """Landed cost, or the purchase cost where it is zero or missing."""
    landed = to_double(landed)
    return f"CASE WHEN {landed} = 0 THEN {to_double(purchase)} ELSE {landed} END"


def effective_margin(price: str, cost: str, margin: str) -> str:
    """The given margin; exactly zero means unknown and is recomputed from price and cost."""
    price, margin = to_double(price), to_double(margin)
    return f"CASE WHEN {margin} = 0 AND {price} > 0 THEN ({price} - {cost}) / {price} ELSE {margin} END"


def profit_signal(price: str, cost: str, margin: str) -> str:
    """``cost`` and ``margin`` are those of ``unit_cost`` and ``effective_margin``."""
    return f"""CASE
        WHEN {to_double(price)} <= 0 OR {cost} <= 0 THEN 'unknown'
        WHEN {margin} < 0 THEN 'loss'
        WHEN {margin} < 0.18D THEN 'low_margin'
        WHEN {margin} >= 0.35D THEN 'high_margin'
        ELSE 'healthy' END"""


def profit_approval(signal: str, quantity: str) -> str:
    return f"{signal} IN {WEAK_PROFIT} AND {to_double(quantity)} > 0"


def profit_text(signal: str) -> str:
    return _texts(signal, PROFIT_TEXT)


def recommended_action(level: str, overstock: str, quantity: str, quality: str) -> str:
    """The action cascade; a NULL data quality counts as not complete."""
    return f"""CASE
        WHEN coalesce({quality}, '') <> 'complete' THEN 'complete_missing_data'
        WHEN {level} IN ('critical', 'high') AND {to_double(quantity)} > 0 THEN 'replenish_now'
        WHEN {level} = 'medium' THEN 'prepare_replenishment'
        WHEN {overstock} = 'high' THEN 'clearance_or_reduce_replenishment'
        ELSE 'keep_monitoring' END"""


def decided_action(level: str, overstock: str, quantity: str, quality: str) -> str:
    """The same cascade inside the final decision, where a missing data quality counts as complete."""
    return recommended_action(level, overstock, quantity, f"coalesce(nullif({quality}, ''), 'complete')")


def decided_level(action: str, level: str) -> str:
    return f"""CASE {action}
        WHEN 'complete_missing_data' THEN 'unknown'
        WHEN 'replenish_now' THEN {level}
        WHEN 'prepare_replenishment' THEN 'medium'
        WHEN 'clearance_or_reduce_replenishment' THEN 'high'
        ELSE 'low' END"""


def decided_confidence(action: str, profit: str) -> str:
    return f"""CASE {action}
        WHEN 'complete_missing_data' THEN 45D
        WHEN 'replenish_now' THEN CASE WHEN {profit} IN {WEAK_PROFIT} THEN 70D ELSE 88D END
        WHEN 'prepare_replenishment' THEN 78D
        WHEN 'clearance_or_reduce_replenishment' THEN 82D
        ELSE 86D END"""


def decided_approval(action: str, profit_needs: str) -> str:
    return f"coalesce({profit_needs}, false) OR {action} IN {COSTLY_ACTIONS}"


def needs_manual_approval(action: str, quantity: str) -> str:
    return f"coalesce({action} IN {COSTLY_ACTIONS}, false) OR {to_double(quantity)} >= 500"


def data_quality(
    has_inventory: str, has_sales: str, has_config: str, average_7d: str, average_30d: str, lead_days: str
) -> str:
    return f"""CASE
        WHEN NOT {has_inventory} THEN 'missing_inventory'
        WHEN NOT {has_sales} THEN 'missing_sales'
        WHEN NOT {has_config} THEN 'missing_config'
        WHEN {to_double(average_7d)} < 0 OR {to_double(average_30d)} < 0 THEN 'invalid_sales'
        WHEN {to_double(lead_days)} < 0 THEN 'invalid_config'
        ELSE 'complete' END"""


def data_quality_strict(
    has_inventory: str,
    has_sales: str,
    has_config: str,
    average_7d: str,
    average_30d: str,
    units_30d: str,
    lead_days: str,
    target_days: str,
    safety_days: str,
    config_status: str,
) -> str:
    """The stricter documented variant: silent SKUs, averages that contradict units, unusable settings."""
    average_7d, average_30d, units = to_double(average_7d), to_double(average_30d), to_double(units_30d)
    return f"""CASE
        WHEN NOT {has_inventory} THEN 'missing_inventory'
        WHEN NOT {has_sales} OR ({average_7d} = 0 AND {average_30d} = 0) THEN 'missing_sales'
        WHEN NOT {has_config} THEN 'missing_config'
        WHEN {units} < 0 OR {average_30d} <> round({units} / 30D, 2) THEN 'invalid_sales'
        WHEN {config_status} IN ('missing', 'invalid') OR {to_double(lead_days)} <= 0
            OR {to_double(target_days)} < {to_double(safety_days)} THEN 'invalid_config'
        WHEN {config_status} = 'inactive' THEN 'missing_config'
        ELSE 'complete' END"""


def urgency(level: str) -> str:
    return f"CASE {level} WHEN 'critical' THEN 'urgent' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'normal' ELSE 'none' END"


def confidence(quality: str, average_7d: str) -> str:
    return f"""CASE {quality}
        WHEN 'complete' THEN CASE WHEN {to_double(average_7d)} > 0 THEN 95D ELSE 75D END
        WHEN 'missing_sales' THEN 50D
        WHEN 'missing_config' THEN 40D
        WHEN 'invalid_sales' THEN 35D
        WHEN 'invalid_config' THEN 35D
        ELSE 20D END"""


def stockout_text(level: str, fulfillable: str, reserved: str, available_days: str, lead_days: str) -> str:
    return f"""concat('Stockout risk is ', {level},
        '; fulfillable inventory is ', {_whole(fulfillable)},
        ', reserved inventory is ', {_whole(reserved)},
        ', available days are ', coalesce({fixed_text(available_days, 2)}, 'unknown'),
        ', lead time is ', {_whole(lead_days)}, ' days.')"""


def decision_text(signal: str, score: str, over_score: str, profit: str, action: str) -> str:
    return f"""concat('Demand signal is ', {signal}, '; stockout score is ', {score},
        '; overstock score is ', {over_score}, '; profitability signal is ', {profit},
        '; final action is ', {action}, '.')"""


def action_reason(sku: str, available_days: str, level: str, overstock: str, quantity: str) -> str:
    return f"""concat('SKU ', coalesce(nullif({sku}, ''), '未知 SKU'),
        ' 当前可售天数为 ', coalesce(concat({fixed_text(available_days, 2)}, ' 天'), '无法计算'),
        '，断货风险为 ', coalesce({level}, 'unknown'),
        '，滞销风险为 ', coalesce({overstock}, 'unknown'),
        '，建议补货数量为 ', cast({to_double(quantity)} AS bigint), '。')"""
