"""SQL twins of the named queries, for DuckDB on the same tables.

They are written from the rule descriptions, not from the Spark code: range joins instead of conditional sums,
``printf`` instead of the tie logic, one statement per query with shared common table expressions.
"""

from __future__ import annotations

KEY = "seller_id, marketplace_id, seller_sku"


def dec(value: str, precision: int, scale: int) -> str:
    """Double to decimal through its text, which rounds halves up as Spark does."""
    return f"CAST(CAST({value} AS VARCHAR) AS DECIMAL({precision},{scale}))"


def day(text: str) -> str:
    return f"DATE '{text}'"


SOURCES = f"""
product_master AS (
  SELECT *, CASE WHEN p_size % 3 = 0 THEN 0::DECIMAL(10,4)
      ELSE {dec('(current_price::DOUBLE - landed_cost::DOUBLE) / current_price::DOUBLE', 10, 4)} END AS gross_margin
  FROM (
    SELECT p_partkey AS id, p_size, 'SELLER-' || p_brand AS seller_id, p_type AS marketplace_id,
      'SKU-' || p_partkey AS seller_sku, 'B' || lpad(p_partkey::VARCHAR, 9, '0') AS asin,
      p_name AS product_name, p_brand AS brand,
      {dec('p_retailprice / 40', 10, 2)} AS current_price,
      CASE WHEN p_size % 17 = 0 THEN 0::DECIMAL(10,2)
        ELSE {dec('(p_retailprice / 40) * (0.55::DOUBLE + 0.01::DOUBLE * p_size)', 10, 2)} END AS landed_cost,
      CASE WHEN p_size % 34 = 0 THEN 0::DECIMAL(10,2)
        ELSE {dec('(p_retailprice / 40) * 0.4::DOUBLE', 10, 2)} END AS purchase_cost,
      p_partkey % 50 = 49 AS is_deleted
    FROM part)),
snapshot_slots(slot, d) AS (
  VALUES (1, DATE '2001-06-16'), (2, DATE '2001-06-23'), (3, DATE '2001-06-30'), (4, DATE '2001-06-30')),
inventory_parts AS (
  SELECT l_partkey AS part, slot, d::TIMESTAMP AS sync_time,
    sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END)::INT
      + (CASE WHEN slot = 4 THEN 1 ELSE 0 END) AS fulfillable_quantity,
    sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity ELSE 0 END)::INT
      AS inbound_working_quantity,
    sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_shipdate > d - INTERVAL 365 DAY
      THEN l_quantity ELSE 0 END)::INT AS inbound_shipped_quantity,
    sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_shipdate > d - INTERVAL 365 DAY
      THEN l_quantity ELSE 0 END)::INT AS inbound_receiving_quantity,
    sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_quantity ELSE 0 END)::INT
      AS total_reserved_quantity,
    sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_shipdate > d - INTERVAL 365 DAY
      THEN l_quantity ELSE 0 END)::INT AS total_unfulfillable_quantity
  FROM lineitem JOIN snapshot_slots ON l_shipdate <= d AND l_shipdate > d - INTERVAL 1460 DAY
  WHERE l_partkey % 29 <> 5 AND (slot < 4 OR l_partkey % 7 = 0)
  GROUP BY l_partkey, slot, d),
inventory_snapshot AS (
  SELECT i.part * 10 + slot AS id, {KEY}, asin, i.* EXCLUDE (part),
    fulfillable_quantity + inbound_working_quantity + inbound_shipped_quantity + inbound_receiving_quantity
      + total_reserved_quantity + total_unfulfillable_quantity AS total_quantity,
    'sync-' || slot AS sync_batch_id
  FROM inventory_parts i JOIN product_master p ON p.id = i.part),
stat_slots(slot, d) AS (VALUES (1, DATE '2001-06-23'), (2, DATE '2001-06-30')),
order_windows AS (
  SELECT l_partkey AS part, slot, d AS stat_date,
    sum(CASE WHEN l_shipdate > d - INTERVAL 8 DAY THEN l_quantity ELSE 0 END) AS sales_units_1d,
    sum(CASE WHEN l_shipdate > d - INTERVAL 24 DAY THEN l_quantity ELSE 0 END) AS sales_units_3d,
    sum(CASE WHEN l_shipdate > d - INTERVAL 56 DAY THEN l_quantity ELSE 0 END) AS sales_units_7d,
    sum(CASE WHEN l_shipdate > d - INTERVAL 112 DAY THEN l_quantity ELSE 0 END) AS sales_units_14d,
    sum(CASE WHEN l_shipdate > d - INTERVAL 240 DAY THEN l_quantity ELSE 0 END) AS sales_units_30d,
    sum(CASE WHEN l_shipdate > d - INTERVAL 56 DAY THEN {dec('l_extendedprice', 12, 2)} ELSE 0 END)
      AS sales_amount_7d,
    sum(CASE WHEN l_shipdate > d - INTERVAL 240 DAY THEN {dec('l_extendedprice', 12, 2)} ELSE 0 END)
      AS sales_amount_30d
  FROM lineitem JOIN stat_slots ON l_shipdate <= d AND l_shipdate > d - INTERVAL 400 DAY
  GROUP BY l_partkey, slot, d),
signed_windows AS (
  SELECT part, slot, stat_date, sales_amount_7d, sales_amount_30d,
    (sales_units_1d * s)::INT AS sales_units_1d, (sales_units_3d * s)::INT AS sales_units_3d,
    (sales_units_7d * s)::INT AS sales_units_7d, (sales_units_14d * s)::INT AS sales_units_14d,
    (sales_units_30d * s)::INT AS sales_units_30d
  FROM (SELECT *, CASE WHEN part % 31 = 7 THEN -1 ELSE 1 END AS s FROM order_windows WHERE part % 19 <> 3)),
"""


def averages(source: str) -> str:
    """Averages, trend and rate over a table of unit windows."""
    avg = {n: dec(f"sales_units_{n}d / {n}::DOUBLE", 10, 2) for n in (3, 7, 30)}
    return f"""
  SELECT *, CASE WHEN raw_rate >= 0.15::DOUBLE THEN 'rising' WHEN raw_rate <= -0.15::DOUBLE THEN 'declining'
      ELSE 'stable' END AS sales_trend, {dec('raw_rate', 10, 4)} AS sales_trend_rate
  FROM (
    SELECT *, CASE WHEN avg_daily_sales_30d > 0
        THEN avg_daily_sales_7d::DOUBLE / avg_daily_sales_30d::DOUBLE - 1 ELSE 0 END AS raw_rate
    FROM (SELECT *, {avg[3]} AS avg_daily_sales_3d, {avg[7]} AS avg_daily_sales_7d,
            {avg[30]} AS avg_daily_sales_30d FROM {source}))"""


SOURCES += f"""
sales_summary AS (
  SELECT a.part * 10 + a.slot AS id, {KEY}, asin, a.* EXCLUDE (part, slot),
    sales_units_7d AS sales_7d, sales_units_30d AS sales_30d
  FROM ({averages('signed_windows')}) a JOIN product_master p ON p.id = a.part),
stages AS (
  SELECT p_partkey AS id, 'SELLER-' || p_brand AS seller_id, p_type AS marketplace_id,
    'SKU-' || p_partkey AS seller_sku,
    3 + p_size % 12 AS purchase_lead_time_days, 2 AS domestic_shipping_days,
    6 + p_size % 15 AS international_shipping_days, 3 AS customs_clearance_days, 5 AS amazon_receiving_days,
    7 AS safety_stock_days,
    CASE WHEN p_size % 11 = 0 THEN 0 ELSE 30 + 10 * (p_size % 7) END AS target_cover_days,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE 6 * (1 + p_size % 4) END AS carton_quantity,
    CASE WHEN p_size % 7 = 0 THEN NULL ELSE 20 + p_size END AS moq,
    CASE WHEN p_size % 13 = 0 THEN 'inactive' WHEN p_size % 29 = 0 THEN 'invalid' ELSE 'complete' END
      AS config_status
  FROM part WHERE p_partkey % 23 <> 0),
replenishment_config AS (
  SELECT *, CASE WHEN id % 37 = 11 THEN -1 ELSE 19 + (purchase_lead_time_days - 3)
      + (international_shipping_days - 6) END AS total_replenishment_days
  FROM stages)
"""


def latest(table: str, order: str, condition: str = "true") -> str:
    return f"""(SELECT * EXCLUDE (newest) FROM (SELECT *, row_number() OVER (
        PARTITION BY {KEY} ORDER BY {order} DESC, id DESC) AS newest FROM {table} WHERE {condition}) WHERE newest = 1)"""


def facts(name: str, as_of: str) -> str:
    """The wide SKU row on the data known at a date."""
    inventory = latest("inventory_snapshot", "sync_time", f"sync_time <= DATE '{as_of}'")
    sales = latest("sales_summary", "stat_date", f"stat_date <= DATE '{as_of}'")
    return f"""
{name} AS (
  SELECT p.seller_id, p.marketplace_id, p.seller_sku, p.asin,
    p.current_price::DOUBLE AS current_price, p.purchase_cost::DOUBLE AS purchase_cost,
    p.landed_cost::DOUBLE AS landed_cost, p.gross_margin::DOUBLE AS gross_margin,
    i.id AS inventory_snapshot_id,
    coalesce(i.fulfillable_quantity, 0) AS fulfillable_quantity,
    coalesce(i.total_quantity, 0) AS total_quantity,
    coalesce(i.inbound_shipped_quantity, 0) AS inbound_shipped_quantity,
    coalesce(i.inbound_receiving_quantity, 0) AS inbound_receiving_quantity,
    coalesce(i.total_unfulfillable_quantity, 0) AS total_unfulfillable_quantity,
    coalesce(i.total_reserved_quantity, 0) AS total_reserved_quantity,
    i.id IS NOT NULL AS has_inventory,
    s.id AS sales_summary_id, coalesce(s.sales_7d, 0) AS sales_7d, coalesce(s.sales_30d, 0) AS sales_30d,
    coalesce(s.sales_trend, 'stable') AS sales_trend,
    coalesce(s.sales_trend_rate, 0)::DOUBLE AS sales_trend_rate,
    coalesce(s.avg_daily_sales_7d, 0)::DOUBLE AS avg_daily_sales_7d,
    coalesce(s.avg_daily_sales_30d, 0)::DOUBLE AS avg_daily_sales_30d,
    s.id IS NOT NULL AS has_sales,
    c.id AS replenishment_config_id, c.total_replenishment_days,
    coalesce(c.target_cover_days, 45) AS target_cover_days,
    coalesce(c.safety_stock_days, 0) AS safety_stock_days,
    c.carton_quantity, c.moq, c.config_status, c.id IS NOT NULL AS has_config
  FROM product_master p
  LEFT JOIN {inventory} i USING ({KEY})
  LEFT JOIN {sales} s USING ({KEY})
  LEFT JOIN replenishment_config c USING ({KEY})
  WHERE NOT p.is_deleted)"""


def score(level: str) -> str:
    return f"""CASE {level} WHEN 'critical' THEN 95 WHEN 'high' THEN 80 WHEN 'medium' THEN 55
        WHEN 'low' THEN 20 ELSE 40 END"""


def carton(quantity: str, size: str) -> str:
    return f"""CASE WHEN {quantity} <= 0 THEN 0 WHEN coalesce({size}, 0) <= 0 THEN ceil({quantity})
        ELSE ceil({quantity} / {size}::DOUBLE) * {size} END"""


RISING, FALLING = "sales_trend = 'rising'", "sales_trend = 'declining'"
WEAK = "profitability_signal IN ('loss', 'low_margin', 'unknown')"
COSTLY = "recommended_action IN ('replenish_now', 'clearance_or_reduce_replenishment')"


def rule_rows(name: str, source: str, as_of: str, eta: str = "NULL::DATE") -> str:
    """All rule results on a facts table."""
    first, second, third, fourth, fifth = (f"{name}_{i}" for i in range(1, 6))
    return f"""
{first} AS (
  SELECT *, DATE '{as_of}' AS analysis_date, {eta} AS inbound_eta_date,
    CASE WHEN NOT has_inventory THEN 'missing_inventory' WHEN NOT has_sales THEN 'missing_sales'
      WHEN NOT has_config THEN 'missing_config'
      WHEN avg_daily_sales_7d < 0 OR avg_daily_sales_30d < 0 THEN 'invalid_sales'
      WHEN total_replenishment_days < 0 THEN 'invalid_config' ELSE 'complete' END AS data_quality_status,
    CASE WHEN avg_daily_sales_7d > 0 THEN avg_daily_sales_7d WHEN avg_daily_sales_30d > 0
      THEN avg_daily_sales_30d ELSE 0 END AS daily_sales,
    inbound_shipped_quantity + inbound_receiving_quantity AS effective_inbound_quantity,
    coalesce(total_replenishment_days, 0) AS lead,
    CASE WHEN avg_daily_sales_30d > 0 THEN total_quantity::DOUBLE / avg_daily_sales_30d END AS total_cover_days,
    CASE WHEN sales_30d <= 0 THEN 'no_sales' WHEN {RISING} OR sales_trend_rate >= 0.15 THEN 'rising'
      WHEN {FALLING} OR sales_trend_rate <= -0.15 THEN 'declining' ELSE 'stable' END AS demand_signal,
    (CASE WHEN target_cover_days <= 0 THEN coalesce(total_replenishment_days, 0) + safety_stock_days
      ELSE target_cover_days END)::DOUBLE
      * (CASE WHEN {RISING} THEN 1.15::DOUBLE WHEN {FALLING} THEN 0.8::DOUBLE ELSE 1 END) AS target_days,
    CASE WHEN landed_cost = 0 THEN purchase_cost ELSE landed_cost END AS unit_cost
  FROM {source}),
{second} AS (
  SELECT *, CASE WHEN daily_sales > 0 THEN fulfillable_quantity::DOUBLE / daily_sales END AS available_days,
    CASE WHEN avg_daily_sales_30d > 0 THEN effective_inbound_quantity::DOUBLE / avg_daily_sales_30d END
      AS inbound_cover_days,
    round(CASE demand_signal WHEN 'no_sales' THEN 0
      WHEN 'rising' THEN least(100, 70 + greatest(sales_trend_rate, 0) * 100)
      WHEN 'declining' THEN greatest(10, 45 + sales_trend_rate * 100)
      ELSE CASE WHEN sales_7d > 0 THEN 55 ELSE 35 END END, 4)::DOUBLE AS demand_score,
    CASE demand_signal
      WHEN 'no_sales' THEN 'No recent sales were provided, so demand is treated as no_sales.'
      WHEN 'rising' THEN 'Recent demand is rising, so stockout and replenishment decisions should be more conservative.'
      WHEN 'declining' THEN 'Recent demand is declining, so replenishment should avoid creating excess inventory.'
      ELSE 'Demand is stable based on the current sales trend signal.' END AS demand_explanation,
    CASE WHEN total_quantity <= 0 THEN 'low' WHEN avg_daily_sales_30d <= 0 THEN 'high'
      WHEN total_cover_days >= 180 THEN 'high' WHEN total_cover_days >= 90 THEN 'medium' ELSE 'low' END
      AS overstock_risk_level,
    target_days * avg_daily_sales_30d - fulfillable_quantity - effective_inbound_quantity AS missing_quantity,
    CASE WHEN target_days > 0 THEN ceil(target_days)::INT ELSE 0 END AS recommended_replenishment_days,
    CASE WHEN gross_margin = 0 AND current_price > 0 THEN (current_price - unit_cost) / current_price
      ELSE gross_margin END AS effective_margin
  FROM {first}),
{third} AS (
  SELECT *,
    CASE WHEN fulfillable_quantity <= 0 THEN 'critical' WHEN available_days IS NULL THEN 'unknown'
      WHEN available_days <= safety_stock_days THEN 'critical' WHEN available_days <= lead THEN 'high'
      WHEN available_days <= lead + 7 THEN 'medium' ELSE 'low' END AS base_stockout_level,
    coalesce(datediff('day', analysis_date, inbound_eta_date) <= available_days + 3, false) AS relieved,
    (greatest({score('overstock_risk_level')}, CASE WHEN total_cover_days >= 180 THEN 88 ELSE 0 END,
      CASE WHEN avg_daily_sales_30d <= 0 THEN 85 ELSE 0 END))::DOUBLE AS floored,
    analysis_date + floor(available_days)::INT AS estimated_stockout_date,
    (CASE WHEN daily_sales <= 0 THEN 0 ELSE greatest(
      CASE WHEN lead > coalesce(available_days, 0) THEN ceil((lead - coalesce(available_days, 0)) * daily_sales)
        ELSE 0 END,
      CASE WHEN fulfillable_quantity <= 0 THEN ceil(lead * daily_sales) ELSE 0 END) END)::BIGINT
      AS estimated_lost_sales_units,
    ({carton('missing_quantity', 'carton_quantity')})::BIGINT AS rounded_quantity,
    CASE WHEN current_price <= 0 OR unit_cost <= 0 THEN 'unknown' WHEN effective_margin < 0 THEN 'loss'
      WHEN effective_margin < 0.18::DOUBLE THEN 'low_margin' WHEN effective_margin >= 0.35::DOUBLE
      THEN 'high_margin' ELSE 'healthy' END AS profitability_signal
  FROM {second}),
{fourth} AS (
  SELECT *,
    CASE WHEN relieved AND base_stockout_level = 'critical' THEN 'high'
      WHEN relieved AND base_stockout_level = 'high' THEN 'medium' ELSE base_stockout_level END
      AS stockout_risk_level,
    (SELECT CASE WHEN relieved THEN greatest(20, raised - 15) ELSE raised END FROM (SELECT least(100,
      {score('base_stockout_level')} + CASE WHEN {RISING} AND base_stockout_level IN ('high', 'medium')
      THEN 8 ELSE 0 END) AS raised))::DOUBLE AS stockout_risk_score,
    least(100, floored + CASE WHEN gross_margin < 0.15::DOUBLE AND overstock_risk_level IN ('high', 'medium')
      THEN 8 ELSE 0 END)::DOUBLE AS overstock_risk_score,
    {dec('estimated_lost_sales_units * current_price', 20, 2)}::DOUBLE AS estimated_lost_revenue,
    (CASE WHEN rounded_quantity > 0 AND rounded_quantity < coalesce(moq, 0)
      THEN {carton('moq', 'carton_quantity')} ELSE rounded_quantity END)::BIGINT
      AS recommended_replenishment_quantity,
    CASE profitability_signal
      WHEN 'unknown' THEN 'Price or cost is missing, so replenishment profitability needs review.'
      WHEN 'loss' THEN 'The SKU appears to be selling below landed cost.'
      WHEN 'low_margin' THEN 'Margin is low, so replenishment should require manual review.'
      WHEN 'high_margin' THEN 'Margin is healthy, so replenishment is financially attractive if demand exists.'
      ELSE 'Margin is acceptable for a normal replenishment decision.' END AS profitability_explanation
  FROM {third}),
{fifth} AS (
  SELECT *,
    CASE WHEN data_quality_status <> 'complete' THEN 'complete_missing_data'
      WHEN stockout_risk_level IN ('critical', 'high') AND recommended_replenishment_quantity > 0
        THEN 'replenish_now'
      WHEN stockout_risk_level = 'medium' THEN 'prepare_replenishment'
      WHEN overstock_risk_level = 'high' THEN 'clearance_or_reduce_replenishment'
      ELSE 'keep_monitoring' END AS recommended_action,
    {dec('recommended_replenishment_quantity * unit_cost', 20, 2)}::DOUBLE AS recommended_replenishment_value,
    {WEAK} AND recommended_replenishment_quantity > 0 AS profit_approval_required,
    CASE stockout_risk_level WHEN 'critical' THEN 'urgent' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'normal'
      ELSE 'none' END AS replenishment_urgency,
    (CASE WHEN data_quality_status = 'complete' THEN CASE WHEN avg_daily_sales_7d > 0 THEN 95 ELSE 75 END
      WHEN data_quality_status = 'missing_sales' THEN 50 WHEN data_quality_status = 'missing_config' THEN 40
      WHEN data_quality_status LIKE 'invalid%' THEN 35 ELSE 20 END)::DOUBLE AS confidence_score,
    'Stockout risk is ' || stockout_risk_level || '; fulfillable inventory is ' || fulfillable_quantity
      || ', reserved inventory is ' || total_reserved_quantity || ', available days are '
      || coalesce(printf('%.2f', available_days), 'unknown') || ', lead time is ' || lead || ' days.'
      AS stockout_explanation,
    'SKU ' || seller_sku || ' 当前可售天数为 ' || coalesce(printf('%.2f', available_days) || ' 天', '无法计算')
      || '，断货风险为 ' || stockout_risk_level || '，滞销风险为 ' || overstock_risk_level
      || '，建议补货数量为 ' || recommended_replenishment_quantity || '。' AS action_reason,
    'Recommended quantity is ' || recommended_replenishment_quantity || ', based on target cover days '
      || printf('%.1f', target_days) || ', 30-day average daily sales ' || printf('%.2f', avg_daily_sales_30d)
      || ', available inventory ' || fulfillable_quantity || ', inbound inventory '
      || effective_inbound_quantity || ', MOQ ' || coalesce(moq, 0) || '.' AS replenishment_explanation
  FROM {fourth}),
{name} AS (
  SELECT *, concat_ws(' ', action_reason, decision_explanation, profitability_explanation,
      replenishment_explanation) AS risk_reason,
    decision_approval_required OR {COSTLY} OR recommended_replenishment_quantity >= 500 AS need_manual_approval
  FROM (
    SELECT *,
      CASE recommended_action WHEN 'complete_missing_data' THEN 'unknown' WHEN 'replenish_now'
        THEN stockout_risk_level WHEN 'prepare_replenishment' THEN 'medium'
        WHEN 'clearance_or_reduce_replenishment' THEN 'high' ELSE 'low' END AS final_risk_level,
      (CASE recommended_action WHEN 'complete_missing_data' THEN 45
        WHEN 'replenish_now' THEN CASE WHEN {WEAK} THEN 70 ELSE 88 END
        WHEN 'prepare_replenishment' THEN 78 WHEN 'clearance_or_reduce_replenishment' THEN 82 ELSE 86 END)::DOUBLE
        AS decision_confidence,
      profit_approval_required OR {COSTLY} AS decision_approval_required,
      'Demand signal is ' || demand_signal || '; stockout score is ' || stockout_risk_score
        || '; overstock score is ' || overstock_risk_score || '; profitability signal is '
        || profitability_signal || '; final action is ' || recommended_action || '.' AS decision_explanation
    FROM {fifth}))"""


ANALYSIS_COLUMNS = """
analysis_batch_id, seller_id, marketplace_id, seller_sku, asin, analysis_date, inventory_snapshot_id,
sales_summary_id, replenishment_config_id, fulfillable_quantity, total_quantity, effective_inbound_quantity,
avg_daily_sales_7d, avg_daily_sales_30d, available_days, total_cover_days, inbound_cover_days,
total_replenishment_days, safety_stock_days, estimated_stockout_date, stockout_risk_level, overstock_risk_level,
replenishment_urgency, recommended_replenishment_quantity, recommended_replenishment_date, recommended_action,
action_reason, risk_reason, need_manual_approval, confidence_score, data_quality_status, stockout_risk_score,
overstock_risk_score, estimated_lost_revenue, decision_confidence"""


def analysis_rows(name: str, source: str, batch: str) -> str:
    return f"""
{name} AS (
  SELECT {ANALYSIS_COLUMNS}, total_unfulfillable_quantity, current_price, purchase_cost, landed_cost, gross_margin
  FROM (SELECT * REPLACE (CASE WHEN has_config THEN safety_stock_days END AS safety_stock_days),
    '{batch}' AS analysis_batch_id, NULL::DATE AS recommended_replenishment_date FROM {source}))"""


def stored_rows(name: str, source: str, created: str) -> str:
    return f"""
{name} AS (
  SELECT {ANALYSIS_COLUMNS}, md5(concat_ws(';', analysis_batch_id, {KEY})) AS id, TIMESTAMP '{created}' AS created_at
  FROM (SELECT * REPLACE ({dec('available_days', 10, 2)}::DOUBLE AS available_days,
    {dec('total_cover_days', 10, 2)}::DOUBLE AS total_cover_days,
    {dec('inbound_cover_days', 10, 2)}::DOUBLE AS inbound_cover_days) FROM {source}))"""


TASK_BRANCHES = [
    (
        1,
        "stockout_warning",
        "stockout",
        "stockout_risk_level IN ('critical', 'high')",
        "stockout_risk_level",
        "estimated_lost_revenue",
        "'[Stockout warning] ' || seller_sku || ' has ' || stockout_risk_level || ' stockout risk'",
        "action_reason",
    ),
    (
        2,
        "replenishment_suggestion",
        "replenishment",
        "recommended_action IN ('replenish_now', 'prepare_replenishment')",
        "stockout_risk_level",
        "estimated_lost_revenue",
        "'[Replenishment suggestion] ' || seller_sku || ' replenish ' || recommended_replenishment_quantity || ' units'",
        "action_reason",
    ),
    (
        3,
        "overstock_warning",
        "overstock",
        "overstock_risk_level = 'high'",
        "'high'",
        "overstock_value",
        "'[Overstock warning] ' || seller_sku || ' has excessive inventory cover'",
        "action_reason",
    ),
    (
        4,
        "unfulfillable_inventory_alert",
        "inventory_exception",
        "total_unfulfillable_quantity > 0",
        "'medium'",
        "0",
        "'[Unfulfillable inventory] ' || seller_sku || ' has unfulfillable inventory'",
        "seller_sku || ' currently has ' || total_unfulfillable_quantity || ' unfulfillable units.'",
    ),
    (
        5,
        "data_missing_alert",
        "data_quality",
        "data_quality_status <> 'complete'",
        "CASE WHEN data_quality_status = 'missing_inventory' THEN 'high' ELSE 'medium' END",
        "0",
        "'[Data quality] ' || seller_sku || ' data quality is ' || data_quality_status",
        "seller_sku || ' data quality is ' || data_quality_status || "
        "'; complete the missing data before relying on the recommendation.'",
    ),
]
OVERSTOCK_VALUE = dec("total_quantity * CASE WHEN landed_cost <= 0 THEN 10 ELSE landed_cost END", 20, 2) + "::DOUBLE"
PRIORITY = """CASE WHEN {level} = 'critical' THEN 'P0' WHEN {level} = 'high' AND {value} >= 3000 THEN 'P0'
    WHEN {value} >= 5000 THEN 'P1' WHEN {level} = 'high' THEN 'P1' WHEN {level} = 'low' THEN 'P3' ELSE 'P2' END"""
IMPACT = """CASE WHEN {value} >= 5000 THEN 'high' WHEN {value} >= 1000 THEN 'medium' WHEN {value} > 0 THEN 'low'
    ELSE 'none' END"""
APPROVAL = """CASE WHEN NOT need_manual_approval THEN 'none' WHEN {value} >= 5000 THEN 'manager' ELSE 'operator' END"""


def task_rows(name: str, source: str, created: str = "2001-06-30") -> str:
    branches = " UNION ALL ".join(
        f"""SELECT *, {order} AS task_order, '{kind}' AS task_type, '{problem}' AS problem_type,
            {level} AS risk_level, ({value})::DOUBLE AS impact, {title} AS task_title, {text} AS task_description
            FROM (SELECT *, {OVERSTOCK_VALUE} AS overstock_value FROM {source}) WHERE {condition}"""
        for order, kind, problem, condition, level, value, title, text in TASK_BRANCHES
    )
    return f"""
{name} AS (
  SELECT md5(concat_ws(';', analysis_batch_id, {KEY}, task_type)) AS task_id,
    md5(concat_ws(';', analysis_batch_id, {KEY})) AS analysis_id, {KEY}, asin, task_type, task_title,
    task_description, {PRIORITY.format(level='risk_level', value='impact')} AS priority, risk_level,
    recommended_action AS suggested_action,
    to_json(struct_pack(seller_sku := seller_sku, recommended_quantity := recommended_replenishment_quantity,
      recommended_action := recommended_action, estimated_impact_value := impact,
      estimated_lost_revenue := estimated_lost_revenue, decision_confidence := decision_confidence,
      approval_required := need_manual_approval,
      estimated_stockout_date := estimated_stockout_date::VARCHAR))::VARCHAR AS action_parameters,
    risk_reason AS expected_impact, need_manual_approval AS approval_required, 'pending' AS task_status,
    NULL::VARCHAR AS assigned_to, NULL::VARCHAR AS operator_id, NULL::VARCHAR AS operator_note,
    NULL::TIMESTAMP AS resolved_at, problem_type, {IMPACT.format(value='impact')} AS impact_level,
    impact AS estimated_impact_value, {APPROVAL.format(value='impact')} AS approval_level, analysis_batch_id,
    task_order, TIMESTAMP '{created}' AS created_at
  FROM ({branches}))"""


AS_OF, BATCH = "2001-06-30", "batch-20010630"
FACTS = SOURCES + "," + facts("facts", AS_OF)
RULES = FACTS + "," + rule_rows("rules", "facts", AS_OF)
ANALYSIS = RULES + "," + analysis_rows("analysis_rows", "rules", BATCH)
STORED = ANALYSIS + "," + stored_rows("stored", "analysis_rows", AS_OF)
TASKS = STORED + "," + task_rows("tasks", "analysis_rows")
PRIOR, PRIOR_BATCH = "2001-06-23", "batch-20010623"
BOTH = ",".join(
    [
        STORED,
        facts("prior_facts", PRIOR),
        rule_rows("prior_rules", "prior_facts", PRIOR),
        analysis_rows("prior_analysis", "prior_rules", PRIOR_BATCH),
        stored_rows("prior_stored", "prior_analysis", PRIOR),
        " both_batches AS (SELECT * FROM stored UNION ALL SELECT * FROM prior_stored)",
    ]
)


def enriched(analysis: str) -> str:
    return f"""(SELECT a.*, p.current_price::DOUBLE AS current_price, p.landed_cost::DOUBLE AS landed_cost,
      p.gross_margin::DOUBLE AS gross_margin, s.sales_7d, s.sales_30d, s.sales_trend,
      s.sales_trend_rate::DOUBLE AS sales_trend_rate,
      c.total_replenishment_days AS total_replenishment_lead_time_days, c.target_cover_days, c.moq,
      a.risk_reason AS decision_explanation
    FROM {analysis} a LEFT JOIN product_master p USING ({KEY})
    LEFT JOIN {latest('sales_summary', 'stat_date')} s USING ({KEY})
    LEFT JOIN replenishment_config c USING ({KEY}))"""


STOCKOUT_RANK = """CASE stockout_risk_level WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
    WHEN 'unknown' THEN 4 ELSE 5 END"""
OVERSTOCK_RANK = "CASE overstock_risk_level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
RISK_ORDER = f"{STOCKOUT_RANK}, {OVERSTOCK_RANK}, available_days ASC NULLS FIRST, seller_sku, seller_id, marketplace_id"
OPEN_ORDER = """CASE priority WHEN 'P0' THEN 1 WHEN 'P1' THEN 2 WHEN 'P2' THEN 3 ELSE 4 END, created_at,
    seller_sku, seller_id, marketplace_id, task_order"""
LIST_COLUMNS = """seller_sku, asin, fulfillable_quantity, total_quantity, effective_inbound_quantity,
    avg_daily_sales_7d, avg_daily_sales_30d, available_days, total_cover_days, estimated_stockout_date,
    stockout_risk_level, overstock_risk_level, recommended_replenishment_quantity, recommended_action,
    action_reason, data_quality_status, created_at, current_price, landed_cost, gross_margin, sales_7d, sales_30d,
    sales_trend, sales_trend_rate, total_replenishment_lead_time_days, target_cover_days, safety_stock_days, moq,
    stockout_risk_score, overstock_risk_score, estimated_lost_revenue, decision_confidence, decision_explanation"""
OPEN_COLUMNS = """task_id, seller_sku, asin, task_type, task_title, task_description, priority, risk_level,
    suggested_action, expected_impact, approval_required, task_status, problem_type, impact_level,
    estimated_impact_value, approval_level, created_at"""
TASK_LIST_COLUMNS = """task_id, seller_sku, asin, task_type, task_title, task_description, priority, risk_level,
    suggested_action, approval_required, task_status, created_at, problem_type, impact_level,
    estimated_impact_value, approval_level"""

GROUP_TEXTS = """group_texts(position, id, title, risk_level, priority, recommended_action, summary, points, solution) AS (
  VALUES
  (0, 'critical_stockout', 'Critical stockout risk', 'critical', 'P0', 'replenish_now',
   '存在 critical 断货或已断货任务，需要作为最高优先级处理。',
   '部分 SKU 处于 critical 断货风险|继续延迟可能造成销售损失和排名波动',
   '优先确认可售库存为 0 或可售天数极低的 SKU|立即确认供应商交期并创建补货计划|断货期间谨慎控制广告放量'),
  (1, 'high_stockout', 'High stockout risk', 'high', 'P1', 'replenish_now',
   '存在 high 断货风险任务，需要尽快排入补货处理队列。',
   '部分 SKU 可售库存偏低|补货不及时会进入 critical 风险区间',
   '按预计断货日期排序处理|核对在途库存和实际可售库存|提前确认采购和入仓计划'),
  (2, 'overstock_risk', 'Overstock and slow-moving risk', 'high', 'P1', 'clearance_or_reduce_replenishment',
   '存在高库存或滞销风险，需要控制后续补货并评估清仓动作。',
   '部分 SKU 库存覆盖天数偏高|库存占用可能影响现金流和仓储成本',
   '暂停或降低相关 SKU 补货计划|评估优惠、清仓或广告去库存策略|复查近 30 日销量趋势'),
  (3, 'data_missing', 'Data quality issue', 'unknown', 'P2', 'complete_missing_data',
   '存在数据缺失任务，影响系统判断销量、补货或风险状态。',
   '销量或补货配置缺失会降低分析可信度|数据不完整会影响补货和清仓决策',
   '优先补齐 sales_summary 和 replenishment_config|重新运行库存 Agent|复核数据质量状态是否恢复 complete'),
  (4, 'unfulfillable_inventory', 'Unfulfillable inventory alert', 'medium', 'P2', 'keep_monitoring',
   '存在不可售库存异常任务，需要检查库存状态并处理异常库存。',
   '不可售库存会降低实际可售能力|异常库存可能带来仓储成本和运营误判',
   '检查 FBA 不可售原因|安排移除、弃置或重新上架流程|同步更新库存快照后重新分析'),
  (5, 'other_pending_tasks', 'Other pending operations tasks', 'medium', 'P3', 'keep_monitoring',
   '仍有其他待处理任务，需要在高风险问题处理后继续跟进。',
   '部分任务未归入高风险分组|仍需保持任务闭环',
   '按优先级逐项处理|处理后刷新任务状态|必要时重新运行库存 Agent'))"""
GROUP_OF_TASK = """CASE WHEN risk_level = 'critical' OR priority = 'P0' THEN 'critical_stockout'
    WHEN risk_level = 'high' OR task_type = 'stockout_warning' THEN 'high_stockout'
    WHEN task_type = 'overstock_warning' THEN 'overstock_risk'
    WHEN task_type = 'data_missing_alert' OR suggested_action = 'complete_missing_data' THEN 'data_missing'
    WHEN task_type = 'unfulfillable_inventory_alert' THEN 'unfulfillable_inventory'
    ELSE 'other_pending_tasks' END"""
CARDS = ",".join(
    [
        TASKS,
        f"""
open_50 AS (SELECT *, {GROUP_OF_TASK} AS insight_id, row_number() OVER (ORDER BY {OPEN_ORDER}) AS ord
  FROM tasks WHERE task_status = 'pending' QUALIFY ord <= 50),
top_20 AS (SELECT *, row_number() OVER (ORDER BY {RISK_ORDER}) AS ord FROM stored QUALIFY ord <= 20),
member_skus AS (SELECT insight_id, seller_sku, row_number() OVER (PARTITION BY insight_id ORDER BY seller_sku) - 1
  AS position FROM (SELECT DISTINCT insight_id, seller_sku FROM open_50)),
sentences AS (
  SELECT insight_id, position::INT AS position, m.seller_sku, t.available_days,
    m.seller_sku || ' 当前可售天数约为 ' || printf('%.2f', t.available_days) || ' 天' AS sentence
  FROM member_skus m LEFT JOIN (
    SELECT seller_sku, available_days FROM top_20
    QUALIFY row_number() OVER (PARTITION BY seller_sku ORDER BY ord DESC) = 1) t ON t.seller_sku = m.seller_sku
  WHERE position < 3)""",
        GROUP_TEXTS,
        """
cards AS (
  SELECT g.id, g.title, g.risk_level, g.priority, s.skus AS affected_sku_count, o.n AS task_count, g.summary,
    g.recommended_action, concat_ws('|', g.points, e.texts) AS risk_points, g.solution,
    s.related_skus, o.related_task_ids
  FROM group_texts g
  JOIN (SELECT insight_id, count(*)::INT AS n, string_agg(task_id, '|' ORDER BY ord) AS related_task_ids
        FROM open_50 GROUP BY 1) o ON o.insight_id = g.id
  JOIN (SELECT insight_id, count(*)::INT AS skus, string_agg(seller_sku, '|' ORDER BY seller_sku) AS related_skus
        FROM member_skus GROUP BY 1) s ON s.insight_id = g.id
  LEFT JOIN (SELECT insight_id, string_agg(sentence, '|' ORDER BY position) AS texts FROM sentences
        WHERE sentence IS NOT NULL GROUP BY 1) e ON e.insight_id = g.id),
related AS (
  SELECT DISTINCT o.insight_id, t.* FROM tasks t JOIN open_50 o
    ON t.task_id = o.task_id OR t.seller_sku = o.seller_sku)""",
    ]
)


def json_list(source: str, order: str) -> str:
    return f"(SELECT to_json(list(x ORDER BY {order}))::VARCHAR FROM {source} x)"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S') AS {column}"


TOP_JSON = f"""(SELECT * EXCLUDE (rank) REPLACE (analysis_date::VARCHAR AS analysis_date,
    estimated_stockout_date::VARCHAR AS estimated_stockout_date,
    recommended_replenishment_date::VARCHAR AS recommended_replenishment_date, {iso('created_at')})
    FROM (SELECT *, row_number() OVER (ORDER BY {RISK_ORDER}) AS rank FROM {enriched('stored')}) WHERE rank <= {{n}})"""
OPEN_JSON = f"""(SELECT to_json(list(x ORDER BY ord))::VARCHAR FROM (SELECT struct_pack(
    {', '.join(f'{c.strip()} := {c.strip()}' for c in OPEN_COLUMNS.split(','))}) AS x, ord
    FROM (SELECT * REPLACE ({iso('created_at')}), row_number() OVER (ORDER BY {OPEN_ORDER}) AS ord
    FROM tasks WHERE task_status = 'pending') WHERE ord <= {{n}}))"""
DISTRIBUTION = """SELECT stockout_risk_level, overstock_risk_level, data_quality_status, count(*) AS sku_count
    FROM stored GROUP BY ALL"""
DASHBOARD = f"""SELECT
    (SELECT count(*) FROM product_master WHERE NOT is_deleted) AS total_skus,
    (SELECT count(*) FROM stored WHERE stockout_risk_level = 'critical') AS critical_stockout_count,
    (SELECT count(*) FROM stored WHERE stockout_risk_level = 'high') AS high_stockout_count,
    (SELECT count(*) FROM stored WHERE overstock_risk_level = 'high') AS overstock_high_count,
    (SELECT count(*) FROM stored WHERE data_quality_status <> 'complete') AS data_missing_count,
    (SELECT count(*) FROM tasks WHERE task_status = 'pending') AS pending_task_count,
    (SELECT count(*) FROM tasks) AS total_tasks,
    (SELECT coalesce(sum({dec('estimated_lost_revenue', 12, 2)}), 0)::DOUBLE FROM stored)
      AS estimated_lost_revenue_total,
    (SELECT count(*) FROM tasks WHERE task_status = 'pending'
      AND (impact_level = 'high' OR estimated_impact_value >= 5000)) AS high_impact_task_count,
    (SELECT {dec('avg(decision_confidence)', 14, 8)}::DOUBLE FROM stored) AS avg_decision_confidence,
    (SELECT {dec('avg(stockout_risk_score)', 14, 8)}::DOUBLE FROM stored) AS stockout_risk_score_avg,
    (SELECT {dec('avg(overstock_risk_score)', 14, 8)}::DOUBLE FROM stored) AS overstock_risk_score_avg"""
TOP_LIST = f"""(SELECT to_json(list(x ORDER BY {RISK_ORDER}))::VARCHAR FROM {TOP_JSON} x)"""
DIST_LIST = json_list(
    f"({DISTRIBUTION})", "-sku_count, stockout_risk_level, overstock_risk_level, data_quality_status"
)

STATUS_UPDATES = f"""
status_updates AS (
  SELECT md5(concat_ws(';', '{BATCH}', {KEY}, ['stockout_warning', 'replenishment_suggestion', 'overstock_warning',
      'unfulfillable_inventory_alert', 'data_missing_alert'][event_id % 5 + 1])) AS task_id,
    CASE event_type WHEN 'click' THEN 'resolved' ELSE 'ignored' END AS task_status,
    'user-' || user_id AS operator_id, 'event ' || event_id AS operator_note, ts AS updated_at
  FROM events JOIN product_master p ON p.id = event_id % (SELECT count(*) FROM part)
  WHERE event_type IN ('click', 'error')),
newest_updates AS (SELECT * FROM status_updates QUALIFY row_number() OVER (PARTITION BY task_id
  ORDER BY updated_at DESC, task_status DESC, operator_id DESC, operator_note DESC) = 1)"""


def rule_select(columns: str, source: str = "rules", base: str = RULES) -> str:
    return f"WITH {base} SELECT {KEY}, {columns} FROM {source}"


LEGACY_CONFIG_LEAD = "c.total_replenishment_days"
DASHBOARD_KEYS = (
    ',"skill_output_fields":["estimated_lost_revenue_total","high_impact_task_count","avg_decision_confidence",'
    '"stockout_risk_score_avg","overstock_risk_score_avg","stockout_risk_score","overstock_risk_score",'
    '"estimated_lost_revenue","decision_confidence"],"ai_constraints":["Do not recalculate risk scores.",'
    '"Do not recalculate replenishment quantity.","Do not recalculate approval level or task priority.",'
    '"Only explain the existing rule Skill outputs."]}'
)
SKU_KEYS = (
    ',"skill_output_fields":["gross_margin","sales_trend","stockout_risk_score","overstock_risk_score",'
    '"estimated_lost_revenue","decision_confidence","decision_explanation"],"ai_constraints":["Do not recalculate risk scores.",'
    '"Do not change the recommended action.","Do not change approval decisions.",'
    '"Only explain the evidence already provided by the rule Skill outputs."]}'
)
INSIGHT_KEYS = (
    ',"skill_output_fields":["problem_type","impact_level","estimated_impact_value","approval_level","stockout_risk_score",'
    '"overstock_risk_score","estimated_lost_revenue","decision_confidence"],"ai_constraints":["Do not recalculate task priority.",'
    '"Do not recalculate approval level.","Do not invent new task ids or SKUs.",'
    '"Only group and explain the existing task and Skill outputs."]}'
)
ORACLE_SQL = {
    "source_scan": f"""WITH {SOURCES} SELECT {KEY}, id, asin, product_name, brand, current_price::DOUBLE AS current_price,
        purchase_cost::DOUBLE AS purchase_cost, landed_cost::DOUBLE AS landed_cost,
        gross_margin::DOUBLE AS gross_margin FROM product_master""",
    "coerce_columns": f"""WITH {SOURCES} SELECT id, {KEY},
        CASE WHEN id % 11 = 0 THEN 0 ELSE total_quantity END AS total_quantity,
        CASE WHEN id % 3 = 0 THEN 0 ELSE fulfillable_quantity END AS fulfillable_quantity,
        CASE WHEN id % 13 = 0 THEN NULL ELSE sync_time END AS sync_time,
        CASE WHEN id % 5 = 0 THEN NULL ELSE 0.5::DOUBLE END AS note FROM inventory_snapshot""",
    "active_products": f"""WITH {SOURCES} SELECT {KEY}, id, asin, current_price::DOUBLE AS current_price
        FROM product_master WHERE NOT is_deleted ORDER BY seller_sku""",
    "latest_inventory": f"""WITH {SOURCES} SELECT {KEY}, id, sync_time, sync_batch_id, fulfillable_quantity,
        total_quantity FROM {latest('inventory_snapshot', 'sync_time')}""",
    "latest_sales": f"""WITH {SOURCES} SELECT {KEY}, id, stat_date, sales_7d, sales_30d,
        sales_amount_7d::DOUBLE AS sales_amount_7d, sales_amount_30d::DOUBLE AS sales_amount_30d, sales_trend
        FROM {latest('sales_summary', 'stat_date')}""",
    "config_scan": f"""WITH {SOURCES} SELECT {KEY}, id, total_replenishment_days, safety_stock_days,
        target_cover_days, carton_quantity, moq, config_status FROM replenishment_config""",
    "project_with_defaults": f"""WITH {STORED} SELECT {KEY}, 0 AS current_price, 0 AS landed_cost, 0 AS gross_margin,
        coalesce(s.sales_units_7d, 0) AS sales_7d, coalesce(s.sales_units_30d, 0) AS sales_30d, s.sales_trend,
        0 AS sales_trend_rate, a.total_replenishment_days AS total_replenishment_lead_time_days,
        c.target_cover_days, 0 AS moq, 0 AS decision_confidence
        FROM stored a LEFT JOIN {latest('sales_summary', 'stat_date')} s USING ({KEY})
        LEFT JOIN replenishment_config c USING ({KEY})""",
    "ensure_columns": f"""WITH {SOURCES} SELECT {KEY},
        total_replenishment_days AS total_replenishment_lead_time_days, 45 AS target_cover_days, safety_stock_days,
        1 AS moq FROM replenishment_config""",
    "product_upsert": f"""WITH {SOURCES} SELECT {KEY}, id, asin,
        (current_price + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END)::DOUBLE AS current_price FROM product_master
        UNION ALL SELECT seller_id, marketplace_id, seller_sku || '-B', id + 1000000000, asin,
        current_price::DOUBLE FROM product_master WHERE id % 100 = 1""",
    "stock_position": f"WITH {SOURCES} SELECT {KEY}, id, sync_time, total_quantity FROM inventory_snapshot",
    "sales_windows": f"""WITH {SOURCES} SELECT * REPLACE (sales_amount_7d::DOUBLE AS sales_amount_7d,
        sales_amount_30d::DOUBLE AS sales_amount_30d) FROM order_windows""",
    "avg_daily_sales": f"""WITH {SOURCES} SELECT part, stat_date, avg_daily_sales_3d::DOUBLE AS avg_daily_sales_3d,
        avg_daily_sales_7d::DOUBLE AS avg_daily_sales_7d, avg_daily_sales_30d::DOUBLE AS avg_daily_sales_30d
        FROM ({averages('order_windows')})""",
    "unit_margin": f"""WITH {SOURCES} SELECT {KEY}, current_price::DOUBLE AS current_price,
        landed_cost::DOUBLE AS landed_cost, CASE WHEN current_price > 0 THEN
        {dec('(current_price::DOUBLE - landed_cost::DOUBLE) / current_price::DOUBLE', 10, 4)}::DOUBLE ELSE 0 END
        AS gross_margin FROM product_master""",
    "lead_time_rollup": f"""WITH {SOURCES} SELECT {KEY}, purchase_lead_time_days, domestic_shipping_days,
        international_shipping_days, customs_clearance_days, amazon_receiving_days,
        purchase_lead_time_days + domestic_shipping_days + international_shipping_days + customs_clearance_days
          + amazon_receiving_days AS total_replenishment_days,
        purchase_lead_time_days + domestic_shipping_days + international_shipping_days + customs_clearance_days
          + amazon_receiving_days + safety_stock_days AS reorder_point_days FROM stages""",
    "sales_trend": f"""WITH {SOURCES} SELECT part, stat_date, sales_trend, sales_trend_rate::DOUBLE AS sales_trend_rate
        FROM ({averages('order_windows')})""",
    "sku_facts": f"WITH {FACTS} SELECT * FROM facts",
    "first_present": f"""WITH {SOURCES} SELECT {KEY}, sales_7d, sales_30d, sales_trend, target_cover_days,
        total_replenishment_days, NULL::INT AS moq FROM sales_summary FULL JOIN replenishment_config USING ({KEY})
        """,
    "enriched_analysis": f"WITH {STORED} SELECT * FROM {enriched('stored')}",
    "analysis_lineage": f"""WITH {TASKS} SELECT t.task_id, t.task_type, t.seller_sku, t.analysis_id,
        a.analysis_batch_id, a.inventory_snapshot_id, a.sales_summary_id, a.replenishment_config_id, i.sync_time,
        i.sync_batch_id, s.stat_date, c.config_status
        FROM tasks t LEFT JOIN stored a ON a.id = t.analysis_id
        LEFT JOIN inventory_snapshot i ON i.id = a.inventory_snapshot_id
        LEFT JOIN sales_summary s ON s.id = a.sales_summary_id
        LEFT JOIN replenishment_config c ON c.id = a.replenishment_config_id""",
    "daily_sales": rule_select("avg_daily_sales_7d, avg_daily_sales_30d, daily_sales"),
    "demand_signal": rule_select("demand_signal, demand_score, demand_explanation"),
    "cover_days": rule_select("available_days, total_cover_days, inbound_cover_days"),
    "effective_inbound": rule_select(
        "inbound_shipped_quantity, inbound_receiving_quantity, effective_inbound_quantity"
    ),
    "stockout_date": rule_select("analysis_date, available_days, estimated_stockout_date"),
    "stockout_level": rule_select("fulfillable_quantity, available_days, stockout_risk_level"),
    "stockout_score": "WITH "
    + FACTS
    + ","
    + rule_rows(
        "relief",
        "facts",
        AS_OF,
        f"""CASE WHEN has_inventory AND inventory_snapshot_id % 4 < 2
            THEN DATE '{AS_OF}' + ((inventory_snapshot_id // 10) % 40)::INT END""",
    )
    + f" SELECT {KEY}, inbound_eta_date, base_stockout_level, stockout_risk_level, stockout_risk_score FROM relief",
    "lost_sales": rule_select("estimated_lost_sales_units, estimated_lost_revenue"),
    "overstock_level": rule_select("total_quantity, total_cover_days, overstock_risk_level"),
    "overstock_score": rule_select("overstock_risk_level, overstock_risk_score"),
    "carton_round": rule_select(
        f"total_quantity, carton_quantity, ({carton('total_quantity', 'carton_quantity')})::BIGINT AS rounded_quantity",
        "facts",
        FACTS,
    ),
    "replenish_qty_basic": f"""WITH {RULES} SELECT {KEY},
        ({carton('m', 'carton_quantity')})::BIGINT AS recommended_quantity FROM (SELECT *,
        target_cover_days * avg_daily_sales_30d - fulfillable_quantity - effective_inbound_quantity AS m FROM rules)""",
    "replenish_qty": rule_select(
        "target_days, recommended_replenishment_quantity, recommended_replenishment_days, replenishment_explanation"
    ),
    "profitability": rule_select(
        f"""profitability_signal, {dec('effective_margin', 20, 4)}::DOUBLE AS margin,
        recommended_replenishment_value, profit_approval_required, profitability_explanation"""
    ),
    "decision": rule_select(
        """recommended_action, final_risk_level, decision_confidence, decision_approval_required,
        decision_explanation"""
    ),
    "recommended_action": rule_select("recommended_action"),
    "manual_approval": rule_select(
        f"{COSTLY} OR recommended_replenishment_quantity >= 500 AS action_needs_approval, need_manual_approval"
    ),
    "data_quality": rule_select("has_inventory, has_sales, has_config, data_quality_status"),
    "data_quality_strict": rule_select(
        f"""CASE WHEN NOT has_inventory THEN 'missing_inventory'
        WHEN NOT has_sales OR (avg_daily_sales_7d = 0 AND avg_daily_sales_30d = 0) THEN 'missing_sales'
        WHEN NOT has_config THEN 'missing_config'
        WHEN sales_30d < 0 OR avg_daily_sales_30d <> {dec('sales_30d / 30::DOUBLE', 10, 2)}::DOUBLE
          THEN 'invalid_sales'
        WHEN config_status = 'invalid' OR total_replenishment_days <= 0 OR target_cover_days < safety_stock_days
          THEN 'invalid_config'
        WHEN config_status = 'inactive' THEN 'missing_config' ELSE 'complete' END AS data_quality_status""",
        "facts",
        FACTS,
    ),
    "urgency_confidence": rule_select("replenishment_urgency, confidence_score"),
    "explanations": rule_select("action_reason, stockout_explanation, profitability_explanation, risk_reason"),
    "analysis": f"WITH {ANALYSIS} SELECT * FROM analysis_rows",
    "tasks": f"WITH {TASKS} SELECT * FROM tasks",
    "task_priority": rule_select(
        f"""stockout_risk_level, estimated_lost_revenue,
        {PRIORITY.format(level='stockout_risk_level', value='estimated_lost_revenue')} AS priority"""
    ),
    "task_impact_approval": rule_select(
        f"""{IMPACT.format(value='estimated_lost_revenue')} AS impact_level,
        {APPROVAL.format(value='estimated_lost_revenue')} AS approval_level"""
    ),
    "overstock_value": rule_select(f"{OVERSTOCK_VALUE} AS estimated_overstock_value", "facts", FACTS),
    "task_payload": f"WITH {TASKS} SELECT task_id, action_parameters FROM tasks",
    "apply_status_updates": f"""WITH {TASKS}, {STATUS_UPDATES}
        SELECT task_id, coalesce(u.task_status, t.task_status) AS task_status, u.operator_id, u.operator_note,
          u.updated_at AS resolved_at, true AS is_known FROM tasks t LEFT JOIN newest_updates u USING (task_id)
        UNION ALL SELECT task_id, task_status, operator_id, operator_note, updated_at, false FROM newest_updates
        WHERE task_id NOT IN (SELECT task_id FROM tasks)""",
    "dashboard_summary": f"WITH {TASKS} {DASHBOARD}",
    "risk_distribution": f"WITH {STORED} {DISTRIBUTION} ORDER BY sku_count DESC",
    "top_risk_skus": f"WITH {STORED} SELECT * FROM {enriched('stored')} ORDER BY {RISK_ORDER} LIMIT 20",
    "analysis_list": f"""WITH {STORED} SELECT {LIST_COLUMNS} FROM {enriched('stored')}
        WHERE stockout_risk_level = 'high' AND seller_sku ILIKE '%ku-1%' ORDER BY seller_sku""",
    "analysis_detail": f"""WITH {BOTH} SELECT {LIST_COLUMNS} FROM {enriched('both_batches')}
        WHERE lower(seller_sku) = 'sku-12' ORDER BY created_at DESC, id DESC LIMIT 1""",
    "open_tasks": f"""WITH {TASKS} SELECT {OPEN_COLUMNS} FROM tasks WHERE task_status = 'pending'
        ORDER BY {OPEN_ORDER} LIMIT 50""",
    "tasks_by_sku": f"WITH {TASKS} SELECT {OPEN_COLUMNS} FROM tasks WHERE lower(seller_sku) = 'sku-12'",
    "task_list": f"""WITH {TASKS} SELECT {TASK_LIST_COLUMNS} FROM tasks WHERE priority = 'P0'
        AND task_status = 'pending' AND seller_sku ILIKE '%ku-1%'""",
    "run_summary": f"""WITH {TASKS} SELECT count(*) AS analyzed_skus,
        count(*) FILTER (stockout_risk_level = 'critical') AS critical_stockout_skus,
        count(*) FILTER (stockout_risk_level = 'high') AS high_stockout_skus,
        count(*) FILTER (overstock_risk_level = 'high') AS overstock_high_skus,
        (SELECT count(*) FROM tasks) AS generated_tasks FROM stored""",
    "batch_stats": f"""WITH {BOTH} SELECT analysis_batch_id, count(*) AS row_count,
        count(*) FILTER (stockout_risk_level = 'critical') AS critical_count, max(created_at) AS created_at
        FROM both_batches GROUP BY analysis_batch_id""",
    "task_type_counts": f"WITH {TASKS} SELECT task_type, priority, count(*) AS task_count FROM tasks GROUP BY ALL",
    "data_quality_report": f"""WITH {RULES} SELECT count(*) AS total_skus,
        (SELECT count(*) FROM rules WHERE NOT has_inventory) AS without_inventory,
        (SELECT count(*) FROM rules WHERE NOT has_sales) AS without_sales,
        (SELECT count(*) FROM rules WHERE NOT has_config) AS without_config,
        count(*) FILTER (data_quality_status LIKE 'missing%') AS missing_any,
        count(*) FILTER (data_quality_status LIKE 'invalid%') AS invalid_values,
        count(*) FILTER (data_quality_status <> 'complete') AS not_complete, true AS is_consistent FROM rules""",
    "pending_today": f"""WITH {TASKS} SELECT count(*) AS pending_count FROM tasks
        WHERE task_status = 'pending' AND created_at::DATE = DATE '{AS_OF}'""",
    "latest_batch": f"""WITH {BOTH} SELECT analysis_batch_id, {KEY}, stockout_risk_level, created_at FROM both_batches
        WHERE created_at = (SELECT max(created_at) FROM both_batches)""",
    "analysis_page": f"""WITH {STORED} SELECT seller_sku, seller_id, marketplace_id, stockout_risk_level, available_days
        FROM stored ORDER BY seller_sku, seller_id, marketplace_id LIMIT 25 OFFSET 50""",
    "insight_groups": f"""WITH {TASKS}, {GROUP_TEXTS} SELECT id, title, g.risk_level, g.priority,
        recommended_action, count(DISTINCT seller_sku) AS affected_sku_count, count(*) AS task_count, summary
        FROM (SELECT *, {GROUP_OF_TASK} AS insight_id FROM tasks WHERE task_status = 'pending') t
        JOIN group_texts g ON g.id = t.insight_id GROUP BY ALL""",
    "insight_cards": f"WITH {CARDS} SELECT * FROM cards",
    "insight_sku_lookup": f"WITH {CARDS} SELECT * FROM sentences",
    "insight_related_tasks": f"WITH {CARDS} SELECT insight_id, task_id, seller_sku, task_type, priority FROM related",
    "insight_rollup": f"""WITH {CARDS} SELECT insight_id, count(*) AS related_task_count,
        sum({dec('estimated_impact_value', 12, 2)})::DOUBLE AS estimated_impact_value,
        CASE WHEN bool_or(impact_level = 'high') THEN 'high' WHEN bool_or(impact_level = 'medium') THEN 'medium'
          WHEN bool_or(impact_level = 'low') THEN 'low' ELSE 'unknown' END AS impact_level,
        CASE WHEN bool_or(approval_level = 'manager') THEN 'manager' WHEN bool_or(approval_level = 'operator')
          THEN 'operator' ELSE 'none' END AS approval_level FROM related GROUP BY insight_id
        UNION ALL SELECT 'no_tasks', 0, 0, 'unknown', 'none'""",
    "insight_first_value": f"""WITH {CARDS}, placed AS (SELECT *, row_number() OVER (PARTITION BY insight_id
          ORDER BY created_at DESC, seller_sku DESC, seller_id DESC, marketplace_id DESC, task_order DESC) AS ord
        FROM related)
        SELECT insight_id, arg_min(impact_level, ord) AS impact_level,
          coalesce(arg_min(estimated_impact_value, ord) FILTER (estimated_impact_value <> 0), 0)
            AS estimated_impact_value,
          arg_min(approval_level, ord) AS approval_level FROM placed GROUP BY insight_id
        UNION ALL SELECT 'no_tasks', 'unknown', 0, 'none'""",
    "insight_json_parse": f"""WITH {TASKS}, grouped AS (
          SELECT substr(seller_sku, 5)::BIGINT AS reply_id, seller_sku, {GROUP_OF_TASK} AS insight_id,
            count(*) AS n, string_agg(task_id, '|' ORDER BY task_id) AS ids
          FROM tasks WHERE task_status = 'pending' GROUP BY 1, 2, 3),
        placed AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY insight_id) - 1 AS position FROM grouped)
        SELECT reply_id, true AS is_valid, position::INT AS position,
          CASE WHEN reply_id % 3 <> 0 THEN insight_id WHEN reply_id % 5 <> 0 THEN 'risk_' || insight_id
            ELSE 'risk_insight_' || (position + 1) END AS id,
          CASE WHEN reply_id % 5 <> 0 THEN 'Risk: ' || insight_id || '!'
            ELSE 'Risk insight ' || (position + 1) END AS title,
          'unknown' AS risk_level, 'P3' AS priority,
          CASE WHEN reply_id % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS affected_sku_count, n AS task_count,
          '' AS summary, 'keep_monitoring' AS recommended_action, '' AS risk_points, '' AS solution,
          seller_sku AS related_skus, ids AS related_task_ids
        FROM placed WHERE reply_id % 4 < 3
        UNION ALL SELECT DISTINCT reply_id, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
          NULL, NULL FROM placed WHERE reply_id % 4 = 3""",
    "explain_context": f"""WITH {TASKS}
        SELECT 'dashboard_summary' AS context, '{{"dashboard_summary":'
          || (SELECT to_json(x)::VARCHAR FROM ({DASHBOARD}) x)
          || ',"risk_distribution":' || {DIST_LIST} || ',"top_risk_skus":' || {TOP_LIST.format(n=10)}
          || ',"open_tasks":' || {OPEN_JSON.format(n=20)} || '{DASHBOARD_KEYS}' AS payload
        UNION ALL SELECT 'task_priority', '{{"open_tasks":' || {OPEN_JSON.format(n=40)} || '}}'
        UNION ALL SELECT 'task_insights', '{{"open_tasks":' || {OPEN_JSON.format(n=50)}
          || ',"top_risk_skus":' || {TOP_LIST.format(n=20)} || ',"risk_distribution":' || {DIST_LIST} || '{INSIGHT_KEYS}'""",
    "explain_context_sku": f"""WITH {TASKS}, listed AS (
          SELECT analysis_id, list(struct_pack(
            {', '.join(f'{c.strip()} := {c.strip()}' for c in OPEN_COLUMNS.split(','))}) ORDER BY task_order DESC) AS l
          FROM (SELECT * REPLACE ({iso('created_at')}) FROM tasks) GROUP BY analysis_id)
        SELECT {KEY}, '{{"sku_detail":' || to_json(e)::VARCHAR || ',"sku_tasks":'
          || coalesce(to_json(l)::VARCHAR, '[]') || '{SKU_KEYS}' AS payload
        FROM (SELECT * REPLACE (analysis_date::VARCHAR AS analysis_date,
            estimated_stockout_date::VARCHAR AS estimated_stockout_date,
            recommended_replenishment_date::VARCHAR AS recommended_replenishment_date, {iso('created_at')})
          FROM {enriched('stored')}) e LEFT JOIN listed ON listed.analysis_id = e.id""",
    "stream_sales_daily": f"""WITH {SOURCES} SELECT {KEY}, ts::DATE AS sold_on, count(*) AS units,
        sum({dec('value', 12, 2)})::DOUBLE AS amount
        FROM events JOIN product_master p ON p.id = event_id % (SELECT count(*) FROM part)
        WHERE event_type = 'purchase' GROUP BY ALL""",
    "stream_latest_inventory": f"""WITH {SOURCES} SELECT {KEY}, id, sync_time, sync_batch_id, fulfillable_quantity,
        total_quantity FROM {latest('inventory_snapshot', 'sync_time')}""",
    "stream_stockout_alerts": f"""WITH {TASKS} SELECT task_id, {KEY}, task_title, priority, risk_level,
        estimated_impact_value FROM tasks JOIN stored a USING ({KEY})
        WHERE task_type = 'stockout_warning' AND a.inventory_snapshot_id IS NOT NULL""",
}
# The stand-alone cascade counts a missing status as not complete; the Spark query blanks one status to show it.

# The newest of two stored batches gives the same reports as that batch alone.
for _name in ("dashboard_summary", "risk_distribution", "top_risk_skus", "open_tasks", "insight_groups", "explain_context_sku"):
    ORACLE_SQL[f"current_{_name}"] = ORACLE_SQL[_name]
ORACLE_SQL["batch_replace"] = ORACLE_SQL["batch_stats"]

ORACLE_SQL["insight_json_repair"] = f"""WITH {TASKS} SELECT substr(seller_sku, 5)::BIGINT AS reply_id, true AS is_valid,
    0 AS position, 'nan_infinity' AS id, seller_sku || ', NaN, "' || chr(92) || '", -Infinity' AS title, 'unknown' AS risk_level,
    'P3' AS priority, 0 AS affected_sku_count, count(*) AS task_count, '[NaN]' AS summary,
    'keep_monitoring' AS recommended_action, '' AS risk_points, '' AS solution, seller_sku AS related_skus, '' AS related_task_ids
    FROM tasks GROUP BY seller_sku"""

ORACLE_SQL["insight_cards_of_sellers"] = f"""WITH {TASKS}, {GROUP_TEXTS},
    grouped AS (SELECT *, {GROUP_OF_TASK} AS insight_id FROM tasks WHERE task_status = 'pending'),
    ids AS (SELECT seller_id, insight_id, string_agg(task_id, '|' ORDER BY ord) FILTER (ord <= 10) AS related_task_ids,
        count(*)::INT AS task_count, count(DISTINCT seller_sku)::INT AS affected_sku_count
      FROM (SELECT *, row_number() OVER (PARTITION BY seller_id, insight_id ORDER BY {OPEN_ORDER}) AS ord FROM grouped)
      GROUP BY ALL),
    skus AS (SELECT seller_id, insight_id, seller_sku, row_number() OVER (PARTITION BY seller_id, insight_id
      ORDER BY seller_sku) AS place FROM (SELECT DISTINCT seller_id, insight_id, seller_sku FROM grouped)),
    worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY {RISK_ORDER}) AS ord FROM stored)
      WHERE ord <= 20),
    told AS (SELECT s.*, CASE WHEN place <= 3 THEN s.seller_sku || ' 当前可售天数约为 ' || printf('%.2f', w.available_days) || ' 天' END AS text
      FROM skus s LEFT JOIN (SELECT seller_id, seller_sku, available_days FROM worst
        QUALIFY row_number() OVER (PARTITION BY seller_id, seller_sku ORDER BY ord DESC) = 1) w USING (seller_id, seller_sku)),
    lists AS (SELECT seller_id, insight_id, string_agg(seller_sku, '|' ORDER BY place) FILTER (place <= 10) AS related_skus,
      string_agg(text, '|' ORDER BY place) FILTER (text IS NOT NULL) AS texts FROM told GROUP BY ALL)
    SELECT seller_id, g.id, g.title, g.risk_level, g.priority, affected_sku_count, task_count, g.summary, g.recommended_action,
      concat_ws('|', g.points, texts) AS risk_points, g.solution, related_skus, related_task_ids
    FROM ids JOIN lists USING (seller_id, insight_id) JOIN group_texts g ON g.id = insight_id"""

# Stored tables give what their plain twins give.
for _name in (
    ["enriched_analysis", "top_risk_skus", "analysis_list", "analysis_detail", "tasks_by_sku"]
    + ["latest_inventory", "latest_sales", "product_upsert"]
):
    ORACLE_SQL[f"stored_{_name}"] = ORACLE_SQL[_name]
ORACLE_SQL["sales_windows_of_days"] = ORACLE_SQL["sales_windows"]
ORACLE_SQL["stream_raised_alerts"] = ORACLE_SQL["stream_stockout_alerts"]
ORACLE_SQL["stored_status_overlay"] = ORACLE_SQL["apply_status_updates"]
ORACLE_SQL["stored_status_folded"] = f"""WITH {TASKS}, {STATUS_UPDATES}
    SELECT task_id, coalesce(u.task_status, t.task_status) AS task_status, u.operator_id, u.operator_note,
      u.updated_at AS resolved_at FROM tasks t LEFT JOIN newest_updates u USING (task_id)"""
ORACLE_SQL["stored_full_refresh"] = f"WITH {SOURCES} " + " UNION ALL ".join(
    f"SELECT '{_name}' AS table_name, count(*) AS row_count, count(DISTINCT id) AS id_count, sum(id)::BIGINT AS id_sum FROM {_name}"
    for _name in ("product_master", "inventory_snapshot", "sales_summary", "replenishment_config")
)
