"""Table layouts and the fixed value lists of the inventory model."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["seller_id", "marketplace_id", "seller_sku"]


_SIMPLE_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _data_type(kind: str) -> T.DataType:
    if kind.startswith("decimal("):
        precision, scale = kind[len("decimal(") : -1].split(",")
        return T.DecimalType(int(precision), int(scale))
    return _SIMPLE_TYPES[kind]


def _layout(text: str) -> T.StructType:
    """Build a layout from ``name type`` lines."""
    pairs = (line.split() for line in text.strip().splitlines())
    return T.StructType([T.StructField(name, _data_type(kind)) for name, kind in pairs])


# The layouts below are fixed values: column names and types that other programs read.
PRODUCT_COLUMNS = """
id bigint
seller_id string
marketplace_id string
marketplace_name string
seller_sku string
asin string
fn_sku string
product_name string
brand string
product_type string
category_name string
current_price decimal(10,2)
purchase_cost decimal(10,2)
landed_cost decimal(10,2)
gross_margin decimal(10,4)
condition_type string
fulfillment_channel string
listing_status string
lifecycle_stage string
launch_date date
is_deleted boolean
created_at timestamp_ntz
updated_at timestamp_ntz
"""

INVENTORY_COLUMNS = """
id bigint
seller_id string
marketplace_id string
seller_sku string
asin string
fn_sku string
condition_type string
total_quantity int
fulfillable_quantity int
inbound_working_quantity int
inbound_shipped_quantity int
inbound_receiving_quantity int
total_reserved_quantity int
pending_customer_order_quantity int
pending_transshipment_quantity int
fc_processing_quantity int
total_unfulfillable_quantity int
total_researching_quantity int
amazon_last_updated_time timestamp_ntz
sync_batch_id string
sync_time timestamp_ntz
"""

SALES_COLUMNS = """
id bigint
seller_id string
marketplace_id string
seller_sku string
asin string
stat_date date
sales_units_1d int
sales_units_3d int
sales_units_7d int
sales_units_14d int
sales_units_30d int
sales_7d int
sales_30d int
avg_daily_sales_3d decimal(10,2)
avg_daily_sales_7d decimal(10,2)
avg_daily_sales_30d decimal(10,2)
sales_amount_7d decimal(12,2)
sales_amount_30d decimal(12,2)
currency string
sales_trend string
sales_trend_rate decimal(10,4)
data_source string
"""

CONFIG_COLUMNS = """
id bigint
seller_id string
marketplace_id string
seller_sku string
supplier_name string
purchase_lead_time_days int
domestic_shipping_days int
international_shipping_days int
customs_clearance_days int
amazon_receiving_days int
total_replenishment_days int
total_replenishment_lead_time_days int
safety_stock_days int
target_stock_days int
target_cover_days int
max_stock_days int
moq int
carton_quantity int
case_pack_quantity int
preferred_shipping_method string
reorder_point_days int
config_status string
"""

ANALYSIS_COLUMNS = """
analysis_batch_id string
seller_id string
marketplace_id string
seller_sku string
asin string
analysis_date date
inventory_snapshot_id bigint
sales_summary_id bigint
replenishment_config_id bigint
fulfillable_quantity int
total_quantity int
effective_inbound_quantity int
avg_daily_sales_7d decimal(10,2)
avg_daily_sales_30d decimal(10,2)
available_days decimal(10,2)
total_cover_days decimal(10,2)
inbound_cover_days decimal(10,2)
total_replenishment_days int
safety_stock_days int
estimated_stockout_date date
stockout_risk_level string
overstock_risk_level string
replenishment_urgency string
recommended_replenishment_quantity int
recommended_replenishment_date date
recommended_action string
action_reason string
risk_reason string
need_manual_approval boolean
confidence_score decimal(5,2)
data_quality_status string
stockout_risk_score decimal(10,4)
overstock_risk_score decimal(10,4)
estimated_lost_revenue decimal(12,2)
decision_confidence decimal(10,4)
"""

TASK_COLUMNS = """
task_id string
analysis_id string
seller_id string
marketplace_id string
seller_sku string
asin string
task_type string
task_title string
task_description string
priority string
risk_level string
suggested_action string
action_parameters string
expected_impact string
approval_required boolean
task_status string
assigned_to string
operator_id string
operator_note string
resolved_at timestamp_ntz
problem_type string
impact_level string
estimated_impact_value decimal(12,2)
approval_level string
"""

STATUS_UPDATE_COLUMNS = """
task_id string
task_status string
operator_id string
operator_note string
updated_at timestamp_ntz
"""

PRODUCTS = _layout(PRODUCT_COLUMNS)
INVENTORY = _layout(INVENTORY_COLUMNS)
SALES = _layout(SALES_COLUMNS)
CONFIGS = _layout(CONFIG_COLUMNS)
ANALYSIS = _layout(ANALYSIS_COLUMNS)
TASKS = _layout(TASK_COLUMNS)
STATUS_UPDATES = _layout(STATUS_UPDATE_COLUMNS)

# Bookkeeping columns added to the stored tables: row id and creation time, and for tasks the batch and the
# position of the task among those of its SKU. Together with the key they replace a running number.
STORED_ANALYSIS = T.StructType(
    [*ANALYSIS.fields, T.StructField("id", T.StringType()), T.StructField("created_at", T.TimestampNTZType())]
)
STORED_TASKS = T.StructType(
    [
        *TASKS.fields,
        T.StructField("analysis_batch_id", T.StringType()),
        T.StructField("task_order", T.IntegerType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

# Tables that the streams keep: sales per SKU and day, and the alert that a SKU calls for, if any.
DAILY_SALES = _layout(
    """
seller_id string
marketplace_id string
seller_sku string
sold_on date
units bigint
amount decimal(22,2)
"""
)
ALERT_STATES = T.StructType(
    [
        *[field for field in STORED_TASKS.fields if field.name in KEY],
        T.StructField("sync_time", T.TimestampNTZType()),
        T.StructField("snapshot_id", T.LongType()),
        *[field for field in STORED_TASKS.fields if field.name not in KEY],
    ]
)

SOURCE_TABLES = {
    "product_master": PRODUCTS,
    "inventory_snapshot": INVENTORY,
    "sales_summary": SALES,
    "replenishment_config": CONFIGS,
}

# Columns added by later table versions, with the value older rows get (fixed values).
LATER_COLUMNS = {
    "product_master": {
        "current_price": ("decimal(10,2)", 0),
        "purchase_cost": ("decimal(10,2)", 0),
        "landed_cost": ("decimal(10,2)", 0),
        "gross_margin": ("decimal(10,4)", 0),
    },
    "sales_summary": {
        "sales_7d": ("int", 0),
        "sales_30d": ("int", 0),
        "sales_trend": ("string", None),
        "sales_trend_rate": ("decimal(10,4)", 0),
    },
    "replenishment_config": {
        "total_replenishment_lead_time_days": ("int", 0),
        "target_cover_days": ("int", 45),
        "safety_stock_days": ("int", 7),
        "moq": ("int", 1),
    },
    "analysis": {
        "stockout_risk_score": ("decimal(10,4)", 0),
        "overstock_risk_score": ("decimal(10,4)", 0),
        "estimated_lost_revenue": ("decimal(12,2)", 0),
        "decision_confidence": ("decimal(10,4)", 0),
    },
    "tasks": {
        "problem_type": ("string", None),
        "impact_level": ("string", None),
        "estimated_impact_value": ("decimal(12,2)", 0),
        "approval_level": ("string", "none"),
    },
}
