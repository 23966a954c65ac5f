"""Inventory model derived from a part / lineitem / events star schema.

Used where no inventory tables exist, as in the tests and the bench: parts become products and settings, order
lines become stock snapshots and sales, click and error events become status changes.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockrisk.functions import measures as m
from stockrisk.operators.measures import (
    SALES_WINDOWS,
    trailing_sales,
    unfold,
    with_lead_time,
    with_sales_averages,
    with_stock_total,
)
from stockrisk.operators.tasks import TASK_TYPES, task_id
from stockrisk.schemas import CONFIGS, INVENTORY, KEY, PRODUCTS, SALES, STATUS_UPDATES
from stockrisk.sources.tables import read_table

AS_OF = date(2001, 6, 30)
PRIOR_AS_OF = date(2001, 6, 23)
BATCH_ID = "batch-20010630"
PRIOR_BATCH_ID = "batch-20010623"
CREATED_AT = datetime(2001, 6, 30)
PRIOR_CREATED_AT = datetime(2001, 6, 23)

SNAPSHOT_DATES = [date(2001, 6, 16), date(2001, 6, 23), date(2001, 6, 30)]
STAT_DATES = [date(2001, 6, 23), date(2001, 6, 30)]
STOCK_HISTORY_DAYS = 1460
SALES_HISTORY_DAYS = 400
MODEL_DAY = 8  # calendar days per sales day: order lines per part are sparse

_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
_TEXT, _TIME = T.StringType(), T.TimestampNTZType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


RAW_TABLES = {
    "part": _fields(
        p_partkey=_LONG, p_name=_TEXT, p_brand=_TEXT, p_type=_TEXT, p_size=_INT, p_retailprice=_DOUBLE
    ),
    "lineitem": _fields(
        l_orderkey=_LONG,
        l_partkey=_LONG,
        l_suppkey=_LONG,
        l_linenumber=_INT,
        l_quantity=_DOUBLE,
        l_extendedprice=_DOUBLE,
        l_discount=_DOUBLE,
        l_tax=_DOUBLE,
        l_returnflag=_TEXT,
        l_linestatus=_TEXT,
        l_shipdate=_TIME,
    ),
    "events": _fields(
        event_id=_LONG, ts=_TIME, user_id=_LONG, event_type=_TEXT, value=_DOUBLE, props=_TEXT
    ),
}


def raw_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", RAW_TABLES[name])


SELLER, SKU = "concat('SELLER-', p_brand)", "concat('SKU-', p_partkey)"
ASIN = "concat('B', lpad(cast(p_partkey AS string), 9, '0'))"
PART_KEYS = [f"{SELLER} AS seller_id", "p_type AS marketplace_id", f"{SKU} AS seller_sku"]


def _part_keys(parts: DataFrame) -> DataFrame:
    """Part number with the three business keys."""
    return parts.selectExpr("p_partkey AS part", *PART_KEYS, f"{ASIN} AS asin")


def products(spark: SparkSession, folder: str) -> DataFrame:
    priced = raw_table(spark, folder, "part").selectExpr(
        "*",
        "cast(p_retailprice / 40D AS decimal(10,2)) AS current_price",
        """CASE WHEN p_size % 17 = 0 THEN cast(0 AS decimal(10,2))
            ELSE cast(p_retailprice / 40D * (0.55D + 0.01D * p_size) AS decimal(10,2)) END AS landed_cost""",
        """CASE WHEN p_size % 34 = 0 THEN cast(0 AS decimal(10,2))
            ELSE cast(p_retailprice / 40D * 0.4D AS decimal(10,2)) END AS purchase_cost""",
    )
    margin = m.unit_margin("current_price", "landed_cost")
    return priced.selectExpr(
        "p_partkey AS id",
        *PART_KEYS,
        f"{ASIN} AS asin",
        "p_name AS product_name",
        "p_brand AS brand",
        "current_price",
        "purchase_cost",
        "landed_cost",
        f"CASE WHEN p_size % 3 = 0 THEN cast(0 AS decimal(10,4)) ELSE {margin} END AS gross_margin",
        "p_partkey % 50 = 49 AS is_deleted",
    ).to(PRODUCTS)


# Fixed values of the mapping: return flag, line status and days of history of each stock quantity.
STOCK_MEANING = {
    "fulfillable_quantity": ("N", "F", 1460),
    "inbound_working_quantity": ("N", "O", 1460),
    "inbound_shipped_quantity": ("A", "O", 365),
    "inbound_receiving_quantity": ("R", "O", 365),
    "total_reserved_quantity": ("A", "F", 1460),
    "total_unfulfillable_quantity": ("R", "F", 365),
}


def inventory_snapshots(spark: SparkSession, folder: str, until: date = AS_OF) -> DataFrame:
    """Three dated stock positions per part, and a corrected one on the last day for every seventh part.

    One aggregation over the lines serves all dates; its few sums per part are then joined to the keys and
    unfolded into rows.
    """
    dates = [day for day in SNAPSHOT_DATES if day <= until]

    def within(end: date, days: int) -> str:
        start = end - timedelta(days=days)
        return f"l_shipdate <= timestamp_ntz'{end}' AND l_shipdate > timestamp_ntz'{start}'"

    sums = []
    for slot, end in enumerate(dates, 1):
        sums.append(F.expr(f"count_if({within(end, STOCK_HISTORY_DAYS)}) AS lines_{slot}"))
        for name, (flag, status, days) in STOCK_MEANING.items():
            counted = f"l_returnflag = '{flag}' AND l_linestatus = '{status}' AND {within(end, days)}"
            sums.append(F.expr(f"sum(CASE WHEN {counted} THEN l_quantity ELSE 0D END) AS {name}_{slot}"))
    history = (dates[-1] - dates[0]).days + STOCK_HISTORY_DAYS
    lines = raw_table(spark, folder, "lineitem").filter(
        f"{within(dates[-1], history)} AND l_partkey % 29 <> 5"
    )
    totals = lines.groupBy(F.col("l_partkey").alias("part")).agg(*sums)

    # Slot 4 repeats the last date with one more unit on hand.
    sources = list(range(1, len(dates) + 1))
    if len(dates) == len(SNAPSHOT_DATES):
        sources.append(len(dates))
    wide = {name: [f"cast({name}_{source} AS int)" for source in sources] for name in STOCK_MEANING}
    wide["lines"] = [f"lines_{source}" for source in sources]
    wide["sync_time"] = [f"timestamp_ntz'{dates[source - 1]}'" for source in sources]
    keyed = totals.join(_part_keys(raw_table(spark, folder, "part")).hint("merge"), "part")
    rows = unfold(keyed, [*KEY, "asin", "part"], wide).filter("lines > 0 AND (slot < 4 OR part % 7 = 0)")
    positions = rows.selectExpr(
        "part * 10 + slot AS id",
        *KEY,
        "asin",
        "fulfillable_quantity + CASE slot WHEN 4 THEN 1 ELSE 0 END AS fulfillable_quantity",
        *list(STOCK_MEANING)[1:],
        "0 AS total_researching_quantity",
        "concat('sync-', slot) AS sync_batch_id",
        "sync_time",
    )
    return with_stock_total(positions).to(INVENTORY)


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as dated sales of a part; amounts are exact decimals, so sums do not depend on order."""
    return raw_table(spark, folder, "lineitem").selectExpr(
        "l_partkey AS part",
        "l_shipdate AS sold_on",
        "l_quantity AS units",
        "cast(l_extendedprice AS decimal(12,2)) AS amount",
    )


def sales_summaries(spark: SparkSession, folder: str, until: date = AS_OF) -> DataFrame:
    dates = [day for day in STAT_DATES if day <= until]
    lines = order_lines(spark, folder).filter("part % 19 <> 3")
    totals = trailing_sales(lines, ["part"], dates, MODEL_DAY, SALES_HISTORY_DAYS)
    # Every 31st part carries unusable (negative) units.
    sign = "CASE WHEN part % 31 = 7 THEN -1 ELSE 1 END"
    units = [f"cast(sales_units_{n}d * {sign} AS int) AS sales_units_{n}d" for n in SALES_WINDOWS]
    signed = totals.selectExpr("part", "slot", "stat_date", *units, "sales_amount_7d", "sales_amount_30d")
    keyed = with_sales_averages(signed).join(_part_keys(raw_table(spark, folder, "part")).hint("merge"), "part")
    return keyed.selectExpr(
        "*",
        "part * 10 + slot AS id",
        "sales_units_7d AS sales_7d",
        "sales_units_30d AS sales_30d",
        "'USD' AS currency",
        "'orders' AS data_source",
    ).to(SALES)


def replenishment_configs(spark: SparkSession, folder: str) -> DataFrame:
    target = "CASE WHEN p_size % 11 = 0 THEN 0 ELSE 30 + 10 * (p_size % 7) END"
    stages = (
        raw_table(spark, folder, "part")
        .filter("p_partkey % 23 <> 0")
        .selectExpr(
            "p_partkey AS id",
            *PART_KEYS,
            "3 + p_size % 12 AS purchase_lead_time_days",
            "2 AS domestic_shipping_days",
            "6 + p_size % 15 AS international_shipping_days",
            "3 AS customs_clearance_days",
            "5 AS amazon_receiving_days",
            "7 AS safety_stock_days",
            f"{target} AS target_stock_days",
            f"{target} AS target_cover_days",
            "CASE WHEN p_size % 5 <> 0 THEN 6 * (1 + p_size % 4) END AS carton_quantity",
            "CASE WHEN p_size % 7 <> 0 THEN 20 + p_size END AS moq",
            """CASE WHEN p_size % 13 = 0 THEN 'inactive' WHEN p_size % 29 = 0 THEN 'invalid'
                ELSE 'complete' END AS config_status""",
        )
    )
    # Every 37th part carries an unusable lead time.
    broken = {
        name: F.expr(f"CASE WHEN id % 37 = 11 THEN -1 ELSE {name} END")
        for name in ("total_replenishment_days", "total_replenishment_lead_time_days")
    }
    return with_lead_time(stages).withColumns(broken).to(CONFIGS)


def _part_count(parts: DataFrame) -> Column:
    return parts.select(F.count(F.lit(1))).scalar()


def status_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks resolve and errors ignore the task of the SKU and type that the event number points to."""
    parts = raw_table(spark, folder, "part")
    events = raw_table(spark, folder, "events").filter("event_type IN ('click', 'error')")
    keyed = events.withColumn("part", F.col("event_id") % _part_count(parts)).join(_part_keys(parts), "part")
    types = ", ".join(f"'{name}'" for name in TASK_TYPES)
    kind = f"element_at(array({types}), cast(event_id % 5 + 1 AS int))"
    batch = f"'{BATCH_ID}'"
    return keyed.selectExpr(
        f"{task_id(batch, kind)} AS task_id",
        "CASE event_type WHEN 'click' THEN 'resolved' ELSE 'ignored' END AS task_status",
        "concat('user-', user_id) AS operator_id",
        "concat('event ', event_id) AS operator_note",
        "ts AS updated_at",
    ).to(STATUS_UPDATES)


def purchases(events: DataFrame, parts: DataFrame) -> DataFrame:
    """Purchase events as sales of one unit; works on a stream of events as well."""
    sold = (
        events.filter("event_type = 'purchase'")
        .withColumn("part", F.col("event_id") % _part_count(parts))
        .selectExpr("part", "ts AS sold_at", "1 AS units", "cast(value AS decimal(12,2)) AS amount")
    )
    return sold.join(_part_keys(parts), "part").drop("part", "asin")
