"""One wide row per SKU, and the joins that bring stored analysis rows back to their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockrisk.operators.latest import latest_inventory, latest_per_key, latest_sales
from stockrisk.schemas import KEY

FOLDED = [f"{name}_folded" for name in KEY]
DEFAULT_TARGET_COVER = "45"  # fixed value: days of cover without a setting
STOCK_COUNTS = [
    "fulfillable_quantity",
    "total_quantity",
    "inbound_shipped_quantity",
    "inbound_receiving_quantity",
    "total_unfulfillable_quantity",
    "total_reserved_quantity",
]


def active_products(products: DataFrame) -> DataFrame:
    return products.filter("NOT is_deleted")


def first_present(df: DataFrame, names: list[str], default: str = "NULL") -> str:
    """Text of the first non-NULL among the columns that ``df`` has, then the default."""
    return f"coalesce({', '.join([name for name in names if name in df.columns] + [default])})"


def _typed(df: DataFrame, kind: str, names: list[str], default: str = "0") -> str:
    return f"cast({first_present(df, names, default)} AS {kind}) AS {names[0]}"


def product_values(products: DataFrame, *more: str) -> DataFrame:
    """What the rules need of a product, and further columns as asked."""
    amounts = ["current_price", "purchase_cost", "landed_cost", "gross_margin"]
    return products.selectExpr(*KEY, *more, "asin", *[_typed(products, "double", [name]) for name in amounts])


def inventory_values(snapshots: DataFrame, *more: str) -> DataFrame:
    return snapshots.selectExpr(
        *KEY,
        *more,
        "id AS inventory_snapshot_id",
        *[_typed(snapshots, "int", [name]) for name in STOCK_COUNTS],
        "true AS has_inventory",
    )


def sales_values(sales: DataFrame, *more: str) -> DataFrame:
    """Units, trend and averages of a sales row, from new or legacy columns."""
    return sales.selectExpr(
        *KEY,
        *more,
        "id AS sales_summary_id",
        _typed(sales, "int", ["sales_7d", "sales_units_7d"]),
        _typed(sales, "int", ["sales_30d", "sales_units_30d"]),
        f"coalesce(nullif({first_present(sales, ['sales_trend'])}, ''), 'stable') AS sales_trend",
        *[
            _typed(sales, "double", [name])
            for name in ("sales_trend_rate", "avg_daily_sales_7d", "avg_daily_sales_30d")
        ],
        "true AS has_sales",
    )


def config_values(configs: DataFrame, *more: str) -> DataFrame:
    """Replenishment settings, from new or legacy columns."""
    lead = first_present(configs, ["total_replenishment_lead_time_days", "total_replenishment_days"])
    return configs.selectExpr(
        *KEY,
        *more,
        "id AS replenishment_config_id",
        f"cast({lead} AS int) AS total_replenishment_days",
        _typed(configs, "int", ["target_cover_days", "target_stock_days"], DEFAULT_TARGET_COVER),
        _typed(configs, "int", ["safety_stock_days"]),
        _typed(configs, "int", ["carton_quantity"], "NULL"),
        _typed(configs, "int", ["moq"], "NULL"),
        _typed(configs, "string", ["config_status"], "NULL"),
        "true AS has_config",
    )


def sku_facts(
    products: DataFrame, snapshots: DataFrame, sales: DataFrame, configs: DataFrame
) -> DataFrame:
    """Active products with their newest snapshot, newest sales row and settings; all left joins on the key.

    Each right side has one row per key, so the joins cannot multiply rows or build up a hot key.  They are merge joins at any
    size: all sides grow with the number of SKUs, and Spark's size check sees the files' size, not that of the rows in them.
    """
    joined = (
        product_values(active_products(products))
        .join(inventory_values(latest_inventory(snapshots)).hint("merge"), KEY, "left")
        .join(sales_values(latest_sales(sales)).hint("merge"), KEY, "left")
        .join(config_values(configs).hint("merge"), KEY, "left")
    )
    return with_fact_defaults(joined)


def with_fact_defaults(joined: DataFrame) -> DataFrame:
    """Defaults for what a SKU without stock, sales or settings lacks."""
    defaults = dict.fromkeys(
        [*STOCK_COUNTS, "sales_7d", "sales_30d", "safety_stock_days"]
        + ["sales_trend_rate", "avg_daily_sales_7d", "avg_daily_sales_30d"],
        "0",
    )
    defaults |= {
        "has_inventory": "false",
        "has_sales": "false",
        "has_config": "false",
        "sales_trend": "'stable'",
        "target_cover_days": DEFAULT_TARGET_COVER,
    }
    return joined.selectExpr(
        *[
            f"coalesce({name}, {defaults[name]}) AS {name}" if name in defaults else name
            for name in joined.columns
        ]
    )


def with_folded_keys(df: DataFrame) -> DataFrame:
    """Add lower-case keys where a table does not store them: stored tables compare keys without regard to case."""
    missing = [f"lower({name}) AS {folded}" for name, folded in zip(KEY, FOLDED) if folded not in df.columns]
    return df.selectExpr("*", *missing) if missing else df


def of_sku(df: DataFrame, seller_sku: str) -> DataFrame:
    """Rows of one SKU name in any case; with stored folded keys the name reaches the scan, which opens one bucket."""
    return with_folded_keys(df).where(F.col("seller_sku_folded") == F.lower(F.lit(seller_sku))).select(df.columns)


def enriched_analysis(
    analysis: DataFrame, products: DataFrame, sales: DataFrame, configs: DataFrame
) -> DataFrame:
    """Stored analysis rows with current product, newest sales and settings columns.

    Missing columns of older tables are replaced by a default or by the column they superseded.
    """
    current_rows = {
        "p": with_folded_keys(products),
        "s": latest_per_key(with_folded_keys(sales), FOLDED, [F.desc("stat_date"), F.desc("id")]),
        "c": with_folded_keys(configs),
    }
    joined = with_folded_keys(analysis).alias("a")
    for alias, df in current_rows.items():
        on = " AND ".join(f"a.{name} = {alias}.{name}" for name in FOLDED)
        joined = joined.join(df.alias(alias).hint("merge"), F.expr(on), "left")  # see ``sku_facts``

    def current(alias: str, df: DataFrame, name: str, fallback: str) -> str:
        return f"{alias}.{name} AS {name}" if name in df.columns else f"{fallback} AS {name}"

    scores = ["stockout_risk_score", "overstock_risk_score", "estimated_lost_revenue", "decision_confidence"]
    return joined.selectExpr(
        *[f"a.{name} AS {name}" for name in analysis.columns if name not in FOLDED],
        *[current("p", products, name, "0") for name in ("current_price", "landed_cost", "gross_margin")],
        current("s", sales, "sales_7d", "coalesce(s.sales_units_7d, 0)"),
        current("s", sales, "sales_30d", "coalesce(s.sales_units_30d, 0)"),
        current("s", sales, "sales_trend", "cast(NULL AS string)"),
        current("s", sales, "sales_trend_rate", "0"),
        current("c", configs, "total_replenishment_lead_time_days", "a.total_replenishment_days"),
        current("c", configs, "target_cover_days", "c.target_stock_days"),
        current("c", configs, "moq", "0"),
        *[f"0 AS {name}" for name in scores if name not in analysis.columns],
        "a.risk_reason AS decision_explanation",
    )


def only_keys_of(df: DataFrame, few: DataFrame) -> DataFrame:
    """Rows of a large table whose key occurs in ``few``, a short picked list.

    The list's SKU names go to the scan as literals, so that a table bucketed by them opens the buckets of these names only.
    """
    wanted = with_folded_keys(few.select(*KEY)).select(*FOLDED)
    names = [row[0] for row in wanted.select("seller_sku_folded").distinct().collect()]
    rows = with_folded_keys(df).where(F.col("seller_sku_folded").isin(names))
    return rows.join(wanted, FOLDED, "left_semi").select(df.columns)


def analysis_lineage(
    analysis: DataFrame, snapshots: DataFrame, sales: DataFrame, configs: DataFrame, tasks: DataFrame
) -> DataFrame:
    """Each task with its analysis row and the three source rows that row was computed from."""
    snapshot = snapshots.selectExpr("id AS source_id", "sync_time", "sync_batch_id")
    summary = sales.selectExpr("id AS source_id", "stat_date")
    config = configs.selectExpr("id AS source_id", "config_status")
    sources = analysis.selectExpr(
        "id AS analysis_id",
        "analysis_batch_id",
        "inventory_snapshot_id",
        "sales_summary_id",
        "replenishment_config_id",
    )
    for name, table in {
        "inventory_snapshot_id": snapshot,
        "sales_summary_id": summary,
        "replenishment_config_id": config,
    }.items():
        # Many rows may lack a source. Distinct negative stand-ins keep them from meeting in one partition.
        key = f"coalesce({name}, -1L - (xxhash64(analysis_id) & 9223372036854775807L)) AS source_id"
        sources = sources.selectExpr("*", key).join(table, "source_id", "left").drop("source_id")
    return tasks.select("task_id", "task_type", "seller_sku", "analysis_id").join(
        sources, "analysis_id", "left"
    )
