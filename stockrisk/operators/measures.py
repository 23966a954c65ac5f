"""Measure jobs over whole tables: trailing sales windows and the derived columns of each source table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockrisk.functions import measures as m
from stockrisk.sources.versions import VersionedTable

SALES_WINDOWS = [1, 3, 7, 14, 30]  # fixed values: days per trailing window
AMOUNT_WINDOWS = [7, 30]


def trailing_sales(
    lines: DataFrame,
    keys: list[str],
    stat_dates: list[date],
    day_length: int = 1,
    history_days: int | None = None,
) -> DataFrame:
    """Units per key for the trailing 1/3/7/14/30 days and amounts for 7/30 days, one row per stat date.

    ``lines`` has ``sold_on`` (date), ``units`` and ``amount``.  All dates and windows are conditional sums of one
    aggregation: the lines are read once and only partial sums per key are shuffled.  ``day_length`` stretches a
    model day over several calendar days; a key gets a row for a date if it has any line in ``history_days``.
    """
    history = history_days or max(SALES_WINDOWS) * day_length
    oldest = min(stat_dates) - timedelta(days=history)
    needed = (F.col("sold_on") > F.lit(oldest)) & (F.col("sold_on") <= F.lit(max(stat_dates)))

    def within(end: date, days: int) -> str:
        return f"sold_on <= date'{end}' AND sold_on > date'{end - timedelta(days=days)}'"

    sums = []
    for slot, end in enumerate(stat_dates, 1):
        sums.append(F.expr(f"count_if({within(end, history)}) AS lines_{slot}"))
        for measure, windows in {"units": SALES_WINDOWS, "amount": AMOUNT_WINDOWS}.items():
            for n in windows:
                inside = within(end, n * day_length)
                sums.append(
                    F.expr(f"sum(CASE WHEN {inside} THEN {measure} ELSE 0 END) AS {measure}_{slot}_{n}")
                )
    totals = lines.filter(needed).groupBy(*keys).agg(*sums)
    slots = range(1, len(stat_dates) + 1)
    wide = {"stat_date": [f"date'{end}'" for end in stat_dates], "lines": [f"lines_{slot}" for slot in slots]}
    for measure, windows in {"units": SALES_WINDOWS, "amount": AMOUNT_WINDOWS}.items():
        for n in windows:
            wide[f"sales_{measure}_{n}d"] = [f"{measure}_{slot}_{n}" for slot in slots]
    return unfold(totals, keys, wide).filter("lines > 0").drop("lines")


def daily_totals(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Units and amount per key and day: the partial sums that every trailing window is made of."""
    day = F.col("sold_on").cast("date").alias("sold_on")
    return lines.groupBy(*keys, day).agg(F.sum("units").alias("units"), F.sum("amount").alias("amount"))


def months_of(after: date, until: date) -> list[str]:
    """The months of the days after ``after`` up to ``until``, as ``yyyy-MM``."""
    first = after + timedelta(days=1)
    numbers = range(first.year * 12 + first.month - 1, until.year * 12 + until.month)
    return [f"{number // 12:04d}-{number % 12 + 1:02d}" for number in numbers]


def trailing_sales_of_days(
    daily: VersionedTable,
    keys: list[str],
    stat_dates: list[date],
    day_length: int = 1,
    history_days: int | None = None,
) -> DataFrame:
    """``trailing_sales`` out of a stored table of daily totals that is split by month.

    Order lines are not read again, and only the months that the windows span are opened.  The table may come from
    ``daily_totals`` or from the stream of daily sales.
    """
    history = history_days or max(SALES_WINDOWS) * day_length
    months = months_of(min(stat_dates) - timedelta(days=history), max(stat_dates))
    return trailing_sales(daily.rows(parts=months), keys, stat_dates, day_length, history_days)


def unfold(df: DataFrame, keys: list[str], wide: dict[str, list[str]]) -> DataFrame:
    """One row per slot from columns that exist once per slot; ``wide`` names the source of each slot.

    Each result is a column of its own and not a struct field, so unused ones are pruned down to the scan.
    """
    count = len(next(iter(wide.values())))
    slots = ", ".join(str(slot) for slot in range(1, count + 1))
    picked = [
        f"CASE slot {' '.join(f'WHEN {slot} THEN {text}' for slot, text in enumerate(texts, 1))} END AS {name}"
        for name, texts in wide.items()
    ]
    return df.selectExpr("*", f"explode(array({slots})) AS slot").selectExpr(*keys, "slot", *picked)


def with_sales_averages(sales: DataFrame) -> DataFrame:
    """Average daily units and the trend they show."""
    averages = [f"{m.average_daily(f'sales_units_{n}d', n)} AS avg_daily_sales_{n}d" for n in (3, 7, 30)]
    rate = m.trend_rate("avg_daily_sales_7d", "avg_daily_sales_30d")
    return (
        sales.selectExpr("*", *averages)
        .selectExpr("*", f"{rate} AS raw_rate")
        .selectExpr(
            "*",
            f"{m.trend_label('raw_rate')} AS sales_trend",
            "cast(raw_rate AS decimal(10,4)) AS sales_trend_rate",
        )
        .drop("raw_rate")
    )


def with_stock_total(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("total_quantity", F.expr(m.stock_total()))


def with_unit_margin(products: DataFrame) -> DataFrame:
    return products.withColumn("gross_margin", F.expr(m.unit_margin("current_price", "landed_cost")))


def with_lead_time(configs: DataFrame) -> DataFrame:
    """Total lead time from the stages, and the reorder point in days."""
    total = "total_replenishment_days"
    return configs.withColumn(total, F.expr(m.lead_time_total())).withColumns(
        {
            "total_replenishment_lead_time_days": F.col(total),
            "reorder_point_days": F.expr(m.reorder_point(total, "safety_stock_days")),
        }
    )
