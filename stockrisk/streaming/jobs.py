"""Streaming jobs over sales, stock snapshots and the other source tables.

Each job keeps its state in Spark's state store and writes the rows that changed in a micro-batch to a change log, one
folder per micro-batch.  A repeated micro-batch overwrites its own folder, so the log is exact after a restart.  Every
``FOLD_EVERY`` micro-batches the log is folded into a table, part by part, so that neither its folders nor what a reader
opens grows with the age of the job.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stockrisk.operators.analysis import analyse
from stockrisk.operators.facts import config_values, inventory_values, product_values, sales_values, with_fact_defaults
from stockrisk.operators.latest import latest_inventory, latest_per_key
from stockrisk.operators.tasks import generate_tasks
from stockrisk.schemas import ALERT_STATES, DAILY_SALES, INVENTORY, KEY
from stockrisk.sources.versions import FoldedLog, VersionedTable, folders_below, key_bucket, remove_folder

FOLD_EVERY = 100
BUCKETS = 64


def append_changes(
    changes: DataFrame,
    write: Callable[[DataFrame, int], None],
    log: FoldedLog,
    checkpoint: str,
    every: str | None = None,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Start a job that hands every micro-batch of an updating stream, with its number, to ``write``, which fills the
    folder of that number in the log.

    It runs at an interval, such as ``"5 minutes"``, or by default until all available input is used.  When a micro-batch
    starts, those before it are complete; they are folded then.
    """

    def run(batch: DataFrame, number: int) -> None:
        if number and number % fold_every == 0:
            log.fold(number - 1)
        write(batch, number)

    return (
        changes.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .foreachBatch(run)
        .start()
    )


def _to_log(log: FoldedLog) -> Callable[[DataFrame, int], None]:
    names = log.schema.names
    return lambda batch, number: batch.select(*names).write.mode("overwrite").parquet(log.folder(number))


def _log(spark: SparkSession, root: str, schema: T.StructType, part: str, combine: Callable) -> FoldedLog:
    return FoldedLog(VersionedTable(spark, f"{root}/table", schema, part), f"{root}/changes", schema, combine)


def _newest_change(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """What a change says replaces what was said before."""

    def combine(rows: DataFrame, changes: DataFrame) -> DataFrame:
        both = rows.withColumn("change", F.lit(-1).cast("long")).unionByName(changes)
        return latest_per_key(both, keys, [F.desc("change")]).drop("change")

    return combine


MONTH = "date_format(sold_on, 'yyyy-MM')"


def daily_sales_log(spark: SparkSession, root: str) -> FoldedLog:
    """Log and table of daily sales.  The table is split by month, so that a fold rewrites the months that sales still
    arrive for, and trailing windows read the months they span."""
    return _log(spark, root, DAILY_SALES, MONTH, _newest_change([*KEY, "sold_on"]))


def inventory_log(spark: SparkSession, root: str, buckets: int = BUCKETS) -> FoldedLog:
    """Log and table of the newest snapshot per key."""

    def combine(rows: DataFrame, changes: DataFrame) -> DataFrame:
        return latest_inventory(rows.unionByName(changes.drop("change")))

    return _log(spark, root, INVENTORY, key_bucket(buckets), combine)


def alert_log(spark: SparkSession, root: str, buckets: int = BUCKETS) -> FoldedLog:
    """Log and table of the alert state per key; a row without task says that none is called for."""
    return _log(spark, root, ALERT_STATES, key_bucket(buckets), _newest_change(KEY))


def daily_sales_changes(sold: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Units and amounts per SKU and day from single sales; sales later than ``lateness`` are dropped.

    ``sold_at`` has no time zone.  Windows need an instant, so it is read as UTC, and the day is taken back from the
    UTC instant, whatever the session's time zone.
    """
    instant = "timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', sold_at))"
    day = "date_from_unix_date(cast(unix_seconds(window.start) DIV 86400 AS int))"
    return (
        sold.withColumn("sold_at", F.expr(instant))
        .withWatermark("sold_at", lateness)
        .groupBy(F.window("sold_at", "1 day"), *KEY)
        .agg(F.sum("units").alias("units"), F.sum("amount").alias("amount"))
        .selectExpr(*KEY, f"{day} AS sold_on", "units", "amount")
    )


def stream_sales_daily(
    sold: DataFrame,
    log: FoldedLog,
    checkpoint: str,
    lateness: str = "1 day",
    every: str | None = None,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Log the totals of the days that changed.  A day's total grows with every change, so its newest change holds it."""
    return append_changes(daily_sales_changes(sold, lateness), _to_log(log), log, checkpoint, every, fold_every)


def latest_inventory_changes(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per key as a running maximum of (sync time, id, row), whatever the arrival order."""
    rest = [name for name in INVENTORY.names if name not in {"sync_time", "id", *KEY}]
    newest = snapshots.groupBy(*KEY).agg(F.max(F.struct("sync_time", "id", *rest)).alias("row"))
    return newest.select(*KEY, "row.*").select(*INVENTORY.names)


def stream_latest_inventory(
    snapshots: DataFrame, log: FoldedLog, checkpoint: str, every: str | None = None, fold_every: int = FOLD_EVERY
) -> StreamingQuery:
    return append_changes(latest_inventory_changes(snapshots), _to_log(log), log, checkpoint, every, fold_every)


# Alerts --------------------------------------------------------------------------------------------------------------

# What decides which row of a source is the newest, and the parts of a SKU's state.
_NEWEST = {
    "product": (product_values, ["updated_at", "id", "is_deleted"]),
    "inventory": (inventory_values, ["sync_time", "id"]),
    "sales": (sales_values, ["stat_date", "id"]),
    "config": (config_values, ["id"]),
}


def sku_states(products: DataFrame, snapshots: DataFrame, sales: DataFrame, configs: DataFrame) -> DataFrame:
    """All that the rules need of every SKU, as one running row per key over streams of all four sources.

    A source's newest row is a running maximum of its order and the few values in use, so arrival order does not matter, and
    the state of a SKU has a fixed size.
    """
    rows = None
    for (kind, (values, order)), source in zip(_NEWEST.items(), (products, snapshots, sales, configs)):
        needed = values(source, *[f"{name} AS order_{name}" for name in order])
        first = [f"order_{name}" for name in order]
        rest = [name for name in needed.columns if name not in {*KEY, *first}]
        part = needed.select(*KEY, F.struct(*first, *rest).alias(kind))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy(*KEY).agg(*[F.max(kind).alias(kind) for kind in _NEWEST])


def facts_of_states(states: DataFrame) -> DataFrame:
    """The wide row per active SKU out of its state, as ``sku_facts`` gives it from the whole tables."""
    values = [
        f"{kind}.{name} AS {name}"
        for kind in _NEWEST
        for name in states.schema[kind].dataType.names
        if not name.startswith("order_")
    ]
    return with_fact_defaults(states.where("product IS NOT NULL AND NOT product.order_is_deleted").selectExpr(*KEY, *values))


def alert_states(states: DataFrame, batch_id: str, as_of: date, created_at: datetime) -> DataFrame:
    """For changed SKUs with stock records: the stockout task each calls for, or a row without task if it calls for none."""
    with_stock = states.where("inventory IS NOT NULL")
    tasks = generate_tasks(analyse(facts_of_states(with_stock), batch_id, as_of), created_at)
    alerts = tasks.filter("task_type = 'stockout_warning'")
    seen = with_stock.selectExpr(*KEY, "inventory.order_sync_time AS sync_time", "inventory.order_id AS snapshot_id")
    return seen.join(alerts, KEY, "left").to(ALERT_STATES)


def stream_stockout_alerts(
    products: DataFrame,
    snapshots: DataFrame,
    sales: DataFrame,
    configs: DataFrame,
    log: FoldedLog,
    checkpoint: str,
    batch_id: str,
    as_of: date,
    created_at: datetime,
    every: str | None = None,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Evaluate every SKU of which any source changed, and log its alert state.

    A micro-batch reads its own rows and the state store, no table.  The changed states are written before they are evaluated,
    because each use of the micro-batch would run its state store again; those of the micro-batch before are removed.
    """
    spark = log.table.spark
    states = f"{log.log.rsplit('/', 1)[0]}/states"

    def evaluate(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{states}/change={number}")
        changed = batch.sparkSession.read.schema(batch.schema).parquet(f"{states}/change={number}")
        alert_states(changed, batch_id, as_of, created_at).write.mode("overwrite").parquet(log.folder(number))
        for name in folders_below(spark, states):
            if name != f"change={number}":
                remove_folder(spark, f"{states}/{name}")

    changes = sku_states(products, snapshots, sales, configs)
    return append_changes(changes, evaluate, log, checkpoint, every, fold_every)


def current_alerts(log: FoldedLog) -> DataFrame:
    """Alerts that still hold."""
    return log.current().filter("task_id IS NOT NULL").drop("sync_time", "snapshot_id")


def stream_raised_alerts(log: FoldedLog, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append every alert that is raised to ``out``, once per task id however often its SKU changes.

    It reads the alert log as a stream and keeps the ids in its state; it may be one fold behind the job that writes the log.
    """
    raised = (
        log.table.spark.readStream.schema(ALERT_STATES)
        .parquet(f"{log.log}/*")
        .filter("task_id IS NOT NULL")
        .dropDuplicates(["task_id"])
        .drop("sync_time", "snapshot_id")
    )
    return (
        raised.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**({"processingTime": every} if every else {"availableNow": True}))
        .format("parquet")
        .start(out)
    )
