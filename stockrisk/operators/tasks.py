"""Work items: fan-out of analysis rows into tasks, and status changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockrisk.functions.numeric import to_double
from stockrisk.functions.rules import money
from stockrisk.operators.analysis import ANALYSIS_ID
from stockrisk.operators.latest import latest_per_key
from stockrisk.schemas import KEY, STATUS_UPDATES, STORED_TASKS
from stockrisk.sources.align import align_to
from stockrisk.sources.versions import FoldedLog, VersionedTable

# Task types in the order in which a SKU's tasks are created.
TASK_TYPES = [
    "stockout_warning",
    "replenishment_suggestion",
    "overstock_warning",
    "unfulfillable_inventory_alert",
    "data_missing_alert",
]
DEFAULT_LANDED_COST = 10


def impact_level(value: str) -> str:
    return f"""CASE WHEN {value} >= 5000 THEN 'high' WHEN {value} >= 1000 THEN 'medium'
        WHEN {value} > 0 THEN 'low' ELSE 'none' END"""


def priority(level: str, value: str) -> str:
    return f"""CASE
        WHEN {level} = 'critical' THEN 'P0'
        WHEN {level} = 'high' AND {value} >= 3000 THEN 'P0'
        WHEN {level} = 'high' OR {value} >= 5000 THEN 'P1'
        WHEN {level} = 'low' THEN 'P3'
        ELSE 'P2' END"""


def approval_level(needed: str, value: str) -> str:
    return f"""CASE WHEN NOT coalesce({needed}, false) THEN 'none'
        WHEN {value} >= 5000 THEN 'manager' ELSE 'operator' END"""


def overstock_value(total: str, landed_cost: str) -> str:
    """Value of the whole stock of a SKU, at a default cost where none is known."""
    cost = to_double(landed_cost)
    return money(total, f"CASE WHEN {cost} <= 0 THEN {DEFAULT_LANDED_COST}D ELSE {cost} END")


def task_id(batch: str, task_type: str) -> str:
    """Digest of batch, key and type, so a repeated run creates the same ids."""
    return f"md5(concat_ws(';', {batch}, {', '.join(KEY)}, {task_type}))"


# When a row calls for the task of each type.
WANTED = {
    "stockout_warning": "stockout_risk_level IN ('critical', 'high')",
    "replenishment_suggestion": "recommended_action IN ('replenish_now', 'prepare_replenishment')",
    "overstock_warning": "overstock_risk_level = 'high'",
    "unfulfillable_inventory_alert": "total_unfulfillable_quantity > 0",
    "data_missing_alert": "data_quality_status <> 'complete'",
}


def _by_type(*texts: str) -> str:
    """The expression for the type of the current task; one text per type, in creation order."""
    return f"CASE task_type {' '.join(f"WHEN '{kind}' THEN {text}" for kind, text in zip(TASK_TYPES, texts, strict=True))} END"


def task_columns() -> dict[str, str]:
    """What a task says, by its type."""
    lost = to_double("estimated_lost_revenue")
    return {
        "problem_type": _by_type(
            "'stockout'", "'replenishment'", "'overstock'", "'inventory_exception'", "'data_quality'"
        ),
        "risk_level": _by_type(
            "stockout_risk_level",
            "stockout_risk_level",
            "'high'",
            "'medium'",
            "CASE WHEN data_quality_status = 'missing_inventory' THEN 'high' ELSE 'medium' END",
        ),
        "impact": _by_type(lost, lost, overstock_value("total_quantity", "landed_cost"), "0D", "0D"),
        "task_title": _by_type(
            "concat('[Stockout warning] ', seller_sku, ' has ', stockout_risk_level, ' stockout risk')",
            "concat('[Replenishment suggestion] ', seller_sku, ' replenish ', "
            "recommended_replenishment_quantity, ' units')",
            "concat('[Overstock warning] ', seller_sku, ' has excessive inventory cover')",
            "concat('[Unfulfillable inventory] ', seller_sku, ' has unfulfillable inventory')",
            "concat('[Data quality] ', seller_sku, ' data quality is ', data_quality_status)",
        ),
        "task_description": _by_type(
            "action_reason",
            "action_reason",
            "action_reason",
            "concat(seller_sku, ' currently has ', total_unfulfillable_quantity, ' unfulfillable units.')",
            "concat(seller_sku, ' data quality is ', data_quality_status, "
            "'; complete the missing data before relying on the recommendation.')",
        ),
    }


# JSON text with the figures behind a task; empty fields are kept as null.
ACTION_PAYLOAD = """to_json(named_struct(
    'seller_sku', seller_sku,
    'recommended_quantity', recommended_replenishment_quantity,
    'recommended_action', recommended_action,
    'estimated_impact_value', impact,
    'estimated_lost_revenue', estimated_lost_revenue,
    'decision_confidence', decision_confidence,
    'approval_required', need_manual_approval,
    'estimated_stockout_date', cast(estimated_stockout_date AS string)),
    map('ignoreNullFields', 'false'))"""


def generate_tasks(analysis: DataFrame, created_at: datetime) -> DataFrame:
    """Fan analysis rows (in full precision) out into zero to five tasks each, in one pass.

    Only the position of a task is unfolded; its texts are computed afterwards and only if they are used.
    """
    wanted = ", ".join(f"CASE WHEN {WANTED[kind]} THEN {i} END" for i, kind in enumerate(TASK_TYPES, 1))
    kinds = ", ".join(f"'{kind}'" for kind in TASK_TYPES)
    fanned = (
        analysis.selectExpr("*", f"explode(array({wanted})) AS task_order")
        .filter("task_order IS NOT NULL")
        .selectExpr("*", f"element_at(array({kinds}), task_order) AS task_type")
        .selectExpr("*", *[f"{text} AS {name}" for name, text in task_columns().items()])
    )
    rows = fanned.selectExpr(
        f"{task_id('analysis_batch_id', 'task_type')} AS task_id",
        f"{ANALYSIS_ID} AS analysis_id",
        *KEY,
        "asin",
        "task_type",
        "task_title",
        "task_description",
        f"{priority('risk_level', 'impact')} AS priority",
        "risk_level",
        "recommended_action AS suggested_action",
        f"{ACTION_PAYLOAD} AS action_parameters",
        "coalesce(nullif(risk_reason, ''), action_reason) AS expected_impact",
        "need_manual_approval AS approval_required",
        "'pending' AS task_status",
        "problem_type",
        f"{impact_level('impact')} AS impact_level",
        "impact AS estimated_impact_value",
        f"{approval_level('need_manual_approval', 'impact')} AS approval_level",
        "analysis_batch_id",
        "task_order",
        f"timestamp_ntz'{created_at}' AS created_at",
    )
    return align_to(rows, STORED_TASKS)


def newest_changes(updates: DataFrame) -> DataFrame:
    """The newest status change per task."""
    order = [F.desc("updated_at"), F.desc("task_status"), F.desc("operator_id"), F.desc("operator_note")]
    return latest_per_key(updates, ["task_id"], order)


def with_status_changes(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Tasks with the newest change of each, and ``is_known``; changes without a task are rows that are not known.

    A change may overwrite any status.  It sets status, operator and note, and its time becomes ``resolved_at``; a change
    older than the one a task records already comes too late.  Nothing is written in between: the join carries the columns
    that are asked of its result, so that a list of statuses shuffles ids and statuses only.
    """
    changed = newest_changes(updates).select(
        "task_id",
        F.col("task_status").alias("_status"),
        F.col("operator_id").alias("_operator"),
        F.col("operator_note").alias("_note"),
        F.col("updated_at").alias("_at"),
    )
    both = tasks.withColumn("is_known", F.lit(True)).join(changed, "task_id", "full")
    values = {"task_status": "_status", "operator_id": "_operator", "operator_note": "_note", "resolved_at": "_at"}
    recorded, new = "struct(resolved_at, task_status, operator_id, operator_note)", "struct(_at, _status, _operator, _note)"
    holds = F.expr(f"_status IS NOT NULL AND (resolved_at IS NULL OR {new} >= {recorded})")
    return both.select(
        *[
            F.when(holds, F.col(values[name])).otherwise(F.col(name)).alias(name) if name in values else F.col(name)
            for name in tasks.columns
        ],
        F.coalesce("is_known", F.lit(False)).alias("is_known"),
    )


def apply_status_updates(tasks: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks after their changes, and the changes whose task does not exist."""
    both = with_status_changes(tasks, updates)
    rejected = both.where("NOT is_known").selectExpr(
        "task_id", "task_status", "operator_id", "operator_note", "resolved_at AS updated_at"
    )
    return both.where("is_known").drop("is_known"), rejected


TASK_PART = "substr(task_id, 1, 2)"  # task ids are hexadecimal digests: up to 256 even parts


class TaskTable:
    """Stored tasks and the changes to them.  Changes are appended as small folders and merged by task id when tasks are
    read; after ``fold_every`` folders they are folded into the parts of the table that hold their tasks."""

    def __init__(self, spark: SparkSession, root: str, fold_every: int = 20) -> None:
        table = VersionedTable(spark, f"{root}/table", STORED_TASKS, TASK_PART)
        self.fold_every = fold_every
        self.log = FoldedLog(table, f"{root}/changes", STATUS_UPDATES, self._fold)

    @staticmethod
    def _fold(tasks: DataFrame, changes: DataFrame) -> DataFrame:
        return apply_status_updates(tasks, changes.drop("change"))[0]

    def replace(self, tasks: DataFrame) -> None:
        """Store tasks; what was changed before belongs to the tasks of then."""
        self.log.table.replace(tasks, self.last())

    def last(self) -> int:
        """Number of the last folder of changes, -1 without any."""
        folded = self.log.table.head().mark
        return max([-1 if folded is None else folded, *self.log.pending()])

    def change(self, updates: DataFrame) -> None:
        """Append changes; one writer at a time."""
        number = self.last() + 1
        pending = self.log.pending()
        if len(pending) >= self.fold_every:
            self.log.fold(pending[-1])
        updates.select(*STATUS_UPDATES.names).write.mode("overwrite").parquet(self.log.folder(number))

    def tasks(self) -> DataFrame:
        """Tasks as they are now."""
        return self.log.current()

    def statuses(self) -> DataFrame:
        """Tasks as they are now with ``is_known``, followed by the pending changes without a task."""
        version = self.log.table.head()
        changes = self.log.table.unread(self.log.changes(), "change", version).drop("change")
        return with_status_changes(self.log.table.rows(version), changes)
