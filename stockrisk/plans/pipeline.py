"""The analysis run: from the four source tables to the stored analysis and task tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockrisk.operators.analysis import analyse, rejected_values, stored_analysis
from stockrisk.operators.facts import sku_facts
from stockrisk.operators.latest import latest_per_key
from stockrisk.operators.tasks import generate_tasks
from stockrisk.plans.reports import run_summary
from stockrisk.schemas import SOURCE_TABLES, STORED_ANALYSIS, STORED_TASKS
from stockrisk.session import written
from stockrisk.sources.tables import (
    batch_folder,
    coerce_columns,
    ensure_columns,
    read_table,
    replace_table,
    write_attempt,
)
from stockrisk.sources.versions import folders_below, remove_folder


@dataclass(frozen=True)
class Sources:
    """The four source tables."""

    products: DataFrame
    inventory: DataFrame
    sales: DataFrame
    configs: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str, file_format: str = "parquet") -> Sources:
        tables = (
            read_table(spark, f"{folder}/{name}", schema, file_format)
            for name, schema in SOURCE_TABLES.items()
        )
        return cls(*tables)

    def facts(self) -> DataFrame:
        return sku_facts(self.products, self.inventory, self.sales, self.configs)


def import_tables(raw: dict[str, DataFrame], folder: str) -> None:
    """Clean raw tables, complete their columns and replace the stored ones."""
    for name, frame in raw.items():
        cleaned = coerce_columns(frame, name)
        completed = ensure_columns(cleaned, name) if name != "inventory_snapshot" else cleaned
        replace_table(completed.to(SOURCE_TABLES[name]), f"{folder}/{name}")


RUNS = "analysis_batch_id string, attempt string, created_at timestamp_ntz, published_at timestamp_ntz"
REJECTS = "id string, analysis_batch_id string, seller_id string, marketplace_id string, seller_sku string, column_name string, value string"


def run_analysis(
    sources: Sources, out: str, batch_id: str, as_of: date, created_at: datetime
) -> DataFrame:
    """Analyse all SKUs, create their tasks, publish this batch and return the run's counts.

    The full-precision rows feed all tables, so they are written once in between.  Tables are written to folders of this
    attempt; one row in the table of runs publishes them together, so that readers see all of a batch or what was
    there before.  Running a batch again gives the same rows and ids, and its last published attempt counts.
    """
    rows = written(analyse(sources.facts(), batch_id, as_of), "analysis")
    publish(
        out,
        batch_id,
        created_at,
        {
            "rejects": rejected_values(rows),
            "tasks": generate_tasks(rows, created_at),
            "analysis": stored_analysis(rows, created_at),
        },
    )
    spark = rows.sparkSession
    runs = [run for run in published(spark, out) if run.analysis_batch_id == batch_id]
    rejected = _read(spark, out, "rejects", _schema(REJECTS), runs)
    counts = run_summary(*(_read(spark, out, name, schema, runs) for name, schema in TABLES.items()))
    return counts.crossJoin(F.broadcast(rejected.agg(F.count("*").alias("rejected_values"))))  # one row each


def publish(out: str, batch_id: str, created_at: datetime, tables: dict[str, DataFrame]) -> None:
    """Write all tables of a batch and make them visible in one step."""
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        write_attempt(rows, f"{out}/{name}", batch_id, attempt)
    spark = next(iter(tables.values())).sparkSession
    run = (batch_id, attempt, created_at, datetime.now(timezone.utc).replace(tzinfo=None))
    spark.createDataFrame([run], RUNS).coalesce(1).write.mode("append").parquet(f"{out}/runs")


TABLES = {"analysis": STORED_ANALYSIS, "tasks": STORED_TASKS}


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def published(spark: SparkSession, out: str) -> list[Row]:
    """The last published attempt of each batch, newest batch first; one row per batch."""
    runs = spark.read.schema(RUNS).parquet(f"{out}/runs")
    last = latest_per_key(runs, ["analysis_batch_id"], [F.desc("published_at"), F.desc("attempt")])
    return last.orderBy(F.desc("created_at"), F.desc("analysis_batch_id")).collect()


def _read(spark: SparkSession, out: str, name: str, schema: T.StructType, runs: list[Row]) -> DataFrame:
    folders = [batch_folder(f"{out}/{name}", run.analysis_batch_id, run.attempt) for run in runs]
    return spark.read.schema(schema).option("basePath", f"{out}/{name}").parquet(*folders).select(*schema.names)


def read_results(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The stored analysis and task tables with all published batches, for reports over the history."""
    runs = published(spark, out)
    return tuple(_read(spark, out, name, schema, runs) for name, schema in TABLES.items())


def read_current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Analysis and tasks of the newest batch, which all other reports are about; only its folders are read, and both are
    of one batch whatever is published meanwhile."""
    runs = published(spark, out)[:1]
    return tuple(_read(spark, out, name, schema, runs) for name, schema in TABLES.items())


def remove_superseded(spark: SparkSession, out: str, running: set[str] = frozenset()) -> list[str]:
    """Remove the folders of attempts that a later attempt of their batch has replaced, or that were never published.

    ``running`` names attempts that are being written now.  Returns what was removed.
    """
    last = {(run.analysis_batch_id, run.attempt) for run in published(spark, out)}
    gone = []
    for name in (*TABLES, "rejects"):
        for batch in folders_below(spark, f"{out}/{name}"):
            for attempt in folders_below(spark, f"{out}/{name}/{batch}"):
                key = batch.removeprefix("analysis_batch_id="), attempt.removeprefix("attempt=")
                if key not in last and key[1] not in running:
                    gone.append(f"{out}/{name}/{batch}/{attempt}")
    for folder in gone:
        remove_folder(spark, folder)
    return gone
