"""Newest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockrisk.schemas import KEY
from stockrisk.sources.versions import Version, VersionedTable


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], count: int = 1) -> DataFrame:
    """The first ``count`` rows per key.

    Spark plans the rank filter as a group limit on both sides of the shuffle, so each map task sends at most
    ``count`` rows per key and a key that holds much of the table costs no more than any other.
    """
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_place") <= count).drop("_place")


def latest_per_key(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key: the first by ``newest_first``."""
    return first_per_key(df, keys, newest_first)


def _newest_snapshot() -> list[Column]:
    return [F.desc("sync_time"), F.desc("id")]


def _newest_summary() -> list[Column]:
    return [F.desc("stat_date"), F.desc("id")]


def latest_inventory(snapshots: DataFrame) -> DataFrame:
    return latest_per_key(snapshots, KEY, _newest_snapshot())


def latest_sales(sales: DataFrame) -> DataFrame:
    return latest_per_key(sales, KEY, _newest_summary())


def _refresh(table: VersionedTable, arrivals: DataFrame, column: str, through: object, newest_first: list[Column]) -> Version:
    def combine(rows: DataFrame, arrived: DataFrame) -> DataFrame:
        return latest_per_key(rows.unionByName(arrived.select(rows.columns)), KEY, newest_first)

    return table.absorb(arrivals, column, combine, through)


def refresh_latest_inventory(
    table: VersionedTable, arrivals: DataFrame, column: str = "arrived_on", through: object = None
) -> Version:
    """Bring a stored table of newest snapshots up to the arrival partitions that it has not seen.

    Its mark is the last partition it holds.  Only the partitions beyond it are read, and only the buckets they touch are
    rewritten.  Snapshots that are late by their sync time count in the partition in which they arrive, so the result
    equals ``latest_inventory`` over all partitions.  A partition is complete when it is absorbed.
    """
    return _refresh(table, arrivals, column, through, _newest_snapshot())


def refresh_latest_sales(
    table: VersionedTable, arrivals: DataFrame, column: str = "arrived_on", through: object = None
) -> Version:
    """The same for sales summaries."""
    return _refresh(table, arrivals, column, through, _newest_summary())
