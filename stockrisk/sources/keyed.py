"""Stored tables for lookups by key without regard to case.

A keyed table carries the lower-case key columns beside the given ones and is bucketed by the folded SKU and sorted by it.  A
lookup by SKU opens one bucket, in which the sorted files' statistics skip most row groups; joins on the folded keys, and the
newest row per folded key, need no shuffle between tables of one bucket count.

Joins use all three keys while the tables are bucketed by one.  Spark avoids the shuffle then only if
``spark.sql.requireAllClusterKeysForCoPartition`` is off, which writing or opening a keyed table sets for the session.

Bucketing by the SKU alone serves the lookups.  Where one SKU name is so common that its bucket would not fit a task, bucket by
all keys (``by=FOLDED``): the joins stay free of shuffles, and lookups rest on the sorted files alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockrisk.operators.facts import FOLDED, with_folded_keys

SORTED = ["seller_sku_folded", "seller_id_folded", "marketplace_id_folded"]


def _join_on_part_of_the_keys(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def write_keyed(df: DataFrame, table: str, buckets: int, path: str | None = None, by: list[str] = SORTED[:1]) -> DataFrame:
    """Full refresh of a keyed catalog table, in ``path`` or the warehouse; one file per bucket."""
    if not set(by) <= set(FOLDED):
        raise ValueError(f"bucket columns must be among {FOLDED}")
    _join_on_part_of_the_keys(df.sparkSession)
    laid_out = with_folded_keys(df).repartition(buckets, *by).sortWithinPartitions(*SORTED)
    writer = laid_out.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*SORTED)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def open_keyed(spark: SparkSession, table: str, path: str, columns: str, buckets: int, by: list[str] = SORTED[:1]) -> DataFrame:
    """A keyed table that another session wrote to ``path``; ``columns`` are its columns as DDL text."""
    _join_on_part_of_the_keys(spark)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet LOCATION '{path}' "
        f"CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(SORTED)}) INTO {buckets} BUCKETS"
    )
    return spark.table(table)
