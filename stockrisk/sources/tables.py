"""Reading, cleaning, aligning and writing the tables of the inventory model."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockrisk.operators.latest import latest_per_key
from stockrisk.schemas import KEY, LATER_COLUMNS, SOURCE_TABLES
from stockrisk.sources.versions import VersionedTable, key_bucket


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet"
) -> DataFrame:
    """Read one table with a given schema; nothing is inferred."""
    reader = spark.read.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(file_format).load(path)


def read_raw_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Read a CSV export as text, to be typed by ``coerce_columns``; bad cells must not drop their row."""
    layout = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    return spark.read.schema(layout).option("header", True).option("enforceSchema", False).csv(path)


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str,
    lower: int,
    upper: int,
    parts: int,
    **options: str,
) -> DataFrame:
    """Read a database table in parallel ranges of a numeric column."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .options(partitionColumn=split_column, lowerBound=lower, upperBound=upper, numPartitions=parts)
        .load()
    )


def _clean_number(column: Column, kind: T.DataType) -> Column:
    """Text or number to the table's type; unreadable, missing and NaN become 0."""
    number = column.try_cast("double")
    number = F.when(F.isnan(number), 0.0).otherwise(F.coalesce(number, F.lit(0.0)))
    if isinstance(kind, T.BooleanType):
        return number != 0
    if isinstance(kind, (T.IntegerType, T.LongType)):
        number = F.round(number)
    return F.coalesce(number.try_cast(kind), F.lit(0).cast(kind))


def coerce_columns(raw: DataFrame, table: str) -> DataFrame:
    """Clean a raw table in one projection.

    Numbers that cannot be read become 0, dates become NULL, NaN in other columns becomes NULL.  Columns the table
    does not know are kept as they are.
    """
    fields = {field.name: field.dataType for field in SOURCE_TABLES[table].fields}
    not_measured = {"id", "created_at", "updated_at"}
    numeric = (T.IntegerType, T.LongType, T.DecimalType, T.BooleanType)
    cleaned = []
    for source in raw.schema.fields:
        name, column, kind = source.name, F.col(source.name), fields.get(source.name)
        if name not in not_measured and isinstance(kind, numeric):
            column = _clean_number(column, kind)
        elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
            column = column.try_cast("timestamp_ntz").cast(kind)
        elif isinstance(source.dataType, (T.FloatType, T.DoubleType)):
            column = F.when(~F.isnan(column), column)
        elif kind is not None:
            column = column.try_cast(kind)
        cleaned.append(column.alias(name))
    return raw.select(*cleaned)


def ensure_columns(df: DataFrame, table: str) -> DataFrame:
    """Add the columns that later versions of a table brought, where they are missing."""
    missing = {
        name: F.lit(value).cast(kind)
        for name, (kind, value) in LATER_COLUMNS[table].items()
        if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def replace_table(df: DataFrame, path: str) -> None:
    """Full refresh of a table."""
    df.write.mode("overwrite").parquet(path)


def replace_bucketed(df: DataFrame, table: str, buckets: int) -> None:
    """Full refresh of a catalog table bucketed and sorted by the business key.

    Tables with the same bucket count are joined on the key, and reduced to the newest row per key, without a
    shuffle.
    """
    writer = df.repartition(buckets, *KEY).write.mode("overwrite")
    writer.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(table)


def batch_folder(path: str, batch_id: str, attempt: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
        raise ValueError(f"batch id not usable as a folder name: {batch_id!r}")
    return f"{path.rstrip('/')}/analysis_batch_id={batch_id}/attempt={attempt}"


def write_attempt(df: DataFrame, path: str, batch_id: str, attempt: str) -> None:
    """Write the rows of a batch to a folder of their own; nobody reads it before the attempt is published."""
    df.drop("analysis_batch_id").write.parquet(batch_folder(path, batch_id, attempt))


def source_tables(spark: SparkSession, root: str, buckets: int = 64) -> dict[str, VersionedTable]:
    """The four stored source tables, each split into buckets of the key."""
    return {name: VersionedTable(spark, f"{root}/{name}", schema, key_bucket(buckets)) for name, schema in SOURCE_TABLES.items()}


def full_refresh(raw: DataFrame, table: VersionedTable, name: str) -> None:
    """Clean a raw table, complete its columns and make it the newest version; readers see the old or the new one."""
    cleaned = coerce_columns(raw, name)
    completed = ensure_columns(cleaned, name) if name in LATER_COLUMNS else cleaned
    table.replace(completed.to(SOURCE_TABLES[name]))


def upsert_into(table: VersionedTable, incoming: DataFrame) -> None:
    """Write product changes back to the table they change.  Only the buckets of the incoming keys are read and rewritten;
    ``incoming`` should be stored, as it is read twice."""
    table.merge(incoming, upsert_products)
    table.vacuum()


def upsert_products(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union of both tables with one row per key; the incoming row wins, its newest version if there are several."""
    both = current.withColumn("_incoming", F.lit(0)).unionByName(
        incoming.withColumn("_incoming", F.lit(1)), allowMissingColumns=True
    )
    newest = [F.desc("_incoming"), F.desc("updated_at"), F.desc("id")]
    return latest_per_key(both, KEY, newest).drop("_incoming")
