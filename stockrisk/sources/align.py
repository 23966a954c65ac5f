"""Fitting rows to a table's columns and types without losing a run to one outlier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the target's columns and types: unknown columns are dropped, unset ones and values that do not fit are NULL."""
    columns = [
        (F.col(field.name).try_cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)).alias(
            field.name
        )
        for field in schema.fields
    ]
    return df.select(*columns)


def misfits(df: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """``keys, column_name, value``: one row per value that ``align_to`` has to leave out."""
    checked = [f.name for f in schema.fields if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    found = [
        F.when(
            F.col(name).isNotNull() & F.col(name).try_cast(schema[name].dataType).isNull(),
            F.struct(F.lit(name).alias("column_name"), F.col(name).cast("string").alias("value")),
        )
        for name in checked
    ]
    if not found:
        return df.select(*keys, F.lit("").alias("column_name"), F.lit("").alias("value")).where("false")
    listed = df.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("misfit"))
    return listed.select(*keys, "misfit.column_name", "misfit.value")
