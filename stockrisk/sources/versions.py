"""Tables that are changed part by part, and of which a reader always sees one whole version.

A table is split into parts by an expression over its rows, such as a bucket of the key or a month.  A change writes the
parts it touches to new folders and then appends one small file that names, for the new version, the folder of every part;
the untouched ones keep theirs.  A run that fails before that file leaves the version before.  Folders that no kept
version names are removed by ``vacuum``, among them those of failed runs.

One writer at a time; readers need no care, as the version before the newest is kept for those still reading it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockrisk.schemas import KEY

Combine = Callable[[DataFrame, DataFrame], DataFrame]
PART = "table_part"
VERSION = "number long, part string, folder string, mark string"
KEPT_VERSIONS = 2


def key_bucket(buckets: int, columns: list[str] = KEY) -> str:
    """Part expression: one of ``buckets`` hashed groups of the key."""
    return f"concat('b', pmod(xxhash64({', '.join(columns)}), {buckets}))"


def folders_below(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    return [item.getPath().getName() for item in system.listStatus(place) if item.isDirectory()]


def remove_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@dataclass(frozen=True)
class Version:
    """The folder of every part, and the caller's mark, such as the last change that the version holds."""

    number: int
    folders: dict[str, str]
    mark: object = None


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, part: str) -> None:
        """``part`` is the text of the expression that gives the part of a row."""
        self.spark, self.root, self.schema, self.part = spark, root.rstrip("/"), schema, part

    def versions(self) -> list[Version]:
        """The kept versions, oldest first."""
        try:
            rows = self.spark.read.schema(VERSION).parquet(f"{self.root}/versions").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        found: dict[int, Version] = {}
        for row in rows:
            version = found.setdefault(row.number, Version(row.number, {}, json.loads(row.mark)))
            if row.part is not None:
                version.folders[row.part] = row.folder
        return [found[number] for number in sorted(found)]

    def head(self) -> Version:
        return ([Version(0, {})] + self.versions())[-1]

    def rows(self, version: Version | None = None, parts: list[str] | None = None) -> DataFrame:
        """The rows of the newest or a given version, all or of some parts; only their folders are opened."""
        version = version or self.head()
        folders = sorted(folder for part, folder in version.folders.items() if parts is None or part in parts)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.StringType())]))
        return reader.option("basePath", f"{self.root}/rows").parquet(*folders).select(*self.schema.names)

    def parts_of(self, rows: DataFrame) -> list[str]:
        """The parts that some rows belong to; there are never more than the table has parts."""
        return [row[0] for row in rows.select(F.expr(self.part)).distinct().collect()]

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Write rows to folders of their own, one per part.  Large parts are split and small ones share a task."""
        path = f"{self.root}/rows/write={uuid.uuid4().hex}"
        laid_out = rows.select(*self.schema.names).withColumn(PART, F.expr(self.part)).hint("rebalance", PART)
        laid_out.write.partitionBy(PART).parquet(path)
        files = self.spark.read.schema(self.schema).parquet(path).inputFiles()
        folders = {unquote(file.rsplit("/", 2)[1]) for file in files}
        return {unquote(name.removeprefix(f"{PART}=")): f"{path}/{name}" for name in folders if name.startswith(PART)}

    def publish(self, version: Version) -> None:
        parts = sorted(version.folders.items()) or [(None, None)]
        rows = [(version.number, part, folder, json.dumps(version.mark)) for part, folder in parts]
        frame = self.spark.createDataFrame(rows, VERSION).coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.root}/versions/of={version.number}")

    def replace(self, rows: DataFrame, mark: object = None) -> Version:
        """A new version with these rows only."""
        head = self.head()
        version = Version(head.number + 1, self._write(rows), mark)
        self.publish(version)
        return version

    def rewrite(self, parts: list[str], rows: DataFrame, mark: object = None) -> Version:
        """A new version in which ``rows`` take the place of the rows of ``parts``; they may be computed from these."""
        head = self.head()
        kept = {part: folder for part, folder in head.folders.items() if part not in parts}
        version = Version(head.number + 1, kept | self._write(rows), mark)
        self.publish(version)
        return version

    def merge(self, changes: DataFrame, combine: Combine, mark: object = None) -> Version:
        """Rewrite the parts that stored ``changes`` touch with ``combine(their rows, changes)``."""
        parts = self.parts_of(changes)
        return self.rewrite(parts, combine(self.rows(parts=parts), changes), mark)

    def absorb(self, log: DataFrame, column: str, combine: Combine, through: object = None) -> Version:
        """Merge the folders of a log beyond the table's mark, up to ``through`` (all there are), which becomes the mark.

        ``column`` is the log's folder column, and only the new folders are read.  A folder must be complete when it is
        absorbed; rows that come late come in a later folder.
        """
        fresh = self.unread(log, column)
        if through is None:
            through = fresh.agg(F.max(column)).first()[0]
            if through is None:
                return self.head()
        fresh = fresh.where(F.col(column) <= F.lit(through))
        return self.merge(fresh, combine, through if isinstance(through, int) else str(through))

    def unread(self, log: DataFrame, column: str, version: Version | None = None) -> DataFrame:
        """The rows of a log beyond the mark of a version."""
        mark = (version or self.head()).mark
        return log if mark is None else log.where(F.col(column) > F.lit(mark).cast(log.schema[column].dataType))

    def vacuum(self, keep: int = KEPT_VERSIONS) -> None:
        """Remove old versions, and the folders that no kept version names."""
        versions = self.versions()
        kept = versions[-keep:]
        for version in versions[:-keep]:
            remove_folder(self.spark, f"{self.root}/versions/of={version.number}")
        used = {folder for version in kept for folder in version.folders.values()}
        for write in folders_below(self.spark, f"{self.root}/rows"):
            path = f"{self.root}/rows/{write}"
            parts = [f"{path}/{name}" for name in folders_below(self.spark, path)]
            unused = [part for part in parts if part not in used]
            for folder in [path] if len(unused) == len(parts) else unused:
                remove_folder(self.spark, folder)


@dataclass(frozen=True)
class FoldedLog:
    """A log of changes, one folder ``change=N`` after another, that is folded into a table from time to time.

    ``combine(rows, changes)`` gives the rows that hold after the changes; ``changes`` has the log's columns and ``change``.
    Folding publishes first and removes afterwards, so that a run that fails in between loses nothing: readers pass over
    what the table already holds, and the next fold removes it.
    """

    table: VersionedTable
    log: str
    schema: T.StructType
    combine: Combine

    def changes(self) -> DataFrame:
        layout = T.StructType([*self.schema.fields, T.StructField("change", T.LongType())])
        if not folders_below(self.table.spark, self.log):
            return self.table.spark.createDataFrame([], layout)
        return self.table.spark.read.schema(layout).parquet(self.log)

    def folder(self, number: int) -> str:
        return f"{self.log}/change={number}"

    def current(self) -> DataFrame:
        """Rows that hold now: those of the table, with the changes not yet folded."""
        version = self.table.head()
        return self.combine(self.table.rows(version), self.table.unread(self.changes(), "change", version))

    def pending(self) -> list[int]:
        """Numbers of the folders that the table does not hold yet."""
        mark = self.table.head().mark
        numbers = sorted(int(name.removeprefix("change=")) for name in folders_below(self.table.spark, self.log) if name.startswith("change="))
        return [number for number in numbers if mark is None or number > mark]

    def fold(self, through: int) -> None:
        """Fold the changes up to number ``through``, which must be complete, and remove what nobody reads any more."""
        before = self.table.head().mark
        if any(number <= through for number in self.pending()):
            self.table.absorb(self.changes(), "change", self.combine, through)
        self.clean(before)

    def clean(self, before: int | None) -> None:
        """Remove the folders that the version before the newest holds already."""
        for name in folders_below(self.table.spark, self.log):
            if before is not None and name.startswith("change=") and int(name.removeprefix("change=")) <= before:
                remove_folder(self.table.spark, f"{self.log}/{name}")
        self.table.vacuum()
