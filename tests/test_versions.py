"""Versioned tables and folded logs: untouched parts stay, failures leave the version before, nothing is lost on the way."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockrisk.operators.latest import latest_per_key
from stockrisk.sources import versions
from stockrisk.sources.versions import FoldedLog, VersionedTable, folders_below, key_bucket

LAYOUT = T.StructType([T.StructField("k", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("v", T.StringType())])


def newest(rows, changes):
    return latest_per_key(rows.unionByName(changes.select(rows.columns)), ["k"], [F.desc("at")])


def table_of(spark, tmp_path):
    return VersionedTable(spark, f"{tmp_path}/table", LAYOUT, "substr(k, 1, 1)")


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), LAYOUT)


def content(df):
    return sorted(tuple(row) for row in df.collect())


def test_a_change_rewrites_the_parts_it_touches(spark, tmp_path):
    table = table_of(spark, tmp_path)
    assert table.rows().count() == 0 and table.head().number == 0
    first = table.replace(frame(spark, ("a1", 1, "x"), ("a2", 1, "x"), ("b1", 1, "x"), ("c/ :%", 1, "x")))
    assert set(first.folders) == {"a", "b", "c"}
    second = table.merge(frame(spark, ("a1", 2, "y"), ("d1", 1, "z")), newest)
    assert second.folders["b"] == first.folders["b"] and second.folders["a"] != first.folders["a"]
    assert content(table.rows()) == [("a1", 2, "y"), ("a2", 1, "x"), ("b1", 1, "x"), ("c/ :%", 1, "x"), ("d1", 1, "z")]
    assert content(table.rows(parts=["d", "no"])) == [("d1", 1, "z")]
    assert content(table.rows(first)) == [("a1", 1, "x"), ("a2", 1, "x"), ("b1", 1, "x"), ("c/ :%", 1, "x")]
    assert len(table.rows(parts=["a"]).inputFiles()) == 1


def test_parts_with_odd_names_and_an_emptied_part(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/odd", LAYOUT, "v")
    table.replace(frame(spark, ("a", 1, "x=y/z %"), ("b", 1, "2020-01-01"), ("c", 1, "7")))
    assert content(table.rows(parts=["x=y/z %"])) == [("a", 1, "x=y/z %")]
    table.rewrite(["x=y/z %", "7"], frame(spark, ("c", 2, "7")))
    assert set(table.head().folders) == {"2020-01-01", "7"} and content(table.rows(parts=["7"])) == [("c", 2, "7")]
    table.vacuum(keep=1)
    assert content(table.rows()) == [("b", 1, "2020-01-01"), ("c", 2, "7")]


def test_a_table_may_replace_what_it_reads(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.replace(frame(spark, ("a1", 1, "x"), ("b1", 1, "x")))
    table.replace(table.rows().withColumn("at", F.col("at") + 1))
    assert content(table.rows()) == [("a1", 2, "x"), ("b1", 2, "x")]


def test_a_failed_change_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path)
    table.replace(frame(spark, ("a1", 1, "x")))
    with monkeypatch.context() as broken:
        broken.setattr(VersionedTable, "publish", lambda self, version: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.merge(frame(spark, ("a1", 2, "y")), newest)
    assert content(table.rows()) == [("a1", 1, "x")]
    assert len(folders_below(spark, f"{table.root}/rows")) == 2
    table.merge(frame(spark, ("a1", 3, "z")), newest)
    table.vacuum()
    assert content(table.rows()) == [("a1", 3, "z")]
    assert len(folders_below(spark, f"{table.root}/rows")) == 2  # this version's and the one before
    assert len(table.versions()) == 2


def test_old_versions_go_and_shared_folders_stay(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.replace(frame(spark, ("a1", 0, "x"), ("b1", 0, "x")))
    for at in range(1, 5):
        table.merge(frame(spark, ("a1", at, "x")), newest)
        table.vacuum()
    assert [v.number for v in table.versions()] == [4, 5]
    assert content(table.rows()) == [("a1", 4, "x"), ("b1", 0, "x")]
    assert sum(len(folders_below(spark, f"{table.root}/rows/{w}")) for w in folders_below(spark, f"{table.root}/rows")) == 3


def folded(spark, tmp_path):
    return FoldedLog(table_of(spark, tmp_path), f"{tmp_path}/log", LAYOUT, newest)


def add(spark, log, number, *rows):
    frame(spark, *rows).coalesce(1).write.mode("overwrite").parquet(log.folder(number))


def test_folding_keeps_what_readers_see(spark, tmp_path):
    log = folded(spark, tmp_path)
    assert log.current().count() == 0 and log.pending() == []
    expected, folders = {}, 0
    for number in range(12):
        changes = [(f"{'abc'[number % 3]}{i}", number, f"v{number}") for i in range(number % 4 + 1)] + [("a0", -number, "late")]
        add(spark, log, number, *changes)
        for k, at, v in changes:
            if k not in expected or at > expected[k][0]:
                expected[k] = (at, v)
        if number % 3 == 2:
            log.fold(number - 1)
        assert content(log.current()) == sorted((k, *x) for k, x in expected.items())
        folders = max(folders, len(folders_below(spark, log.log)))
    assert log.pending() == [11] and folders <= 7
    assert len(folders_below(spark, log.log)) <= 4


def test_a_crash_between_fold_and_removal(spark, tmp_path, monkeypatch):
    log = folded(spark, tmp_path)
    for number in range(4):
        add(spark, log, number, ("a", number, "x"), (f"b{number}", 0, "x"))
    with monkeypatch.context() as broken:
        broken.setattr(versions, "remove_folder", lambda spark, path: 1 / 0)
        log.fold(1)
        with pytest.raises(ZeroDivisionError):
            log.fold(2)
    expected = [("a", 3, "x"), *[(f"b{n}", 0, "x") for n in range(4)]]
    assert content(log.current()) == expected and log.pending() == [3]
    again = folded(spark, tmp_path)  # after a restart
    again.fold(2)
    assert content(again.current()) == expected
    add(spark, again, 4, ("a", 9, "y"))
    again.fold(4)
    again.fold(4)
    assert content(again.current()) == sorted([("a", 9, "y"), *expected[1:]]) and again.pending() == []


def test_only_new_folders_are_read(spark, tmp_path):
    log = folded(spark, tmp_path)
    for number in range(3):
        add(spark, log, number, ("a", number, "x"))
    log.fold(1)
    plan = log.table.unread(log.changes(), "change")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(change" in plan and "(change" in plan


def test_buckets_of_keys(spark):
    keys = spark.range(1000).selectExpr("'s' AS seller_id", "'m' AS marketplace_id", "concat('k', id) AS seller_sku")
    counts = {r[0]: r[1] for r in keys.groupBy(F.expr(key_bucket(8))).count().collect()}
    assert set(counts) == {f"b{i}" for i in range(8)} and max(counts.values()) < 250
