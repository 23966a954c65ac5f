"""Streams run to completion give what the batch jobs give; late rows are dropped."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from places import SMALL
from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockrisk.operators.latest import latest_inventory
from stockrisk.operators.measures import trailing_sales, trailing_sales_of_days
from stockrisk.plans import catalog
from stockrisk.schemas import INVENTORY, KEY
from stockrisk.sources import order_history as oh
from stockrisk.sources import versions
from stockrisk.sources.versions import folders_below
from stockrisk.streaming import jobs

SALE = "seller_id string, marketplace_id string, seller_sku string, sold_at timestamp_ntz, units int, amount decimal(12,2)"


def file_stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def sales(spark, rows):
    return spark.createDataFrame([("s", "m", sku, at, n) for sku, at, n in rows],
        "seller_id string, marketplace_id string, seller_sku string, sold_at timestamp_ntz, units int"
    ).withColumn("amount", F.expr("cast(units * 2 AS decimal(12,2))"))


def test_daily_sales_drop_only_late_rows(spark, tmp_path):
    """Three micro-batches; a restart in between; one row arrives after its day was closed."""
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/cp"
    log = jobs.daily_sales_log(spark, f"{tmp_path}/daily")
    day = datetime(2024, 1, 10)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        arrivals = [
            [("A", day, 1), ("A", day + timedelta(hours=23, minutes=59), 2), ("B", day, 5)],
            [("A", day + timedelta(hours=12), 4), ("A", day + timedelta(days=5), 7)],
            [("A", day, 100), ("B", day + timedelta(days=5), 3)],  # the first is five days late
        ]
        for rows in arrivals:
            sales(spark, rows).coalesce(1).write.mode("append").parquet(folder)
            jobs.stream_sales_daily(file_stream(spark, folder, SALE), log, checkpoint).awaitTermination()
        current = log.current()
        ours = {(r.seller_sku, r.sold_on): (r.units, float(r.amount)) for r in current.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    # Daily totals feed the trailing windows as well as single sales do.
    windows = trailing_sales(current, ["seller_sku"], [later := date(2024, 1, 15)])
    assert {r.seller_sku: (r.sales_units_1d, r.sales_units_7d) for r in windows.collect()} == {
        "A": (7, 14),
        "B": (3, 8),
    }
    assert ours == {
        ("A", date(2024, 1, 10)): (7, 14.0),
        ("B", date(2024, 1, 10)): (5, 10.0),
        ("A", later): (7, 14.0),
        ("B", later): (3, 6.0),
    }


def test_latest_inventory_does_not_depend_on_arrival_order(spark, tmp_path):
    snapshots = catalog.model(spark, SMALL).inventory
    for number, order in enumerate([F.asc("id"), F.desc("sync_time")]):
        folder = f"{tmp_path}/in{number}"
        pieces = snapshots.withColumn("piece", F.ntile(3).over(Window.orderBy(order)))
        for piece in (1, 2, 3):
            pieces.filter(F.col("piece") == piece).drop("piece").coalesce(1).write.mode("append").parquet(folder)
        log = jobs.inventory_log(spark, f"{tmp_path}/log{number}", buckets=3)
        stream = file_stream(spark, folder, INVENTORY)
        jobs.stream_latest_inventory(stream, log, f"{tmp_path}/cp{number}", fold_every=2).awaitTermination()
        current = log.current()
        assert log.pending() == [2] and log.table.rows().count() > 0
        batch = latest_inventory(snapshots)
        assert current.exceptAll(batch).count() == 0 and current.count() == batch.count()


def test_a_folded_log_gives_what_an_unfolded_one_gives(spark, tmp_path, monkeypatch):
    """Twelve micro-batches with restarts, late rows, and a crash between a fold and its removals."""
    folder = f"{tmp_path}/in"
    day = datetime(2024, 1, 28)
    logs = {every: jobs.daily_sales_log(spark, f"{tmp_path}/daily{every}") for every in (2, 1000)}
    real = versions.remove_folder

    def crash_once(session, path):
        monkeypatch.setattr(versions, "remove_folder", real)
        raise OSError("lost")

    crashes = 0
    for number in range(6):
        at = day + timedelta(days=number)
        rows = [("A", at, 1), ("B", at + timedelta(hours=1), 2), ("A", at - timedelta(hours=20), 3), ("C", day - timedelta(days=9), 50)]
        for half in (rows[:2], rows[2:]):
            sales(spark, half).coalesce(1).write.mode("append").parquet(folder)
        for every, log in logs.items():
            if every == 2 and number == 3:
                monkeypatch.setattr(versions, "remove_folder", crash_once)
            for _ in range(2):
                stream = file_stream(spark, folder, SALE)
                query = jobs.stream_sales_daily(stream, log, f"{tmp_path}/cp{every}", fold_every=every)
                try:
                    query.awaitTermination()
                    break
                except StreamingQueryException:
                    crashes += 1
            assert len(folders_below(spark, log.log)) <= 6 or every == 1000
    assert crashes == 1
    folded, plain = (log.current() for log in logs.values())
    assert sorted(folded.collect()) == sorted(plain.collect()) and folded.count() > 10
    assert len(logs[2].table.head().folders) == 2 and not logs[1000].table.head().folders  # two months
    # Windows for any date come out of the folded table, which holds all but the last changes.
    last = logs[2].pending()[-1]
    logs[2].fold(last)
    dates = [date(2024, 1, 30), date(2024, 2, 2)]
    ours = trailing_sales_of_days(logs[2].table, ["seller_sku"], dates)
    assert sorted(ours.collect()) == sorted(trailing_sales(plain, ["seller_sku"], dates).collect()) and ours.count() >= 4


def alert_stream(spark, model, tmp_path, log, **sources):
    """All four sources as streams; a source given as a folder arrives file by file, the others at once."""
    streams = []
    for name in ("products", "inventory", "sales", "configs"):
        rows = getattr(model, name)
        if name not in sources:
            rows.write.mode("ignore").parquet(f"{tmp_path}/{name}")
            streams.append(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/{name}"))
        else:
            streams.append(file_stream(spark, sources[name], rows.schema))
    return jobs.stream_stockout_alerts(*streams, log, f"{tmp_path}/cp", oh.BATCH_ID, oh.AS_OF, oh.CREATED_AT, fold_every=2)


def stockout_tasks(model):
    with_stock = model.facts.filter("has_inventory").select(*KEY)
    return model.tasks.filter("task_type = 'stockout_warning'").join(with_stock, KEY, "left_semi")


def test_alerts_follow_the_newest_rows_of_all_sources(spark, tmp_path):
    """Snapshots and sales arrive by date, newest first for sales; alerts that no longer hold disappear, raised ones stay."""
    model = catalog.model(spark, SMALL)
    arrivals = {"inventory": f"{tmp_path}/snapshots", "sales": f"{tmp_path}/summaries"}
    log = jobs.alert_log(spark, f"{tmp_path}/alerts", buckets=3)
    raised = f"{tmp_path}/raised"
    steps = [("inventory", "id % 10 = 1"), ("sales", "id % 10 = 2"), ("inventory", "id % 10 = 2"), ("sales", "id % 10 = 1"), ("inventory", "id % 10 > 2")]
    model.sales.limit(0).write.parquet(arrivals["sales"])
    seen = set()
    for name, rows in steps:
        getattr(model, name).filter(rows).coalesce(1).write.mode("append").parquet(arrivals[name])
        alert_stream(spark, model, tmp_path, log, **arrivals).awaitTermination()
        jobs.stream_raised_alerts(log, raised, f"{tmp_path}/raised-cp").awaitTermination()
        seen |= {row.task_id for row in jobs.current_alerts(log).collect()}
    batch = stockout_tasks(model)
    alerts = jobs.current_alerts(log)
    assert alerts.select(batch.columns).exceptAll(batch).count() == 0
    assert alerts.count() == batch.count() > 50
    once = [row.task_id for row in spark.read.parquet(raised).collect()]
    assert len(once) == len(set(once)) and set(once) == seen > {row.task_id for row in batch.collect()}
    assert len(folders_below(spark, f"{tmp_path}/alerts/states")) == 1


def test_a_micro_batch_of_alerts_reads_no_table(spark, tmp_path, monkeypatch):
    model = catalog.model(spark, SMALL)
    files = []
    real = jobs.alert_states

    def watched(states, *rest):
        found = real(states, *rest)
        files.append(found.inputFiles())
        return found

    monkeypatch.setattr(jobs, "alert_states", watched)
    alert_stream(spark, model, tmp_path, jobs.alert_log(spark, f"{tmp_path}/alerts")).awaitTermination()
    assert len(files) == 1 and files[0] and all("/states/change=" in file for file in files[0])


def test_repeated_micro_batches_raise_an_alert_once(spark, tmp_path):
    model = catalog.model(spark, SMALL)
    log = jobs.alert_log(spark, f"{tmp_path}/alerts")
    raised = f"{tmp_path}/raised"
    alert_stream(spark, model, tmp_path, log).awaitTermination()
    for _ in range(2):
        jobs.stream_raised_alerts(log, raised, f"{tmp_path}/raised-cp").awaitTermination()
        spark.read.parquet(log.folder(0)).write.parquet(f"{tmp_path}/again{_}")
        spark.read.parquet(f"{tmp_path}/again{_}").write.mode("overwrite").parquet(log.folder(0))
    assert spark.read.parquet(raised).count() == stockout_tasks(model).count()
