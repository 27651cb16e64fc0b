"""Readers and append sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from telemark.operators import identity, legacy
from telemark.sources import landing, readers, sinks


def test_append_once_and_prune(spark, tables, tmp_path):
    root = str(tmp_path)
    receipts = identity.receipts(tables.outcome())
    sinks.append_new(receipts, root, "receipts")
    sinks.append_new(receipts, root, "receipts")
    stored = readers.read_table(spark, root, "receipts")
    assert stored.count() == receipts.count()
    raw = spark.read.parquet(f"{root}/receipts")
    day = raw.first().receipt_date
    plan = raw.where(F.col("receipt_date") == F.lit(day))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(receipt_date" in plan


def test_key_twice_in_a_load_is_stored_once(spark, tables, tmp_path):
    root = str(tmp_path)
    samples = tables.health_samples()
    for name, rows in (("health_samples", samples), ("alerts", legacy.alerts(samples))):
        for _ in range(2):
            sinks.append_new(rows.unionByName(rows), root, name)
        stored = spark.read.parquet(f"{root}/{name}")
        assert stored.count() == rows.dropDuplicates(list(sinks.STORED[name][1])).count()
        days = stored.select("receipt_date").distinct().count()
        assert len(stored.inputFiles()) <= days + 4  # shuffle partitions, not tasks times dates


def test_null_key_parts_equal_each_other(spark, tables, tmp_path):
    samples = tables.health_samples().limit(5).withColumn("source", F.lit(None).cast("string"))
    for _ in range(2):
        sinks.append_new(samples.unionByName(samples), str(tmp_path), "health_samples")
    key = list(sinks.STORED["health_samples"][1])
    assert spark.read.parquet(f"{tmp_path}/health_samples").count() == samples.select(*key).distinct().count()


def test_a_later_load_adds_only_what_is_new(spark, tables, tmp_path):
    receipts = identity.receipts(tables.outcome())
    sinks.append_new(receipts.where("receipt_id % 3 = 0"), str(tmp_path), "receipts")
    sinks.append_new(receipts, str(tmp_path), "receipts")
    stored = spark.read.parquet(f"{tmp_path}/receipts")
    assert stored.count() == stored.select("receipt_id").distinct().count() == receipts.count()


def test_landed_files_are_in_arrival_order(spark, tables, tmp_path):
    path = f"{tmp_path}/in"
    shuffled = tables.deliveries().orderBy(F.rand(3))
    cut = shuffled.approxQuantile("received_us", [0.5], 0.0)[0]
    made = landing.land_in_order(shuffled.where(F.col("received_us") <= cut), path, 100)
    made += landing.land_in_order(shuffled.where(F.col("received_us") > cut), path, 100)
    files = sorted(Path(path).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == made >= 10
    assert [f.name for f in files] == sorted(f.name for f in files)
    assert len({f.stat().st_mtime_ns for f in files}) == made
    seen = [tuple(r) for f in files for r in spark.read.parquet(str(f)).select(*landing.ORDER).collect()]
    assert seen == sorted(seen) and len(seen) == tables.deliveries().count()


def test_nothing_landed(spark, tables, tmp_path):
    landing.land_in_order(tables.deliveries().limit(0), f"{tmp_path}/in")
    assert spark.read.schema(tables.deliveries().schema).parquet(f"{tmp_path}/in").count() == 0


def test_deliveries_from_messages(spark):
    messages = spark.createDataFrame(
        [(bytearray(b"\1\2"), 3, 7, [("X-Request-ID", bytearray(b"r")), ("Content-Type", bytearray(b"text/plain"))])],
        "value binary, partition int, offset bigint, headers array<struct<key:string,value:binary>>",
    ).withColumn("timestamp", F.timestamp_micros(F.lit(1784203200000001)))
    row = readers.deliveries_from_messages(messages).first()
    assert (row.delivery_id, row.received_us, row.request_id, row.content_type, bytes(row.raw_body)) == (
        (3 << 48) + 7, 1784203200000001, "r", "text/plain", b"\1\2")


def test_stream_reader(spark, tables, tmp_path):
    tables.deliveries().limit(20).write.parquet(f"{tmp_path}/deliveries")
    stream = readers.stream_table(spark, str(tmp_path), "deliveries", 1)
    seen = []
    query = (
        stream.writeStream.foreachBatch(lambda b, i: seen.append(b.count()))
        .option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sum(seen) == 20
