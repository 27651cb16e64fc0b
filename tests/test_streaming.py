"""The stream gives the batch results when fed in arrival order."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemark.operators import identity, legacy, metrics, sequence
from telemark.sources import landing
from telemark.streaming import ledger

OUTCOME = [
    "delivery_id", "request_state", "first_delivery_id", "packet_state", "origin_delivery_id",
    "validation_status", "rejection_reason", "response_code",
]


def in_files(df, order, path, parts):
    """Consecutive arrival ranges as separate files, oldest first."""
    bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    edges = [None, *bounds, None]
    for i in range(parts):
        part = df
        if edges[i] is not None:
            part = part.where(F.col(order) > edges[i])
        if edges[i + 1] is not None:
            part = part.where(F.col(order) <= edges[i + 1])
        part.coalesce(1).write.mode("append").parquet(path)


def test_delivery_stream_equals_batch(spark, tables, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    deliveries = tables.deliveries()
    in_files(deliveries, "received_us", source, 3)
    out = []

    def sink(batch, batch_id):
        ledger.write_batch(root)(batch, batch_id)
        batch.select(*OUTCOME, "sequence_disposition", "missing_before").write.mode(
            "overwrite"
        ).parquet(f"{root}/outcome/batch_id={batch_id}")
        out.append(batch_id)

    stream = ledger.delivery_stream(ledger.read_deliveries(spark, source, 1))
    ledger.run_available(stream, sink, str(tmp_path / "ck"))
    assert len(out) >= 3
    got = spark.read.parquet(f"{root}/outcome")
    batch = identity.delivery_outcome(identity.identify(deliveries))
    assert sorted(map(tuple, got.select(*OUTCOME).collect()), key=str) == sorted(
        map(tuple, batch.select(*OUTCOME).collect()), key=str
    )
    disposed = sequence.sequence_disposition(
        batch.where("request_state = 'NEW' and packet_state = 'PACKET'")
    ).select("delivery_id", "sequence_disposition", "missing_before")
    streamed = got.where("sequence_disposition is not null").select(*disposed.columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, disposed.collect()))
    receipts = spark.read.parquet(f"{root}/receipts").count()
    assert receipts == identity.receipts(batch).count()

    # a restart on the same checkpoint finds nothing new and adds nothing
    ledger.run_available(
        ledger.delivery_stream(ledger.read_deliveries(spark, source, 1)), sink, str(tmp_path / "ck")
    )
    assert spark.read.parquet(f"{root}/receipts").count() == receipts


def test_answer_does_not_depend_on_files_per_trigger(spark, tables, tmp_path):
    deliveries, source = tables.deliveries(), str(tmp_path / "in")
    unordered = str(tmp_path / "unordered")
    deliveries.repartition(20).write.parquet(unordered)
    landing.land_in_order(spark.read.parquet(unordered), source, deliveries.count() // 20)
    batch = identity.delivery_outcome(identity.identify(deliveries))
    disposed = sequence.sequence_disposition(
        batch.where("request_state = 'NEW' and packet_state = 'PACKET'")
    ).select("delivery_id", "sequence_disposition", "missing_before")
    want = sorted(map(tuple, batch.select(*OUTCOME).join(disposed, "delivery_id", "left").collect()), key=str)
    wide = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for per_trigger in (1, 3, 1000):
            out, batches = str(tmp_path / f"out-{per_trigger}"), []

            def sink(rows, batch_id):
                rows.select(*OUTCOME, "sequence_disposition", "missing_before").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
                batches.append(batch_id)

            stream = ledger.delivery_stream(ledger.read_deliveries(spark, source, per_trigger))
            ledger.run_available(stream, sink, str(tmp_path / f"ck-{per_trigger}"))
            assert len(batches) >= 20 // per_trigger
            got = spark.read.parquet(out).drop("batch_id")
            assert sorted(map(tuple, got.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)


def test_repeated_batch_leaves_tables_unchanged(spark, tables, tmp_path):
    outcome = identity.delivery_outcome(identity.identify(tables.deliveries())).withColumns(
        {"sequence_disposition": F.lit("FIRST"), "missing_before": F.lit(0)}
    )
    sink = ledger.write_batch(str(tmp_path))
    sink(outcome, 7)
    once = spark.read.parquet(f"{tmp_path}/receipts").count()
    sink(outcome, 7)
    assert spark.read.parquet(f"{tmp_path}/receipts").count() == once


def test_rate_and_absence_streams_equal_batch(spark, tables, tmp_path):
    samples = tables.health_samples()
    source = str(tmp_path / "in")
    in_files(samples, "received_ns", source, 2)

    def read():
        return (
            spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(source)
        )

    def collected(stream, name):
        path = str(tmp_path / name)
        sink = lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch_id={i}")
        ledger.run_available(stream, sink, str(tmp_path / f"ck-{name}"))
        return spark.read.parquet(path).drop("batch_id")

    rates = {tuple(r) for r in collected(ledger.frame_rate_stream(read()), "rate").collect()}
    expected = {tuple(r) for r in metrics.frame_rate(samples).collect()}
    # windows at the end stay open until the watermark passes them
    assert rates <= expected and len(expected - rates) <= 10

    fired = collected(ledger.stopped_stream(read()), "stopped")
    starts = {r.at_us for r in fired.where("state = 'FIRING'").collect()}
    empty = legacy.alerts(samples).limit(0)
    gaps = legacy.sequence_gaps(tables.legacy_packets()).limit(0)
    intervals = metrics.alert_rules(samples, gaps, empty).collect()
    want = {r.start_us for r in intervals}
    assert want - starts == set() and len(starts - want) <= 1


def test_increase_stream_equals_batch(spark, tables, tmp_path):
    events = legacy.alerts(tables.health_samples())
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    in_files(events, "created_ns", source, 2)
    read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream = ledger.increase_stream(read, "created_ns", ["severity"], F.lit(1))
    sink = lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}")
    ledger.run_available(stream, sink, str(tmp_path / "ck"))
    got = {tuple(r) for r in spark.read.parquet(out).drop("batch_id").collect()}
    minute, want = 60_000_000, {}
    for r in events.select("created_ns", "severity").collect():
        at = r.created_ns // 1000
        for k in range(5):
            window = ((at // minute - k) * minute, r.severity)
            want[window] = want.get(window, 0) + 1
    want = {(start, severity, n) for (start, severity), n in want.items()}
    # windows at the end stay open until the watermark passes them
    last = max(start for start, *_ in want)
    assert got <= want and all(last - start <= 10 * minute for start, *_ in want - got)


def test_bulk_loads_equal_one_batch(spark, tables, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    deliveries = tables.deliveries()
    in_files(deliveries, "received_us", source, 3)
    sink = ledger.bulk_sink(root)
    for _ in range(2):  # the second run finds nothing new
        ledger.run_available(ledger.read_deliveries(spark, source, 1), sink, str(tmp_path / "ck"))
    got = spark.read.parquet(f"{root}/outcome")
    assert got.select("batch_id").distinct().count() >= 3
    batch = identity.delivery_outcome(identity.identify(deliveries))
    assert sorted(map(tuple, got.select(*OUTCOME).collect()), key=str) == sorted(
        map(tuple, batch.select(*OUTCOME).collect()), key=str
    )
    disposed = sequence.sequence_disposition(
        batch.where("request_state = 'NEW' and packet_state = 'PACKET'")
    ).select("delivery_id", "sequence_disposition", "missing_before", "high_water_before")
    packets = spark.read.parquet(f"{root}/packets").select(*disposed.columns)
    assert sorted(map(tuple, packets.collect()), key=str) == sorted(
        map(tuple, disposed.collect()), key=str
    )
    last = got.agg(F.max("batch_id")).first()[0]
    state = spark.read.parquet(f"{root}/sequence_state/batch_id={last}")
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, sequence.sequence_state(spark.read.parquet(f"{root}/packets")).select(*state.columns).collect()))
    assert spark.read.parquet(f"{root}/state_conflicts").count() == 0
