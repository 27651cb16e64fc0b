"""The arrival-ordered source: the same answer however many steps a trigger takes, restarts and failed landings included."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemark.operators import identity, sequence
from telemark.sources import arrivals
from telemark.streaming import ledger, loads
from test_loads import OUTCOME as RECEIPT_COLUMNS
from test_loads import rows
from test_streaming import OUTCOME


def landed(deliveries, root, step_rows):
    """Three loads of shuffled rows; each load in arrival order after the one before."""
    edges = deliveries.approxQuantile("received_us", [0.3, 0.6], 0.0)
    slot = sum((F.col("received_us") > e).cast("int") for e in edges)
    for load in range(3):
        part = deliveries.where(slot == load).orderBy(F.rand(load))
        assert arrivals.land(part, root, load, step_rows)
        assert not arrivals.land(part, root, load, step_rows)


def test_answer_does_not_depend_on_steps_per_trigger(spark, tables, tmp_path):
    deliveries, root = tables.deliveries(), str(tmp_path / "in")
    landed(deliveries, root, deliveries.count() // 12)
    batch = identity.delivery_outcome(identity.identify(deliveries))
    disposed = sequence.sequence_disposition(
        batch.where("request_state = 'NEW' and packet_state = 'PACKET'")
    ).select("delivery_id", "sequence_disposition", "missing_before")
    want = sorted(map(tuple, batch.select(*OUTCOME).join(disposed, "delivery_id", "left").collect()), key=str)
    wide = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for per_trigger in (3, None):
            out, batches = str(tmp_path / f"out-{per_trigger}"), []

            def sink(batch, batch_id):
                batch.select(*OUTCOME, "sequence_disposition", "missing_before").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
                batches.append(batch_id)

            checkpoint = str(tmp_path / f"ck-{per_trigger}")
            stream = ledger.delivery_stream(arrivals.read_stream(spark, root, checkpoint, per_trigger))
            arrivals.run_caught_up(stream, sink, checkpoint)
            assert len(batches) >= (4 if per_trigger else 1)
            got = spark.read.parquet(out).drop("batch_id")
            assert sorted(map(tuple, got.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)


def test_batches_ascend_and_restarts_continue(spark, tables, tmp_path):
    deliveries, root, checkpoint = tables.deliveries(), str(tmp_path / "in"), str(tmp_path / "ck")
    half = deliveries.approxQuantile("received_us", [0.5], 0.0)[0]
    early, late = deliveries.where(F.col("received_us") <= half), deliveries.where(F.col("received_us") > half)
    arrivals.land(early, root, 0, early.count() // 5)
    seen = []

    def sink(batch, batch_id):
        edge = batch.agg(F.min(F.struct(*arrivals.ORDER)), F.max(F.struct(*arrivals.ORDER)), F.count("*")).first()
        seen.append((tuple(edge[0]), tuple(edge[1]), edge[2]))

    arrivals.run_caught_up(arrivals.read_stream(spark, root, checkpoint, 1), sink, checkpoint)
    first = len(seen)
    assert first >= 5 and sum(n for *_, n in seen) == early.count()
    # an interrupted landing is not seen, and its next try is
    late.limit(7).write.parquet(f"{root}/arrivals/load=1/step=0")
    arrivals.run_caught_up(arrivals.read_stream(spark, root, checkpoint, 1), sink, checkpoint)
    assert len(seen) == first
    arrivals.land(late, root, 1, late.count() // 5)
    arrivals.run_caught_up(arrivals.read_stream(spark, root, checkpoint, 2), sink, checkpoint)
    assert sum(n for *_, n in seen) == deliveries.count()
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:], strict=False))


def test_loads_from_the_stream(spark, tables, tmp_path):
    deliveries, root = tables.deliveries(), str(tmp_path / "in")
    landed(deliveries, root, deliveries.count() // 2)
    stored = loads.Ledger(spark, str(tmp_path / "ledger"))
    checkpoint = str(tmp_path / "ck")
    arrivals.run_caught_up(arrivals.read_stream(spark, root, checkpoint, 3), loads.load_sink(stored), checkpoint)
    batch = identity.receipts(identity.delivery_outcome(identity.identify(deliveries)))
    assert rows(stored.table("receipts"), RECEIPT_COLUMNS) == rows(batch, RECEIPT_COLUMNS)


def test_nothing_landed(spark, tmp_path):
    seen = []
    checkpoint = str(tmp_path / "ck")
    arrivals.run_caught_up(arrivals.read_stream(spark, str(tmp_path / "none"), checkpoint), lambda b, i: seen.append(b.count()), checkpoint)
    assert sum(seen) == 0
