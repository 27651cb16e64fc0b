"""Replay, conflict and duplicate scenarios, and hot groups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from telemark.operators import identity, sequence
from test_wire import RECEIVED_US, frame

OCTET = "application/octet-stream"


def request(n: int) -> str:
    return f"{n:08x}-0000-4000-8000-000000000000"


def deliveries(spark, rows):
    return spark.createDataFrame(
        [(i, RECEIVED_US + at, rid, ct, bytearray(raw)) for i, at, rid, ct, raw in rows],
        "delivery_id bigint, received_us bigint, request_id string, content_type string, "
        "raw_body binary",
    )


def outcome(spark, rows):
    done = identity.delivery_outcome(identity.identify(deliveries(spark, rows)))
    return {r.delivery_id: r for r in done.collect()}, done


def test_request_replay_and_conflict(spark):
    good, changed = frame(), frame(voltage_mv=28101)
    got, done = outcome(spark, [
        (1, 0, request(1), OCTET, good), (2, 1, request(1), OCTET, good),
        (3, 2, request(1), OCTET, changed), (4, 3, request(1), OCTET, changed)])
    assert [got[i].request_state for i in (1, 2, 3, 4)] == ["NEW", "REPLAY", "CONFLICT", "CONFLICT"]
    assert [got[i].response_code for i in (1, 2, 3, 4)] == [202, 200, 409, 409]
    receipts = {r.receipt_id: r for r in identity.receipts(done).collect()}
    assert set(receipts) == {1, 3, 4} and receipts[3].duplicate_of_receipt_id == 1
    assert receipts[3].rejection_reason == identity.REQUEST_CONFLICT


def test_duplicates_gaps_and_state(spark):
    got, done = outcome(spark, [
        (1, 0, request(1), OCTET, frame(sequence_number=10)),
        (2, 1, request(2), OCTET, frame(sequence_number=13)),
        (3, 2, request(3), OCTET, frame(sequence_number=13)),
        (4, 3, request(4), OCTET, frame(sequence_number=13, voltage_mv=1)),
        (5, 4, request(3), OCTET, frame(sequence_number=13)),
        (6, 5, request(4), OCTET, frame(sequence_number=13, voltage_mv=1))])
    states = [got[i].packet_state for i in range(1, 7)]
    assert states == ["PACKET", "PACKET", "DUPLICATE", "CONFLICT", "DUPLICATE", "CONFLICT"]
    assert [got[i].response_code for i in range(1, 7)] == [202, 202, 200, 409, 200, 409]
    packets = done.where("packet_state = 'PACKET' and request_state = 'NEW'")
    disposed = sequence.sequence_disposition(packets)
    rows = {r.sequence_number: r for r in disposed.collect()}
    assert (rows[10].sequence_disposition, rows[10].missing_before) == ("FIRST", 10)
    assert (rows[13].sequence_disposition, rows[13].missing_before) == ("GAP", 2)
    state = sequence.sequence_state(disposed).first()
    assert (state.high_water_sequence, state.accepted_packet_count, state.missing_packet_count) == (
        13, 2, 12)


def test_rejected_makes_no_packet_and_replays_as_rejected(spark):
    got, done = outcome(spark, [
        (1, 0, request(1), OCTET, b""), (2, 1, request(1), OCTET, b""),
        (3, 2, request(2), "text/plain", frame()), (4, 3, request(2), OCTET, frame()),
        (5, 4, None, OCTET, frame()), (6, 5, "x", OCTET, frame())])
    assert [got[i].validation_status for i in range(1, 7)] == ["REJECTED"] * 6
    assert [got[i].response_code for i in range(1, 7)] == [422, 422, 400, 422, 400, 400]
    assert identity.quarantine(done).count() == 4
    assert done.where("packet_state is not null").count() == 0


def test_replay_is_judged_by_its_first_receipt_time(spark):
    ahead = frame(timestamp_us=RECEIVED_US + 300000001)
    got, _ = outcome(spark, [(1, 0, request(1), OCTET, ahead), (2, 10, request(1), OCTET, ahead)])
    assert got[2].rejection_reason == "TIMESTAMP_TOO_FAR_IN_FUTURE"


def test_state_conflict_of_a_later_load(spark):
    packets = spark.createDataFrame([(1, 42, 7), (1, 43, 7)], "payload_id bigint, boot_id bigint, sequence_number bigint")
    state = spark.createDataFrame([(1, 42, 7)], "payload_id bigint, boot_id bigint, high_water_sequence bigint")
    got = [(r.boot_id, r.state_conflict) for r in sequence.state_conflicts(packets, state).collect()]
    assert got == [(42, "SEQUENCE_STATE_CONFLICT")]


def test_hot_groups_are_split(spark, tmp_path):
    """A third of all rows under one request id, a third under one packet key and
    a third without a request id: same result, and the join splits the hot side."""
    n = 20000
    body = frame(sequence_number=5)
    third = F.col("id") % 3
    rows = spark.range(3 * n).select(
        F.col("id").alias("delivery_id"),
        (F.lit(RECEIVED_US) + F.col("id")).alias("received_us"),
        F.when(third == 0, request(0xFFFFFFFF))
        .when(third == 1, F.concat(F.lpad(F.hex("id"), 8, "0"), F.lit("-0000-4000-8000-000000000000")))
        .alias("request_id"),
        F.lit(OCTET).alias("content_type"),
        F.lit(bytearray(body)).alias("raw_body"),
    )
    rows = rows.withColumn("request_id", F.lower("request_id"))
    path = str(tmp_path / "hot")
    rows.repartition(8).write.parquet(path)
    stored = spark.read.parquet(path)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        done = identity.request_identity(stored)
        counts = {r.request_state: r["count"] for r in done.groupBy("request_state").count().collect()}
        plan_source = identity.request_identity(stored)
        plan_source.write.format("noop").mode("overwrite").save()
        joined = plan_source.select("delivery_id", "request_state")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert counts == {"NEW": 2 * n + 1, "REPLAY": n - 1}
    assert "skew=true" in plan
    final = identity.delivery_outcome(identity.identify(stored))
    states = {r.packet_state: r["count"] for r in final.where("request_state='NEW'").groupBy("packet_state").count().collect()}
    assert states == {"PACKET": 1, "DUPLICATE": n, None: n}


def test_every_canonical_id_form(spark):
    ids = [str(uuid.UUID(int=i, version=4)) for i in range(50)]
    rows = [(i, i, rid, OCTET, frame(sequence_number=i)) for i, rid in enumerate(ids)]
    got, _ = outcome(spark, rows)
    assert {r.validation_status for r in got.values()} == {"ACCEPTED"}
