"""Version 1 command and acknowledgement frames, history, deadlines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from telemark.functions import command_wire as cw
from telemark.functions import wire
from telemark.operators import command_history as ch

COMMAND = bytes.fromhex(
    "010152f274b5508a4f46902205992e7c96a301010100000656b92df17000000656b92fbb338002360d5332"
)
ACK = bytes.fromhex(
    "010252f274b5508a4f46902205992e7c96a30101040000000000002a00000007000656b92e00b240ef1cae4d"
)
ID = "52f274b5-508a-4f46-9022-05992e7c96a3"
NOON = 1784203200000000


def raw(spark, *values, name="raw_command"):
    return spark.createDataFrame([(bytearray(v),) for v in values], f"{name} binary")


def test_golden_command(spark):
    row = cw.decode_commands(raw(spark, COMMAND)).first()
    assert row.frame_rejection is None
    assert (row.command_id, row.payload_id, row.opcode, row.argument_length, row.argument) == (ID, 1, 1, 1, 2)
    assert (row.issued_us, row.expires_us) == (NOON, NOON + 30000000)
    body = cw.command_body(*(F.lit(v) for v in (1, 1, ID, 1, 1, 1, 0, NOON, NOON + 30000000, 2)))
    assert bytes(wire.with_crc(spark.range(1), body, "r").first().r) == COMMAND


def test_golden_ack(spark):
    row = cw.decode_acks(raw(spark, ACK, name="raw_ack")).withColumn("n", cw.ack_name("ack_type")).first()
    assert row.frame_rejection is None
    assert (row.command_id, row.payload_id, row.opcode, row.n, row.reason_code, row.boot_id,
            row.sequence_number, row.event_us) == (ID, 1, 1, "EXECUTED", 0, 42, 7, NOON + 1000000)
    body = cw.ack_body(*(F.lit(v) for v in (ID, 1, 1, 4, 0, 0, 42, 7, NOON + 1000000)))
    assert bytes(wire.with_crc(spark.range(1), body, "r").first().r) == ACK


def test_damage(spark):
    flipped = bytearray(COMMAND); flipped[20] ^= 1
    got = [r.frame_rejection for r in cw.decode_commands(raw(spark, flipped, COMMAND[:41], b"", b"\2", COMMAND + b"0")).collect()]
    assert got == ["CRC_MISMATCH", "INVALID_FRAME_LENGTH", "EMPTY_BODY", "UNSUPPORTED_PROTOCOL_VERSION", "INVALID_FRAME_LENGTH"]
    broken = bytearray(ACK); broken[40] ^= 1
    assert [r.frame_rejection for r in cw.decode_acks(raw(spark, broken, ACK[:-1], name="raw_ack")).collect()] == [
        "CRC_MISMATCH", "INVALID_FRAME_LENGTH"]


def test_clock(spark):
    df = spark.createDataFrame(
        [(0, 10_000_000, 12_000_000), (0, 10_000_000, 12_000_001), (2_000_001, 9_000_000, 0), (2_000_000, 9_000_000, 0)],
        "issued_us bigint, expires_us bigint, at_us bigint")
    got = [r[0] for r in df.select(cw.clock_rejection("issued_us", "expires_us", "at_us")).collect()]
    assert got == [None, "COMMAND_EXPIRED", "CLOCK_SKEW", None]


def fold(events):
    state, path = "CREATED", []
    for no, event, reason in events:
        legal = event in ch.TRANSITIONS[state]
        if state == "UNKNOWN" and event == "REJECTED" and reason == "EXECUTION_ABORTED":
            legal = False
        if legal:
            path.append((no, state, event)); state = event
    return path


@pytest.mark.parametrize("block_rows", [2, 7, 1 << 20])
def test_history_equals_fold(spark, block_rows):
    rng = random.Random(block_rows)
    normal = ["VALIDATED", "QUEUED", "SENT", "RECEIVED", "ACCEPTED", "EXECUTED"]
    streams = {"hot": rng.choices(ch.STATES[1:], k=300)}
    for i in range(20):
        streams[f"c{i}"] = normal[: rng.randrange(1, 7)] + rng.choices(ch.STATES[1:], k=rng.randrange(12))
    rows, plain = [], {}
    for c, stream in streams.items():
        for j, event in enumerate(stream):
            reason = rng.choice([None, "EXECUTION_ABORTED", "PAYLOAD_BUSY"]) if event == "REJECTED" else None
            rows.append((c, len(rows), j * 1000, event, reason))
            plain.setdefault(c, []).append((rows[-1][1], event, reason))
    events = spark.createDataFrame(rows, "command_id string, event_no bigint, at_us bigint, event string, reason string")
    history = ch.command_history(events, block_rows)
    got = {}
    for r in history.orderBy("event_no").collect():
        got.setdefault(r.command_id, []).append((r.event_no, r.from_state, r.to_state))
    want = {c: fold(e) for c, e in plain.items() if fold(e)}
    assert got == want
    assert ch.illegal_events(events, history).count() == len(rows) - sum(map(len, want.values()))


def test_deadlines(spark):
    rows = [("a", 1, 0, "VALIDATED"), ("a", 2, 0, "QUEUED"), ("a", 3, 0, "SENT"), ("a", 4, 5_000_000, "RECEIVED"),
            ("a", 5, 10_000_001, "ACCEPTED"), ("a", 6, 20_000_001, "EXECUTED")]
    events = spark.createDataFrame([(*r, None) for r in rows], "command_id string, event_no bigint, at_us bigint, event string, reason string")
    commands = spark.createDataFrame([("a", 1)], "command_id string, opcode bigint")
    late = ch.missed_deadlines(ch.command_history(events), commands, 10**12).collect()
    assert [(r.last_state, r.deadline_us, r.to_state) for r in late] == [
        ("RECEIVED", 10_000_000, "TIMED_OUT"), ("RECEIVED", 10_000_000, "UNKNOWN")]


def test_idempotency(spark):
    rows = [(1, 0, "op", "k", 1, "SET_PAYLOAD_MODE", '{"mode":"SAFE"}'),
            (2, 1, "op", "k", 1, "SET_PAYLOAD_MODE", ' { "mode" : "SAFE" }'),
            (3, 2, "op", "k", 1, "SET_PAYLOAD_MODE", '{"mode":"SCIENCE"}'),
            (4, 3, "other", "k", 1, "RESET_PAYLOAD", "{}"), (5, 4, "op", "k2", 1, "RESET_PAYLOAD", "{}")]
    df = spark.createDataFrame(rows, "request_no bigint, received_us bigint, operator_id string, "
                               "idempotency_key string, payload_id bigint, name string, arguments string")
    got = {r.request_no: r.intent for r in ch.operator_idempotency(df).collect()}
    assert got == {1: "NEW", 2: "REPLAY", 3: "CONFLICT", 4: "NEW", 5: "NEW"}
