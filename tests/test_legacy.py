from __future__ import annotations

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from telemark.functions import legacy_wire as lw
from telemark.functions import wire
from telemark.operators import commands, legacy


def packet(apid, count, payload, version=0, kind=0):
    head = struct.pack("!HHH", version << 13 | kind << 12 | 1 << 11 | apid, 3 << 14 | count, len(payload) + 3)
    return head + payload + struct.pack("!I", zlib.crc32(head + payload))


HEALTH = struct.pack("!QHhiBB", 1784203200123456789, 28456, -1234, -2200, 2, 3)
ACK = struct.pack("!IBiQ", 2**32 - 1, 1, -5, 77)


def packets(spark, raws):
    return spark.createDataFrame(
        [(i, i * 1000, "10.0.0.1:5005", bytearray(r)) for i, r in enumerate(raws)],
        "packet_no bigint, received_ns bigint, source string, raw_packet binary",
    )


def test_health_round_trip(spark):
    row = legacy.health_samples(packets(spark, [packet(100, 42, HEALTH)])).first()
    assert (row.sequence_count, row.timestamp_ns, row.bus_voltage_v, row.battery_temp_c,
            row.wheel_rpm, row.mode, row.fault_flags) == (42, 1784203200123456789, 28.456, -12.34, -2200, 2, 3)
    body = lw.health_body(F.lit(42), F.lit(1784203200123456789), F.lit(28.456), F.lit(-12.34),
                          F.lit(-2200), F.lit(2), F.lit(3))
    assert bytes(wire.with_crc(spark.range(1), body, "raw").first().raw) == packet(100, 42, HEALTH)


def test_half_even_wire_units(spark):
    body = lw.health_body(F.lit(0), F.lit(0), F.lit(0.0125), F.lit(-0.125), F.lit(0), F.lit(0), F.lit(0))
    raw = bytes(wire.with_crc(spark.range(1), body, "raw").first().raw)
    assert struct.unpack("!Hh", raw[14:18]) == (round(0.0125 * 1000), round(-0.125 * 100))


def test_ack_and_command(spark):
    row = legacy.command_acks(packets(spark, [packet(101, 7, ACK)])).first()
    assert (row.command_id, row.status, row.applied_value, row.timestamp_ns) == (2**32 - 1, 1, -5, 77)
    body = lw.ack_body(F.lit(7), F.lit(2**32 - 1), F.lit(1), F.lit(-5), F.lit(77))
    assert bytes(wire.with_crc(spark.range(1), body, "raw").first().raw) == packet(101, 7, ACK)
    frame = wire.with_crc(spark.range(1), lw.command_body(*(F.lit(v) for v in (9, 2, -6000, 5))), "raw_command")
    raw = bytes(frame.first().raw_command)
    plain = struct.pack("!IBiQ", 9, 2, -6000, 5)
    assert raw == plain + struct.pack("!I", zlib.crc32(plain))
    bad = [raw, raw[:-1], raw[:-1] + bytes([raw[-1] ^ 1]), b""]
    df = spark.createDataFrame([(bytearray(b),) for b in bad], "raw_command binary")
    got = [tuple(r)[1:] for r in lw.decode_command_frames(df).collect()]
    assert got[0] == (9, 2, -6000, 5, None)
    assert [g[-1] for g in got[1:]] == ["INVALID_COMMAND_LENGTH", "CRC_MISMATCH", "INVALID_COMMAND_LENGTH"]


def test_rejections(spark):
    good = packet(100, 1, HEALTH)
    broken = bytearray(good); broken[8] ^= 1
    raws = [good, broken, good[:-1], good[:10], b"", packet(100, 1, HEALTH, version=1),
            packet(100, 1, HEALTH[:-1]), packet(101, 1, ACK + b"\0"), packet(200, 1, b"x")]
    got = [r.packet_rejection for r in legacy.decoded(packets(spark, raws)).orderBy("packet_no").collect()]
    assert got == [None, "CRC_MISMATCH", "LENGTH_MISMATCH", "PACKET_TOO_SHORT", "PACKET_TOO_SHORT",
                   "UNSUPPORTED_PACKET_VERSION", "INVALID_HEALTH_LENGTH", "INVALID_ACK_LENGTH", None]
    results = {(r.result, r.apid_label): r.packets for r in legacy.ingest_counts(packets(spark, raws)).collect()}
    assert results == {("accepted", "health"): 1, ("rejected", "unknown"): 7, ("unsupported", "200"): 1}


@pytest.mark.parametrize("block_rows", [1, 2, 1 << 20])
def test_sequence_gaps(spark, block_rows):
    counts = [16382, 16383, 0, 3, 3, 2]
    raws = [packet(100, c, HEALTH) for c in counts]
    # a bad payload is still observed, a bad checksum is not
    raws += [packet(100, 5, HEALTH[:-1]), packet(100, 9, HEALTH)[:-1], packet(100, 6, HEALTH), packet(200, 4, b"y")]
    rows = legacy.sequence_gaps(packets(spark, raws), block_rows).orderBy("packet_no").collect()
    assert [r.gap for r in rows] == [0, 0, 0, 2, 16383, 16382, 2, 0, 0]


def test_limits(spark):
    df = spark.createDataFrame(
        [(22.5, 70.0, 5800, 1), (28.0, 32.0, 1200, 0), (24.0, 65.0, -5500, 0), (25.9, 55.0, -5501, 0),
         (26.0, 55.1, 0, 0)],
        "bus_voltage_v double, battery_temp_c double, wheel_rpm bigint, fault_flags bigint")
    got = [[(v.parameter, v.severity) for v in r[0]] for r in df.select(lw.limit_violations()).collect()]
    critical, warning = "CRITICAL", "WARNING"
    assert got == [
        [("bus_voltage_v", critical), ("battery_temp_c", critical), ("wheel_rpm", critical), ("fault_flags", critical)],
        [], [("bus_voltage_v", warning), ("battery_temp_c", warning)],
        [("bus_voltage_v", warning), ("wheel_rpm", critical)], [("battery_temp_c", warning)]]


def test_envelopes(spark):
    rows = legacy.envelopes(packets(spark, [packet(100, 1, HEALTH), packet(101, 2, ACK), packet(200, 3, b"z")])).collect()
    documents = {r.subject: json.loads(r.value) for r in rows}
    assert set(documents) == {lw.SUBJECT_HEALTH, lw.SUBJECT_ACK}
    assert documents[lw.SUBJECT_HEALTH]["data"]["battery_temp_c"] == -12.34
    assert documents[lw.SUBJECT_ACK]["data"] == {"command_id": 2**32 - 1, "status": 1, "applied_value": -5, "timestamp_ns": 77}
    assert " " not in rows[0].value


def test_envelope_parse(spark):
    good = '{"apid":100,"sequence_count":4,"data":{"timestamp_ns":"5","bus_voltage_v":28,"battery_temp_c":1.5,"wheel_rpm":3.9,"mode":1,"fault_flags":0}}'
    values = [good, good[:40], good.replace('"mode":1,', ""), good.replace("1.5", '"warm"'), "null", ""]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "packet_no bigint, value string")
    rows = legacy.parse_health_envelopes(df).orderBy("packet_no").collect()
    assert [r.is_malformed for r in rows] == [False] + [True] * 5
    assert (rows[0].timestamp_ns, rows[0].bus_voltage_v, rows[0].wheel_rpm) == (5, 28.0, 3)


def test_append_once(spark):
    samples = legacy.health_samples(packets(spark, [packet(100, 1, HEALTH), packet(100, 2, HEALTH)]))
    assert legacy.append_once(samples, samples.where("sequence_count = 1")).count() == 1


def test_commands(spark):
    df = spark.createDataFrame(
        [(1, "SET_MODE", 3, True), (2, "SET_WHEEL_RPM", -6000, False), (3, "FORMAT_STORAGE", 0, True),
         (4, "SET_MODE", 9, True), (5, "RESET_FAULTS", 0, False)],
        "id bigint, name string, argument bigint, dry_run boolean")
    rows = {r.id: r for r in commands.validate_commands(df).collect()}
    assert [rows[i].status for i in range(1, 6)] == ["DRY_RUN_VALIDATED", "QUEUED", None, None, "QUEUED"]
    assert rows[3].reason == "unsupported command: FORMAT_STORAGE"
    assert rows[4].reason == "argument 9 outside [0, 3] for SET_MODE"
