"""Frame layout, checksum, rejection priority and boundary values."""

from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from telemark.functions import wire

GOLDEN = bytes.fromhex("01010000002a00000001000656b92df170000b186dc40200cc6d0205")
RECEIVED_US = 1784203201000000  # 2026-07-16T12:00:01Z
GOOD = (1, 1, 42, 1, 1784203200000000, 2840, 28100, 2, 0)


def frame(**changes) -> bytes:
    names = wire.FRAME_FIELDS
    values = dict(zip(names, GOOD)) | changes
    body = struct.pack(">BBIIQhHBB", *(values[n] for n in names))
    return body + struct.pack(">I", zlib.crc32(body))


def reasons(spark, raws, received=RECEIVED_US):
    df = spark.createDataFrame(
        [(i, bytearray(r), received) for i, r in enumerate(raws)],
        "i bigint, raw_body binary, received_us bigint",
    )
    rows = wire.validate_frames(df).orderBy("i").collect()
    return [r.frame_rejection for r in rows]


def test_golden_frame(spark):
    df = spark.createDataFrame([(bytearray(GOLDEN),)], "raw_body binary")
    row = wire.decode_frames(df).withColumn(
        "pid", wire.packet_id("payload_id", "boot_id", "sequence_number")
    ).first()
    assert tuple(row[f] for f in wire.FRAME_FIELDS) == GOOD
    assert row.wire_crc == row.calculated_crc == 0xCC6D0205
    assert row.pid == "TLM-P01-B0000002A-S00000001"
    again = wire.encode_frames(wire.decode_frames(df).drop("raw_body")).first()
    assert bytes(again.raw_body) == GOLDEN and again.encode_rejection is None


def test_crc_check_value(spark):
    row = spark.range(1).select(F.crc32(F.lit("123456789").cast("binary"))).first()
    assert row[0] == 0xCBF43926


def test_corruption_and_priority(spark):
    flipped = bytearray(GOLDEN)
    flipped[18] ^= 1
    raws = [
        GOLDEN, flipped, frame(protocol_version=2), b"", GOLDEN[:-1], GOLDEN + b"\0", b"\x02",
        frame(payload_id=2), frame(boot_id=0), frame(operating_mode=4), frame(fault_flags=0x40),
        frame(payload_id=2, boot_id=0, temperature_centi_c=15001, operating_mode=9),
        frame(temperature_centi_c=-10001, voltage_mv=50001, fault_flags=0x80),
    ]
    assert reasons(spark, raws) == [
        None, "CRC_MISMATCH", "UNSUPPORTED_PROTOCOL_VERSION", "EMPTY_BODY", "INVALID_FRAME_LENGTH",
        "INVALID_FRAME_LENGTH", "UNSUPPORTED_PROTOCOL_VERSION", "UNSUPPORTED_PAYLOAD_ID",
        "INVALID_BOOT_ID", "INVALID_OPERATING_MODE", "RESERVED_FAULT_BITS_SET",
        "UNSUPPORTED_PAYLOAD_ID", "TEMPERATURE_OUT_OF_RANGE",
    ]


def test_boundaries(spark):
    raws = [
        frame(temperature_centi_c=-10000), frame(temperature_centi_c=15000),
        frame(temperature_centi_c=-10001), frame(temperature_centi_c=15001),
        frame(voltage_mv=0), frame(voltage_mv=50000), frame(voltage_mv=50001),
        frame(timestamp_us=1767225599999999), frame(timestamp_us=1767225600000000),
        frame(timestamp_us=RECEIVED_US + 300000000), frame(timestamp_us=RECEIVED_US + 300000001),
        frame(timestamp_us=2**63 - 1), frame(timestamp_us=2**63), frame(timestamp_us=2**64 - 1),
        frame(boot_id=2**32 - 1, sequence_number=2**32 - 1),
    ]
    future = "TIMESTAMP_TOO_FAR_IN_FUTURE"
    assert reasons(spark, raws) == [
        None, None, "TEMPERATURE_OUT_OF_RANGE", "TEMPERATURE_OUT_OF_RANGE", None, None,
        "VOLTAGE_OUT_OF_RANGE", "TIMESTAMP_BEFORE_PROJECT_EPOCH", None, None, future, future,
        future, future, None,
    ]


def test_unsigned_extremes_round_trip(spark):
    raws = [
        frame(boot_id=2**32 - 1, sequence_number=2**32 - 1, timestamp_us=2**64 - 1,
              temperature_centi_c=-32768, voltage_mv=65535, operating_mode=255, fault_flags=255,
              protocol_version=255, payload_id=255),
        frame(sequence_number=0x80FF00FF, timestamp_us=2**63, temperature_centi_c=-1),
    ]
    df = spark.createDataFrame([(bytearray(r),) for r in raws], "raw_body binary")
    decoded = wire.decode_frames(df).withColumn("exact", wire.wire_timestamp("timestamp_us"))
    rows = decoded.collect()
    assert [int(r.exact) for r in rows] == [2**64 - 1, 2**63]
    assert [r.temperature_centi_c for r in rows] == [-32768, -1]
    assert rows[0].sequence_number == 2**32 - 1 and rows[1].sequence_number == 0x80FF00FF
    back = wire.encode(decoded.withColumnRenamed("raw_body", "was"), "now").collect()
    assert all(bytes(r.was) == bytes(r.now) for r in back)


def test_encoder_checks_fields(spark):
    rows = [GOOD, (2, *GOOD[1:]), (*GOOD[:5], 15001, *GOOD[6:]), (*GOOD[:8], 0xC0)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in wire.FRAME_FIELDS))
    got = [(r.encode_rejection, r.raw_body is None) for r in wire.encode_frames(df).collect()]
    assert got == [
        (None, False), ("UNSUPPORTED_PROTOCOL_VERSION", True), ("TEMPERATURE_OUT_OF_RANGE", True),
        ("RESERVED_FAULT_BITS_SET", True),
    ]


@pytest.mark.parametrize(
    "content_type, request_id, reason",
    [
        ("application/octet-stream", "5b0ef52e-1517-4b70-8e9d-f49ef2f72d8d", None),
        (" Application/OCTET-stream ; v=1", "5b0ef52e-1517-4b70-8e9d-f49ef2f72d8d", None),
        (None, "5b0ef52e-1517-4b70-8e9d-f49ef2f72d8d", "INVALID_CONTENT_TYPE"),
        ("text/plain", None, "INVALID_CONTENT_TYPE"),
        ("application/octet-stream", None, "INVALID_REQUEST_ID"),
        ("application/octet-stream", "not-a-uuid", "INVALID_REQUEST_ID"),
        ("application/octet-stream", "5B0EF52E-1517-4B70-8E9D-F49EF2F72D8D", "INVALID_REQUEST_ID"),
        ("application/octet-stream", "5b0ef52e-1517-1b70-8e9d-f49ef2f72d8d", "INVALID_REQUEST_ID"),
        ("application/octet-stream", "5b0ef52e-1517-4b70-ce9d-f49ef2f72d8d", "INVALID_REQUEST_ID"),
        ("application/octet-stream", "5b0ef52e-1517-4b70-8e9d-f49ef2f72d8d\n", "INVALID_REQUEST_ID"),
    ],
)
def test_header_rules(spark, content_type, request_id, reason):
    df = spark.createDataFrame([(content_type, request_id)], "content_type string, request_id string")
    assert df.select(wire.header_rejection("content_type", "request_id")).first()[0] == reason


def test_boundary_rules(spark):
    rows = [(None, 1024), (None, 1025), ("28", 28), ("1024", 28), ("1025", 28), (" 2_048 ", 28),
            ("ten", 28), ("9" * 60, 28), ("-5", 28)]
    df = spark.createDataFrame(rows, "declared string, size int")
    got = [r[0] for r in df.select(wire.boundary_rejection("declared", "size")).collect()]
    large = "BODY_TOO_LARGE"
    assert got == [None, large, None, None, large, large, "INVALID_CONTENT_LENGTH", large, None]


def test_display_rounding(spark):
    df = spark.createDataFrame(
        [("28.405", 100, 2841), ("-1.005", 100, -101), ("28.1005", 1000, 28101)],
        "display string, factor int, want bigint",
    )
    for r in df.collect():
        one = df.where(F.col("display") == r.display)
        assert one.select(wire.rounded_wire_units("display", r.factor)).first()[0] == r.want
        as_double = one.select(F.col("display").cast("double").alias("d"))
        assert as_double.select(wire.rounded_wire_units("d", r.factor)).first()[0] == r.want


def test_display_forms(spark):
    row = spark.range(1).select(
        wire.iso_time(F.lit(1784203200000000)), wire.iso_time(F.lit(1784203200000250)),
        wire.payload_label(F.lit(1)), wire.is_packet_id(F.lit("TLM-P01-B0000002A-S00000001")),
        wire.is_packet_id(F.lit("TLM-P01-B0000002a-S00000001")),
        wire.is_packet_id(F.lit("TLM-P01-B0000002A-S00000001\n")),
    ).first()
    assert tuple(row) == (
        "2026-07-16T12:00:00Z", "2026-07-16T12:00:00.000250Z", "PAYLOAD-01", True, False, False
    )


def test_payloads_beyond_two_digits_have_no_id(spark):
    row = spark.range(1).select(
        *(wire.packet_id(F.lit(p), F.lit(1), F.lit(1)).alias(f"p{p}") for p in (0, 99, 100, 255)),
        wire.payload_label(F.lit(100)).alias("label"),
    ).first()
    assert row["p0"] == "TLM-P00-B00000001-S00000001" and row["p99"] == "TLM-P99-B00000001-S00000001"
    assert row["p100"] is None and row["p255"] is None and row["label"] is None
