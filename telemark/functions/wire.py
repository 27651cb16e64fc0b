"""Telemetry frame version 1: column expressions for the 28-byte layout.

A frame is read as four 56-bit words, because ``conv`` on 14 hex digits always
fits a signed bigint; fields are then cut out with shifts and masks. Everything
stays in generated code, no Python worker is started.

    bytes  0..6   version, payload, boot(4), sequence[0]
    bytes  7..13  sequence[1..3], time[0..3]
    bytes 14..20  time[4..7], temperature(2), voltage[0]
    bytes 21..27  voltage[1], mode, faults, crc(4)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the interface contract.
PROTOCOL_VERSION = 1
SUPPORTED_PAYLOAD_ID = 1
FRAME_SIZE = 28
BODY_SIZE = 24
UINT32_MAX = 4294967295
PROJECT_EPOCH_US = 1767225600000000  # 2026-01-01T00:00:00Z
MAX_FUTURE_SKEW_US = 300000000
MIN_TEMPERATURE_CENTI_C, MAX_TEMPERATURE_CENTI_C = -10000, 15000
MIN_VOLTAGE_MV, MAX_VOLTAGE_MV = 0, 50000
MAX_MODE = 3
RESERVED_FAULT_MASK = 0xC0
MAX_EVIDENCE_BYTES = 1024
OCTET_STREAM = "application/octet-stream"
MODE_NAMES = ("SAFE", "STANDBY", "SCIENCE", "CALIBRATION")
FAULT_NAMES = (
    (0x01, "OVER_TEMPERATURE"),
    (0x02, "UNDER_VOLTAGE"),
    (0x04, "OVER_VOLTAGE"),
    (0x08, "TEMPERATURE_SENSOR_FAULT"),
    (0x10, "VOLTAGE_SENSOR_FAULT"),
    (0x20, "INTERNAL_PAYLOAD_FAULT"),
)
PACKET_ID_PATTERN = r"^TLM-P[0-9]{2}-B[0-9A-F]{8}-S[0-9A-F]{8}\z"
WHITESPACE = " \t\r\n\x0b\x0c"
UUID4_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"

FRAME_FIELDS = (
    "protocol_version",
    "payload_id",
    "boot_id",
    "sequence_number",
    "timestamp_us",
    "temperature_centi_c",
    "voltage_mv",
    "operating_mode",
    "fault_flags",
)
# What ``decode_frames`` adds.
DECODED = (*FRAME_FIELDS, "wire_crc", "calculated_crc")


def col_of(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read by reference.

    Catalyst copies a projected expression into every filter pushed through it.
    For byte decoding that would repeat the work once per rule, so these columns
    are produced by a one-row ``inline``, which predicates do not pass.
    """
    row = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select("*", F.inline(F.array(row)))


def whole_div(value: Column | str, divisor: int) -> Column:
    """Integer quotient in bigint; ``/`` would go through a double."""
    return F.call_function("div", col_of(value), F.lit(divisor).cast("bigint"))


def unsigned(raw: Column, offset: int, size: int) -> Column:
    """Big-endian unsigned integer of up to seven bytes as bigint."""
    return F.conv(F.hex(F.substring(raw, offset + 1, size)), 16, 10).cast("bigint")


def signed(value: Column, bits: int) -> Column:
    """Two's complement reading of an unsigned field."""
    half = 1 << (bits - 1)
    return (value + F.lit(half)).bitwiseAND(F.lit((1 << bits) - 1)) - F.lit(half)


def bits(word: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << width) - 1))


def hex_digits(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def two_digits(value: Column) -> Column:
    """NULL outside 0..99, which two digits cannot hold."""
    return F.when(value.between(0, 99), F.lpad(value.cast("string"), 2, "0"))


def _words(raw: str) -> dict[str, Column]:
    whole = F.when(F.length(raw) == FRAME_SIZE, F.col(raw))
    return {
        "_w0": unsigned(whole, 0, 7),
        "_w1": unsigned(whole, 7, 7),
        "_w2": unsigned(whole, 14, 7),
        "_w3": unsigned(whole, 21, 7),
        "calculated_crc": frame_crc(whole),
        "_size": F.coalesce(F.length(raw), F.lit(0)),
        "_version": F.hex(F.substring(raw, 1, 1)),
    }


def _read_words(df: DataFrame, raw: str) -> DataFrame:
    return compute_once(df, **_words(raw))


def _fields_of_words() -> dict[str, Column]:
    w0, w1, w2, w3 = (F.col(f"_w{i}") for i in range(4))
    high_time = F.shiftleft(w1.bitwiseAND(F.lit(0xFFFFFFFF)), 32)
    return {
        "protocol_version": bits(w0, 48, 8),
        "payload_id": bits(w0, 40, 8),
        "boot_id": bits(w0, 8, 32),
        "sequence_number": F.shiftleft(bits(w0, 0, 8), 24).bitwiseOR(bits(w1, 32, 24)),
        "timestamp_us": high_time.bitwiseOR(bits(w2, 24, 32)),
        "temperature_centi_c": signed(bits(w2, 8, 16), 16),
        "voltage_mv": F.shiftleft(bits(w2, 0, 8), 8).bitwiseOR(bits(w3, 48, 8)),
        "operating_mode": bits(w3, 40, 8),
        "fault_flags": bits(w3, 32, 8),
        "wire_crc": bits(w3, 0, 32),
    }


_SCRATCH = ("_w0", "_w1", "_w2", "_w3", "_size", "_version")


def wire_timestamp(timestamp_us: Column | str) -> Column:
    value = col_of(timestamp_us)
    wide = value.cast("decimal(20,0)")
    return F.when(value < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast(
        "decimal(20,0)"
    )


def frame_crc(raw: Column | str) -> Column:
    """CRC-32/ISO-HDLC over the first 24 bytes."""
    return F.crc32(F.substring(col_of(raw), 1, BODY_SIZE))


def decode_frames(df: DataFrame, raw: str = "raw_body", if_read: bool = False) -> DataFrame:
    """Add the nine wire fields, ``wire_crc`` and ``calculated_crc``; all NULL
    unless the frame is 28 bytes long. With ``if_read`` nothing is decoded for a
    reader of other columns only, and a filter on the fields decodes anew.

    ``timestamp_us`` carries the unsigned 64-bit wire value in a bigint, so a
    value of 2^63 or more reads negative; ``wire_timestamp`` gives its exact
    unsigned decimal.
    """
    words = df.withColumns(_words(raw)) if if_read else _read_words(df, raw)
    return words.withColumns(_fields_of_words()).drop(*_SCRATCH)


def encode(df: DataFrame, out: str = "raw_body") -> DataFrame:
    """Add the 28-byte frame of the nine field columns, unchecked.

    The body is written as four 48-bit words; the CRC covers it.
    """

    def word(*parts: tuple[str | Column, int]) -> Column:
        total = F.lit(0).cast("bigint")
        for value, width in parts:
            total = F.shiftleft(total, width).bitwiseOR(
                col_of(value).cast("bigint").bitwiseAND(F.lit((1 << width) - 1))
            )
        return hex_digits(total, 12)

    high_time = F.shiftrightunsigned(F.col("timestamp_us").cast("bigint"), 48)
    body = F.unhex(
        F.concat(
            word(("protocol_version", 8), ("payload_id", 8), ("boot_id", 32)),
            word(("sequence_number", 32), (high_time, 16)),
            word(("timestamp_us", 48)),
            word(
                ("temperature_centi_c", 16), ("voltage_mv", 16),
                ("operating_mode", 8), ("fault_flags", 8),
            ),
        )
    )
    return with_crc(df, body, out)


def with_crc(df: DataFrame, body: Column, out: str) -> DataFrame:
    return (
        compute_once(df, _body=body)
        .withColumn(out, F.concat("_body", F.unhex(hex_digits(F.crc32("_body"), 8))))
        .drop("_body")
    )


def encode_frames(df: DataFrame, out: str = "raw_body", received: str | None = None) -> DataFrame:
    """Encode the nine field columns; a row that breaks a field rule gets a NULL
    frame and the first broken rule in ``encode_rejection``."""
    reason = field_rejection({f: F.col(f) for f in FRAME_FIELDS}, received)
    version = F.when(
        F.col("protocol_version") != PROTOCOL_VERSION, F.lit("UNSUPPORTED_PROTOCOL_VERSION")
    )
    checked = df.withColumn("encode_rejection", F.coalesce(version, reason))
    return encode(checked, out).withColumn(
        out, F.when(F.col("encode_rejection").isNull(), F.col(out))
    )


def packet_id(payload_id: Column | str, boot_id: Column | str, sequence: Column | str) -> Column:
    return F.concat(
        F.lit("TLM-P"),
        two_digits(col_of(payload_id)),
        F.lit("-B"),
        hex_digits(col_of(boot_id), 8),
        F.lit("-S"),
        hex_digits(col_of(sequence), 8),
    )


def is_packet_id(value: Column | str) -> Column:
    return F.coalesce(col_of(value).rlike(PACKET_ID_PATTERN), F.lit(False))


def first_broken(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds, in the order given."""
    return F.coalesce(*(F.when(broken, F.lit(name)) for broken, name in rules))


def field_rejection(f: dict[str, Column], received_us: Column | str | None) -> Column:
    ts = f["timestamp_us"]
    future = (
        F.lit(False) if received_us is None else ts > col_of(received_us) + F.lit(MAX_FUTURE_SKEW_US)
    )
    # A negative bigint is a wire time of 2^63 or more: never before the epoch,
    # and later than any receipt.
    beyond = F.lit(False) if received_us is None else ts < 0
    return first_broken(
        (f["payload_id"] != SUPPORTED_PAYLOAD_ID, "UNSUPPORTED_PAYLOAD_ID"),
        (f["boot_id"] == 0, "INVALID_BOOT_ID"),
        ((ts >= 0) & (ts < PROJECT_EPOCH_US), "TIMESTAMP_BEFORE_PROJECT_EPOCH"),
        (beyond | future, "TIMESTAMP_TOO_FAR_IN_FUTURE"),
        (
            ~f["temperature_centi_c"].between(MIN_TEMPERATURE_CENTI_C, MAX_TEMPERATURE_CENTI_C),
            "TEMPERATURE_OUT_OF_RANGE",
        ),
        (~f["voltage_mv"].between(MIN_VOLTAGE_MV, MAX_VOLTAGE_MV), "VOLTAGE_OUT_OF_RANGE"),
        (~f["operating_mode"].between(0, MAX_MODE), "INVALID_OPERATING_MODE"),
        (
            f["fault_flags"].bitwiseAND(F.lit(RESERVED_FAULT_MASK)) != 0,
            "RESERVED_FAULT_BITS_SET",
        ),
    )


def validate_frames(
    df: DataFrame, raw: str = "raw_body", received_us: str = "received_us", **also: Column
) -> DataFrame:
    """Decode and add ``frame_rejection``: the first broken rule of the
    receiver's order, NULL when valid. Bad bytes give a reason, never an error.

    The version byte is looked at before length and checksum. ``also`` names
    further columns to evaluate once along with the verdict.
    """
    fields = _fields_of_words()
    rejection = F.coalesce(
        first_broken(
            (F.col("_size") == 0, "EMPTY_BODY"),
            (F.col("_version") != "01", "UNSUPPORTED_PROTOCOL_VERSION"),
            (F.col("_size") != FRAME_SIZE, "INVALID_FRAME_LENGTH"),
            (fields["wire_crc"] != F.col("calculated_crc"), "CRC_MISMATCH"),
        ),
        field_rejection(fields, received_us),
    )
    return compute_once(
        _read_words(df, raw), **fields, frame_rejection=rejection, **also
    ).drop(*_SCRATCH)


def is_canonical_request_id(request_id: Column | str) -> Column:
    return F.coalesce(col_of(request_id).rlike(UUID4_PATTERN), F.lit(False))


def canonical_request_id(request_id: Column | str) -> Column:
    """The presented id when it is a lower-case version 4 UUID, else NULL."""
    return F.when(col_of(request_id).rlike(UUID4_PATTERN), col_of(request_id))


def header_rejection(content_type: Column | str, request_id: Column | str) -> Column:
    media = F.lower(F.trim(F.substring_index(col_of(content_type), ";", 1), F.lit(WHITESPACE)))
    return first_broken(
        (F.coalesce(media, F.lit("")) != OCTET_STREAM, "INVALID_CONTENT_TYPE"),
        (~is_canonical_request_id(request_id), "INVALID_REQUEST_ID"),
    )


def boundary_rejection(declared_length: Column | str, actual_size: Column | str) -> Column:
    """Why a submission is refused before a receipt exists: a length header that
    is no integer, or a declared or actual size over the evidence cap."""
    text = F.trim(col_of(declared_length), F.lit(WHITESPACE))
    is_integer = text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*\z")
    number = F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,0)")
    too_large = F.coalesce(number > MAX_EVIDENCE_BYTES, F.length(text) > 38)
    return first_broken(
        (F.coalesce(~is_integer, F.lit(False)), "INVALID_CONTENT_LENGTH"),
        (F.coalesce(is_integer & too_large, F.lit(False)), "BODY_TOO_LARGE"),
        (col_of(actual_size) > MAX_EVIDENCE_BYTES, "BODY_TOO_LARGE"),
    )


def rounded_wire_units(display: Column | str, factor: int) -> Column:
    """Display decimal text times a factor, rounded half away from zero.

    The text is read as an exact decimal; a double is formatted first, because
    rounding the double itself would round another number.
    """
    exact = col_of(display).cast("string").cast("decimal(28,10)")
    return F.round(exact * F.lit(factor).cast("decimal(8,0)"), 0).cast("bigint")


def iso_time(timestamp_us: Column | str) -> Column:
    """UTC ISO text with ``Z``; the fraction is left out when it is zero."""
    value = col_of(timestamp_us)
    moment = F.timestamp_micros(value)
    return F.concat(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.pmod(value, F.lit(1000000)) == 0, F.lit("")).otherwise(
            F.concat(F.lit("."), F.lpad(F.pmod(value, F.lit(1000000)).cast("string"), 6, "0"))
        ),
        F.lit("Z"),
    )


def payload_label(payload_id: Column | str) -> Column:
    return F.concat(F.lit("PAYLOAD-"), two_digits(col_of(payload_id)))


def parsed_identifiers() -> Column:
    """The identifiers document kept on receipts that reach acceptance."""
    return F.to_json(
        F.struct(
            packet_id("payload_id", "boot_id", "sequence_number").alias("packet_id"),
            "protocol_version",
            "payload_id",
            "boot_id",
            "sequence_number",
            F.col("timestamp_us").alias("sample_timestamp_us"),
        )
    )
