"""Command and acknowledgement frames of the version 1 contract.

    command (42 or 43)  version, type, command id(16), payload, opcode,
                        argument length, reserved, issued(8), expires(8),
                        argument(0 or 1), crc(4)
    ack (44)            version, type, command id(16), payload, opcode, ack type,
                        reserved, reason(2), boot(4), sequence(4), time(8), crc(4)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions.wire import (
    UUID4_PATTERN,
    bits,
    compute_once,
    first_broken,
    hex_digits,
    unsigned,
)

# Fixed values of the interface contract.
COMMAND_SIZE, ACK_SIZE = 42, 44
COMMAND_TYPE, ACK_TYPE = 1, 2
SET_PAYLOAD_MODE, RESET_PAYLOAD, REQUEST_STATUS = 1, 2, 3
EXPIRY_S = {SET_PAYLOAD_MODE: 30, RESET_PAYLOAD: 10, REQUEST_STATUS: 10}
CLOCK_TOLERANCE_US = 2000000
ACK_NAMES = ("RECEIVED", "ACCEPTED", "REJECTED", "EXECUTED")
REASON_NAMES = (
    "NONE",
    "UNSUPPORTED_PROTOCOL_VERSION",
    "WRONG_PAYLOAD_ID",
    "UNKNOWN_OPCODE",
    "INVALID_ARGUMENT_LENGTH",
    "INVALID_ARGUMENT_VALUE",
    "COMMAND_EXPIRED",
    "MODE_INHIBIT",
    "PAYLOAD_BUSY",
    "COMMAND_ID_CONFLICT",
    "EXECUTION_ABORTED",
    "CLOCK_SKEW",
)


def uuid_text(raw: Column, offset: int) -> Column:
    """Canonical text of 16 bytes in their written order."""
    digits = F.lower(F.hex(F.substring(raw, offset + 1, 16)))
    return F.concat_ws(
        "-",
        *(F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))),
    )


def _crc_matches(raw: Column, size: Column) -> Column:
    stored = F.conv(F.hex(F.substring(raw, size - 3, F.lit(4))), 16, 10).cast("bigint")
    return stored == F.crc32(F.substring(raw, F.lit(1), size - 4))


def decode_commands(df: DataFrame, raw: str = "raw_command") -> DataFrame:
    """Add command fields and ``frame_rejection``; NULL fields for other sizes."""
    size = F.length(raw)
    whole = F.when(size.isin(COMMAND_SIZE, COMMAND_SIZE + 1), F.col(raw))
    read = compute_once(
        df,
        _size=F.coalesce(size, F.lit(0)),
        _version=F.hex(F.substring(raw, 1, 1)),
        _head=unsigned(whole, 18, 4),
        _t0=unsigned(whole, 22, 7),
        _t1=unsigned(whole, 29, 7),
        _t2=unsigned(whole, 36, 2),
        _type=unsigned(whole, 1, 1),
        _argument=F.when(size == COMMAND_SIZE + 1, unsigned(whole, 38, 1)),
        _crc_ok=_crc_matches(whole, size),
        command_id=F.when(whole.isNotNull(), uuid_text(whole, 2)),
    )
    head = F.col("_head")
    fields = {
        "payload_id": bits(head, 24, 8),
        "opcode": bits(head, 16, 8),
        "argument_length": bits(head, 8, 8),
        "reserved": bits(head, 0, 8),
        "issued_us": F.shiftleft("_t0", 8).bitwiseOR(bits(F.col("_t1"), 48, 8)),
        "expires_us": F.shiftleft(bits(F.col("_t1"), 0, 48), 16).bitwiseOR(F.col("_t2")),
        "argument": F.col("_argument"),
    }
    needed = F.when(F.col("opcode") == SET_PAYLOAD_MODE, 1).otherwise(0)
    present = F.col("_size") - COMMAND_SIZE
    # the text form of unsigned order: negative bigints are the larger values
    later = F.when(
        (F.col("issued_us") < 0) == (F.col("expires_us") < 0),
        F.col("expires_us") > F.col("issued_us"),
    ).otherwise(F.col("expires_us") < 0)
    rejection = first_broken(
        (F.col("_size") == 0, "EMPTY_BODY"),
        (F.col("_version") != "01", "UNSUPPORTED_PROTOCOL_VERSION"),
        (~present.between(0, 1), "INVALID_FRAME_LENGTH"),
        (~F.col("_crc_ok"), "CRC_MISMATCH"),
        (F.col("_type") != COMMAND_TYPE, "INVALID_FRAME_TYPE"),
        (F.col("reserved") != 0, "RESERVED_BYTE_SET"),
        (~F.col("command_id").rlike(UUID4_PATTERN), "INVALID_COMMAND_ID"),
        (F.col("payload_id") != 1, "WRONG_PAYLOAD_ID"),
        (~F.col("opcode").between(1, 3), "UNKNOWN_OPCODE"),
        (
            (F.col("argument_length") != needed) | (present != needed),
            "INVALID_ARGUMENT_LENGTH",
        ),
        (F.col("argument") > 2, "INVALID_ARGUMENT_VALUE"),
        (~later, "INVALID_EXPIRY"),
    )
    return (
        read.withColumns(fields)
        .withColumn("frame_rejection", rejection)
        .drop("_size", "_version", "_head", "_t0", "_t1", "_t2", "_type", "_argument", "_crc_ok")
    )


def clock_rejection(issued_us: str, expires_us: str, at_us: str) -> Column:
    """What the payload's clock says about a sound command; two seconds of
    difference are tolerated on both sides."""
    issued, expires, at = F.col(issued_us), F.col(expires_us), F.col(at_us)
    return first_broken(
        ((issued < 0) | (issued > at + CLOCK_TOLERANCE_US), "CLOCK_SKEW"),
        ((expires >= 0) & (at > expires + CLOCK_TOLERANCE_US), "COMMAND_EXPIRED"),
    )


def decode_acks(df: DataFrame, raw: str = "raw_ack") -> DataFrame:
    """Add acknowledgement fields and ``frame_rejection``."""
    size = F.length(raw)
    whole = F.when(size == ACK_SIZE, F.col(raw))
    read = compute_once(
        df,
        _size=F.coalesce(size, F.lit(0)),
        _version=F.hex(F.substring(raw, 1, 1)),
        _type=unsigned(whole, 1, 1),
        _a0=unsigned(whole, 18, 6),
        _a1=unsigned(whole, 24, 7),
        _a2=unsigned(whole, 31, 7),
        _a3=unsigned(whole, 38, 2),
        _crc_ok=_crc_matches(whole, size),
        command_id=F.when(whole.isNotNull(), uuid_text(whole, 2)),
    )
    a0, a1, a2 = F.col("_a0"), F.col("_a1"), F.col("_a2")
    fields = {
        "payload_id": bits(a0, 40, 8),
        "opcode": bits(a0, 32, 8),
        "ack_type": bits(a0, 24, 8),
        "reserved": bits(a0, 16, 8),
        "reason_code": bits(a0, 0, 16),
        "boot_id": bits(a1, 24, 32),
        "sequence_number": F.shiftleft(bits(a1, 0, 24), 8).bitwiseOR(bits(a2, 48, 8)),
        "event_us": F.shiftleft(bits(a2, 0, 48), 16).bitwiseOR(F.col("_a3")),
    }
    refusal = F.col("ack_type") == 3
    rejection = first_broken(
        (F.col("_size") == 0, "EMPTY_BODY"),
        (F.col("_version") != "01", "UNSUPPORTED_PROTOCOL_VERSION"),
        (F.col("_size") != ACK_SIZE, "INVALID_FRAME_LENGTH"),
        (~F.col("_crc_ok"), "CRC_MISMATCH"),
        (F.col("_type") != ACK_TYPE, "INVALID_FRAME_TYPE"),
        (F.col("reserved") != 0, "RESERVED_BYTE_SET"),
        (~F.col("ack_type").between(1, len(ACK_NAMES)), "INVALID_ACK_TYPE"),
        (
            (refusal != (F.col("reason_code") != 0))
            | (F.col("reason_code") >= len(REASON_NAMES)),
            "INVALID_REASON_CODE",
        ),
        (F.col("boot_id") == 0, "INVALID_BOOT_ID"),
    )
    return (
        read.withColumns(fields)
        .withColumn("frame_rejection", rejection)
        .drop("_size", "_version", "_type", "_a0", "_a1", "_a2", "_a3", "_crc_ok")
    )


def _low(value: Column, width: int) -> Column:
    return value.cast("bigint").bitwiseAND(F.lit((1 << width) - 1))


def _packed(*parts: tuple[Column, int]) -> Column:
    total = F.lit(0).cast("bigint")
    for value, width in parts:
        total = F.shiftleft(total, width).bitwiseOR(_low(value, width))
    return total


def command_body(
    version: Column, kind: Column, command_id: Column, payload_id: Column, opcode: Column,
    argument_length: Column, reserved: Column, issued_us: Column, expires_us: Column,
    argument: Column,
) -> Column:
    """Bytes before the checksum; a NULL argument adds none."""
    byte = lambda c: (c, 8)
    return F.unhex(
        F.concat(
            hex_digits(_packed(byte(version), byte(kind)), 4),
            F.replace(command_id, F.lit("-"), F.lit("")),
            hex_digits(_packed(*map(byte, (payload_id, opcode, argument_length, reserved))), 8),
            hex_digits(issued_us.cast("bigint"), 16),
            hex_digits(expires_us.cast("bigint"), 16),
            F.coalesce(hex_digits(argument, 2), F.lit("")),
        )
    )


def ack_body(
    command_id: Column, payload_id: Column, opcode: Column, ack_type: Column, reserved: Column,
    reason_code: Column, boot_id: Column, sequence: Column, event_us: Column,
) -> Column:
    byte = lambda c: (c, 8)
    return F.unhex(
        F.concat(
            F.lit("0102"),
            F.replace(command_id, F.lit("-"), F.lit("")),
            hex_digits(
                _packed(*map(byte, (payload_id, opcode, ack_type, reserved)), (reason_code, 16)), 12
            ),
            hex_digits(_low(boot_id, 32), 8),
            hex_digits(_low(sequence, 32), 8),
            hex_digits(event_us.cast("bigint"), 16),
        )
    )


def ack_name(ack_type: Column | str) -> Column:
    value = F.col(ack_type) if isinstance(ack_type, str) else ack_type
    return F.when(
        value.between(1, len(ACK_NAMES)),
        F.element_at(F.array(*map(F.lit, ACK_NAMES)), value.cast("int")),
    )


def reason_name(code: Column | str) -> Column:
    value = F.col(code) if isinstance(code, str) else code
    return F.when(
        value.between(0, len(REASON_NAMES) - 1),
        F.element_at(F.array(*map(F.lit, REASON_NAMES)), (value + 1).cast("int")),
    )
