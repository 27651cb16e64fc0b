"""Legacy space packets: header, payload and command-frame expressions, limits.

    header (6)   word 1: version 3, type 1, secondary flag 1, application id 11
                 word 2: sequence flags 2, count 14      word 3: data length - 1
    health (18)  time_ns u64, mV u16, centi-C i16, rpm i32, mode u8, flags u8
    ack (17)     command_id u32, status u8, applied i32, time_ns u64
    command (17) id u32, opcode u8, argument i32, issued_ns u64, then CRC
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions.wire import (
    bits,
    col_of,
    compute_once,
    first_broken,
    hex_digits,
    signed,
    unsigned,
)

# Fixed values of the legacy packet format.
APID_HEALTH = 100
APID_COMMAND_ACK = 101
MAX_SEQUENCE = 16383
HEADER_SIZE, CRC_SIZE = 6, 4
HEALTH_SIZE, ACK_SIZE, COMMAND_SIZE = 18, 17, 21
SUBJECT_HEALTH = "telemetry.health"
SUBJECT_ACK = "telemetry.command_ack"
SUBJECT_STATUS = "commands.status"

# Fixed command allow-list: name, opcode, minimum, maximum.
COMMANDS = (
    ("SET_MODE", 1, 0, 3),
    ("SET_WHEEL_RPM", 2, -6000, 6000),
    ("RESET_FAULTS", 3, 0, 0),
)


def decode_packets(df: DataFrame, raw: str = "raw_packet") -> DataFrame:
    """Add header fields, ``packet_rejection`` and the payload words.

    Header fields are NULL when the packet is shorter than header, CRC and one
    byte. The payload words (bytes 6..12, 13..19, 20..23) are read once and cut
    by ``health_fields`` and ``ack_fields``.
    """
    size = F.length(raw)
    whole = F.when(size >= HEADER_SIZE + CRC_SIZE + 1, F.col(raw))
    read = compute_once(
        df,
        packet_size=F.coalesce(size, F.lit(0)),
        _head=unsigned(whole, 0, 6),
        _p1=unsigned(whole, 6, 7),
        _p2=unsigned(whole, 13, 7),
        _p3=unsigned(whole, 20, 4),
        _stored=F.conv(F.hex(F.substring(whole, size - 3, F.lit(CRC_SIZE))), 16, 10).cast("bigint"),
        _computed=F.crc32(F.substring(whole, F.lit(1), size - CRC_SIZE)),
    )
    head, packet_size = F.col("_head"), F.col("packet_size")
    payload_size = packet_size - (HEADER_SIZE + CRC_SIZE)
    version, apid, length = bits(head, 45, 3), bits(head, 32, 11), bits(head, 0, 16)
    rejection = first_broken(
        (packet_size < HEADER_SIZE + CRC_SIZE + 1, "PACKET_TOO_SHORT"),
        (packet_size != length + (HEADER_SIZE + 1), "LENGTH_MISMATCH"),
        (F.col("_stored") != F.col("_computed"), "CRC_MISMATCH"),
        (version != 0, "UNSUPPORTED_PACKET_VERSION"),
        ((apid == APID_HEALTH) & (payload_size != HEALTH_SIZE), "INVALID_HEALTH_LENGTH"),
        ((apid == APID_COMMAND_ACK) & (payload_size != ACK_SIZE), "INVALID_ACK_LENGTH"),
    )
    return compute_once(
        read,
        packet_version=version,
        packet_type=bits(head, 44, 1),
        apid=apid,
        sequence_count=bits(head, 16, 14),
        data_length=length,
        packet_rejection=rejection,
    ).drop("_head", "_stored", "_computed")


def packet_payload(raw: Column | str) -> Column:
    raw = col_of(raw)
    return F.substring(raw, F.lit(HEADER_SIZE + 1), F.length(raw) - (HEADER_SIZE + CRC_SIZE))


# Rejections found only after the packet itself was sound; its sequence count
# was already observed by then.
PAYLOAD_REJECTIONS = ("INVALID_HEALTH_LENGTH", "INVALID_ACK_LENGTH")


def health_fields() -> dict[str, Column]:
    """Health payload fields of decoded packets, display units as doubles."""
    p1, p2, p3 = F.col("_p1"), F.col("_p2"), F.col("_p3")
    rpm = F.shiftleft(bits(p2, 0, 16), 16).bitwiseOR(bits(p3, 16, 16))
    return {
        "timestamp_ns": F.shiftleft(p1, 8).bitwiseOR(bits(p2, 48, 8)),
        "bus_voltage_v": bits(p2, 32, 16) / F.lit(1000.0),
        "battery_temp_c": signed(bits(p2, 16, 16), 16) / F.lit(100.0),
        "wheel_rpm": signed(rpm, 32),
        "mode": bits(p3, 8, 8),
        "fault_flags": bits(p3, 0, 8),
    }


def ack_fields() -> dict[str, Column]:
    p1, p2, p3 = F.col("_p1"), F.col("_p2"), F.col("_p3")
    applied = F.shiftleft(bits(p1, 0, 16), 16).bitwiseOR(bits(p2, 40, 16))
    return {
        "command_id": bits(p1, 24, 32),
        "status": bits(p1, 16, 8),
        "applied_value": signed(applied, 32),
        "timestamp_ns": F.shiftleft(bits(p2, 0, 40), 24).bitwiseOR(bits(p3, 8, 24)),
    }


def decode_command_frames(df: DataFrame, raw: str = "raw_command") -> DataFrame:
    """Add the command fields and ``command_rejection``; NULL fields unless the
    frame is 21 bytes long."""
    whole = F.when(F.length(raw) == COMMAND_SIZE, F.col(raw))
    read = compute_once(
        df,
        _c0=unsigned(whole, 0, 7),
        _c1=unsigned(whole, 7, 7),
        _c2=unsigned(whole, 14, 7),
        _computed=F.crc32(F.substring(whole, 1, COMMAND_SIZE - CRC_SIZE)),
        _size=F.coalesce(F.length(raw), F.lit(0)),
    )
    c0, c1, c2 = F.col("_c0"), F.col("_c1"), F.col("_c2")
    argument = F.shiftleft(bits(c0, 0, 16), 16).bitwiseOR(bits(c1, 40, 16))
    return read.withColumns(
        {
            "command_id": bits(c0, 24, 32),
            "opcode": bits(c0, 16, 8),
            "argument": signed(argument, 32),
            "issued_ns": F.shiftleft(bits(c1, 0, 40), 24).bitwiseOR(bits(c2, 32, 24)),
            "command_rejection": first_broken(
                (F.col("_size") != COMMAND_SIZE, "INVALID_COMMAND_LENGTH"),
                (bits(c2, 0, 32) != F.col("_computed"), "CRC_MISMATCH"),
            ),
        }
    ).drop("_c0", "_c1", "_c2", "_computed", "_size")


def _low(value: Column, width: int) -> Column:
    return value.cast("bigint").bitwiseAND(F.lit((1 << width) - 1))


def packet_body(
    apid: Column | int, sequence_count: Column, payload_hex: Column, payload_size: int,
    packet_type: int = 0,
) -> Column:
    """Header and payload bytes; ``wire.with_crc`` appends the checksum."""
    apid = F.lit(apid) if isinstance(apid, int) else apid
    words = F.shiftleft(
        F.lit((packet_type << 12) | (1 << 11)).cast("bigint").bitwiseOR(apid.cast("bigint")), 32
    )
    words = words.bitwiseOR(
        F.shiftleft(F.lit(3 << 14).cast("bigint").bitwiseOR(sequence_count.cast("bigint")), 16)
    ).bitwiseOR(F.lit(payload_size + CRC_SIZE - 1))
    return F.unhex(F.concat(hex_digits(words, 12), payload_hex))


def health_payload_hex(
    timestamp_ns: Column, bus_voltage_v: Column, battery_temp_c: Column, wheel_rpm: Column,
    mode: Column, fault_flags: Column,
) -> Column:
    """Display doubles go to wire units with half-even rounding."""
    mv = F.rint(bus_voltage_v.cast("double") * F.lit(1000.0))
    centi = F.rint(battery_temp_c.cast("double") * F.lit(100.0))
    units = F.shiftleft(_low(mv, 16), 16).bitwiseOR(_low(centi, 16))
    state = F.shiftleft(_low(mode, 8), 8).bitwiseOR(_low(fault_flags, 8))
    return F.concat(
        hex_digits(timestamp_ns.cast("bigint"), 16),
        hex_digits(units, 8),
        hex_digits(F.shiftleft(_low(wheel_rpm, 32), 16).bitwiseOR(state), 12),
    )


def health_body(sequence_count: Column, *sample: Column) -> Column:
    return packet_body(APID_HEALTH, sequence_count, health_payload_hex(*sample), HEALTH_SIZE)


def ack_payload_hex(command_id: Column, status: Column, applied: Column, time_ns: Column) -> Column:
    head = F.shiftleft(_low(command_id, 32), 8).bitwiseOR(_low(status, 8))
    return F.concat(
        hex_digits(head, 10), hex_digits(_low(applied, 32), 8),
        hex_digits(time_ns.cast("bigint"), 16),
    )


def ack_body(sequence_count: Column, *ack: Column) -> Column:
    return packet_body(APID_COMMAND_ACK, sequence_count, ack_payload_hex(*ack), ACK_SIZE)


def command_body(
    command_id: Column, opcode: Column, argument: Column, issued_ns: Column
) -> Column:
    """A command frame has the ack payload's shape; the CRC covers it alone."""
    return F.unhex(ack_payload_hex(command_id, opcode, argument, issued_ns))


def limit_violations(
    bus_voltage_v: Column | str = "bus_voltage_v",
    battery_temp_c: Column | str = "battery_temp_c",
    wheel_rpm: Column | str = "wheel_rpm",
    fault_flags: Column | str = "fault_flags",
) -> Column:
    """Array of {parameter, value, severity, message}, at most one per parameter."""
    v, t, rpm, flags = map(col_of, (bus_voltage_v, battery_temp_c, wheel_rpm, fault_flags))

    def violation(parameter: str, value: Column, severity: str, message: str) -> Column:
        return F.struct(
            F.lit(parameter).alias("parameter"),
            value.cast("double").alias("value"),
            F.lit(severity).alias("severity"),
            F.lit(message).alias("message"),
        )

    bus, battery = "bus_voltage_v", "battery_temp_c"
    return F.array_compact(
        F.array(
            F.when(v < 24.0, violation(bus, v, "CRITICAL", "Bus voltage below 24.0 V")).when(
                v < 26.0, violation(bus, v, "WARNING", "Bus voltage below 26.0 V")
            ),
            F.when(
                t > 65.0, violation(battery, t, "CRITICAL", "Battery temperature above 65 C")
            ).when(t > 55.0, violation(battery, t, "WARNING", "Battery temperature above 55 C")),
            F.when(
                F.abs(rpm) > 5500,
                violation("wheel_rpm", rpm, "CRITICAL", "Reaction wheel speed exceeds 5500 RPM"),
            ),
            F.when(
                flags != 0,
                violation("fault_flags", flags, "CRITICAL", "Spacecraft fault flag is set"),
            ),
        )
    )


def subject_of(apid: Column | str) -> Column:
    a = col_of(apid)
    return F.when(a == APID_HEALTH, SUBJECT_HEALTH).when(a == APID_COMMAND_ACK, SUBJECT_ACK)
