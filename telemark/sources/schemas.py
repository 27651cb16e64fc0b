"""Table schemas. Unsigned 32-bit wire values need bigint; times are UTC
microseconds in bigint so that comparisons are exact."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "boolean": T.BooleanType(),
    "double": T.DoubleType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """``name type, name type``; unlike the DDL parser it needs no session."""
    fields = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


DELIVERY = struct(
    "delivery_id bigint, received_us bigint, request_id string, content_type string, "
    "raw_body binary"
)
RECEIPT = struct(
    "receipt_id bigint, presented_request_id string, canonical_request_id string, "
    "identity string, content_type string, received_us bigint, raw_body binary, "
    "raw_body_size int, body_sha256 string, validation_status string, rejection_reason string, "
    "parsed_identifiers string, duplicate_of_receipt_id bigint, logical_packet_id string, "
    "queue_status string"
)
REQUEST_IDENTITY = struct(
    "request_id string, first_receipt_id bigint, body_sha256 string, created_us bigint"
)
PACKET = struct(
    "packet_id string, source_receipt_id bigint, received_us bigint, protocol_version bigint, "
    "payload_id bigint, boot_id bigint, sequence_number bigint, timestamp_us bigint, "
    "temperature_centi_c bigint, voltage_mv bigint, operating_mode bigint, fault_flags bigint, "
    "raw_sha256 string, sequence_disposition string, missing_before bigint"
)
SEQUENCE_STATE = struct(
    "payload_id bigint, boot_id bigint, high_water_sequence bigint, "
    "accepted_packet_count bigint, missing_packet_count bigint, last_high_water_packet_id string"
)
JOB = struct(
    "job_id string, packet_id string, created_us bigint, queued_us bigint, max_attempts int"
)
ATTEMPT = struct(
    "job_id string, packet_id string, attempt_no int, ended_us bigint, outcome string, error string"
)
PROCESSED = struct(
    "packet_id string, job_id string, temperature_c double, voltage_v double, "
    "operating_mode string, fault_names array<string>, classification string, "
    "is_stale boolean, processor_version string, processed_us bigint"
)
AUDIT = struct(
    "event_id string, occurred_us bigint, service_name string, event_name string, "
    "actor_identity string, outcome string, reason string, receipt_id bigint, "
    "packet_id string, job_id string, event_data string"
)
LEGACY_PACKET = struct(
    "packet_no bigint, received_ns bigint, source string, raw_packet binary"
)
COMMAND = struct("id bigint, created_us bigint, name string, argument bigint, dry_run boolean")
TABLES = {
    "deliveries": DELIVERY,
    "receipts": RECEIPT,
    "request_identities": REQUEST_IDENTITY,
    "packets": PACKET,
    "sequence_states": SEQUENCE_STATE,
    "processed": PROCESSED,
    "audit": AUDIT,
    "legacy_packets": LEGACY_PACKET,
}
