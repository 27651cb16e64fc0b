"""Processed results, lookup views, idempotent storage and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions import health, wire
from telemark.operators.identity import PACKET_KEY

COMPARED = (
    "temperature_c", "voltage_v", "operating_mode", "fault_names",
    "classification", "is_stale", "processor_version",
)


def packets_table(outcome: DataFrame, disposed: DataFrame) -> DataFrame:
    """The accepted packets with their disposition. A disposition that carries ``raw_body`` is
    the table but for decoding; otherwise both sides hold one row per
    delivery id, so the join has no hot key."""
    if "raw_body" in disposed.columns:
        placed = wire.decode_frames(disposed.drop(*PACKET_KEY))
    else:
        accepted = outcome.where(
            (F.col("request_state") == "NEW") & (F.col("packet_state") == "PACKET")
        )
        placed = accepted.join(disposed.select("delivery_id", "sequence_disposition", "missing_before"), "delivery_id")
    return placed.select(
        wire.packet_id(*PACKET_KEY).alias("packet_id"),
        F.col("delivery_id").alias("source_receipt_id"),
        "received_us",
        *wire.FRAME_FIELDS,
        F.sha2("raw_body", 256).alias("raw_sha256"),
        "sequence_disposition",
        "missing_before",
    )


def processed_results(packets: DataFrame) -> DataFrame:
    """One result per packet, map-only."""
    return packets.select("packet_id", *health.processed_columns())


def stored_results(packets: DataFrame, status: DataFrame) -> DataFrame:
    """Results of packets whose job is complete."""
    complete = status.where(F.col("state") == "COMPLETE").select(
        "packet_id", "job_id", F.col("completed_us").alias("processed_us")
    )
    return processed_results(packets).join(complete, "packet_id")


def raw_view(packets: DataFrame, receipts: DataFrame, status: DataFrame) -> DataFrame:
    """Raw lookup: packet, its source receipt and the state of its job."""
    source = receipts.select(
        F.col("receipt_id").alias("source_receipt_id"), "raw_body", "body_sha256"
    )
    jobs = status.select("packet_id", F.col("state").alias("processing_state"))
    return (
        packets.join(source, "source_receipt_id")
        .join(jobs, "packet_id", "left")
        .select(
            F.col("packet_id").alias("message_id"),
            F.col("source_receipt_id").alias("receipt_id"),
            F.lower(F.hex("raw_body")).alias("raw_hex"),
            "body_sha256",
            wire.iso_time("received_us").alias("received_at"),
            "protocol_version",
            wire.payload_label("payload_id").alias("payload_id"),
            "boot_id",
            "sequence_number",
            wire.iso_time("timestamp_us").alias("sample_time"),
            "sequence_disposition",
            "missing_before",
            "processing_state",
        )
    )


def processed_view(packets: DataFrame, processed: DataFrame, status: DataFrame) -> DataFrame:
    """Processed lookup: the result, or how far the packet's job has come."""
    jobs = status.select("packet_id", "state")
    missing = F.col("classification").isNull()
    return (
        packets.select("packet_id")
        .join(processed, "packet_id", "left")
        .join(jobs, "packet_id", "left")
        .select(
            F.col("packet_id").alias("message_id"),
            "temperature_c",
            "voltage_v",
            "operating_mode",
            "fault_names",
            "classification",
            F.when(F.col("is_stale"), "STALE")
            .when(~F.col("is_stale"), "CURRENT")
            .alias("freshness"),
            "processor_version",
            wire.iso_time("processed_us").alias("processed_at"),
            F.when(missing, F.coalesce("state", F.lit("UNKNOWN"))).alias("processing_state"),
            F.when(~missing, 200)
            .when(F.col("state") == "FAILED", 422)
            .otherwise(202)
            .alias("response_code"),
        )
    )


def lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    """Point read: an equality filter that reaches the scan. A packet id that
    does not have the id's form finds nothing."""
    found = table.where(F.col(key) == F.lit(value))
    if key in ("packet_id", "message_id"):
        found = found.where(wire.is_packet_id(F.lit(value)))
    return found


def lookup_many(requested: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """One answer per requested key: the row, or 404 when it is absent."""
    wanted = requested.select(key).where(F.col(key).isNotNull()).distinct()
    present = table.withColumn("_present", F.lit(True))
    return (
        wanted.join(present, key, "left")
        .withColumn("response_code", F.when(F.col("_present"), 200).otherwise(404))
        .drop("_present")
    )


def consistency_check(packets: DataFrame, receipts: DataFrame) -> DataFrame:
    """Packets whose stored fields differ from their preserved bytes, with the
    names of the fields that differ. Such a packet fails permanently."""
    again = wire.decode_frames(
        receipts.select(F.col("receipt_id").alias("source_receipt_id"), "raw_body")
    ).select("source_receipt_id", *(F.col(f).alias(f"raw_{f}") for f in wire.FRAME_FIELDS))
    differing = F.array_compact(
        F.array(
            *(
                F.when(~F.col(f).eqNullSafe(F.col(f"raw_{f}")), F.lit(f))
                for f in wire.FRAME_FIELDS
            )
        )
    )
    return (
        packets.join(again, "source_receipt_id", "left")
        .withColumn("differing", differing)
        .where(F.size("differing") > 0)
        .select("packet_id", "source_receipt_id", "differing")
    )


def same_result(stored: str, candidate: str) -> Column:
    same = F.lit(True)
    for name in COMPARED:
        same = same & F.col(f"{stored}.{name}").eqNullSafe(F.col(f"{candidate}.{name}"))
    return same


def new_results(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-if-absent: a stored row always wins."""
    return candidates.join(stored.select("packet_id"), "packet_id", "left_anti")


def result_conflicts(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Packets with a stored result that a repeat contradicts in any field."""
    return (
        stored.alias("s")
        .join(candidates.alias("c"), "packet_id")
        .where(~same_result("s", "c"))
        .select(
            "packet_id",
            F.col("s.classification").alias("stored_classification"),
            F.col("c.classification").alias("candidate_classification"),
        )
    )


def upsert_results(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """The result table after a load: stored rows kept, absent ones added."""
    columns = ["packet_id", *COMPARED]
    return stored.select(*columns).unionByName(
        new_results(candidates, stored).select(*columns)
    )
