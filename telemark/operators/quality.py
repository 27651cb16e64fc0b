"""Constraint and referential checks over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions.wire import UINT32_MAX

# Fixed value domains.
VALIDATION_STATUSES = ("PENDING", "ACCEPTED", "REJECTED", "DUPLICATE", "CONFLICT")
QUEUE_STATUSES = ("NOT_APPLICABLE", "PENDING_QUEUE", "QUEUED")
DISPOSITIONS = ("FIRST", "IN_ORDER", "GAP", "LATE")
JOB_STATES = ("PENDING_QUEUE", "QUEUED", "PROCESSING", "RETRY_WAIT", "COMPLETE", "FAILED")
CLASSES = ("NOMINAL", "WARNING", "CRITICAL")


def _outside(column: str, allowed: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def _not_u32(column: str) -> Column:
    return ~F.coalesce(F.col(column).between(0, UINT32_MAX), F.lit(False))


def rules() -> dict[str, dict[str, Column]]:
    """Broken-row condition per table and rule."""
    return {
        "receipts": {
            "body_size": ~F.col("raw_body_size").between(0, 1024),
            "validation_status": _outside("validation_status", VALIDATION_STATUSES),
            "queue_status": _outside("queue_status", QUEUE_STATUSES),
        },
        "packets": {
            "payload_positive": ~(F.col("payload_id") > 0),
            "boot_positive": ~(F.col("boot_id") > 0),
            "sequence_u32": _not_u32("sequence_number"),
            "missing_nonnegative": ~(F.col("missing_before") >= 0),
            "disposition": _outside("sequence_disposition", DISPOSITIONS),
        },
        "sequence_states": {
            "high_water_u32": _not_u32("high_water_sequence"),
            "accepted_nonnegative": ~(F.col("accepted_packet_count") >= 0),
            "missing_nonnegative": ~(F.col("missing_packet_count") >= 0),
        },
        "jobs": {
            "attempts_nonnegative": ~(F.col("attempt_count") >= 0),
            "max_attempts_positive": ~(F.col("max_attempts") > 0),
            "state": _outside("state", JOB_STATES),
        },
        "processed": {"classification": _outside("classification", CLASSES)},
    }


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Broken rows per rule: one pass over each table."""
    reports = []
    for table, broken in rules().items():
        if table not in tables:
            continue
        counts = tables[table].agg(
            *(F.count_if(condition).alias(name) for name, condition in broken.items())
        )
        pairs = F.array(
            *(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in broken)
        )
        reports.append(counts.select(F.lit(table).alias("table_name"), F.inline(pairs)))
    return reduce(DataFrame.unionByName, reports)


# Fixed foreign keys: name, child table, child column, parent table, parent key.
FOREIGN_KEYS = (
    ("receipt_duplicate_of", "receipts", "duplicate_of_receipt_id", "receipts", "receipt_id"),
    ("identity_first_receipt", "request_identities", "first_receipt_id", "receipts", "receipt_id"),
    ("packet_source_receipt", "packets", "source_receipt_id", "receipts", "receipt_id"),
    ("state_high_water_packet", "sequence_states", "last_high_water_packet_id", "packets", "packet_id"),
    ("job_packet", "jobs", "packet_id", "packets", "packet_id"),
    ("processed_packet", "processed", "packet_id", "packets", "packet_id"),
    ("processed_job", "processed", "job_id", "jobs", "job_id"),
    ("audit_receipt", "audit", "receipt_id", "receipts", "receipt_id"),
    ("audit_packet", "audit", "packet_id", "packets", "packet_id"),
    ("audit_job", "audit", "job_id", "jobs", "job_id"),
)


def fk_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that child rows name and no parent has, with the number of rows.

    Each parent meets the keys of all its children in one anti join. They are
    counted before it, so a key named by very many rows crosses the shuffle once
    per map task; a child with several columns is read once.
    """
    by_parent: dict[tuple[str, str], dict[str, list[tuple[str, str]]]] = {}
    for name, child, column, parent, key in FOREIGN_KEYS:
        if child in tables and parent in tables:
            by_parent.setdefault((parent, key), {}).setdefault(child, []).append((name, column))
    found = []
    for (parent, key), children in by_parent.items():
        named = reduce(
            DataFrame.unionByName,
            [
                tables[child].select(
                    F.inline(F.array(*(F.struct(F.lit(n).alias("constraint_name"), F.col(c).alias("_key")) for n, c in columns)))
                )
                for child, columns in children.items()
            ],
        )
        counted = (
            named.where(F.col("_key").isNotNull())
            .groupBy("constraint_name", "_key")
            .agg(F.count(F.lit(1)).alias("child_rows"))
        )
        found.append(
            counted.join(tables[parent].select(F.col(key).alias("_key")), "_key", "left_anti").select(
                "constraint_name", F.col("_key").cast("string").alias("missing_key"), "child_rows"
            )
        )
    return reduce(DataFrame.unionByName, found)
