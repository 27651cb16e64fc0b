"""Audit history derived from deliveries, boundary attempts and the work log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions import wire
from telemark.operators.identity import PACKET_KEY, VENDOR_IDENTITY, has_packet
from telemark.operators.jobs import backoff_seconds
from telemark.operators.scale import ordered_lag

GATEWAY, WORKER = "ground-api", "payload-worker"
# Fixed event names.
EVENT_NAMES = (
    "telemetry.delivery.received",
    "telemetry.delivery.request_id_conflict",
    "telemetry.delivery.rejected",
    "telemetry.delivery.duplicate",
    "telemetry.delivery.sequence_conflict",
    "telemetry.delivery.security_rejected",
    "telemetry.sequence.state_conflict",
    "telemetry.packet.accepted",
    "telemetry.processing.queued",
    "telemetry.processing.claimed",
    "telemetry.processing.completed",
    "telemetry.processing.retry_scheduled",
    "telemetry.processing.failed",
    "vendor.authentication.failed",
)
COLUMNS = (
    "event_id", "occurred_us", "service_name", "event_name", "actor_identity", "outcome",
    "reason", "receipt_id", "packet_id", "job_id", "event_data",
)
_TEXT = ("reason", "packet_id", "job_id", "event_data")


def _event(when: Column, name: str, outcome: Column | str, actor: Column | str, **more: Column) -> Column:
    """One audit row as a struct, NULL where its rule does not hold."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    fields = [
        F.lit(name).alias("event_name"),
        as_column(outcome).alias("outcome"),
        as_column(actor).alias("actor_identity"),
    ]
    for key in _TEXT:
        fields.append(more.get(key, F.lit(None)).cast("string").alias(key))
    return F.when(when, F.struct(*fields))


def delivery_events(outcome: DataFrame, disposed: DataFrame | None = None) -> DataFrame:
    """Gateway events: each delivery is read once and yields its rows.

    A replay leaves no event. With ``disposed`` the acceptance event carries the
    packet's disposition.
    """
    rows = outcome.where(~F.col("is_replay"))
    without = {
        "sequence_disposition": F.lit(None).cast("string"),
        "missing_before": F.lit(None).cast("bigint"),
    }
    if disposed is not None:
        # only the acceptance event reads the disposition: rows without one need not meet it
        accepted = F.coalesce(F.col("packet_state") == "PACKET", F.lit(False))
        found = disposed.select("delivery_id", "sequence_disposition", "missing_before")
        met = rows.where(accepted).join(found, "delivery_id", "left")
        rows = met.unionByName(rows.where(~accepted).withColumns(without))
    else:
        rows = rows.withColumns(without)
    packet, job = wire.packet_id(*PACKET_KEY), F.concat(F.lit("JOB-"), wire.packet_id(*PACKET_KEY))
    status, reason, state = F.col("validation_status"), F.col("rejection_reason"), F.col("packet_state")
    reused = F.col("request_state") == "CONFLICT"
    digest = F.to_json(
        F.struct(
            F.sha2("raw_body", 256).alias("body_sha256"),
            F.length("raw_body").alias("raw_body_size"),
        )
    )
    events = F.array_compact(
        F.array(
            _event(~reused, EVENT_NAMES[0], "RECORDED", VENDOR_IDENTITY, event_data=digest),
            _event(reused, EVENT_NAMES[1], "CONFLICT", VENDOR_IDENTITY, reason=reason, event_data=digest),
            _event(status == "REJECTED", EVENT_NAMES[2], "REJECTED", GATEWAY, reason=reason),
            _event(
                state == "DUPLICATE", EVENT_NAMES[3], "DUPLICATE", GATEWAY,
                packet_id=packet, job_id=job,
                event_data=F.to_json(
                    F.struct(F.col("origin_delivery_id").cast("string").alias("original_receipt_id"))
                ),
            ),
            _event(state == "CONFLICT", EVENT_NAMES[4], "CONFLICT", GATEWAY, reason=reason, packet_id=packet),
            _event(
                state == "PACKET", EVENT_NAMES[7], "PENDING_QUEUE", GATEWAY,
                packet_id=packet, job_id=job,
                event_data=F.to_json(F.struct("sequence_disposition", "missing_before")),
            ),
            _event(
                state == "PACKET", EVENT_NAMES[8], "QUEUED", GATEWAY, packet_id=packet, job_id=job,
                event_data=F.to_json(F.struct(job.alias("queue_message_id"))),
            ),
        )
    )
    return rows.select(
        "delivery_id", F.col("received_us").alias("occurred_us"), F.posexplode(events)
    ).select(
        F.concat_ws("-", F.lit("D"), "delivery_id", "pos").alias("event_id"),
        "occurred_us",
        F.lit(GATEWAY).alias("service_name"),
        F.col("col.event_name"),
        F.col("col.actor_identity"),
        F.col("col.outcome"),
        F.col("col.reason"),
        # the queueing event names the job, not the receipt
        F.when(F.col("col.event_name") != EVENT_NAMES[8], F.col("delivery_id")).alias("receipt_id"),
        F.col("col.packet_id"),
        F.col("col.job_id"),
        F.col("col.event_data"),
    )


def work_events(attempts: DataFrame, base_backoff: int = 1) -> DataFrame:
    """Worker events: a claim and an end for every attempt."""
    outcome, n = F.col("outcome"), F.col("attempt_no")
    failed = (outcome == "permanent") | ((outcome == "temporary") & (n >= F.col("max_attempts")))
    retry = (outcome == "temporary") & ~failed
    packet, job = F.col("packet_id"), F.col("job_id")
    count = F.to_json(F.struct(n.alias("attempt_count")))
    next_us = F.when(retry, F.col("ended_us") + backoff_seconds(n, base_backoff) * 1000000)
    detail = F.to_json(
        F.struct(
            n.alias("attempt_count"), "max_attempts", wire.iso_time(next_us).alias("next_attempt_at")
        )
    )
    same = {"packet_id": packet, "job_id": job}
    events = F.array_compact(
        F.array(
            _event(outcome.isNotNull(), EVENT_NAMES[9], "PROCESSING", WORKER, event_data=count, **same),
            _event(outcome == "success", EVENT_NAMES[10], "COMPLETE", WORKER, **same),
            _event(retry, EVENT_NAMES[11], "RETRY_WAIT", WORKER, reason=F.col("error"), event_data=detail, **same),
            _event(failed, EVENT_NAMES[12], "FAILED", WORKER, reason=F.col("error"), event_data=detail, **same),
        )
    )
    return attempts.select(
        F.col("job_id").alias("_job"), "attempt_no", "ended_us", F.posexplode(events)
    ).select(
        F.concat_ws("-", F.lit("A"), "_job", "attempt_no", "pos").alias("event_id"),
        # a claim is dated one second before its end
        F.when(F.col("pos") == 0, F.col("ended_us") - 1000000)
        .otherwise(F.col("ended_us"))
        .alias("occurred_us"),
        F.lit(WORKER).alias("service_name"),
        F.col("col.event_name"),
        F.col("col.actor_identity"),
        F.col("col.outcome"),
        F.col("col.reason"),
        F.lit(None).cast("bigint").alias("receipt_id"),
        F.col("col.packet_id"),
        F.col("col.job_id"),
        F.col("col.event_data"),
    )


def boundary_events(attempts: DataFrame) -> DataFrame:
    """Refusals before a receipt exists: bad credential, then size rules."""
    denied = ~F.col("token_ok")
    refused = wire.boundary_rejection("declared_length", F.length("raw_body"))
    reason = F.when(denied, "INVALID_VENDOR_TOKEN").otherwise(refused)
    return (
        attempts.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select(
            F.concat(F.lit("B-"), F.col("attempt_id").cast("string")).alias("event_id"),
            F.col("received_us").alias("occurred_us"),
            F.lit(GATEWAY).alias("service_name"),
            F.when(denied, EVENT_NAMES[13]).otherwise(EVENT_NAMES[5]).alias("event_name"),
            F.when(denied, "unauthenticated").otherwise(VENDOR_IDENTITY).alias("actor_identity"),
            F.lit("REJECTED").alias("outcome"),
            "reason",
            F.lit(None).cast("bigint").alias("receipt_id"),
            F.lit(None).cast("string").alias("packet_id"),
            F.lit(None).cast("string").alias("job_id"),
            F.to_json(F.struct(F.col("request_id").alias("presented_request_id"))).alias("event_data"),
        )
    )


def state_conflict_events(loaded: DataFrame) -> DataFrame:
    """Events for packets an incremental load found to contradict stored state."""
    return loaded.where(F.col("state_conflict").isNotNull()).select(
        F.concat(F.lit("S-"), F.col("delivery_id").cast("string")).alias("event_id"),
        F.col("received_us").alias("occurred_us"),
        F.lit(GATEWAY).alias("service_name"),
        F.lit(EVENT_NAMES[6]).alias("event_name"),
        F.lit(GATEWAY).alias("actor_identity"),
        F.lit("CONFLICT").alias("outcome"),
        F.col("state_conflict").alias("reason"),
        F.col("delivery_id").alias("receipt_id"),
        F.lit(None).cast("string").alias("packet_id"),
        F.lit(None).cast("string").alias("job_id"),
        F.lit(None).cast("string").alias("event_data"),
    )


def audit_history(*parts: DataFrame) -> DataFrame:
    history, *rest = (part.select(*COLUMNS) for part in parts)
    for part in rest:
        history = history.unionByName(part)
    return history


def packet_timeline(events: DataFrame, slices: int | None = None) -> DataFrame:
    """Audit rows of each packet in time order with the outcome before.

    A packet delivered very often has very many rows, so the order is cut into
    range slices rather than windowed per packet.
    """
    rows = events.where(F.col("packet_id").isNotNull()).select(
        "packet_id", "occurred_us", "event_id", "event_name", "outcome"
    )
    return ordered_lag(
        rows, ["packet_id"], ["occurred_us", "event_id"], "outcome", "previous_outcome", slices
    )
