"""Who a delivery is: request identity, packet identity, final outcome.

Arrival order is ``(received_us, delivery_id)``. Groups are counted by a hash
aggregate without bytes; the first row of those with more than one is found by a
partial aggregate and joined back to their deliveries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions import wire
from telemark.operators.scale import attach_group_facts
from telemark.operators.sequence import STATE_CONFLICT

PACKET_KEY = ["payload_id", "boot_id", "sequence_number"]
# Fixed value: every delivery of one listener has its authenticated peer.
VENDOR_IDENTITY = "local-token:vendor-simulator"
REQUEST_CONFLICT = "REQUEST_ID_REUSED_WITH_DIFFERENT_BODY"
SEQUENCE_CONFLICT = "SEQUENCE_CONFLICT"


def first_of_group(rows: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """Row count ``n`` and the first arrival's columns as ``fact``, per key.

    The struct's minimum is decided by receipt time and delivery id, which is
    unique, so the carried columns are never compared.
    """
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("received_us", "delivery_id", *carried)).alias("fact"),
    )


def repeated_groups(rows: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """``first_of_group`` of the keys with more than one row.

    Rows are counted without what they carry; only rows of repeated keys, few as a
    rule, reach the struct's minimum, so bytes of lone rows are neither sorted nor shuffled here.
    """
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return first_of_group(rows.join(repeated.drop("_rows"), keys, "left_semi"), keys, *carried)


def request_identity(deliveries: DataFrame) -> DataFrame:
    """Add ``request_state`` NEW / REPLAY / CONFLICT and ``first_delivery_id``.

    The first body owns a canonical request id. Deliveries without one are
    always NEW. A replay is judged by its first delivery, so that delivery's
    content type and receipt time come along as ``judged_*``.
    """
    rows = wire.compute_once(
        deliveries, canonical_request_id=wire.canonical_request_id("request_id")
    )
    named = rows.where(F.col("canonical_request_id").isNotNull())
    repeated = repeated_groups(named, ["canonical_request_id"], "raw_body", "content_type")
    rows = attach_group_facts(
        rows, repeated, ["canonical_request_id"], row_id="delivery_id"
    )
    owner = F.col("fact.delivery_id")
    is_new = owner.isNull() | (owner == F.col("delivery_id"))
    same_body = F.col("raw_body").eqNullSafe(F.col("fact.raw_body"))
    return wire.compute_once(
        rows,
        request_state=F.when(is_new, "NEW").when(same_body, "REPLAY").otherwise("CONFLICT"),
        first_delivery_id=F.coalesce(owner, F.col("delivery_id")),
        judged_received_us=F.when(is_new, F.col("received_us")).otherwise(
            F.col("fact.received_us")
        ),
        judged_content_type=F.when(is_new, F.col("content_type")).otherwise(
            F.col("fact.content_type")
        ),
    ).drop("fact")


def identify(deliveries: DataFrame) -> DataFrame:
    """Request identity, then the map-only decode and validation."""
    return wire.validate_frames(
        request_identity(deliveries),
        received_us="judged_received_us",
        header_rejection=wire.header_rejection("judged_content_type", "request_id"),
    )


def request_ledger(deliveries: DataFrame) -> DataFrame:
    """One row per canonical request id: the delivery that owns it."""
    named = deliveries.withColumn(
        "canonical_request_id", wire.canonical_request_id("request_id")
    ).where(F.col("canonical_request_id").isNotNull())
    return first_of_group(named, ["canonical_request_id"], "raw_body").select(
        F.col("canonical_request_id").alias("request_id"),
        F.col("fact.delivery_id").alias("first_receipt_id"),
        F.sha2("fact.raw_body", 256).alias("body_sha256"),
        F.col("fact.received_us").alias("created_us"),
    )


def passes_validation() -> Column:
    return F.col("header_rejection").isNull() & F.col("frame_rejection").isNull()


def is_candidate() -> Column:
    """A delivery that may become, duplicate or contradict a packet."""
    return (F.col("request_state") == "NEW") & passes_validation()


def packet_firsts(identified: DataFrame) -> DataFrame:
    """Per packet key: number of candidate deliveries and the first of them."""
    return first_of_group(identified.where(is_candidate()), PACKET_KEY, "raw_body")


def unique_packets(identified: DataFrame) -> DataFrame:
    """The accepted packets: first candidate of every key, decoded again from
    its own bytes, so only the bytes travel through the shuffle."""
    kept = packet_firsts(identified).select(
        F.col("fact.delivery_id").alias("delivery_id"),
        F.col("fact.received_us").alias("received_us"),
        F.col("fact.raw_body").alias("raw_body"),
    )
    return (
        wire.decode_frames(kept)
        .drop("wire_crc", "calculated_crc")
        .withColumn("packet_id", wire.packet_id(*PACKET_KEY))
    )


def packet_identity(identified: DataFrame) -> DataFrame:
    """Add ``packet_state`` PACKET / DUPLICATE / CONFLICT and ``origin_delivery_id``.

    Later deliveries are always compared with the first accepted bytes. A replay
    has its first delivery's bytes, so it takes that delivery's state without
    another join. Rows that never reach acceptance get NULL.
    """
    repeated = repeated_groups(identified.where(is_candidate()), PACKET_KEY, "raw_body").select(
        *(F.col(k).alias(f"_{k}") for k in PACKET_KEY), "n", "fact"
    )
    reaches = (F.col("request_state") != "CONFLICT") & passes_validation()
    keys = [f"_{k}" for k in PACKET_KEY]
    keyed = identified.withColumns({f"_{k}": F.when(reaches, F.col(k)) for k in PACKET_KEY})
    # the fields are in the bytes: they are read again behind the shuffle instead of crossing it
    rows = attach_group_facts(keyed.drop(*wire.DECODED), repeated, keys, row_id="delivery_id")
    rows = wire.decode_frames(rows).select(*keyed.columns, "fact")
    first = F.coalesce("fact.delivery_id", "first_delivery_id")
    return wire.compute_once(
        rows,
        packet_state=F.when(
            reaches,
            F.when(first == F.col("first_delivery_id"), "PACKET")
            .when(F.col("raw_body") == F.col("fact.raw_body"), "DUPLICATE")
            .otherwise("CONFLICT"),
        ),
        origin_delivery_id=F.when(reaches, first),
    ).drop("fact", *keys)


def delivery_outcome(identified: DataFrame) -> DataFrame:
    """Final status, reason and response code of every delivery.

    A replay answers with what its first delivery became: 422 for a rejected
    one, 409 for a conflict, 200 otherwise.
    """
    return with_outcome(packet_identity(identified))


def with_outcome(states: DataFrame) -> DataFrame:
    """Status, reason and response code from request and packet state; map-only."""
    replay = F.col("request_state") == "REPLAY"
    reused = F.col("request_state") == "CONFLICT"
    packet = F.col("packet_state")
    rejection = F.coalesce("header_rejection", "frame_rejection")
    return states.withColumns(
        {
            "is_replay": replay,
            "validation_status": F.when(reused, "CONFLICT")
            .when(rejection.isNotNull(), "REJECTED")
            .when(packet == "PACKET", "ACCEPTED")
            .otherwise(packet),
            "rejection_reason": F.when(reused, REQUEST_CONFLICT)
            .when(rejection.isNotNull(), rejection)
            .when(packet == "CONFLICT", SEQUENCE_CONFLICT),
            "response_code": F.when(reused, 409)
            .when(F.col("header_rejection").isNotNull() & ~replay, 400)
            .when(rejection.isNotNull(), 422)
            .when(packet == "CONFLICT", 409)
            .when(replay | (packet == "DUPLICATE"), 200)
            .otherwise(202),
        }
    )


def has_packet() -> Column:
    """Candidates and their replays name the packet they belong to."""
    return F.col("origin_delivery_id").isNotNull()


def receipts(outcome: DataFrame, identity: str = VENDOR_IDENTITY) -> DataFrame:
    """Receipt ledger: one row per delivery that is not a replay.

    An accepted packet's work is queued as it is accepted, so its receipt reads
    QUEUED.
    """
    linked = F.when(
        F.col("request_state") == "CONFLICT", F.col("first_delivery_id")
    ).when(F.col("packet_state").isin("DUPLICATE", "CONFLICT"), F.col("origin_delivery_id"))
    return outcome.where(~F.col("is_replay")).select(
        F.col("delivery_id").alias("receipt_id"),
        F.col("request_id").alias("presented_request_id"),
        "canonical_request_id",
        F.lit(identity).alias("identity"),
        "content_type",
        "received_us",
        "raw_body",
        F.length("raw_body").alias("raw_body_size"),
        F.sha2("raw_body", 256).alias("body_sha256"),
        "validation_status",
        "rejection_reason",
        F.when(
            has_packet() | F.col("rejection_reason").eqNullSafe(STATE_CONFLICT), wire.parsed_identifiers()
        ).alias("parsed_identifiers"),
        linked.alias("duplicate_of_receipt_id"),
        F.when(has_packet(), wire.packet_id(*PACKET_KEY)).alias("logical_packet_id"),
        F.when(F.col("validation_status") == "ACCEPTED", "QUEUED")
        .otherwise("NOT_APPLICABLE")
        .alias("queue_status"),
    )


def duplicate_links(outcome: DataFrame) -> DataFrame:
    """Receipts that repeat or contradict a packet, with the packet's source."""
    return outcome.where(
        ~F.col("is_replay") & F.col("packet_state").isin("DUPLICATE", "CONFLICT")
    ).select(
        F.col("delivery_id").alias("receipt_id"),
        F.col("packet_state").alias("link"),
        F.col("origin_delivery_id").alias("original_receipt_id"),
        wire.packet_id(*PACKET_KEY).alias("packet_id"),
        F.concat(F.lit("JOB-"), wire.packet_id(*PACKET_KEY)).alias("job_id"),
    )


def quarantine(outcome: DataFrame) -> DataFrame:
    """Rejected receipts with their bytes; they make no packet and no state."""
    return outcome.where(~F.col("is_replay") & (F.col("validation_status") == "REJECTED")).select(
        F.col("delivery_id").alias("receipt_id"), "received_us", "raw_body", "rejection_reason"
    )
