"""Version 1 command and acknowledgement tables derived from ``events``
(FIXTURES.md B.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.functions import command_wire as cw
from telemark.functions import wire
from telemark.operators.scale import blocked_row_number
from telemark.sources.sample import SECOND_US, _flip_last_byte, events, every


def _uuid(number, tail: int):
    return F.concat(
        F.lower(wire.hex_digits(number, 8)),
        F.lit("-0000-4000-8000-"),
        F.lower(wire.hex_digits(F.lit(tail), 12)),
    )


def issued_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved commands, before damage."""
    e, kind = F.col("e"), F.col("event_type")
    opcode = F.when(kind == "click", 1).when(kind == "purchase", 2).otherwise(3).cast("bigint")
    return (
        events(spark, sf_dir)
        .where(kind.isin("click", "purchase", "view"))
        .select(
            "e",
            _uuid(e, 7).alias("command_id"),
            F.lit(1).cast("bigint").alias("payload_id"),
            opcode.alias("opcode"),
            F.col("sample_us").alias("issued_us"),
            (F.col("sample_us") + F.when(kind == "click", 30).otherwise(10) * SECOND_US).alias(
                "expires_us"
            ),
            F.when(kind == "click", e % 3).alias("argument"),
        )
    )


def command_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    sent = issued_commands(spark, sf_dir)
    length = F.when(every(59), 2).when(F.col("argument").isNotNull(), 1).otherwise(0)
    body = cw.command_body(
        F.when(every(37), 2).otherwise(1),
        F.when(every(41), 2).otherwise(1),
        F.when(every(71), _uuid(e, 7)).otherwise(F.col("command_id")),
        F.when(every(47), 2).otherwise(1),
        F.when(every(53), 9).otherwise(F.col("opcode")),
        length,
        F.when(every(43), 1).otherwise(0),
        F.col("issued_us"),
        F.when(every(67), F.col("issued_us")).otherwise(F.col("expires_us")),
        F.when(every(61) & F.col("argument").isNotNull(), F.lit(7)).otherwise(F.col("argument")),
    )
    encoded = wire.compute_once(wire.with_crc(sent, body, "encoded"), intact=F.col("encoded"))
    size = F.length("intact")
    flipped = F.when(size == 43, _flip_last_byte(F.col("intact"), 43)).otherwise(
        _flip_last_byte(F.col("intact"), 42)
    )
    damaged = (
        F.when(every(31), F.substring("intact", 1, 41))
        .when(every(29), flipped)
        .otherwise(F.col("intact"))
    )
    at = F.when(every(73), 45).when(every(79), -3).otherwise(1) * SECOND_US
    return wire.compute_once(encoded, raw_command=damaged).select(
        F.col("e").alias("frame_no"), (F.col("issued_us") + at).alias("at_us"), "raw_command"
    )


def _ack_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RECEIVED, ACCEPTED and a final event per command; some are lost."""
    e, k = F.col("e"), F.col("k")
    steps = F.when(every(13), F.array(F.lit(0))).when(
        every(11), F.array(F.lit(0), F.lit(2))
    ).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    refused = every(7) & (k == 2)
    late = F.when(every(17) & (k == 2), 60).otherwise(k + 1)
    rows = (
        issued_commands(spark, sf_dir)
        .withColumn("k", F.explode(steps))
        .select(
            "e", "k", "opcode", "issued_us",
            (e * 4 + k).alias("ack_no"),
            F.when(every(29), _uuid(e, 9)).otherwise(F.col("command_id")).alias("command_id"),
            F.when(refused, 3).when(k == 2, 4).otherwise(k + 1).cast("bigint").alias("ack_type"),
            F.when(refused, F.when(every(2), 10).otherwise(7)).otherwise(0).cast("bigint").alias("reason_code"),
            (e % 5 + 1).alias("boot_id"),
            (F.col("issued_us") + late * SECOND_US).alias("event_us"),
        )
    )
    ranked = blocked_row_number(rows, ["boot_id"], "ack_no", "rn")
    return ranked.withColumn("sequence_number", F.col("rn") + wire.whole_div("rn", 9))


def ack_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acks as delivered, with exact copies (1) and contradicting ones (2)."""
    a = F.col("ack_no")
    copies = F.array_compact(
        F.array(F.lit(0), F.when(every(17, "ack_no"), 1), F.when(every(19, "ack_no"), 2))
    )
    copy = F.col("copy")
    rows = _ack_events(spark, sf_dir).withColumn("copy", F.explode(copies)).withColumns(
        {
            "delivery_id": a * 4 + copy,
            "received_us": F.col("event_us")
            + F.when(copy == 1, 30).when(copy == 2, 40).otherwise(0) * SECOND_US,
            "sent_us": F.col("event_us") + F.when(copy == 2, 1).otherwise(0),
        }
    )
    body = cw.ack_body(
        F.col("command_id"), F.lit(1),
        F.when(every(31, "ack_no"), F.col("opcode") % 3 + 1).otherwise(F.col("opcode")),
        F.col("ack_type"), F.lit(0),
        F.when(every(37, "ack_no"), 99).otherwise(F.col("reason_code")),
        F.col("boot_id"), F.col("sequence_number"), F.col("sent_us"),
    )
    encoded = wire.compute_once(wire.with_crc(rows, body, "encoded"), intact=F.col("encoded"))
    damaged = F.when(every(23, "ack_no"), _flip_last_byte(F.col("intact"), 44)).otherwise(
        F.col("intact")
    )
    return wire.compute_once(encoded, raw_ack=damaged).select("delivery_id", "received_us", "raw_ack")


def state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipt-ordered state events: ground steps, acks, and some timeouts that
    ground recorded before a late final ack."""
    sent = issued_commands(spark, sf_dir)
    ground = sent.select(
        "command_id", "e",
        F.posexplode(F.array(*map(F.lit, ("VALIDATED", "QUEUED", "SENT")))).alias("k", "event"),
        "issued_us",
    ).select(
        "command_id",
        (F.col("e") * 16 + F.col("k")).alias("event_no"),
        F.col("issued_us").alias("at_us"),
        "event",
        F.lit(None).cast("string").alias("reason"),
    )
    acks = _ack_events(spark, sf_dir).where(~every(29)).select(
        "command_id",
        (F.col("e") * 16 + 8 + F.col("k")).alias("event_no"),
        F.col("event_us").alias("at_us"),
        cw.ack_name("ack_type").alias("event"),
        F.when(F.col("reason_code") != 0, cw.reason_name("reason_code")).alias("reason"),
    )
    timeouts = sent.where(every(17)).select(
        "command_id", "e", "issued_us",
        F.posexplode(F.array(F.lit("TIMED_OUT"), F.lit("UNKNOWN"))).alias("k", "event"),
    ).select(
        "command_id",
        (F.col("e") * 16 + 6 + F.col("k")).alias("event_no"),
        (F.col("issued_us") + 6 * SECOND_US).alias("at_us"),
        "event",
        F.lit(None).cast("string").alias("reason"),
    )
    repeats = ground.where((F.col("event") == "SENT") & every(3, "event_no")).withColumn(
        "event_no", F.col("event_no") + 3
    )
    return ground.unionByName(acks).unionByName(timeouts).unionByName(repeats)


def operator_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator commands with repeated and contradicted idempotency keys."""
    e, copy = F.col("e"), F.col("copy")
    copies = F.array_compact(F.array(F.lit(0), F.when(every(5), 1), F.when(every(7), 2)))
    mode = F.element_at(
        F.array(*map(F.lit, ("SAFE", "STANDBY", "SCIENCE"))), ((e + (copy == 2).cast("int")) % 3 + 1).cast("int")
    )
    spacing = F.when(copy == 1, F.lit(' { "mode" : "')).otherwise(F.lit('{"mode":"'))
    return (
        events(spark, sf_dir)
        .where("event_type = 'click'")
        .withColumn("copy", F.explode(copies))
        .select(
            (e * 4 + copy).alias("request_no"),
            (F.col("sample_us") + copy * SECOND_US).alias("received_us"),
            F.concat(F.lit("operator-"), (F.col("user_id") % 3).cast("string")).alias("operator_id"),
            F.concat(F.lit("key-"), e.cast("string")).alias("idempotency_key"),
            F.lit(1).cast("bigint").alias("payload_id"),
            F.lit("SET_PAYLOAD_MODE").alias("name"),
            F.concat(spacing, mode, F.lit('"}')).alias("arguments"),
        )
    )
