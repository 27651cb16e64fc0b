"""Legacy packet stream: demux, envelopes, gaps, limits and alerts.

``packet_no`` is the arrival number of a packet: unique, ascending with arrival.
Application ids are few, so nothing here groups raw rows by one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions import legacy_wire as lw
from telemark.operators.scale import BLOCK_ROWS, blocked_lag

SCRATCH = ("_p1", "_p2", "_p3")


def decoded(packets: DataFrame) -> DataFrame:
    return lw.decode_packets(packets)


def sound(df: DataFrame) -> DataFrame:
    return df.where(F.col("packet_rejection").isNull())


def health_samples(packets: DataFrame) -> DataFrame:
    rows = sound(decoded(packets)).where(F.col("apid") == lw.APID_HEALTH)
    return rows.withColumns(lw.health_fields()).select(
        "packet_no", "received_ns", "source", "apid", "sequence_count", *lw.health_fields()
    )


def command_acks(packets: DataFrame) -> DataFrame:
    rows = sound(decoded(packets)).where(F.col("apid") == lw.APID_COMMAND_ACK)
    return rows.withColumns(lw.ack_fields()).select(
        "packet_no", "received_ns", "source", "apid", "sequence_count", *lw.ack_fields()
    )


def ingest_result() -> dict[str, Column]:
    """Result and application label of a decoded packet."""
    subject = lw.subject_of("apid")
    rejected = F.col("packet_rejection").isNotNull()
    return {
        "result": F.when(rejected, "rejected").when(subject.isNull(), "unsupported").otherwise("accepted"),
        "apid_label": F.when(rejected, "unknown")
        .when(F.col("apid") == lw.APID_HEALTH, "health")
        .when(F.col("apid") == lw.APID_COMMAND_ACK, "command_ack")
        .otherwise(F.col("apid").cast("string")),
    }


def demux(packets: DataFrame) -> DataFrame:
    """One scan, every packet with the subject it is published under, if any."""
    return (
        decoded(packets)
        .withColumns(ingest_result())
        .withColumn("subject", F.when(F.col("result") == "accepted", lw.subject_of("apid")))
    )


def on_subject(df: DataFrame, subject: str) -> DataFrame:
    return df.where(F.col("subject") == subject)


def ingest_counts(packets: DataFrame) -> DataFrame:
    return demux(packets).groupBy("result", "apid_label").agg(F.count(F.lit(1)).alias("packets"))


def envelopes(packets: DataFrame) -> DataFrame:
    """Compact JSON envelope of every accepted packet, from one scan."""
    head = ["apid", "sequence_count", "received_ns", "source"]

    def document(data: dict[str, Column]) -> Column:
        return F.to_json(
            F.struct(*head, F.struct(*(v.alias(k) for k, v in data.items())).alias("data"))
        )

    rows = demux(packets).where(F.col("result") == "accepted")
    return rows.select(
        "packet_no",
        "subject",
        F.when(F.col("apid") == lw.APID_HEALTH, document(lw.health_fields()))
        .otherwise(document(lw.ack_fields()))
        .alias("value"),
    )


_HEALTH_TEXT = (
    "apid string, sequence_count string, received_ns string, source string, data struct<"
    "timestamp_ns string, bus_voltage_v string, battery_temp_c string, wheel_rpm string, "
    "mode string, fault_flags string>"
)
HEALTH_CASTS = {
    "timestamp_ns": "bigint",
    "bus_voltage_v": "double",
    "battery_temp_c": "double",
    "wheel_rpm": "bigint",
    "mode": "bigint",
    "fault_flags": "bigint",
}


def _number(text: Column, kind: str) -> Column:
    """Integers drop a fraction, as an explicit integer conversion does."""
    if kind == "double":
        return text.try_cast("double")
    whole = F.substring_index(F.trim(text), ".", 1)
    return F.coalesce(text.try_cast("bigint"), whole.try_cast("bigint"))


def parse_health_envelopes(values: DataFrame) -> DataFrame:
    """Typed samples from health envelopes; ``is_malformed`` marks those to
    quarantine (broken JSON, a missing field or one that is no number)."""
    doc = F.col("_doc")
    fields = {
        name: _number(doc[f"data"][name], kind) for name, kind in HEALTH_CASTS.items()
    }
    fields["sequence_count"] = _number(doc["sequence_count"], "bigint")
    broken = F.lit(False)
    for name in fields:
        broken = broken | F.col(name).isNull()
    return (
        values.withColumn("_doc", F.from_json("value", _HEALTH_TEXT))
        .withColumns(fields)
        .withColumn("is_malformed", broken)
        .withColumns({name: F.when(~F.col("is_malformed"), F.col(name)) for name in fields})
        .drop("_doc")
    )


def observed(packets: DataFrame) -> DataFrame:
    """Packets whose count the tracker sees: sound packets, whatever their
    application, and those whose payload alone is bad."""
    rejection = F.col("packet_rejection")
    return decoded(packets).where(
        rejection.isNull() | rejection.isin(*lw.PAYLOAD_REJECTIONS)
    )


def sequence_gaps(packets: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Missing counts before each packet, per application, modulo 2^14. The
    previous count is always the last seen, so a repeat reads as 16,383."""
    rows = observed(packets).select("packet_no", "received_ns", "apid", "sequence_count")
    lagged = blocked_lag(
        rows, ["apid"], "packet_no", "sequence_count", "previous_count", block_rows
    )
    step = F.col("sequence_count") - F.col("previous_count") - 1
    return lagged.withColumn(
        "gap",
        F.coalesce(step.bitwiseAND(F.lit(lw.MAX_SEQUENCE)), F.lit(0)).cast("bigint"),
    )


def gap_totals(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("apid").agg(F.sum("gap").alias("missing"))


def alerts(samples: DataFrame) -> DataFrame:
    """One row per violated limit."""
    return samples.select(
        F.col("packet_no"),
        F.col("received_ns").alias("created_ns"),
        F.col("sequence_count").alias("telemetry_sequence"),
        F.inline(lw.limit_violations()),
    )


def alert_counts(alerts_: DataFrame) -> DataFrame:
    return alerts_.groupBy("severity", "parameter").agg(F.count(F.lit(1)).alias("alerts"))


def latest_gauges(samples: DataFrame) -> DataFrame:
    order = F.struct("received_ns", "packet_no")
    return samples.agg(
        F.max_by("bus_voltage_v", order).alias("latest_bus_voltage_v"),
        F.max_by("battery_temp_c", order).alias("latest_battery_temp_c"),
    )


def processed_stream(samples: DataFrame) -> DataFrame:
    """Samples with their violations array, as published after processing."""
    return samples.withColumn("violations", lw.limit_violations())


def append_once(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Samples not stored yet; redelivery of a packet adds nothing."""
    return new.join(
        stored.select("apid", "source", "sequence_count", "received_ns"),
        ["apid", "source", "sequence_count", "received_ns"],
        "left_anti",
    )


def operator_feed(samples: DataFrame, alerts_: DataFrame, advisories: DataFrame) -> DataFrame:
    """Processed samples, alerts and advisories under their subjects."""
    processed = processed_stream(samples).select(
        F.lit("telemetry.processed").alias("subject"),
        "packet_no",
        F.to_json(
            F.struct(
                "apid", "sequence_count", "received_ns", "source",
                F.struct(*HEALTH_CASTS).alias("data"), "violations",
            )
        ).alias("payload"),
    )
    limits = alerts_.select(
        F.lit("alerts.limit").alias("subject"),
        "packet_no",
        F.to_json(
            F.struct("parameter", "value", "severity", "message", "telemetry_sequence")
        ).alias("payload"),
    )
    return processed.unionByName(limits).unionByName(
        advisories.select(
            F.concat(F.lit("advisories."), "topic").alias("subject"), "packet_no", "payload"
        )
    )
