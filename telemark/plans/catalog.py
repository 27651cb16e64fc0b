"""Every registered query: name -> function of (spark, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemark.functions import command_wire, health, legacy_wire, wire
from telemark.operators import (
    audit, commands, identity, jobs, legacy, load, metrics, quality, results, sequence, topk,
)
from telemark.operators import command_history as command_history_
from telemark.plans.tables import Tables
from telemark.session import settle
from telemark.sources import arrivals, command_sample, sample
from telemark.streaming import ledger, loads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF_US = sample.SHIFT_US + 1706745600000000  # one month after the first sample
FIELDS = list(wire.FRAME_FIELDS)


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and arrays of text joined, for comparison with SQL."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: plain(build(Tables(spark, sf_dir)))
    return build


def _hex(column: str, name: str = "raw_hex"):
    return F.hex(column).alias(name)


# -- sources and sinks ---------------------------------------------------------


@query
def deliveries(t):
    return t.deliveries().select(
        "delivery_id", "received_us", "request_id", "content_type", _hex("raw_body")
    )


@query
def receipt_ledger(t):
    outcome = identity.delivery_outcome(identity.identify(t.deliveries()))
    return identity.receipts(outcome).select(
        "receipt_id", "presented_request_id", "canonical_request_id", "identity", "received_us",
        "raw_body_size", "body_sha256", "validation_status", "rejection_reason",
        F.get_json_object("parsed_identifiers", "$.packet_id").alias("parsed_packet_id"),
        "duplicate_of_receipt_id", "logical_packet_id", "queue_status",
    )


@query
def quarantine(t):
    outcome = identity.delivery_outcome(identity.identify(t.deliveries()))
    return identity.quarantine(outcome).withColumn("raw_body", F.hex("raw_body"))


@query
def security_rejected(t):
    return audit.boundary_events(t.boundary()).select(
        "event_id", "occurred_us", "event_name", "actor_identity", "outcome", "reason"
    )


@query
def audit_events(t):
    return t.audit_history().drop("event_data")


def _earlier_results(t):
    """Results stored by an earlier load: every third event, some contradicting."""
    e = wire.whole_div("source_receipt_id", 8)
    first = t.packets().where(e % 3 == 0)
    stale = e % 21 == 0
    return first.select("packet_id", stale.alias("_contradicts"), *health.processed_columns()).withColumn(
        "classification",
        F.when(~F.col("_contradicts"), F.col("classification"))
        .when(F.col("classification") == "NOMINAL", "WARNING")
        .otherwise("NOMINAL"),
    ).drop("_contradicts")


@query
def processed_upsert(t):
    return results.upsert_results(results.processed_results(t.packets()), _earlier_results(t))


@query
def result_conflicts(t):
    return results.result_conflicts(results.processed_results(t.packets()), _earlier_results(t))


@query
def legacy_packets(t):
    return t.legacy_packets().select("packet_no", "received_ns", "source", _hex("raw_packet"))


@query
def legacy_demux(t):
    return legacy.demux(t.legacy_packets()).select("packet_no", "subject", "result", "apid_label")


@query
def legacy_envelope(t):
    return legacy.envelopes(t.legacy_packets())


@query
def legacy_envelope_parse(t):
    values = sample.damaged_envelopes(legacy.envelopes(t.legacy_packets()))
    return legacy.parse_health_envelopes(values).drop("value", "subject")


# -- projections ---------------------------------------------------------------


@query
def frame_decode(t):
    return wire.decode_frames(t.deliveries()).select("delivery_id", *FIELDS, "wire_crc")


@query
def frame_crc(t):
    return wire.decode_frames(t.deliveries()).select(
        "delivery_id", "calculated_crc",
        (F.col("calculated_crc") == F.col("wire_crc")).alias("matches"),
    )


@query
def frame_encode(t):
    frames = sample.frames(t.spark, t.sf_dir)
    return wire.encode_frames(frames, received="received_us").select(
        "e", "encode_rejection", _hex("raw_body")
    )


@query
def packet_id(t):
    return wire.decode_frames(t.deliveries()).select(
        "delivery_id",
        wire.packet_id("payload_id", "boot_id", "sequence_number").alias("packet_id"),
        wire.is_packet_id(wire.packet_id("payload_id", "boot_id", "sequence_number")).alias("is_id"),
        wire.is_packet_id("request_id").alias("request_is_id"),
    )


@query
def engineering_units(t):
    return wire.decode_frames(t.deliveries()).select(
        "delivery_id",
        health.celsius("temperature_centi_c").alias("temperature_c"),
        health.volts("voltage_mv").alias("voltage_v"),
    )


@query
def sample_time(t):
    return wire.decode_frames(t.deliveries()).select(
        "delivery_id", "timestamp_us", wire.iso_time("timestamp_us").alias("sample_time")
    )


@query
def fault_names(t):
    return wire.decode_frames(t.deliveries()).select(
        "delivery_id", "fault_flags", health.fault_names("fault_flags").alias("fault_names")
    )


@query
def health_temperature(t):
    return wire.decode_frames(t.deliveries()).select(
        "delivery_id", health.temperature_class("temperature_centi_c").alias("temperature_class")
    )


@query
def health_voltage(t):
    return wire.decode_frames(t.deliveries()).select(
        "delivery_id", health.voltage_class("voltage_mv").alias("voltage_class")
    )


@query
def health_faults(t):
    return wire.decode_frames(t.deliveries()).select(
        "delivery_id", health.fault_class("fault_flags").alias("fault_class")
    )


def _valid(t):
    return wire.validate_frames(t.deliveries()).where(F.col("frame_rejection").isNull())


@query
def freshness(t):
    return _valid(t).select(
        "delivery_id", health.freshness("timestamp_us", "received_us").alias("freshness")
    )


@query
def health_assessment(t):
    return health.assess_health(_valid(t)).select(
        "delivery_id", "temperature_class", "voltage_class", "fault_class", "freshness",
        "classification",
    )


@query
def processed(t):
    return results.processed_results(identity.unique_packets(identity.identify(t.deliveries())))


@query
def scaled_wire_units(t):
    e = F.col("e")
    text = F.concat(
        F.when(e % 7 == 0, F.lit("-")).otherwise(F.lit("")),
        wire.whole_div(e, 10000).cast("string"), F.lit("."),
        F.lpad((e % 10000).cast("string"), 4, "0"),
    )
    return sample.events(t.spark, t.sf_dir).select(
        "e", text.alias("display"),
        wire.rounded_wire_units(text, 100).alias("centi"),
        wire.rounded_wire_units(text, 1000).alias("milli"),
    )


@query
def legacy_decode(t):
    return legacy.decoded(t.legacy_packets()).select(
        "packet_no", "packet_version", "packet_type", "apid", "sequence_count", "data_length",
        F.hex(legacy_wire.packet_payload("raw_packet")).alias("payload_hex"),
    )


@query
def legacy_health(t):
    return t.health_samples().drop("source", "apid")


@query
def legacy_ack(t):
    return legacy.command_acks(t.legacy_packets()).drop("source", "apid")


@query
def legacy_encode(t):
    samples = sample.legacy_samples(t.spark, t.sf_dir)
    body = legacy_wire.health_body(
        F.col("sequence_count"), F.col("timestamp_ns"), F.col("mv") / 1000.0,
        F.col("centi_c") / 100.0, F.col("wheel_rpm"), F.col("mode"), F.col("fault_flags"),
    )
    return wire.with_crc(samples, body, "raw").select("e", _hex("raw"))


@query
def legacy_command_frame(t):
    return legacy_wire.decode_command_frames(sample.command_frames(t.spark, t.sf_dir)).drop(
        "raw_command"
    )


@query
def limit_violations(t):
    return legacy.alerts(t.health_samples())


# -- validation ----------------------------------------------------------------


@query
def rejection_reason(t):
    return wire.validate_frames(t.deliveries()).select("delivery_id", "frame_rejection")


@query
def header_validation(t):
    return t.deliveries().select(
        "delivery_id",
        wire.header_rejection("content_type", "request_id").alias("header_rejection"),
    )


@query
def delivery_outcome(t):
    outcome = identity.delivery_outcome(identity.identify(t.deliveries()))
    return outcome.select(
        "delivery_id", "is_replay", "validation_status", "rejection_reason", "response_code",
        "origin_delivery_id",
    )


@query
def legacy_rejection(t):
    return legacy.decoded(t.legacy_packets()).select("packet_no", "packet_rejection")


@query
def command_validation(t):
    return commands.validate_commands(t.commands()).select(
        "id", "name", "argument", "dry_run", "result", "reason", "status", "opcode"
    )


@query
def constraint_report(t):
    """Real tables, and as the packets table every decodable delivery, valid or not."""
    unchecked = wire.decode_frames(t.deliveries()).where(F.col("boot_id").isNotNull()).withColumns(
        {
            "missing_before": F.lit(0).cast("bigint"),
            "sequence_disposition": F.when(sample.every(45, "delivery_id"), "SKIPPED").otherwise("FIRST"),
        }
    )
    return quality.constraint_report(
        {
            "receipts": t.receipts(),
            "packets": unchecked,
            "sequence_states": t.sequence_states(),
            "jobs": t.job_status(),
            "processed": t.processed(),
        }
    )


# -- joins ---------------------------------------------------------------------


@query
def raw_view(t):
    return results.raw_view(t.packets(), t.receipts(), t.job_status())


@query
def processed_view(t):
    return results.processed_view(t.packets(), t.processed(), t.job_status())


@query
def duplicate_links(t):
    return identity.duplicate_links(
        identity.delivery_outcome(identity.identify(t.deliveries()))
    )


def _acks(t):
    validated = commands.validate_commands(t.commands())
    return sample.command_acks(validated, legacy.command_acks(t.legacy_packets()))


def _accepted_commands(t):
    return commands.validate_commands(t.commands()).where(F.col("result") == "accepted")


@query
def command_acks(t):
    return commands.ack_updates(_acks(t), _accepted_commands(t))


@query
def orphan_acks(t):
    return commands.orphan_acks(_acks(t), _accepted_commands(t))


@query
def consistency_check(t):
    """Stored packets with some fields altered after acceptance."""
    e = wire.whole_div("source_receipt_id", 8)
    altered = t.packets().withColumns(
        {
            "voltage_mv": F.when(e % 50 == 0, F.col("voltage_mv") + 7).otherwise(F.col("voltage_mv")),
            "operating_mode": F.when(e % 77 == 0, (F.col("operating_mode") + 1) % 4).otherwise(
                F.col("operating_mode")
            ),
        }
    )
    return results.consistency_check(altered, t.receipts())


@query
def fk_violations(t):
    """All tables with some receipts and packets taken away."""
    return quality.fk_violations(
        {
            "receipts": t.receipts().where(F.col("receipt_id") % 97 != 0),
            "request_identities": t.request_identities(),
            "packets": t.packets().where(F.col("boot_id") % 31 != 0),
            "sequence_states": t.sequence_states(),
            "jobs": t.jobs(),
            "processed": t.processed(),
            "audit": t.audit(),
        }
    )


@query
def lookup_command(t):
    requested = _acks(t).select(F.col("command_id").alias("id"))
    table = _accepted_commands(t).select("id", "name", "argument", "status")
    return results.lookup_many(requested, table, "id")


# -- aggregates ----------------------------------------------------------------


@query
def service_counters(t):
    return metrics.service_counters(
        t.outcome(), t.disposed(), t.attempts(), t.processed(), t.boundary()
    )


@query
def rejection_breakdown(t):
    return metrics.status_breakdown(t.receipts())


@query
def queue_depth(t):
    return jobs.queue_depth(t.job_status(backlog=True))


@query
def job_status(t):
    return jobs.job_status(t.jobs(backlog=True), t.attempts(backlog=True))


@query
def sequence_state(t):
    packets = identity.unique_packets(identity.identify(t.deliveries()))
    return sequence.sequence_state(sequence.sequence_disposition(packets))


@query
def legacy_ingest_counts(t):
    return legacy.ingest_counts(t.legacy_packets())


@query
def legacy_gap_totals(t):
    return legacy.gap_totals(legacy.sequence_gaps(t.legacy_packets()))


@query
def latency_histogram(t):
    return metrics.latency_histogram(t.health_samples())


@query
def alert_counts(t):
    return legacy.alert_counts(legacy.alerts(t.health_samples()))


@query
def latest_gauges(t):
    return legacy.latest_gauges(t.health_samples())


@query
def command_counters(t):
    validated = commands.validate_commands(t.commands())
    events = sample.command_events(validated.where(F.col("result") == "accepted"), _acks(t))
    parsed = legacy.parse_health_envelopes(
        sample.damaged_envelopes(legacy.envelopes(t.legacy_packets()))
    )
    health_messages = parsed.select(
        F.lit("health").alias("subject"),
        F.when(F.col("is_malformed"), "error").otherwise("ok").alias("result"),
    )
    other = events.select(
        F.when(F.col("subject") == legacy_wire.SUBJECT_ACK, "command_ack")
        .otherwise("command_status").alias("subject"),
        F.lit("ok").alias("result"),
    )
    return commands.command_counters(validated, events, health_messages.unionByName(other))


# -- ordered -------------------------------------------------------------------


@query
def request_identity(t):
    return identity.request_identity(t.deliveries()).select(
        "delivery_id", "request_state", "first_delivery_id"
    )


@query
def packet_identity(t):
    return identity.packet_identity(identity.identify(t.deliveries())).where(
        (F.col("request_state") == "NEW") & F.col("packet_state").isNotNull()
    ).select("delivery_id", "packet_state", "origin_delivery_id")


@query
def sequence_disposition(t):
    packets = identity.unique_packets(identity.identify(t.deliveries()))
    return sequence.sequence_disposition(packets)


@query
def wide_sequence_state(t):
    disposed = sequence.sequence_disposition(sample.wide_packets(t.spark, t.sf_dir))
    late = disposed.groupBy("boot_id").agg(F.count_if(F.col("sequence_disposition") == "LATE").alias("late_packet_count"))
    return sequence.sequence_state(disposed).join(late, "boot_id").drop("payload_id", "last_high_water_packet_id")


@query
def sequence_decision(t):
    fresh = t.outcome().where(F.col("request_state") == "NEW")
    return sequence.sequence_decision(
        fresh, sequence.sequence_disposition(t.accepted(), settled=True)
    )


@query
def missing_ranges(t):
    return sequence.missing_ranges(sequence.sequence_disposition(t.accepted(), settled=True))


@query
def legacy_sequence_gap(t):
    return legacy.sequence_gaps(t.legacy_packets()).drop("received_ns")


@query
def command_status(t):
    validated = _accepted_commands(t)
    return commands.latest_status(validated, sample.command_events(validated, _acks(t)))


@query
def packet_timeline(t):
    return audit.packet_timeline(t.audit())


# -- lists and sets ------------------------------------------------------------


@query
def latest_telemetry(t):
    return topk.latest_samples(t.health_samples(), 500)


@query
def latest_alerts(t):
    return topk.latest_alerts(legacy.alerts(t.health_samples()), 500)


@query
def latest_audit(t):
    return topk.latest_audit(t.audit().drop("event_data"), 1000)


@query
def pending_jobs(t):
    return jobs.pending_jobs(t.job_status(backlog=True), AS_OF_US, 1000).select(
        "job_id", "state", "created_us", "next_attempt_us"
    )


@query
def recoverable_jobs(t):
    return jobs.recoverable_jobs(t.job_status(backlog=True), AS_OF_US, 10000).select(
        "job_id", "state", "created_us", "next_attempt_us"
    )


@query
def operator_feed(t):
    samples = t.health_samples()
    feed = legacy.operator_feed(
        samples, legacy.alerts(samples), sample.advisories(t.spark, t.sf_dir)
    )
    return feed.select(
        "subject", "packet_no",
        F.coalesce(
            F.get_json_object("payload", "$.parameter"),
            F.get_json_object("payload", "$.violations[0].parameter"),
        ).alias("parameter"),
        F.get_json_object("payload", "$.severity").alias("severity"),
        F.get_json_object("payload", "$.data.wheel_rpm").cast("bigint").alias("wheel_rpm"),
    )


@query
def legacy_processed(t):
    return legacy.processed_stream(t.health_samples()).select(
        "packet_no", "sequence_count",
        F.size("violations").alias("violation_count"),
        F.array_join(
            F.transform("violations", lambda v: F.concat_ws(":", v.parameter, v.severity)), "|"
        ).alias("violations"),
    )


# -- rates and alerts ----------------------------------------------------------


@query
def frame_rate(t):
    return metrics.frame_rate(t.health_samples())


@query
def gap_increase(t):
    return metrics.gap_increase(legacy.sequence_gaps(t.legacy_packets()).where("gap > 0"))


@query
def alert_increase(t):
    return metrics.alert_increase(legacy.alerts(t.health_samples()))


@query
def telemetry_series(t):
    return metrics.telemetry_series(t.health_samples())


@query
def alert_rules(t):
    samples = t.health_samples()
    return metrics.alert_rules(
        samples, legacy.sequence_gaps(t.legacy_packets()), legacy.alerts(samples), AS_OF_US
    )


# -- whole-path queries --------------------------------------------------------


@query
def session_health(t):
    """Which sessions lost packets, and how healthy are they?"""
    packets = settle(identity.unique_packets(identity.identify(t.deliveries())), "packets")
    state = sequence.sequence_state(sequence.sequence_disposition(packets, settled=True))
    graded = health.assess_health(packets).groupBy("payload_id", "boot_id").agg(
        *(
            F.count_if(F.col("classification") == name).alias(f"{name.lower()}_packets")
            for name in health.CLASSES
        ),
        F.count_if(F.col("freshness") == "STALE").alias("stale_packets"),
    )
    return state.join(graded, ["payload_id", "boot_id"])


@query
def codec_round_trip(t):
    """Encode, decode and validate one legacy health packet per line item, then
    compare what came back."""
    line = t.spark.read.parquet(f"{t.sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").cast("bigint").alias("k"),
        F.col("l_linenumber").cast("bigint").alias("n"),
        (F.col("l_partkey").cast("bigint") % 30000).alias("mv"),
    )
    body = legacy_wire.health_body(
        (F.col("k") * 8 + F.col("n")) % 16384,
        F.lit(wire.PROJECT_EPOCH_US * 1000) + F.col("k") * 1000 + F.col("n"),
        F.col("mv") / 1000.0,
        (F.col("mv") - 15000) / 100.0,
        F.col("mv") * 3 - 45000,
        F.col("n") % 4,
        F.lit(0),
    )
    decoded = legacy_wire.decode_packets(wire.with_crc(line, body, "raw_packet"))
    back = legacy.sound(decoded).withColumns(legacy_wire.health_fields())
    return back.agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("sequence_count").alias("sum_count"),
        F.sum(F.col("timestamp_ns") - wire.PROJECT_EPOCH_US * 1000).alias("sum_ns"),
        F.sum(F.rint(F.col("bus_voltage_v") * 1000).cast("bigint")).alias("sum_mv"),
        F.sum(F.rint(F.col("battery_temp_c") * 100).cast("bigint")).alias("sum_centi_c"),
        F.sum("wheel_rpm").alias("sum_rpm"),
        F.sum("mode").alias("sum_mode"),
    )


# -- version 1 commands and acknowledgements -----------------------------------


@query
def command_frame_v1(t):
    decoded = command_wire.decode_commands(t.command_frames_v1())
    return decoded.withColumn(
        "clock_rejection",
        F.when(
            F.col("frame_rejection").isNull(),
            command_wire.clock_rejection("issued_us", "expires_us", "at_us"),
        ),
    ).drop("raw_command", "at_us")


@query
def ack_frame_v1(t):
    return command_wire.decode_acks(t.ack_deliveries()).drop("raw_ack")


def _identified_acks(t):
    decoded = command_wire.decode_acks(t.ack_deliveries())
    return command_history_.ack_identity(decoded)


@query
def ack_identity(t):
    return _identified_acks(t).select("delivery_id", "ack_state", "origin_delivery_id")


@query
def ack_sequence(t):
    return sequence.sequence_disposition(_identified_acks(t).where("ack_state = 'ACK'"))


@query
def ack_correlation(t):
    saved = command_sample.issued_commands(t.spark, t.sf_dir)
    unique = _identified_acks(t).where("ack_state = 'ACK'")
    return command_history_.correlate_acks(unique, saved).select(
        "delivery_id", "command_id", "correlation",
        command_wire.ack_name("ack_type").alias("ack_name"),
        command_wire.reason_name("reason_code").alias("reason"),
    )


@query
def command_history(t):
    events = t.state_events()
    return command_history_.command_history(events)


@query
def illegal_transitions(t):
    events = t.state_events()
    history = command_history_.command_history(events)
    return command_history_.illegal_events(events, history)


@query
def command_deadlines(t):
    history = command_history_.command_history(t.state_events())
    saved = command_sample.issued_commands(t.spark, t.sf_dir)
    return command_history_.missed_deadlines(history, saved, AS_OF_US)


@query
def operator_idempotency(t):
    requests = t.operator_requests()
    return command_history_.operator_idempotency(requests).select(
        "request_no", "intent", "first_request_no"
    )


# -- stream --------------------------------------------------------------------


@query
def delivery_stream(t):
    """The delivery stream over everything that has landed, run until it is
    caught up; the result is read back from the stream's own sink."""
    out = t.scratch("delivery-stream")
    columns = [
        "delivery_id", "request_state", "first_delivery_id", "packet_state", "origin_delivery_id",
        "validation_status", "rejection_reason", "sequence_disposition", "missing_before",
    ]

    def sink(batch, batch_id):
        batch.select(*columns).write.mode("overwrite").parquet(f"{out}/rows/batch_id={batch_id}")

    source = arrivals.read_stream(t.spark, t.arrivals(), f"{out}/checkpoint", 8)
    arrivals.run_caught_up(ledger.delivery_stream(source), sink, f"{out}/checkpoint", ledger.state_partitions(t.spark))
    return t.spark.read.parquet(f"{out}/rows").select(*columns)


@query
def ledger_load(t):
    """Two loads, split in the middle of the month: the second meets the first
    through the stored outcome only."""
    middle = sample.SHIFT_US + 1705363200000000  # 2024-01-16 before the shift
    arrived = t.deliveries()
    early = arrived.where(F.col("received_us") < middle)
    first = settle(identity.delivery_outcome(identity.identify(early)), "first_load")
    second = load.load_outcome(arrived.where(F.col("received_us") >= middle), first)
    columns = ["delivery_id", "is_replay", "validation_status", "rejection_reason", "response_code",
               "origin_delivery_id"]
    return first.select(*columns).unionByName(second.select(*columns))


def _oversize(t):
    """Copies of every 301st event's first delivery with a body over the evidence cap."""
    first = t.deliveries().where("delivery_id % 8 = 0 and (delivery_id div 8) % 301 = 0")
    return first.select(
        (F.col("delivery_id") + 7).alias("delivery_id"), "received_us", F.lit(None).cast("string").alias("request_id"), "content_type",
        F.repeat(F.lit("x"), 1025).cast("binary").alias("raw_body"),
    )


def _by_load(t, arrived, slot):
    """What arrived, in a folder per load: a load reads its own rows, however many others have landed."""
    path, placed = t.scratch("arrived"), arrived.withColumn("slot", slot)
    placed.write.option("compression", "zstd").partitionBy("slot").parquet(path)
    return t.spark.read.schema(placed.schema).parquet(path)


@query
def ledger_loads(t):
    """Four loads by receipt time, one of them tried again, each published whole:
    the audit history that the ledger holds afterwards."""
    stored = loads.Ledger(t.spark, t.scratch("ledger"))
    edges = [sample.SHIFT_US + (1704067200 + 604800 * k) * 1000000 for k in range(1, 4)]  # weeks of January before the shift
    arrived = _by_load(t, t.deliveries().unionByName(_oversize(t)), sum((F.col("received_us") >= edge).cast("int") for edge in edges))

    def worker(packets):
        work = sample.jobs(packets.withColumnRenamed("source_receipt_id", "delivery_id"))
        attempts = sample.attempts(work)
        return attempts, jobs.job_status(work, attempts)

    for number in (0, 1, 1, 2, 3):
        stored.load(number, arrived.where(F.col("slot") == number).drop("slot"), worker)
    return stored.table("audit").drop("event_data", "load")
