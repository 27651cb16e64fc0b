"""Work status, views, stored results, reports and alert rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from telemark.operators import audit, jobs, legacy, metrics, quality, results, topk
from telemark.plans.catalog import QUERIES
from telemark.plans.oracle import ORACLES


def log(spark, rows):
    return spark.createDataFrame(
        rows, "job_id string, packet_id string, attempt_no int, ended_us bigint, outcome string, "
        "error string, max_attempts int")


def status(spark, names, rows, queued=True, **options):
    table = spark.createDataFrame(
        [(n, f"P-{n}", 0, 1 if queued else None, 2) for n in names],
        "job_id string, packet_id string, created_us bigint, queued_us bigint, max_attempts int")
    return {r.job_id: r for r in jobs.job_status(table, log(spark, rows), **options).collect()}


def test_retry_then_failed(spark):
    step = lambda n, o: ("J", "P-J", n, n * 10_000_000, o, "OSError: x", 2)
    one = status(spark, ["J"], [step(1, "temporary")])["J"]
    assert (one.state, one.next_attempt_us, one.attempt_count) == ("RETRY_WAIT", 11_000_000, 1)
    two = status(spark, ["J"], [step(1, "temporary"), step(2, "temporary")])["J"]
    assert (two.state, two.failed_us, two.next_attempt_us) == ("FAILED", 20_000_000, None)
    assert status(spark, ["J"], [step(1, "permanent")])["J"].state == "FAILED"
    done = status(spark, ["J"], [step(1, "temporary"), step(2, "success")])["J"]
    assert (done.state, done.last_error, done.queue_status) == ("COMPLETE", None, "QUEUED")
    assert status(spark, ["J"], [step(1, "claimed")])["J"].lease_expires_us == 10_000_000
    assert status(spark, ["J"], [], queued=False)["J"].queue_status == "PENDING_QUEUE"


def test_backoff_is_bounded(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 9, 10, 60)], "n int")
    assert [r[0] for r in df.select(jobs.backoff_seconds(F.col("n"))).collect()] == [1, 2, 4, 256, 300, 300]
    with pytest.raises(ValueError):
        jobs.backoff_seconds(F.col("n"), 0)


def test_backlog_lists(spark):
    df = spark.createDataFrame(
        [("a", "PENDING_QUEUE", 3, None, None), ("b", "RETRY_WAIT", 1, 5, None), ("c", "RETRY_WAIT", 2, 50, None),
         ("d", "QUEUED", 4, None, None), ("e", "PROCESSING", 5, None, 9), ("f", "COMPLETE", 6, None, None)],
        "job_id string, state string, created_us bigint, next_attempt_us bigint, lease_expires_us bigint")
    assert [r.job_id for r in jobs.pending_jobs(df, 10).collect()] == ["b", "a"]
    assert [r.job_id for r in jobs.recoverable_jobs(df, 10).collect()] == ["b", "a", "d"]
    assert sorted(r.job_id for r in df.where(jobs.is_claimable(10)).collect()) == ["b", "d", "e"]
    assert jobs.queue_depth(df).first()[0] == 5
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            jobs.pending_jobs(df, 10, bad)
    with pytest.raises(ValueError):
        topk.latest_alerts(df, 501)


def result_row(pid, classification="NOMINAL", faults=()):
    return (pid, 1.0, 28.0, "SAFE", list(faults), classification, False, "telemetry-v1")


RESULT = ("packet_id string, temperature_c double, voltage_v double, operating_mode string, "
          "fault_names array<string>, classification string, is_stale boolean, processor_version string")


def test_results_are_stored_once(spark):
    stored = spark.createDataFrame([result_row("a"), result_row("b", "WARNING")], RESULT)
    again = spark.createDataFrame([result_row("a"), result_row("b"), result_row("c", faults=["X"])], RESULT)
    assert [r.packet_id for r in results.result_conflicts(again, stored).collect()] == ["b"]
    table = {r.packet_id: r.classification for r in results.upsert_results(again, stored).collect()}
    assert table == {"a": "NOMINAL", "b": "WARNING", "c": "NOMINAL"}
    twice = results.upsert_results(again, results.upsert_results(again, stored))
    assert twice.count() == 3


def test_processed_view_without_job_is_unknown(spark):
    packets = spark.createDataFrame([("a",), ("b",), ("c",)], "packet_id string")
    done = spark.createDataFrame([(*result_row("a"), 0)], RESULT + ", processed_us bigint")
    work = spark.createDataFrame([("a", "COMPLETE"), ("b", "FAILED")], "packet_id string, state string")
    rows = {r.message_id: r for r in results.processed_view(packets, done, work).collect()}
    assert [(rows[k].processing_state, rows[k].response_code) for k in "abc"] == [
        (None, 200), ("FAILED", 422), ("UNKNOWN", 202)]


def test_point_lookup_prunes_and_checks_the_id(spark, tables):
    packets = tables.packets()
    some = packets.first().packet_id
    found = results.lookup(packets, "packet_id", some)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(packet_id" in plan
    assert results.lookup(packets, "packet_id", some.lower()).count() == 0


def test_counters_default_to_zero(spark, tables):
    none = lambda df: df.limit(0)
    rows = metrics.service_counters(
        none(tables.outcome()), none(tables.disposed()), none(tables.attempts()),
        none(tables.processed()), none(tables.boundary())).collect()
    assert {r.counter: r.value for r in rows} == dict.fromkeys(metrics.COUNTERS, 0)


def test_constraint_rules_find_broken_rows(spark):
    states = spark.createDataFrame([(-1, 0, 0), (2**32, -1, 0), (5, 1, 1)],
        "high_water_sequence bigint, accepted_packet_count bigint, missing_packet_count bigint")
    got = {r.rule: r.violations for r in quality.constraint_report({"sequence_states": states}).collect()}
    assert got == {"high_water_u32": 2, "accepted_nonnegative": 1, "missing_nonnegative": 0}


def test_state_conflict_event(spark):
    loaded = spark.createDataFrame([(1, 5, "SEQUENCE_STATE_CONFLICT"), (2, 6, None)],
        "delivery_id bigint, received_us bigint, state_conflict string")
    rows = audit.state_conflict_events(loaded).collect()
    assert [(r.event_name, r.receipt_id) for r in rows] == [("telemetry.sequence.state_conflict", 1)]


def test_event_names_are_all_known(tables):
    names = {r.event_name for r in tables.audit().select("event_name").distinct().collect()}
    assert names == set(audit.EVENT_NAMES) - {"telemetry.sequence.state_conflict"}


def test_alert_rules(spark):
    second = 1_000_000_000
    samples = spark.createDataFrame([(s * second,) for s in (0, 3, 100, 400)], "received_ns bigint")
    gaps = spark.createDataFrame([(7 * second, 100, 2), (200 * second, 100, 1), (900 * second, 100, 1), (1, 100, 0)],
        "received_ns bigint, apid bigint, gap bigint")
    alerts = spark.createDataFrame([(1 * second, "CRITICAL", "p"), (61 * second, "CRITICAL", "p"), (500 * second, "WARNING", "p")],
        "created_ns bigint, severity string, parameter string")
    got = sorted((r.rule, r.start_us // 1000000, r.end_us // 1000000) for r in metrics.alert_rules(samples, gaps, alerts).collect())
    assert got == [
        ("CriticalVehicleLimit", 5, 125), ("TelemetrySequenceGap", 10, 500), ("TelemetrySequenceGap", 900, 1200),
        ("TelemetryStopped", 95, 100), ("TelemetryStopped", 190, 400)]

    def running(as_of):
        rows = metrics.alert_rules(samples, gaps, alerts, as_of * 1000000).where("end_us is null")
        return [(r.rule, r.start_us // 1000000) for r in rows.collect()]

    assert running(489) == []
    assert running(490) == [("TelemetryStopped", 490)]


def test_latency_never_below_zero(spark):
    df = spark.createDataFrame([(1000, 5000), (9_000_000, 0), (5, -2**63)], "received_ns bigint, timestamp_ns bigint")
    rows = {r.le_ms: r for r in metrics.latency_histogram(df).collect()}
    assert (rows["5"].cumulative, rows["10"].cumulative, rows["+Inf"].cumulative) == (2, 3, 3)
    assert rows["5"].total_ns == 9_000_000


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
