"""Counters, histogram, rates, panels and alert rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemark.functions.wire import whole_div

# Fixed counter names.
COUNTERS = (
    "payload_messages_received_total",
    "payload_messages_rejected_total",
    "payload_duplicate_messages_total",
    "payload_sequence_gaps_total",
    "payload_processing_successes_total",
    "payload_processing_failures_total",
    "payload_stale_results_total",
    "vendor_authentication_failures_total",
    "database_errors_total",
)
# Fixed histogram bounds in milliseconds; the last bucket is unbounded.
LATENCY_BOUNDS_MS = (5, 10, 25, 50, 75, 100, 250, 500, 750, 1000, 2500, 5000, 7500, 10000)
SECOND_US = 1000000
# Fixed alerting times: evaluation step, rate window, hold, increase windows.
STEP_S, RATE_WINDOW_S, HOLD_S = 5, 60, 30
GAP_WINDOW_S, CRITICAL_WINDOW_S = 300, 60


def service_counters(
    outcome: DataFrame,
    disposed: DataFrame,
    attempts: DataFrame,
    processed: DataFrame,
    boundary: DataFrame,
    database_errors: DataFrame | None = None,
) -> DataFrame:
    """The fixed counters, zero where nothing happened.

    Every delivery counts as received, replays too. A replay of a rejected or
    conflicting delivery does not count as rejected again; a replay of a
    duplicate does count as a duplicate again.
    """
    replay = F.col("is_replay")
    refused = F.col("validation_status").isin("REJECTED", "CONFLICT")
    parts = [
        outcome.agg(
            F.count(F.lit(1)).alias(COUNTERS[0]),
            F.count_if(refused & ~replay).alias(COUNTERS[1]),
            F.count_if(F.col("packet_state") == "DUPLICATE").alias(COUNTERS[2]),
        ),
        disposed.agg(F.sum("missing_before").alias(COUNTERS[3])),
        attempts.agg(
            F.count_if(F.col("outcome") == "success").alias(COUNTERS[4]),
            F.count_if(F.col("outcome").isin("temporary", "permanent")).alias(COUNTERS[5]),
        ),
        processed.agg(F.count_if("is_stale").alias(COUNTERS[6])),
        boundary.agg(F.count_if(~F.col("token_ok")).alias(COUNTERS[7])),
    ]
    if database_errors is not None:
        parts.append(database_errors.agg(F.count(F.lit(1)).alias(COUNTERS[8])))
    rows = []
    for part in parts:
        pairs = [
            F.struct(
                F.lit(name).alias("counter"),
                F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias("value"),
            )
            for name in part.columns
        ]
        rows.append(part.select(F.inline(F.array(*pairs))))
    if database_errors is None:
        zero = F.struct(F.lit(COUNTERS[8]).alias("counter"), F.lit(0).cast("bigint").alias("value"))
        rows.append(outcome.sparkSession.range(1).select(F.inline(F.array(zero))))
    return reduce(DataFrame.unionByName, rows)


def status_breakdown(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("validation_status", "rejection_reason").agg(
        F.count(F.lit(1)).alias("receipts")
    )


def latency_histogram(samples: DataFrame) -> DataFrame:
    """Cumulative buckets, sum and count of receipt minus sample time, never
    below zero. One aggregate; the buckets are its columns turned to rows."""
    # an unsigned sample time of 2^63 or more reads negative and lies ahead
    sample = F.col("timestamp_ns")
    latency = F.when(sample < 0, F.lit(0)).otherwise(
        F.greatest(F.col("received_ns") - sample, F.lit(0))
    )
    aggregates = [
        F.count_if(latency <= bound * 1000000).alias(f"le_{bound}") for bound in LATENCY_BOUNDS_MS
    ]
    totals = samples.agg(
        *aggregates, F.count(F.lit(1)).alias("n"), F.sum(latency).alias("total_ns")
    )
    buckets = [
        F.struct(F.lit(str(bound)).alias("le_ms"), F.col(f"le_{bound}").alias("cumulative"))
        for bound in LATENCY_BOUNDS_MS
    ]
    buckets.append(F.struct(F.lit("+Inf").alias("le_ms"), F.col("n").alias("cumulative")))
    return totals.select(
        F.inline(F.array(*buckets)), F.col("n").alias("observations"), "total_ns"
    )


def frame_rate(samples: DataFrame, slide: str | None = None) -> DataFrame:
    """Accepted health packets per second over one-minute windows."""
    at = F.timestamp_micros(whole_div("received_ns", 1000))
    window = F.window(at, "1 minute", slide) if slide else F.window(at, "1 minute")
    return samples.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("frames")).select(
        F.unix_micros("w.start").alias("window_start_us"),
        "frames",
        (F.col("frames") / F.lit(60.0)).alias("frames_per_second"),
    )


def increase(
    events: DataFrame, at_ns: str, labels: list[str], amount: Column, width: str, slide: str
) -> DataFrame:
    """Counter increase over sliding windows."""
    at = F.timestamp_micros(whole_div(at_ns, 1000))
    return (
        events.groupBy(F.window(at, width, slide).alias("w"), *labels)
        .agg(F.sum(amount).alias("increase"))
        .select(F.unix_micros("w.start").alias("window_start_us"), *labels, "increase")
    )


def gap_increase(gaps: DataFrame) -> DataFrame:
    return increase(gaps, "received_ns", ["apid"], F.col("gap"), "5 minutes", "1 minute")


def alert_increase(alerts: DataFrame) -> DataFrame:
    return increase(
        alerts, "created_ns", ["severity"], F.lit(1).cast("bigint"), "5 minutes", "1 minute"
    )


def telemetry_series(samples: DataFrame) -> DataFrame:
    """Mean and last voltage and temperature per minute. The means come from
    integer wire units, so they do not depend on the order of addition."""
    at = F.timestamp_micros(whole_div("received_ns", 1000))
    order = F.struct("received_ns", "packet_no")
    mv = F.round(F.col("bus_voltage_v") * 1000).cast("bigint")
    centi = F.round(F.col("battery_temp_c") * 100).cast("bigint")
    n = F.count(F.lit(1))
    return (
        samples.groupBy(F.window(at, "1 minute").alias("w"))
        .agg(
            (F.sum(mv) / n / F.lit(1000.0)).alias("mean_bus_voltage_v"),
            (F.sum(centi) / n / F.lit(100.0)).alias("mean_battery_temp_c"),
            F.max_by("bus_voltage_v", order).alias("last_bus_voltage_v"),
            F.max_by("battery_temp_c", order).alias("last_battery_temp_c"),
        )
        .select(F.unix_micros("w.start").alias("window_start_us"), "mean_bus_voltage_v",
                "mean_battery_temp_c", "last_bus_voltage_v", "last_battery_temp_c")
    )


def _tick(at_ns: str) -> Column:
    """First evaluation tick at or after an event."""
    return whole_div(F.col(at_ns) + F.lit(STEP_S * 1000000000 - 1), STEP_S * 1000000000)


def _active_ticks(events: DataFrame, at_ns: str, rule: str, severity: str, label: Column) -> DataFrame:
    """Distinct ticks with activity per rule and label. The partial aggregate
    leaves at most one row per label and five seconds of calendar time, which
    bounds the ordered windows below however many events there are."""
    return events.groupBy(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        label.cast("string").alias("label"), _tick(at_ns).alias("tick"),
    ).agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def alert_rules(
    samples: DataFrame, gaps: DataFrame, alerts: DataFrame, as_of_us: int | None = None
) -> DataFrame:
    """Firing intervals [start, end) of the three rules.

    TelemetryStopped needs a rate of zero held for 30 s; with a one-minute rate
    window that is 90 s after the tick of the last frame. The other rules fire
    while their window holds any increase; overlapping windows are merged.

    With ``as_of_us``, telemetry that stopped for good and is still missing then
    gives a TelemetryStopped row without an end.
    """
    order = Window.partitionBy("rule", "severity", "label").orderBy("tick")
    quiet = RATE_WINDOW_S // STEP_S + HOLD_S // STEP_S
    frames = _active_ticks(samples, "received_ns", "TelemetryStopped", "critical", F.lit("health"))
    stopped = (
        frames.withColumn("_from", F.lag("tick").over(order) + quiet)
        .where(F.col("_from") < F.col("tick"))
        .select("rule", "severity", "label", F.col("_from").alias("start"), F.col("tick").alias("end"))
    )
    if as_of_us is not None:
        last = frames.groupBy("rule", "severity", "label").agg((F.max("tick") + quiet).alias("start"))
        running = last.where(F.col("start") * (STEP_S * SECOND_US) <= as_of_us)
        stopped = stopped.unionByName(running.withColumn("end", F.lit(None).cast("bigint")))

    def islands(ticks: DataFrame, width: int) -> DataFrame:
        opens = F.coalesce(F.col("tick") - F.lag("tick").over(order) > width, F.lit(True))
        numbered = ticks.withColumn("_opens", opens.cast("int")).withColumn(
            "_island", F.sum("_opens").over(order)
        )
        return numbered.groupBy("rule", "severity", "label", "_island").agg(
            F.min("tick").alias("start"), (F.max("tick") + width).alias("end")
        ).drop("_island")

    gap_ticks = _active_ticks(
        gaps.where("gap > 0"), "received_ns", "TelemetrySequenceGap", "warning", F.col("apid")
    )
    critical_ticks = _active_ticks(
        alerts.where(F.col("severity") == "CRITICAL"), "created_ns",
        "CriticalVehicleLimit", "critical", F.col("parameter"),
    )
    fired = stopped.unionByName(islands(gap_ticks, GAP_WINDOW_S // STEP_S)).unionByName(
        islands(critical_ticks, CRITICAL_WINDOW_S // STEP_S)
    )
    step_us = STEP_S * SECOND_US
    return fired.select(
        "rule", "severity", "label",
        (F.col("start") * step_us).alias("start_us"),
        (F.col("end") * step_us).alias("end_us"),
    )
