"""Bounded newest-first and oldest-first lists (TakeOrderedAndProject)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_limit(df: DataFrame, order: list[Column], limit: int, maximum: int) -> DataFrame:
    if not 1 <= limit <= maximum:
        raise ValueError(f"limit must be between 1 and {maximum}")
    return df.orderBy(*order).limit(limit)


def latest_samples(samples: DataFrame, limit: int = 20) -> DataFrame:
    return bounded_limit(
        samples.select(
            "received_ns", "packet_no", "timestamp_ns", "sequence_count", "bus_voltage_v",
            "battery_temp_c", "wheel_rpm", "mode", "fault_flags",
        ),
        [F.desc("received_ns"), F.desc("packet_no")], limit, 500,
    )


def latest_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    return bounded_limit(
        alerts, [F.desc("created_ns"), F.desc("packet_no"), F.asc("parameter")], limit, 500
    )


def latest_audit(events: DataFrame, limit: int = 100) -> DataFrame:
    return bounded_limit(events, [F.desc("occurred_us"), F.desc("event_id")], limit, 1000)
