from __future__ import annotations

from pyspark.sql import functions as F

from telemark.functions import health

LETTER = {"N": "NOMINAL", "W": "WARNING", "C": "CRITICAL", None: None}


def classes(spark, function, pairs):
    df = spark.createDataFrame([(v,) for v, _ in pairs], "v bigint")
    got = {r.v: r.c for r in df.select("v", function("v").alias("c")).collect()}
    assert got == {v: LETTER[want] for v, want in pairs}


def test_temperature(spark):
    classes(spark, health.temperature_class, [
        (-4001, "C"), (-4000, "W"), (-2001, "W"), (-2000, "N"), (6199, "N"), (6200, "W"),
        (8499, "W"), (8500, "C"), (None, None)])


def test_voltage(spark):
    classes(spark, health.voltage_class, [
        (21999, "C"), (22000, "W"), (25999, "W"), (26000, "N"), (30000, "N"), (30001, "W"),
        (34000, "W"), (34001, "C")])


def test_faults(spark):
    classes(spark, health.fault_class, [
        (0, "N"), (0x01, "W"), (0x06, "W"), (0x08, "C"), (0x21, "C"), (0x40, None), (0x80, None)])


def test_combined_and_freshness(spark):
    day = health.STALE_AFTER_US
    df = spark.createDataFrame(
        [(6200, 28000, 0x20, 0, day), (2000, 28000, 0, 0, day + 1), (2000, 28000, 0x40, 0, 0),
         (2000, 28000, 0, -1, 2**62)],
        "temperature_centi_c bigint, voltage_mv bigint, fault_flags bigint, timestamp_us bigint, "
        "received_us bigint",
    )
    rows = health.assess_health(df).collect()
    assert (rows[0].temperature_class, rows[0].voltage_class, rows[0].fault_class) == (
        "WARNING", "NOMINAL", "CRITICAL")
    assert [(r.classification, r.freshness) for r in rows] == [
        ("CRITICAL", "CURRENT"), ("NOMINAL", "STALE"), (None, "CURRENT"), ("NOMINAL", "CURRENT")]


def test_names(spark):
    row = spark.range(1).select(
        health.fault_names(F.lit(0x22)), health.mode_name(F.lit(3)), health.mode_name(F.lit(4)),
        health.celsius(F.lit(2840)), health.volts(F.lit(28100)),
    ).first()
    assert tuple(row) == (["UNDER_VOLTAGE", "INTERNAL_PAYLOAD_FAULT"], "CALIBRATION", None, 28.4, 28.1)
