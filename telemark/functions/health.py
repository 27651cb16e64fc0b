"""Health and freshness classes of a version 1 sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions.wire import FAULT_NAMES, MODE_NAMES, col_of

# Fixed values of the interface contract.
STALE_AFTER_US = 86400000000
PROCESSOR_VERSION = "telemetry-v1"
DEFINED_FAULT_MASK = 0x3F
CRITICAL_FAULT_MASK = 0x38
WARNING_FAULT_MASK = 0x07
CLASSES = ("NOMINAL", "WARNING", "CRITICAL")


def _grade(critical: Column, warning: Column) -> Column:
    return F.when(critical, "CRITICAL").when(warning, "WARNING").otherwise("NOMINAL")


def temperature_class(centi_c: Column | str) -> Column:
    t = col_of(centi_c)
    return F.when(
        t.isNotNull(), _grade((t < -4000) | (t >= 8500), (t < -2000) | (t >= 6200))
    )


def voltage_class(mv: Column | str) -> Column:
    v = col_of(mv)
    return F.when(
        v.isNotNull(), _grade((v < 22000) | (v > 34000), (v < 26000) | (v > 30000))
    )


def fault_class(flags: Column | str) -> Column:
    """NULL when a bit outside the defined set is up; such rows are quarantined."""
    f = col_of(flags)
    known = f.between(0, DEFINED_FAULT_MASK)
    return F.when(
        known,
        _grade(
            f.bitwiseAND(F.lit(CRITICAL_FAULT_MASK)) != 0,
            f.bitwiseAND(F.lit(WARNING_FAULT_MASK)) != 0,
        ),
    )


def freshness(timestamp_us: Column | str, received_us: Column | str) -> Column:
    sample = col_of(timestamp_us)
    # an unsigned wire time of 2^63 or more reads negative and lies ahead
    age = F.when(sample >= 0, col_of(received_us) - sample)
    return F.when(age > STALE_AFTER_US, "STALE").otherwise("CURRENT")


def most_severe(*classes: Column) -> Column:
    """Highest class; NULL if any component is NULL."""
    known = F.lit(True)
    for c in classes:
        known = known & c.isNotNull()
    rank = F.greatest(*(F.array_position(F.array(*map(F.lit, CLASSES)), c) for c in classes))
    return F.when(known, F.element_at(F.array(*map(F.lit, CLASSES)), rank.cast("int")))


def mode_name(mode: Column | str) -> Column:
    m = col_of(mode)
    return F.when(
        m.between(0, len(MODE_NAMES) - 1),
        F.element_at(F.array(*map(F.lit, MODE_NAMES)), (m + 1).cast("int")),
    )


def fault_names(flags: Column | str) -> Column:
    """Names of the bits that are up, ascending by bit."""
    f = col_of(flags)
    up = F.array_compact(
        F.array(*(F.when(f.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for bit, name in FAULT_NAMES))
    )
    return F.when(f.isNotNull(), up)


def celsius(centi_c: Column | str) -> Column:
    return col_of(centi_c) / F.lit(100.0)


def volts(mv: Column | str) -> Column:
    return col_of(mv) / F.lit(1000.0)


def assess_health(df: DataFrame) -> DataFrame:
    """Add the three component classes, their combination and the freshness."""
    parts = {
        "temperature_class": temperature_class("temperature_centi_c"),
        "voltage_class": voltage_class("voltage_mv"),
        "fault_class": fault_class("fault_flags"),
        "freshness": freshness("timestamp_us", "received_us"),
    }
    return df.withColumns(parts).withColumn(
        "classification",
        most_severe(F.col("temperature_class"), F.col("voltage_class"), F.col("fault_class")),
    )


def processed_columns() -> list[Column]:
    """The processed-result projection over decoded, valid frames."""
    return [
        celsius("temperature_centi_c").alias("temperature_c"),
        volts("voltage_mv").alias("voltage_v"),
        mode_name("operating_mode").alias("operating_mode"),
        fault_names("fault_flags").alias("fault_names"),
        most_severe(
            temperature_class("temperature_centi_c"),
            voltage_class("voltage_mv"),
            fault_class("fault_flags"),
        ).alias("classification"),
        (freshness("timestamp_us", "received_us") == "STALE").alias("is_stale"),
        F.lit(PROCESSOR_VERSION).alias("processor_version"),
    ]
