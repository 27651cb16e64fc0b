"""Append sinks of the stored tables.

Tables are partitioned by receipt date, so that date filters prune folders, and
sorted by their lookup key within files, so that point reads skip row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemark.functions.wire import whole_div
from telemark.session import settle

# Table name: time column in micro- or nanoseconds, lookup key.
STORED = {
    "receipts": ("received_us", ("receipt_id",)),
    "quarantine": ("received_us", ("receipt_id",)),
    "packets": ("received_us", ("packet_id",)),
    "processed": ("processed_us", ("packet_id",)),
    "audit": ("occurred_us", ("event_id",)),
    "health_samples": ("received_ns", ("apid", "source", "sequence_count", "received_ns")),
    "alerts": ("created_ns", ("packet_no", "parameter", "severity")),
}


def _receipt_date(time_column: str) -> Column:
    at = whole_div(time_column, 1000) if time_column.endswith("_ns") else F.col(time_column)
    return F.to_date(F.timestamp_micros(at))


def append_table(df: DataFrame, root: str, name: str) -> None:
    """Rows are placed by date and key before the write, so a task meets few dates
    and the number of files follows the size of the load, not tasks times dates."""
    time_column, key = STORED[name]
    dated = df.withColumn("receipt_date", _receipt_date(time_column))
    (
        dated.repartitionByRange("receipt_date", *key)
        .sortWithinPartitions("receipt_date", *key)
        .write.mode("append")
        .partitionBy("receipt_date")
        .parquet(f"{root}/{name}")
    )


def append_new(df: DataFrame, root: str, name: str) -> None:
    """Append rows whose key is not stored yet; a repeated load adds nothing, and
    of rows that share a key within the load only the earliest is taken. NULL key
    parts equal each other, within a load and against what is stored.

    A load that fails part way leaves no rows: the write commits as a whole.
    Where the key holds the time, only the stored dates of the load are read.
    The load is computed once, however many times it is read here.
    """
    time_column, key = STORED[name]
    spark = df.sparkSession
    path = f"{root}/{name}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    order = Window.partitionBy(*key).orderBy(time_column)
    df = settle(df.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth"), "load")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        stored = spark.read.parquet(path)
        if time_column in key:
            low, high = df.agg(F.min(_receipt_date(time_column)), F.max(_receipt_date(time_column))).first()
            stored = stored.where(F.col("receipt_date").between(F.lit(low), F.lit(high)))
        stored = stored.select(*(F.col(k).alias(f"_{k}") for k in key))
        df = df.join(stored, [df[k].eqNullSafe(stored[f"_{k}"]) for k in key], "left_anti")
    append_table(df, root, name)
