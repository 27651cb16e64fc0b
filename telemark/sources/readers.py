"""Batch and stream readers of the landing tables, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemark.sources.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def stream_table(
    spark: SparkSession, root: str, name: str, files_per_trigger: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(TABLES[name])
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(f"{root}/{name}")
    )


def deliveries_from_messages(messages: DataFrame) -> DataFrame:
    """Deliveries from a message source with binary ``value``, ``timestamp``,
    ``partition``, ``offset`` and text headers, such as a Kafka topic.

    The id packs partition and offset, so it is unique and ascends within a
    partition.
    """
    headers = F.map_from_entries(
        F.transform(
            "headers", lambda h: F.struct(F.lower(h["key"]), h["value"].cast("string"))
        )
    )
    return messages.select(
        (F.shiftleft(F.col("partition").cast("bigint"), 48).bitwiseOR(F.col("offset"))).alias(
            "delivery_id"
        ),
        F.unix_micros("timestamp").alias("received_us"),
        headers["x-request-id"].alias("request_id"),
        headers["content-type"].alias("content_type"),
        F.col("value").alias("raw_body"),
    )
