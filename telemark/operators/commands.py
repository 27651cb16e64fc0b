"""Command requests, their acknowledgements and their latest status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.functions.legacy_wire import COMMANDS


def _of_command(position: int) -> Column:
    """A column of the fixed allow-list, by command name."""
    value = F.lit(None).cast("bigint")
    for command in COMMANDS:
        value = F.when(F.col("name") == command[0], F.lit(command[position])).otherwise(value)
    return value


def validate_commands(requests: DataFrame) -> DataFrame:
    """Allow-list check and first status; map-only, the list is three literals."""
    reason = F.when(
        F.col("opcode").isNull(), F.concat(F.lit("unsupported command: "), "name")
    ).when(
        ~F.col("argument").between(_of_command(2), _of_command(3)),
        F.format_string(
            "argument %d outside [%d, %d] for %s",
            "argument", _of_command(2), _of_command(3), "name",
        ),
    )
    accepted = F.col("reason").isNull()
    return (
        requests.withColumn("opcode", _of_command(1))
        .withColumn("reason", reason)
        .withColumns(
            {
                "result": F.when(accepted, "accepted").otherwise("invalid"),
                "status": F.when(
                    accepted, F.when(F.col("dry_run"), "DRY_RUN_VALIDATED").otherwise("QUEUED")
                ),
            }
        )
    )


def ack_updates(acks: DataFrame, commands: DataFrame) -> DataFrame:
    """Acknowledgements of known commands and the status each one sets."""
    known = commands.select(F.col("id").alias("command_id"), "name")
    return acks.join(known, "command_id").select(
        "command_id",
        "name",
        "ack_no",
        F.when(F.col("status") == 0, "ACKED").otherwise("REJECTED").alias("new_status"),
        F.concat(F.lit("spacecraft applied_value="), F.col("applied_value").cast("string")).alias(
            "detail"
        ),
    )


def orphan_acks(acks: DataFrame, commands: DataFrame) -> DataFrame:
    return acks.join(
        commands.select(F.col("id").alias("command_id")), "command_id", "left_anti"
    )


def latest_status(commands: DataFrame, events: DataFrame) -> DataFrame:
    """Status after the last event of each command. The last update wins without
    any guard on the state before it."""
    last = events.groupBy("command_id").agg(
        F.max_by(F.struct("status", "detail", "at_us"), F.struct("at_us", "event_order")).alias("last")
    )
    return commands.join(last, F.col("id") == F.col("command_id"), "left").select(
        "id",
        "name",
        "argument",
        F.coalesce("last.status", "status").alias("status"),
        F.col("last.detail").alias("status_detail"),
        F.coalesce("last.at_us", "created_us").alias("updated_us"),
    )


def command_counters(validated: DataFrame, events: DataFrame, messages: DataFrame) -> DataFrame:
    """Requests by result and dry run, dispatches by result and name, processed
    messages by subject and result, in one long table."""
    count = F.count(F.lit(1)).alias("value")
    requests = validated.groupBy(
        F.col("result").alias("label_1"), F.col("dry_run").cast("string").alias("label_2")
    ).agg(count)
    names = validated.select(F.col("id").alias("command_id"), "name")
    dispatched = events.where(F.col("status").isin("DISPATCHED", "DISPATCH_ERROR")).join(
        names, "command_id"
    )
    sent = F.when(F.col("status") == "DISPATCHED", "sent").otherwise("error")
    dispatches = dispatched.groupBy(sent.alias("label_1"), F.col("name").alias("label_2")).agg(count)
    processed = messages.groupBy(
        F.col("subject").alias("label_1"), F.col("result").alias("label_2")
    ).agg(count)
    metric = "metric"
    return (
        requests.withColumn(metric, F.lit("mission_api_command_requests_total"))
        .unionByName(dispatches.withColumn(metric, F.lit("command_dispatch_total")))
        .unionByName(processed.withColumn(metric, F.lit("processor_messages_total")))
    )
