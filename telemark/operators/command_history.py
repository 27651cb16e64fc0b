"""Command evidence of the version 1 contract: acknowledgement identity and
correlation, state history, deadlines and operator idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemark.functions import command_wire as cw
from telemark.operators.identity import first_of_group
from telemark.operators.scale import BLOCK_ROWS, attach_group_facts, block_of

ACK_KEY = ["payload_id", "boot_id", "sequence_number"]

# Fixed state names and legal transitions.
STATES = (
    "CREATED", "VALIDATED", "QUEUED", "SENT", "RECEIVED", "ACCEPTED", "EXECUTED", "REJECTED",
    "TIMED_OUT", "UNKNOWN",
)
TRANSITIONS = {
    "CREATED": ("VALIDATED",),
    "VALIDATED": ("QUEUED",),
    "QUEUED": ("SENT",),
    "SENT": ("RECEIVED", "ACCEPTED", "EXECUTED", "REJECTED", "TIMED_OUT"),
    "RECEIVED": ("ACCEPTED", "EXECUTED", "REJECTED", "TIMED_OUT"),
    "ACCEPTED": ("EXECUTED", "REJECTED", "TIMED_OUT"),
    "TIMED_OUT": ("UNKNOWN",),
    "UNKNOWN": ("EXECUTED", "REJECTED"),
    "EXECUTED": (),
    "REJECTED": (),
}
# Fixed deadlines in seconds for the next evidence, by state and opcode.
DEADLINE_S = {"SENT": 5, "RECEIVED": 5}
ACCEPTED_DEADLINE_S = {cw.SET_PAYLOAD_MODE: 10, cw.RESET_PAYLOAD: 30, cw.REQUEST_STATUS: 5}


def ack_identity(acks: DataFrame) -> DataFrame:
    """Add ``ack_state`` ACK / DUPLICATE / ACK_SEQUENCE_CONFLICT to sound acks.

    ``acks`` is decoded and carries ``delivery_id``, ``received_us``, ``raw_ack``.
    """
    sound = acks.where(F.col("frame_rejection").isNull())
    repeated = first_of_group(sound, ACK_KEY, "raw_ack").where("n > 1")
    rows = attach_group_facts(sound, repeated, ACK_KEY, row_id="delivery_id")
    first = F.coalesce("fact.delivery_id", "delivery_id")
    return rows.withColumns(
        {
            "ack_state": F.when(first == F.col("delivery_id"), "ACK")
            .when(F.col("raw_ack") == F.col("fact.raw_ack"), "DUPLICATE")
            .otherwise("ACK_SEQUENCE_CONFLICT"),
            "origin_delivery_id": first,
        }
    ).drop("fact")


def correlate_acks(acks: DataFrame, commands: DataFrame) -> DataFrame:
    """Add ``correlation``: MATCHED, ORPHAN, or MISMATCHED when the payload or
    opcode is not the saved command's."""
    saved = commands.select(
        "command_id", F.struct("payload_id", "opcode").alias("_saved")
    )
    same = (F.col("_saved.payload_id") == F.col("payload_id")) & (
        F.col("_saved.opcode") == F.col("opcode")
    )
    return (
        acks.join(saved, "command_id", "left")
        .withColumn(
            "correlation",
            F.when(F.col("_saved").isNull(), "ORPHAN").when(same, "MATCHED").otherwise("MISMATCHED"),
        )
        .drop("_saved")
    )


def _next_state(state: Column, event: Column, aborted: Column) -> Column:
    """State after an event: the event's own name when legal, else unchanged.

    An aborted execution does not resolve UNKNOWN.
    """
    legal = F.lit(False)
    for source, targets in TRANSITIONS.items():
        if targets:
            legal = legal | ((state == source) & event.isin(*targets))
    unresolved = (state == "UNKNOWN") & (event == "REJECTED") & aborted
    return F.when(legal & ~unresolved, event).otherwise(state)


def command_history(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The legal transitions of each command, in receipt order.

    ``events`` holds ``command_id``, ``event_no`` (unique, ascending with ground
    receipt), ``at_us``, ``event`` (a state name) and ``reason``. A command is
    folded in blocks of ``event_no``: each block is a map over the ten states
    and the maps are chained. The state graph has no cycle, so at most nine
    blocks of a command move it; only those are run again from their entry
    state, and no command carries more than nine transitions.
    """
    blocks = (
        events.withColumn("block", block_of("event_no", block_rows))
        .groupBy("command_id", "block")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "event_no", "at_us", "event",
                        (F.coalesce("reason", F.lit("")) == "EXECUTION_ABORTED").alias("aborted"),
                    )
                )
            ).alias("events")
        )
    )
    step = lambda state, e: _next_state(state, e["event"], e["aborted"])
    ends = blocks.select(
        "command_id", "block",
        F.transform(
            F.array(*map(F.lit, STATES)), lambda s: F.aggregate("events", s, step)
        ).alias("ends"),
    )
    names = F.array(*map(F.lit, STATES))
    idle = F.array().cast("array<struct<block:bigint,entry:string>>")

    def chain(done: Column, m: Column) -> Column:
        """Keep the blocks in which the state moves, with their entry state."""
        state = done["state"]
        after = F.element_at(m["ends"], F.array_position(names, state).cast("int"))
        here = F.struct(m["block"].alias("block"), state.alias("entry"))
        return F.struct(
            after.alias("state"),
            F.when(after != state, F.concat(done["moving"], F.array(here)))
            .otherwise(done["moving"])
            .alias("moving"),
        )

    entries = (
        ends.groupBy("command_id")
        .agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("maps"))
        .select(
            "command_id",
            F.aggregate(
                "maps", F.struct(F.lit(STATES[0]).alias("state"), idle.alias("moving")), chain
            ).alias("chained"),
        )
        .select("command_id", F.inline("chained.moving"))
    )
    none = F.array().cast("array<struct<event_no:bigint,at_us:bigint,from_state:string,to_state:string>>")

    def walk(done: Column, e: Column) -> Column:
        state = done["state"]
        after = step(state, e)
        row = F.struct(
            e["event_no"].alias("event_no"), e["at_us"].alias("at_us"),
            state.alias("from_state"), after.alias("to_state"),
        )
        return F.struct(
            after.alias("state"),
            F.when(after != state, F.concat(done["path"], F.array(row)))
            .otherwise(done["path"])
            .alias("path"),
        )

    start = F.struct(F.col("entry").alias("state"), none.alias("path"))
    return (
        blocks.join(entries, ["command_id", "block"])
        .select("command_id", F.aggregate("events", start, walk).alias("walked"))
        .select("command_id", F.inline("walked.path"))
    )


def illegal_events(events: DataFrame, history: DataFrame) -> DataFrame:
    """Events that moved nothing: audit evidence. Event numbers are unique."""
    return events.join(history.select("event_no"), "event_no", "left_anti")


def missed_deadlines(history: DataFrame, commands: DataFrame, as_of_us: int) -> DataFrame:
    """States left waiting past their deadline, each with the TIMED_OUT and
    UNKNOWN rows it leads to. A command has at most nine transitions, so the
    window per command is bounded."""
    order = Window.partitionBy("command_id").orderBy("event_no")
    seconds = F.lit(None).cast("bigint")
    for state, allowed in DEADLINE_S.items():
        seconds = F.when(F.col("to_state") == state, F.lit(allowed)).otherwise(seconds)
    for opcode, allowed in ACCEPTED_DEADLINE_S.items():
        seconds = F.when(
            (F.col("to_state") == "ACCEPTED") & (F.col("opcode") == opcode), F.lit(allowed)
        ).otherwise(seconds)
    waited = (
        history.withColumn("next_us", F.lead("at_us").over(order))
        .join(commands.select("command_id", "opcode"), "command_id")
        .withColumn("deadline_us", F.col("at_us") + seconds * 1000000)
    )
    late = F.coalesce("next_us", F.lit(as_of_us)) > F.col("deadline_us")
    return waited.where(late).select(
        "command_id",
        F.col("to_state").alias("last_state"),
        "deadline_us",
        F.inline(
            F.array(
                F.struct(F.col("to_state").alias("from_state"), F.lit("TIMED_OUT").alias("to_state")),
                F.struct(F.lit("TIMED_OUT").alias("from_state"), F.lit("UNKNOWN").alias("to_state")),
            )
        ),
    )


def operator_idempotency(requests: DataFrame) -> DataFrame:
    """Add ``intent`` NEW / REPLAY / CONFLICT per (operator, idempotency key).

    Only payload, command name and the mode argument count: key order and
    spacing of the JSON arguments make no other command.
    """
    normal = requests.withColumn(
        "_command",
        F.concat_ws(
            "|", "payload_id", "name",
            F.coalesce(F.get_json_object("arguments", "$.mode"), F.lit("")),
        ),
    )
    keys = ["operator_id", "idempotency_key"]
    repeated = first_of_group(
        normal.withColumnRenamed("request_no", "delivery_id"), keys, "_command"
    ).where("n > 1")
    rows = attach_group_facts(normal, repeated, keys, row_id="request_no")
    first = F.coalesce("fact.delivery_id", "request_no")
    return rows.withColumns(
        {
            "intent": F.when(first == F.col("request_no"), "NEW")
            .when(F.col("_command") == F.col("fact._command"), "REPLAY")
            .otherwise("CONFLICT"),
            "first_request_no": first,
        }
    ).drop("fact", "_command")
