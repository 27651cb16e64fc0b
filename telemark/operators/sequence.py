"""Sequence disposition of accepted packets inside a (payload, boot) session.

The rule is a fold over arrival order: a packet advances the high-water mark H
when (S - H) mod 2^32 lies in 1 .. 2^31 - 1, otherwise it is late.

While a session spans less than 2^31, the fold has an equivalent that needs no
arrival-ordered pass: a packet is late exactly when some packet with a larger
sequence number arrived before it, and H is the next lower packet that is not
late. Both look along the *sequence* axis, where numbers are unique, so fixed
blocks of it hold a bounded number of rows however large the session is (at
most 16,384 blocks of 2^18). Each block needs two carries: the earliest arrival
in higher blocks and the last advancing number in lower blocks.

Sessions that do span 2^31 or more take the exact fold in slices of arrival
order. What a slice does to any entering H is an interval map; the maps are
composed in a tree (``interval_maps``), which gives every slice its H.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemark.functions import wire
from telemark.operators import interval_maps
from telemark.operators.scale import UNBOUNDED, block_of, ranged_slices
from telemark.session import settle

SESSION = ["payload_id", "boot_id"]
BLOCK_NUMBERS = 1 << 18
# Receipt time of the row that stands for a stored mark.
SEED_US = -(1 << 62)
STATE_CONFLICT = "SEQUENCE_STATE_CONFLICT"
MODULUS, HALF_RANGE = interval_maps.MODULUS, interval_maps.HALF_RANGE
# Rows of a wide session's slice.
SLICE_ROWS = 1 << 17
KEPT = [*SESSION, "sequence_number", "received_us", "delivery_id"]


def _blocks(rows: DataFrame) -> DataFrame:
    """Per session and block: earliest arrival, lowest and highest number."""
    return rows.groupBy(*SESSION, "block").agg(
        F.min(F.struct("received_us", "delivery_id")).alias("earliest"),
        F.min("sequence_number").alias("lowest"),
        F.max("sequence_number").alias("highest"),
    )


def _block_carries(blocks: DataFrame) -> DataFrame:
    session = Window.partitionBy(*SESSION)
    higher = session.orderBy(F.col("block").desc()).rowsBetween(UNBOUNDED, -1)
    span = F.max("highest").over(session) - F.min("lowest").over(session)
    return blocks.select(
        *SESSION, "block",
        F.min("earliest").over(higher).alias("earliest_above"),
        (span >= HALF_RANGE).alias("is_wide"),
    )


def _narrow_disposition(rows: DataFrame, carries: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Rows of sessions spanning less than 2^31."""
    block = Window.partitionBy(*SESSION, "block")
    above = block.orderBy(F.col("sequence_number").desc()).rowsBetween(UNBOUNDED, -1)
    below = block.orderBy("sequence_number").rowsBetween(UNBOUNDED, -1)
    here = F.struct("received_us", "delivery_id")
    earliest_later = F.least(F.min(here).over(above), F.col("earliest_above"))
    marked = (
        rows.join(carries.where(~F.col("is_wide")), [*SESSION, "block"])
        .withColumn("is_late", F.coalesce(earliest_later < here, F.lit(False)))
        .withColumn("advancing", F.when(~F.col("is_late"), F.col("sequence_number")))
    )
    lower = Window.partitionBy(*SESSION).orderBy("block").rowsBetween(UNBOUNDED, -1)
    highest_below = (
        marked.groupBy(*SESSION, "block")
        .agg(F.max("advancing").alias("top"))
        .select(*SESSION, "block", F.max("top").over(lower).alias("top_below"))
    )
    return (
        marked.withColumn("_local", F.max("advancing").over(below))
        .join(highest_below, [*SESSION, "block"])
        .select(
            *KEPT,
            F.when(~F.col("is_late"), F.coalesce("_local", "top_below")).alias("high_water_before"),
            "is_late",
            *carried,
        )
    )


# -- exact fold for wide sessions --------------------------------------------


def _advances(number: int, high_water: int) -> bool:
    return 1 <= (number - high_water) % MODULUS < HALF_RANGE


def _fold_slice(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["received_us", "delivery_id"])
    entry = pdf["entry"].iloc[0]
    high_water = None if pd.isna(entry) else int(entry)
    before, late = [], []
    for s in pdf["sequence_number"].tolist():
        is_late = high_water is not None and not _advances(s, high_water)
        before.append(None if is_late else high_water)
        late.append(is_late)
        if not is_late:
            high_water = s
    out = pdf[KEPT].copy()
    out["high_water_before"] = pd.array(before, dtype="Int64")
    out["is_late"] = late
    return out


def _wide_disposition(rows: DataFrame, slices: int | None = None) -> DataFrame:
    order = ["received_us", "delivery_id"]
    # of several sessions at most: a slice holds a bounded number of rows, whatever the settings
    least = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    sliced = ranged_slices(rows.select(*KEPT), [*SESSION, *order], slices or least)
    place = F.struct(*order)
    named = sliced.groupBy(*SESSION, "slice").agg(F.min_by("sequence_number", place).alias("number"))
    firsts = settle(named.groupBy(*SESSION).agg(
        F.min("slice").alias("begin"), F.max("slice").alias("end"), F.min_by("number", "slice").alias("entry"),
    ))
    top = firsts.agg(F.max(F.col("end") - F.col("begin"))).first()[0]
    placed = sliced.join(firsts.select(*SESSION, "begin"), SESSION).withColumn("node", (F.col("slice") - F.col("begin")).cast("bigint"))
    placed = placed.drop("slice", "begin")
    # a session's first number meets itself as the mark and leaves it as it is
    entered = interval_maps.entries(interval_maps.slice_maps(placed, order), firsts.select(*SESSION, "entry"), top)
    entered = entered.withColumn("entry", F.when(F.col("node") > 0, F.col("entry")))
    group = [*SESSION, "node"]
    return placed.join(entered, group).groupBy(*group).applyInPandas(
        _fold_slice,
        "payload_id bigint, boot_id bigint, sequence_number bigint, received_us bigint, "
        "delivery_id bigint, high_water_before bigint, is_late boolean",
    )


# -- public operators ---------------------------------------------------------


def _disposition() -> dict[str, Column]:
    s, h = F.col("sequence_number"), F.col("high_water_before")
    distance = F.pmod(s - h, F.lit(MODULUS))
    return {
        "sequence_disposition": F.when(F.col("is_late"), "LATE")
        .when(h.isNull(), "FIRST")
        .when(distance == 1, "IN_ORDER")
        .otherwise("GAP"),
        "missing_before": F.when(F.col("is_late"), F.lit(0).cast("bigint"))
        .when(h.isNull(), s)
        .otherwise(distance - 1),
    }


def state_conflicts(packets: DataFrame, state: DataFrame) -> DataFrame:
    """Packets of a later load that equal the stored mark while it stands, although no
    stored packet has that number: the state contradicts the permanent records.

    A packet that arrives after another one of the load has moved the mark is an
    ordinary late one; without arrival columns the mark is taken to stand. Conflicts
    are reported, not disposed; the caller leaves them out.
    """
    s, mark = F.col("sequence_number"), F.col("high_water_sequence")
    met = packets.join(state.select(*SESSION, "high_water_sequence"), SESSION)
    if not {"received_us", "delivery_id"} <= set(packets.columns):
        return met.where(s == mark).select(*packets.columns, F.lit(STATE_CONFLICT).alias("state_conflict"))
    place = F.struct("received_us", "delivery_id")
    moved = met.where(F.pmod(s - mark, F.lit(MODULUS)).between(1, HALF_RANGE - 1)).groupBy(*SESSION).agg(F.min(place).alias("_moved"))
    stands = F.col("_moved").isNull() | (place < F.col("_moved"))
    return (
        met.where(s == mark).join(moved, SESSION, "left").where(stands)
        .select(*packets.columns, F.lit(STATE_CONFLICT).alias("state_conflict"))
    )


def _seeded(packets: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New packets behind one row per stored session that stands for its mark:
    earlier than any delivery, so the same rules continue from it. Apart from
    them, the packets that have the mark's own number: it has been left behind."""
    marks = state.select(*SESSION, F.col("high_water_sequence").alias("sequence_number"))
    sessions = packets.select(*SESSION).distinct()
    seeds = marks.join(sessions, SESSION, "left_semi").select(
        *SESSION, "sequence_number",
        F.lit(SEED_US).cast("bigint").alias("received_us"),
        F.lit(-1).cast("bigint").alias("delivery_id"),
    )
    fresh = packets.join(marks, [*SESSION, "sequence_number"], "left_anti")
    again = packets.join(marks, [*SESSION, "sequence_number"], "left_semi")
    return fresh.select(*KEPT).unionByName(seeds), again.select(*KEPT)


def sequence_disposition(
    packets: DataFrame,
    state: DataFrame | None = None,
    *,
    block_rows: int = BLOCK_NUMBERS,
    slices: int | None = None,
    settled: bool = False,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """Disposition, missing count and the mark before each accepted packet, and its ``carried`` columns.

    ``packets`` holds one row per packet key. It is written once to the shared
    checkpoint folder unless the caller says it already is a written table,
    because its carries and the test for wide sessions read it several times.

    With ``state``, the sequence state of earlier loads, the sessions continue
    from their stored marks; ``packets`` then holds only new packet keys without
    ``state_conflicts``, and ``merged_state`` gives the state after the load.
    """
    again = None
    if state is None:
        kept = packets.select(*KEPT, *carried)
    elif carried:
        raise ValueError("columns are carried without a stored state only")
    else:
        kept, again = _seeded(packets, state)
    if not settled or state is not None:
        kept = settle(kept)
    rows = kept.withColumn("block", block_of("sequence_number", block_rows))
    carries = _block_carries(_blocks(rows))
    narrow = _narrow_disposition(rows, carries, carried)
    wide_sessions = carries.where("is_wide").select(*SESSION).distinct()
    late = F.lit(None).cast("bigint").alias("high_water_before"), F.lit(True).alias("is_late")
    if not wide_sessions.isEmpty():
        wide_rows = kept if again is None else kept.unionByName(again)
        wide_rows = wide_rows.join(wide_sessions, SESSION, "left_semi")
        wide = _wide_disposition(wide_rows, slices)
        if carried:
            wide = wide.join(wide_rows.select("delivery_id", *carried), "delivery_id")
        narrow = narrow.unionByName(wide)
        again = again and again.join(wide_sessions, SESSION, "left_anti")
    if again is not None:
        narrow = narrow.unionByName(again.select(*KEPT, *late))
    if state is not None:
        narrow = narrow.where(F.col("received_us") != SEED_US)
    return narrow.withColumns(_disposition()).select(
        *KEPT, "sequence_disposition", "missing_before", "high_water_before", *carried
    )


def sequence_state(disposed: DataFrame) -> DataFrame:
    """Per session: high water, accepted and missing counts, packet at the mark.

    A late arrival adds to the accepted count and never lowers the missing one.
    """
    advancing = F.when(
        F.col("sequence_disposition") != "LATE", F.struct("received_us", "delivery_id")
    )
    return (
        disposed.groupBy(*SESSION)
        .agg(
            F.max_by("sequence_number", advancing).alias("high_water_sequence"),
            F.count(F.lit(1)).alias("accepted_packet_count"),
            F.sum("missing_before").alias("missing_packet_count"),
        )
        .withColumn(
            "last_high_water_packet_id",
            wire.packet_id("payload_id", "boot_id", "high_water_sequence"),
        )
    )


def missing_ranges(disposed: DataFrame) -> DataFrame:
    """Inclusive range of numbers absent before a packet that opened a gap."""
    h = F.col("high_water_before")
    return disposed.where(F.col("missing_before") > 0).select(
        *SESSION, "sequence_number",
        F.when(h.isNull(), F.lit(0).cast("bigint"))
        .otherwise(F.pmod(h + 1, F.lit(MODULUS)))
        .alias("missing_from"),
        F.pmod(F.col("sequence_number") - 1, F.lit(MODULUS)).alias("missing_to"),
        F.col("missing_before").alias("missing_count"),
    )


def fine_disposition(disposition: Column, missing: Column) -> Column:
    """The pure rule's names: FIRST split by gap, late spelt out."""
    return (
        F.when(disposition == "FIRST", F.when(missing > 0, "FIRST_WITH_GAP").otherwise("FIRST_IN_ORDER"))
        .when(disposition == "LATE", "LATE_OR_OUT_OF_ORDER")
        .otherwise(disposition)
    )


def decision_flags(disposition: Column) -> dict[str, Column]:
    unique = ~disposition.isin("DUPLICATE", "CONFLICT")
    return {
        "accepted": disposition != "CONFLICT",
        "should_queue": unique,
        "should_advance_high_water": unique & (disposition != "LATE_OR_OUT_OF_ORDER"),
    }


def sequence_decision(candidates: DataFrame, disposed: DataFrame) -> DataFrame:
    """Fine-grained decision for every delivery that reached acceptance.

    ``candidates`` carries ``packet_state``. Only packets need their
    disposition, and a delivery id is unique, so this join has no hot key.
    """
    found = disposed.select("delivery_id", "sequence_disposition", "missing_before")
    name = F.when(
        F.col("packet_state") == "PACKET",
        fine_disposition(F.col("sequence_disposition"), F.col("missing_before")),
    ).otherwise(F.col("packet_state"))
    return (
        candidates.where(F.col("packet_state").isNotNull())
        .join(found, "delivery_id", "left")
        .select(
            "delivery_id", *SESSION, "sequence_number",
            name.alias("disposition"),
            F.coalesce("missing_before", F.lit(0)).cast("bigint").alias("missing_count"),
        )
        .withColumns(decision_flags(F.col("disposition")))
    )


def merged_state(state: DataFrame, loaded: DataFrame) -> DataFrame:
    """Stored sequence state after a load: counts add up, and the mark is the
    load's last advancing number where it has one."""
    new = sequence_state(loaded).drop("last_high_water_packet_id")
    old = state.select(*SESSION, *(F.col(c).alias(f"_{c}") for c in new.columns if c not in SESSION))
    both = old.join(new, SESSION, "full_outer")
    zero = F.lit(0).cast("bigint")
    return both.select(
        *SESSION,
        F.coalesce("high_water_sequence", "_high_water_sequence").alias("high_water_sequence"),
        *(
            (F.coalesce(c, zero) + F.coalesce(f"_{c}", zero)).alias(c)
            for c in ("accepted_packet_count", "missing_packet_count")
        ),
    ).withColumn(
        "last_high_water_packet_id",
        wire.packet_id("payload_id", "boot_id", "high_water_sequence"),
    )
