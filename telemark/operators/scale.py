"""Building blocks that keep one key's rows spread over many tasks.

Any key (a session, a request id, a packet, an application id) may own a large
share of all rows. Nothing here puts such a group into one task: group facts
are pre-aggregated and handed back without moving a hot key's rows, and ordered
operators work on blocks whose size is bounded by the uniqueness of their order
column, with a small carry from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemark.functions.wire import whole_div
from telemark.session import settle

# Rows of one key per ordered block.
BLOCK_ROWS = 1 << 20
UNBOUNDED = Window.unboundedPreceding


def attach_group_facts(
    rows: DataFrame, facts: DataFrame, keys: list[str], *, row_id: str
) -> DataFrame:
    """Left join one ``fact`` struct per key onto the rows of that key.

    Rows with a NULL key have nothing to find; they carry their own id in an
    extra join column, so they spread evenly instead of meeting in one reducer.

    That column also gives both sides a shuffle of their own directly below the
    join, which is the shape in which adaptive execution splits a hot key's rows
    over several tasks (``spark.sql.adaptive.skewJoin``); the facts side holds
    one row per key, so repeating it for each split is cheap. If all facts
    together are small, adaptive execution broadcasts them by measured size.
    """
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    placed = rows.withColumn(
        "_spread", F.when(no_key, F.col(row_id)).otherwise(F.lit(-1).cast("bigint"))
    )
    # always -1, but not foldable, so it stays an equi-join column
    spread = F.least(F.col("n"), F.lit(-1).cast("bigint"))
    found = facts.select(*keys, "fact", spread.alias("_spread"))
    return placed.join(found, [*keys, "_spread"], "left").drop("_spread")


def block_of(order: Column | str, block_rows: int = BLOCK_ROWS) -> Column:
    return whole_div(order, block_rows)


def blocked_row_number(
    df: DataFrame, keys: list[str], order: str, name: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Zero-based row number per key by a unique integer order column.

    A key's rows are ranked inside blocks of the order column (no block can hold
    more than ``block_rows`` rows of it) and shifted by the number of rows in
    earlier blocks, which comes from a partial aggregate.
    """
    rows = df.withColumn("_block", block_of(order, block_rows))
    by_block = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(UNBOUNDED, -1)
    shift = by_block.select(
        *keys, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift")
    )
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        rows.withColumn("_rn", F.row_number().over(within))
        .join(shift, [*keys, "_block"])
        .withColumn(name, (F.col("_rn") - 1 + F.col("_shift")).cast("bigint"))
        .drop("_block", "_rn", "_shift")
    )


def blocked_lag(
    df: DataFrame, keys: list[str], order: str, value: str, name: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Previous ``value`` (not NULL) per key by a unique integer order column."""
    rows = df.withColumn("_block", block_of(order, block_rows))
    last_of_block = rows.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_block")
    carry = last_of_block.select(*keys, "_block", F.lag("_last").over(before).alias("_carry"))
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        rows.withColumn("_prev", F.lag(value).over(within))
        .join(carry, [*keys, "_block"])
        .withColumn(name, F.coalesce("_prev", "_carry"))
        .drop("_block", "_prev", "_carry", "_last")
    )


def ranged_slices(df: DataFrame, order: list[str], slices: int | None = None) -> DataFrame:
    """Range-partition by a unique order and number the slices.

    Works for any order columns, ties and bursts included, because the range
    bounds are sampled from the data. The result is settled: slice numbers must
    be the same for every branch that reads them.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id())
    return settle(ranged)


def ordered_lag(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str,
    slices: int | None = None,
) -> DataFrame:
    """Previous ``value`` per key in any total order, with no group in one task.

    Only the first row of a slice can need a value from outside it, and that is
    the last row of the slice before: one carry row per slice.
    """
    sliced = ranged_slices(df, [*keys, *order], slices)
    place = F.struct(*keys, *order)
    tails = sliced.groupBy("slice").agg(
        F.max_by(F.struct(*keys, value), place).alias("_tail")
    )
    neighbours = Window.partitionBy(F.lit(0)).orderBy("slice")
    # one row per slice, so this window and the broadcast are bounded by the
    # partition count
    carry = tails.select("slice", F.lag("_tail").over(neighbours).alias("_tail"))
    within = Window.partitionBy("slice").orderBy(*keys, *order)
    same_key = F.lit(True)
    for key in keys:
        same_key = same_key & F.col(f"_before.{key}").eqNullSafe(F.col(key))
    return (
        sliced.withColumn("_before", F.lag(F.struct(*keys, value)).over(within))
        .join(F.broadcast(carry), "slice")
        .withColumn("_before", F.coalesce("_before", "_tail"))
        .withColumn(name, F.when(same_key, F.col(f"_before.{value}")))
        .drop("slice", "_before", "_tail")
    )
