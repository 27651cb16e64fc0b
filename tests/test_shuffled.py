"""What crosses the shuffles of the ledger steps, and what is written: the same rows with less of them."""

from __future__ import annotations

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from telemark.functions import wire
from telemark.operators import audit, identity, results, sequence
from telemark.session import settle


def _rows(df):
    return sorted(map(str, df.collect()))


def test_decoded_fields_do_not_cross_the_packet_shuffle(spark, tables):
    identified = identity.identify(tables.deliveries())
    states = identity.packet_identity(identified)
    assert states.columns[: len(identified.columns)] == identified.columns
    plan = states._jdf.queryExecution().optimizedPlan()
    # the left side of the outer join with the packets' facts is what is shuffled
    joins = []

    def walk(node):
        if node.nodeName() == "Join" and "LeftOuter" in node.joinType().toString():
            names = [node.left().output().apply(i).name() for i in range(node.left().output().size())]
            if "_sequence_number" in names:
                joins.append(names)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert len(joins) == 1 and not set(joins[0]) & {*wire.FRAME_FIELDS, "wire_crc", "calculated_crc"}
    fields = wire.decode_frames(tables.deliveries()).select("delivery_id", *wire.DECODED)
    assert _rows(states.select(*fields.columns)) == _rows(fields)


def test_packets_from_a_disposition_that_carries_the_bytes(spark, tables):
    narrow = tables.accepted().select(*sequence.KEPT, "raw_body")
    # one wide session beside the others
    wide = spark.createDataFrame(
        [(1, 999999, n, 5 + i, -1 - i, bytes([i])) for i, n in enumerate((0, 1 << 30, 3 << 30, 5, 1 << 31))],
        narrow.schema,
    )
    packets = settle(narrow.unionByName(wide))
    got = sequence.sequence_disposition(packets, settled=True, carried=("raw_body",))
    plain = sequence.sequence_disposition(packets, settled=True)
    want = plain.join(packets.select("delivery_id", "raw_body"), "delivery_id").select(*got.columns)
    assert _rows(got) == _rows(want)
    disposed = sequence.sequence_disposition(tables.accepted(), settled=True, carried=("raw_body",))
    direct = results.packets_table(tables.outcome(), disposed)
    assert _rows(direct) == _rows(results.packets_table(tables.outcome(), disposed.drop("raw_body")))


def test_rows_without_a_disposition_do_not_meet_it(spark, tables):
    outcome, disposed = tables.outcome(), tables.disposed()
    found = disposed.select("delivery_id", "sequence_disposition", "missing_before")
    joined = outcome.where(~F.col("is_replay")).join(found, "delivery_id", "left")
    accepted = audit.delivery_events(outcome, disposed).where(F.col("event_name") == audit.EVENT_NAMES[7])
    want = joined.where("packet_state = 'PACKET'").select(
        F.col("delivery_id").alias("receipt_id"), F.to_json(F.struct("sequence_disposition", "missing_before")).alias("event_data")
    )
    assert _rows(accepted.select("receipt_id", "event_data")) == _rows(want)
    assert audit.delivery_events(outcome, disposed).count() == audit.delivery_events(outcome).count()


def test_settled_tables_are_written_with_zstd(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    settled = settle(spark.read.parquet(str(tmp_path / "in")))
    path = settled.inputFiles()[0].removeprefix("file://")
    assert pq.ParquetFile(path).metadata.row_group(0).column(0).compression == "ZSTD"
