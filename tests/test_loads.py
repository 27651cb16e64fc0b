"""Loads into the stored ledger: whole or not at all, keys without bodies, contradictions and refusals."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from telemark.operators import audit, identity
from telemark.streaming import key_ledger, loads
from telemark.streaming.commits import Commits, Load, RefusedLoad
from test_identity import OCTET, request
from test_wire import RECEIVED_US, frame

OUTCOME = [
    "receipt_id", "canonical_request_id", "body_sha256", "validation_status", "rejection_reason", "parsed_identifiers",
    "duplicate_of_receipt_id", "logical_packet_id", "queue_status",
]


def rows(df, columns):
    return Counter(map(tuple, df.select(*columns).collect()))


@pytest.fixture(scope="module")
def arrived(tables):
    return tables.deliveries()


def cuts(arrived, n):
    edges = arrived.approxQuantile("received_us", [i / n for i in range(1, n)], 0.0)
    slot = sum((F.col("received_us") > e).cast("int") for e in edges)
    return [arrived.where(slot == k) for k in range(n)]


def test_loads_equal_one_batch_and_read_no_earlier_body(spark, arrived, tmp_path):
    stored = loads.Ledger(spark, str(tmp_path))
    parts = cuts(arrived, 5)
    for number, part in enumerate(parts):
        assert stored.load(number, part)
        assert not stored.load(number, part)
        if number == 2:
            receipts = stored.table("receipts").persist()
            kept = rows(receipts, OUTCOME)
            # what later loads may not touch
            for file in [*Path(tmp_path, "receipts").rglob("*.parquet"), *Path(tmp_path, "packets").rglob("*.parquet")]:
                file.write_bytes(b"unreadable")
    later = spark.read.parquet(*(f"{tmp_path}/receipts/load={n}" for n in (3, 4)))
    batch = identity.receipts(identity.delivery_outcome(identity.identify(arrived)))
    assert kept + rows(later, OUTCOME) == rows(batch, OUTCOME)
    assert stored.commits.snapshot().load == 4


def test_a_load_that_fails_half_way_leaves_nothing(spark, arrived, tmp_path, monkeypatch):
    first, second = cuts(arrived, 2)
    stored = loads.Ledger(spark, str(tmp_path))
    stored.load(7, first)
    names = ("receipts", "packets", "audit")
    before = {n: stored.table(n).count() for n in names} | {"state": rows(stored.sequence_state(), ["boot_id", "accepted_packet_count"])}
    append = Load.append

    def failing(self, name, df):
        if name == "audit":
            raise OSError("lost")
        return append(self, name, df)

    monkeypatch.setattr(Load, "append", failing)
    with pytest.raises(OSError):
        stored.load(8, second)
    again = loads.Ledger(spark, str(tmp_path))
    assert {n: again.table(n).count() for n in names} | {"state": rows(again.sequence_state(), ["boot_id", "accepted_packet_count"])} == before
    monkeypatch.undo()
    assert again.load(8, second)
    batch = identity.delivery_outcome(identity.identify(arrived))
    assert rows(again.table("receipts"), OUTCOME) == rows(identity.receipts(batch), OUTCOME)
    assert again.table("packets").count() == batch.where("request_state = 'NEW' and packet_state = 'PACKET'").count()
    assert again.sequence_state().agg(F.sum("accepted_packet_count")).first()[0] == again.table("packets").count()


def test_the_second_writer_of_a_load_is_refused(spark, tmp_path):
    commits = Commits(spark, str(tmp_path))
    one, two = commits.begin(0), commits.begin(0)
    one.append("t", spark.range(3))
    one.commit()
    with pytest.raises(Exception, match="exist"):
        two.commit()
    with pytest.raises(RefusedLoad):
        commits.begin(0)
    assert commits.snapshot().load == 0 and commits.read("t", spark.range(1).schema).count() == 3


def deliveries(spark, made):
    """(id, boot, number, changed) as valid frames in order of id."""
    return spark.createDataFrame(
        [
            (i, RECEIVED_US + i, request(i), OCTET, bytearray(frame(boot_id=boot, sequence_number=seq, voltage_mv=28000 + changed)))
            for i, boot, seq, changed in made
        ],
        "delivery_id bigint, received_us bigint, request_id string, content_type string, raw_body binary",
    )


def test_packets_that_contradict_the_stored_state(spark, tmp_path):
    stored = loads.Ledger(spark, str(tmp_path))
    stored.load(0, deliveries(spark, [(1, 5, 10, 0), (2, 6, 3, 0), (3, 7, 8, 0)]))
    # the marks of boots 5 and 6 say more than the packets
    seed = stored.commits.begin(1)
    state = stored.sequence_state()
    seed.replace("sequence_state", state.withColumn("high_water_sequence", F.col("high_water_sequence") + F.when(F.col("boot_id") < 7, 2).otherwise(0)))
    seed.commit()
    second = deliveries(spark, [
        (11, 5, 12, 0), (12, 5, 12, 0), (13, 5, 13, 0), (14, 5, 12, 0), (15, 5, 12, 1),  # conflicts, moved on, late, other bytes
        (21, 6, 4, 0), (22, 6, 5, 0), (31, 7, 8, 0), (32, 7, 9, 0),
    ])
    second = second.unionByName(second.where("delivery_id = 11").withColumns({"delivery_id": F.lit(19), "received_us": F.col("received_us") + 9}))
    stored.load(2, second)
    got = {r.receipt_id: r for r in stored.table("receipts").collect()}
    for i in (11, 12, 22):
        r = got[i]
        assert (r.validation_status, r.rejection_reason, r.queue_status, r.logical_packet_id) == ("CONFLICT", "SEQUENCE_STATE_CONFLICT", "NOT_APPLICABLE", None)
        assert '"sequence_number"' in r.parsed_identifiers
    assert 19 not in got  # a replay of the conflict
    assert [got[i].validation_status for i in (13, 14, 15, 21, 31, 32)] == ["ACCEPTED", "ACCEPTED", "CONFLICT", "ACCEPTED", "DUPLICATE", "ACCEPTED"]
    assert got[15].rejection_reason == "SEQUENCE_CONFLICT" and got[31].duplicate_of_receipt_id == 3
    packets = {r.source_receipt_id: (r.sequence_disposition, r.missing_before) for r in stored.table("packets").collect()}
    assert packets == {1: ("FIRST", 10), 2: ("FIRST", 3), 3: ("FIRST", 8), 13: ("IN_ORDER", 0), 14: ("LATE", 0), 21: ("LATE", 0), 32: ("IN_ORDER", 0)}
    events = stored.table("audit").where(F.col("event_name") == audit.EVENT_NAMES[6])
    assert rows(events, ["receipt_id", "outcome", "reason"]) == Counter({(i, "CONFLICT", "SEQUENCE_STATE_CONFLICT"): 1 for i in (11, 12, 22)})
    received = stored.table("audit").where(F.col("event_name") == audit.EVENT_NAMES[0])
    assert {r.receipt_id for r in received.collect()} == set(got)
    # a later replay of a conflict is one still, and makes no packet
    third = second.where("delivery_id = 11").withColumns({"delivery_id": F.lit(41), "received_us": F.col("received_us") + 90})
    stored.load(3, third)
    assert stored.table("receipts").where("receipt_id = 41").count() == 0 and stored.table("packets").count() == 7
    marks = {r.boot_id: (r.high_water_sequence, r.accepted_packet_count) for r in stored.sequence_state().collect()}
    assert marks == {5: (13, 3), 6: (5, 2), 7: (9, 2)}


def test_bodies_over_the_cap_never_reach_the_ledger(spark, tmp_path):
    fine = deliveries(spark, [(1, 5, 10, 0)])
    large = fine.select(
        F.lit(2).cast("bigint").alias("delivery_id"), "received_us", "request_id", "content_type", F.repeat(F.lit("x"), 1025).cast("binary").alias("raw_body")
    )
    at_cap = large.withColumns({"delivery_id": F.lit(3).cast("bigint"), "raw_body": F.repeat(F.lit("x"), 1024).cast("binary"), "request_id": F.lit("r")})
    stored = loads.Ledger(spark, str(tmp_path))
    stored.load(0, fine.unionByName(large).unionByName(at_cap))
    assert rows(stored.table("receipts"), ["receipt_id", "raw_body_size"]) == Counter([(1, len(frame())), (3, 1024)])
    refused = stored.table("security_rejected").collect()
    assert [(r.delivery_id, r.body_size, r.reason) for r in refused] == [(2, 1025, "BODY_TOO_LARGE")]
    events = stored.table("audit").where(F.col("event_name") == audit.EVENT_NAMES[5]).collect()
    assert [(r.event_id, r.receipt_id, r.reason) for r in events] == [("B-2", None, "BODY_TOO_LARGE")]


def test_key_ledger_levels_filters_and_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_ledger, "BUCKET_KEYS", 50)
    commits = Commits(spark, str(tmp_path))
    keys = key_ledger.KeyLedger(commits, "k", "a bigint, b string", "owner bigint")
    rng, known = random.Random(4), {}
    for number in range(8):
        fresh = {}
        while len(fresh) < 60:
            key = (rng.randrange(10**9), f"s{rng.randrange(5)}")
            if key not in known:
                fresh[key] = rng.randrange(10**6)
        known |= fresh
        load = commits.begin(number)
        keys.add(load, spark.createDataFrame([(*k, v) for k, v in fresh.items()], keys.schema))
        load.commit()
    at = commits.snapshot()
    levels = keys._levels(at)
    assert sum(level["rows"] for level in levels) == len(known) and len(levels) <= 4
    asked = [*rng.sample(sorted(known), 40), *((rng.randrange(10**9), "s9") for _ in range(200)), (None, "s1")]
    got = {(r.a, r.b): r.owner for r in keys.lookup(spark.createDataFrame(asked, keys.keys), at).collect()}
    assert got == {k: known[k] for k in asked if k in known}
    # absent keys hardly pass the filters, and what passes reads its buckets only
    none = keys.lookup(spark.createDataFrame([(i, "absent") for i in range(3)], keys.keys), at)
    plan = none._jdf.queryExecution().toString()
    assert none.count() == 0 and ("bucket" in plan)
    assert keys.lookup(spark.createDataFrame([], keys.keys), at).count() == 0


def test_the_query_gives_each_load_its_own_files(spark, monkeypatch):
    from conftest import SMALL

    from telemark.plans.catalog import QUERIES

    read = {}

    def seen(self, number, deliveries, worker=None):
        assert deliveries.columns == ["delivery_id", "received_us", "request_id", "content_type", "raw_body"]
        read[number] = {r[0] for r in deliveries.select(F.input_file_name()).collect()}

    monkeypatch.setattr(loads.Ledger, "load", seen)
    assert QUERIES["ledger_loads"](spark, SMALL).count() == 0
    assert sorted(read) == [0, 1, 2, 3] and all(read.values())
    assert len(set.union(*read.values())) == sum(map(len, read.values()))
