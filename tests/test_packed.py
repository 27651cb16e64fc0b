"""Rows go to the delivery stream's steps packed by bucket, over as many state partitions as there are cores."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from test_processors import Handle

from telemark.plans.catalog import QUERIES
from telemark.streaming import ledger, processors
from telemark.streaming.processors import BUCKETS, CHUNK_KEYS, LABELS, FirstArrival, Packed, pack, unpack

BIG = 1 << 60  # a double does not hold the next number


def batches(rows, size):
    table = pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("text", pa.string()), ("body", pa.binary())]))
    return table.to_batches(max_chunksize=size)


def test_packing_keeps_every_row(monkeypatch):
    rows = [
        {"bucket": k * 7 % 5, "n": BIG + k if k % 3 else None, "text": f"t{k}" if k % 4 else None, "body": b"\0" * (k % 6) if k % 5 else None}
        for k in range(1000)
    ]
    want = [{c: row[c] for c in ("n", "text", "body")} for row in sorted(rows, key=lambda row: row["bucket"])]
    packed = list(pack(iter(batches(rows, 90))))
    assert [b.num_rows for b in packed] == [5] and packed[0]["bucket"].to_pylist() == LABELS[:5].tolist()
    assert [row for b in unpack(iter(packed)) for row in b.to_pylist()] == want
    # bytes that are held are bounded
    monkeypatch.setattr(processors, "PACK_BYTES", 3000)
    packed = list(pack(iter(batches(rows, 90))))
    assert len(packed) > 3
    assert sorted(map(str, (row for b in unpack(iter(packed)) for row in b.to_pylist()))) == sorted(map(str, want))
    assert list(pack(iter([]))) == []


def test_buckets_are_dealt_evenly(spark):
    labels = spark.createDataFrame([(n, label) for n, label in enumerate(LABELS.tolist())], "n int, label int")
    assert labels.where(F.hash("label") != F.col("n")).count() == 0 and labels.count() == BUCKETS
    sizes = labels.repartition(12, "label").groupBy(F.spark_partition_id()).count()
    assert {r["count"] for r in sizes.collect()} == {21, 22}


def judged(step, rows):
    """Rows in several packed tables of one bucket, as frames of Spark's."""
    kinds = {"note": pa.string(), "body": pa.binary(), "bucket": pa.int32(), "keyed": pa.bool_()}
    schema = pa.schema([(c, kinds.get(c, pa.int64())) for c in ("bucket", *rows[0])])
    table = pa.Table.from_pylist([row | {"bucket": 3} for row in rows], schema)
    frames = [packed.to_pandas() for part in table.to_batches(max_chunksize=len(rows) // 3) for packed in pack(iter([part]))]
    got = pd.concat(list(step.handleInputRows((3,), iter(frames), None)))
    return [row for blob in got["packed"] for row in processors._unpacked(blob).to_pylist()]


def test_first_arrivals_over_packed_rows():
    step = Packed(FirstArrival(["k"], ["delivery_id", "note"], ("body",), "own_"), ["delivery_id", "own_delivery_id", "own_note", "own_equal_body"])
    step.init(Handle())
    first, count = {}, CHUNK_KEYS + 100
    for batch in range(3):
        rows = [
            {"delivery_id": BIG + batch * count + n, "received_us": batch, "k": n // 2 if n % 3 else n + 1000 * batch, "keyed": n % 10 != 0,
             "key_hash": n % 50, "note": "x" if n % 7 == 0 else None, "body": [None, b"", b"a"][n * batch % 3]}
            for n in range(count)
        ]
        for row in rows:
            if row["keyed"]:
                first.setdefault(row["k"], row)
        own = {row["delivery_id"]: first[row["k"]] if row["keyed"] else row for row in rows}
        want = [
            {"delivery_id": row["delivery_id"], "own_delivery_id": own[row["delivery_id"]]["delivery_id"],
             "own_note": own[row["delivery_id"]]["note"], "own_equal_body": own[row["delivery_id"]]["body"] == row["body"]}
            for row in rows
        ]
        assert judged(step, rows[::-1]) == want


def test_state_partitions_do_not_follow_shuffle_partitions(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    seen = set(shared.rglob("checkpoint/state"))
    wide = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert QUERIES["delivery_stream"](spark, "/root/testdata/sf0.001").count() > 0
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        most = max(ledger.LEAST_PARTITIONS, spark.sparkContext.defaultParallelism)
        assert ledger.state_partitions(spark) == most < 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)
    assert ledger.state_partitions(spark) == int(wide)
    (state,) = set(shared.rglob("checkpoint/state")) - seen
    assert sorted(step.name for step in state.iterdir()) == ["0", "1", "2"]
    assert all(sum(d.name.isdigit() for d in step.iterdir()) == most for step in state.iterdir())
