"""Stateful processors of the delivery stream.

A group is a hash bucket of keys, so one call serves every key of the bucket that a micro-batch brings: the state is
asked a few times per bucket instead of several times per key. Rows come to a bucket packed, as the Arrow tables that
``pack`` makes of a source task's rows, and leave it so for ``unpack``: Spark hands grouped rows to Python one by one, which
costs more than the work on them. Each key leaves one small record, forever: the contract has no watermark on
identity, a late frame is always accepted. Rows of one key and one micro-batch
are handled in arrival order; across batches, arrival order is batch order.
Micro-batch size (files or bytes per trigger) bounds the rows of a bucket per call.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MODULUS = 1 << 32
HALF_RANGE = 1 << 31
# Hash buckets of keys, the groups of the stateful steps. A checkpoint is bound to their number.
BUCKETS = 256
# Keys of one stored chunk of a bucket.
CHUNK_KEYS = 1024
# Bytes of rows that are packed at a time, and of a packed table that leaves a step, some.
PACK_BYTES = 16 << 20
FIRST, EQUAL = "first_", "equal_"
STORED = pa.ipc.IpcWriteOptions(compression="zstd")


def _label(hashed: int) -> int:
    """The int whose hash in Spark (Murmur3, seed 42) is ``hashed``."""
    word = (1 << 32) - 1

    def divided(h: int, factor: int) -> int:
        return h * pow(factor, -1, 1 << 32) & word

    def turned(h: int, places: int) -> int:
        return (h >> places | h << 32 - places) & word

    h = hashed & word
    h = divided(h ^ h >> 16, 0xC2B2AE35)
    h = divided(h ^ h >> 13 ^ h >> 26, 0x85EBCA6B)
    h = divided((h ^ h >> 16 ^ 4) - 0xE6546B64, 5)
    h = divided(turned(h, 13) ^ 42, 0x1B873593)
    h = divided(turned(h, 15), 0xCC9E2D51)
    return h - (h >> 31 << 32)


# Group keys of the buckets: Spark deals bucket ``n`` to partition ``n`` modulo their number, so none has many more than another.
LABELS = np.array([_label(n) for n in range(BUCKETS)], np.int32)


def _packed(rows: pa.Table, options: pa.ipc.IpcWriteOptions | None = None) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=options) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(blob)).read_all()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their ``bucket`` as one row per bucket, its label and ``packed``, for every ``PACK_BYTES`` or so of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= PACK_BYTES:
            yield _dealt(held)
            held, size = [], 0
    if size:
        yield _dealt(held)


def _dealt(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    order = np.argsort(rows["bucket"].to_numpy(), kind="stable")
    rows = rows.take(order).combine_chunks()
    buckets, begins = np.unique(rows["bucket"].to_numpy(), return_index=True)
    rows = rows.drop_columns("bucket")
    ends = [*begins[1:].tolist(), len(order)]
    packed = [_packed(rows.slice(begin, end - begin)) for begin, end in zip(begins.tolist(), ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(LABELS[buckets]), pa.array(packed, pa.binary())], ["bucket", "packed"])


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch["packed"]:
            yield from pa.ipc.open_stream(blob.as_buffer())


def in_arrival_order(rows: pa.Table) -> pa.Table:
    return rows.take(pc.sort_indices(rows, [("received_us", "ascending"), ("delivery_id", "ascending")])).combine_chunks()


def numbered(keys: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's key, in order of first appearance, and where each key appears first. Keys hold no NULL."""
    numbers = np.zeros(keys.num_rows, np.int64)
    for column in keys.itercolumns():
        # numbers are below the number of rows, so the product stays in range
        codes = column.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        numbers = pd.factorize(numbers * keys.num_rows + codes)[0]
    return numbers, np.unique(numbers, return_index=True)[1]


class BucketStep(StatefulProcessor):
    """A step whose ``judged`` takes the rows of a bucket in arrival order. ``bucket`` and ``keyed`` are not passed on."""

    def judged(self, rows: pa.Table) -> pa.Table:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).drop(columns="bucket")
        yield self.judged(in_arrival_order(pa.Table.from_pandas(frame, preserve_index=False))).to_pandas()

    def close(self) -> None:
        pass


class Packed(StatefulProcessor):
    """``step`` over rows that ``pack`` has packed; what it returns is packed in tables of ``columns``."""

    def __init__(self, step: BucketStep, columns: list[str]) -> None:
        self.step, self.columns = step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.step.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        arrived = pa.concat_tables([_unpacked(blob) for frame in rows for blob in frame["packed"]])
        judged = self.step.judged(in_arrival_order(arrived)).select(self.columns).combine_chunks()
        most = max(1, judged.num_rows * PACK_BYTES // max(1, judged.nbytes))
        for begin in range(0, judged.num_rows, most):
            yield pd.DataFrame({"packed": [_packed(judged.slice(begin, most))]})

    def close(self) -> None:
        self.step.close()


class FirstArrival(BucketStep):
    """Adds the ``carried`` columns of the first arrival of each row's key, as ``first_*``, and whether its ``compared`` columns
    are equal to the row's or both NULL, as ``first_equal_*``. ``prefix`` is for another name than ``first_``.

    Rows have ``keyed`` and ``key_hash``; one that is not keyed stands for itself and leaves no state. A bucket's keys are
    stored in chunks, their hashes apart from their records: a call reads all hashes of its bucket, eight bytes a key, and
    only records of chunks where one of its keys may be.
    """

    def __init__(self, keys: list[str], carried: list[str], compared: tuple[str, ...] = (), prefix: str = FIRST) -> None:
        self.keys, self.carried, self.compared, self.prefix = keys, carried, compared, prefix

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getMapState("hashes", "chunk bigint", "hashes binary")
        self.records = handle.getMapState("records", "chunk bigint", "rows binary")

    def judged(self, rows: pa.Table) -> pa.Table:
        held = [*self.carried, *self.compared]
        first = rows.select(held)
        places = np.flatnonzero(rows["keyed"].to_numpy())
        if len(places):
            numbers, begins = numbered(rows.select(self.keys).take(places))
            owners = self._owners(rows.select([*self.keys, "key_hash", *held]).take(places[begins]))
            at = np.arange(rows.num_rows)
            at[places] = rows.num_rows + numbers
            first = pa.concat_tables([first, owners.select(held)]).combine_chunks().take(at)
        own, rows = rows, rows.drop_columns(["keyed", "key_hash"])
        for c in self.carried:
            rows = rows.append_column(f"{self.prefix}{c}", first[c])
        for c in self.compared:
            both_null = pc.and_(own[c].is_null(), first[c].is_null())
            rows = rows.append_column(f"{self.prefix}{EQUAL}{c}", pc.coalesce(pc.equal(own[c], first[c]), both_null))
        return rows

    def _owners(self, firsts: pa.Table) -> pa.Table:
        """Stored records of the keys; the keys that have none are stored with this record."""
        asked = firsts["key_hash"].to_numpy()
        chunks, blobs = [], []
        for (chunk,), (blob,) in self.hashes.iterator():
            chunks.append(chunk)
            blobs.append(blob)
        sizes = np.array([len(blob) for blob in blobs], np.int64) // 8
        newest = int(np.argmax(chunks)) if chunks else None
        last, size = (-1, 0) if newest is None else (chunks[newest], int(sizes[newest]))
        held = np.frombuffer(b"".join(blobs), np.int64)
        # most stored hashes fall out by their upper bits
        upper = np.zeros(1 << 16, bool)
        upper[asked.view(np.uint64) >> np.uint64(48)] = True
        likely = np.flatnonzero(upper[held.view(np.uint64) >> np.uint64(48)])
        hits = likely[np.isin(held[likely], asked)]
        met = [chunks[n] for n in np.unique(np.searchsorted(np.cumsum(sizes), hits, side="right")).tolist()]
        if not met:
            self._store(firsts, last, size)
            return firsts
        stored = pa.concat_tables([_unpacked(self.records.getValue((chunk,))[0]) for chunk in met])
        stored = stored.filter(pa.array(np.isin(stored["key_hash"].to_numpy(), asked)))
        both = pa.concat_tables([stored, firsts]).combine_chunks()
        # stored keys are all different, so a stored key's number is its place
        numbers = numbered(both.select(self.keys))[0][stored.num_rows:]
        known = numbers < stored.num_rows
        self._store(firsts.filter(pa.array(~known)), last, size)
        return both.take(np.where(known, numbers, stored.num_rows + np.arange(len(numbers))))

    def _store(self, fresh: pa.Table, last: int, size: int) -> None:
        """The last chunk is filled up before the next one is begun."""
        if not fresh.num_rows:
            return
        if 0 < size < CHUNK_KEYS:
            fresh = pa.concat_tables([_unpacked(self.records.getValue((last,))[0]), fresh])
        else:
            last += 1
        fresh = fresh.combine_chunks()
        for n, begin in enumerate(range(0, fresh.num_rows, CHUNK_KEYS)):
            part = fresh.slice(begin, CHUNK_KEYS)
            self.hashes.updateValue((last + n,), (part["key_hash"].to_numpy().tobytes(),))
            self.records.updateValue((last + n,), (_packed(part, STORED),))


class SequenceTracker(BucketStep):
    """High-water mark and counts per (payload, boot); ``keyed`` rows are tracked."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "marks binary")

    def judged(self, rows: pa.Table) -> pa.Table:
        dispositions, gaps = [None] * rows.num_rows, [None] * rows.num_rows
        marks, changed = None, False
        tracked = np.flatnonzero(rows["keyed"].to_numpy())
        if len(tracked):
            stored = self.marks.get()
            held = np.frombuffer(bytes(stored[0]) if stored else b"", np.int64).reshape(-1, 5).tolist()
            marks = {(payload, boot): mark for payload, boot, *mark in held}
        columns = (rows[c].to_numpy()[tracked].tolist() for c in ("payload", "boot", "sequence"))
        for place, payload, boot, s in zip(tracked.tolist(), *columns, strict=True):
            high, accepted, missing = marks.get((payload, boot), (None, 0, 0))
            distance = None if high is None else (s - high) % MODULUS
            if distance == 0:
                dispositions[place], gaps[place] = "SEQUENCE_STATE_CONFLICT", 0
                continue
            if distance is None:
                disposition, gap, high = "FIRST", s, s
            elif distance < HALF_RANGE:
                disposition = "IN_ORDER" if distance == 1 else "GAP"
                gap, high = distance - 1, s
            else:
                disposition, gap = "LATE", 0
            dispositions[place], gaps[place] = disposition, gap
            marks[payload, boot], changed = (high, accepted + 1, missing + gap), True
        if changed:
            self.marks.update((np.array([(*session, *mark) for session, mark in marks.items()], np.int64).tobytes(),))
        rows = rows.drop_columns(["keyed", "payload", "boot", "sequence"])
        return rows.append_column("sequence_disposition", pa.array(dispositions, pa.string())).append_column(
            "missing_before", pa.array(gaps, pa.int64())
        )


class AbsenceAlert(StatefulProcessor):
    """Fires when no activity tick arrives for a while, by event-time timers."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "tick_ms bigint, firing boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, firing = self.last.get() or (None, False)
        ticks = sorted({int(r.tick_us) // 1000 for r in rows})
        for tick in ticks:
            if last is not None and tick <= last:
                continue
            if last is not None and not firing and last + self.quiet_ms < tick:
                yield Row(label=key[0], state="FIRING", at_us=(last + self.quiet_ms) * 1000)
                firing = True
            if firing:
                yield Row(label=key[0], state="RESOLVED", at_us=tick * 1000)
                firing = False
            last = tick
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.quiet_ms)
        self.last.update((last, firing))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        last, firing = self.last.get()
        if not firing:
            self.last.update((last, True))
            yield Row(label=key[0], state="FIRING", at_us=(last + self.quiet_ms) * 1000)

    def close(self) -> None:
        pass
