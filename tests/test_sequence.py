"""Disposition against the plain fold, on narrow and wide sessions."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemark.operators import interval_maps, sequence

MOD, HALF = 1 << 32, 1 << 31


def fold(numbers):
    high, out = None, []
    for s in numbers:
        if high is None:
            out.append(("FIRST", s, None)); high = s
            continue
        d = (s - high) % MOD
        if 1 <= d < HALF:
            out.append(("IN_ORDER" if d == 1 else "GAP", d - 1, high)); high = s
        else:
            out.append(("LATE", 0, None))
    return out


def run(spark, sessions, **options):
    rows = [
        (1, boot, s, 1000 + at // 3, 10_000 * boot + at)
        for boot, numbers in sessions.items()
        for at, s in enumerate(numbers)
    ]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, sequence.KEPT and ", ".join(f"{c} bigint" for c in sequence.KEPT))
    return sequence.sequence_disposition(df, **options)


def check(spark, sessions, **options):
    disposed = run(spark, sessions, **options)
    got = {
        (r.boot_id, r.delivery_id): (r.sequence_disposition, r.missing_before, r.high_water_before)
        for r in disposed.collect()
    }
    want = {
        (boot, 10_000 * boot + at): result
        for boot, numbers in sessions.items()
        for at, result in enumerate(fold(numbers))
    }
    assert got == want
    return disposed


def unique(numbers):
    return list(dict.fromkeys(numbers))


def test_table_of_pairs(spark):
    check(spark, {
        1: [0], 2: [13], 3: [10, 11], 4: [10, 13], 5: [20, 18], 6: [100, 100 + HALF],
        7: [100, 101 + HALF], 8: [100, 99 + HALF], 9: [MOD - 1, 0]})


def test_jump_beyond_half_range(spark):
    numbers = [10, 13, 11, 14, 2147483700, 2147483676, 20]
    check(spark, {1: numbers})
    assert [d for d, _, _ in fold(numbers)][-3:] == ["LATE", "LATE", "GAP"]


@pytest.mark.parametrize("block_rows", [4, 64, 1 << 20])
def test_narrow_sessions(spark, block_rows):
    rng = random.Random(block_rows)
    sessions = {}
    for boot in range(1, 13):
        base = rng.choice([0, 5, 1000, MOD - 5000])
        walk = [base + i + rng.choice([0, 0, 0, -7, 9, 30, -60]) for i in range(rng.randrange(1, 120))]
        sessions[boot] = unique(max(0, min(MOD - 1, s)) for s in walk)
    disposed = check(spark, sessions, block_rows=block_rows)
    state = {r.boot_id: r for r in sequence.sequence_state(disposed).collect()}
    for boot, numbers in sessions.items():
        results = fold(numbers)
        last = [s for s, (d, _, _) in zip(numbers, results) if d != "LATE"][-1]
        assert state[boot].high_water_sequence == last
        assert state[boot].missing_packet_count == sum(m for _, m, _ in results)


@pytest.mark.parametrize("slices", [1, 3, 7])
def test_wide_sessions(spark, slices):
    rng = random.Random(slices)
    sessions = {1: [5, 6, 7]}
    for boot in range(2, 8):
        near = [rng.choice([0, HALF - 40, HALF, MOD - 40, 3 << 30]) + rng.randrange(40) for _ in range(90)]
        far = [rng.randrange(MOD) for _ in range(90)]
        falling = [HALF + 500 - i for i in range(60)] + [400 - i for i in range(60)]
        sessions[boot] = unique(rng.choice([near, far, near + far, falling, falling[::-1] + far]))
    check(spark, sessions, slices=slices, block_rows=1 << 28)


def test_wide_sessions_over_many_pages(spark, monkeypatch):
    monkeypatch.setattr(interval_maps, "PAGE", 2)
    rng = random.Random(9)
    falling = [HALF + 500 - i for i in range(40)] + [9] + [400 - i for i in range(40)]
    check(spark, {1: falling, 2: unique(rng.randrange(MOD) for _ in range(70))}, slices=6)


def mark_after(numbers, high):
    for s in numbers:
        if 1 <= (s - high) % MOD < HALF:
            high = s
    return high


def some_numbers(rng):
    return unique(rng.choice([rng.randrange(MOD), HALF + rng.randrange(9), rng.randrange(9), MOD - 1 - rng.randrange(9)]) for _ in range(20))


def probes(rng, numbers):
    near = [(n + d) % MOD for n in numbers for d in (-HALF - 1, -HALF, 1 - HALF, -1, 0, 1)]
    return [*near, 0, MOD - 1, *(rng.randrange(MOD) for _ in range(40))]


def test_transfer_equals_fold():
    rng = random.Random(11)
    for _ in range(60):
        numbers = some_numbers(rng)
        starts, becomes = interval_maps.transfer(numbers)
        assert starts[0] == 0 and (np.diff(starts) > 0).all() and (np.diff(becomes) != 0).all()
        marks = np.array(probes(rng, numbers))
        assert interval_maps.applied(starts, becomes, marks).tolist() == [mark_after(numbers, h) for h in marks.tolist()]


@pytest.mark.parametrize("page", [1, 3, 1000])
def test_composition_equals_fold_over_pages(spark, page):
    rng = random.Random(page)
    runs = {(boot, node): some_numbers(rng) for boot in (1, 2) for node in range(3)}
    runs[3, 0] = some_numbers(rng)
    rows = [
        (1, boot, node, *p) for (boot, node), numbers in runs.items()
        for p in interval_maps.pages(*interval_maps.transfer(numbers), MOD, page)
    ]
    maps = spark.createDataFrame([(*r[:5], bytearray(r[5]), bytearray(r[6])) for r in rows], interval_maps.MAP_DDL)
    found = {}
    for r in interval_maps.composed(interval_maps.composed(maps, page), page).collect():
        found.setdefault(r.boot_id, []).append((r.low, r.until, np.frombuffer(r.starts, np.int64), np.frombuffer(r.becomes, np.int64)))
    for boot in (1, 2, 3):
        parts = sorted(found[boot], key=lambda p: p[0])
        assert [p[1] for p in parts] == [*(p[0] for p in parts[1:]), MOD] and parts[0][0] == 0
        assert all(len(p[2]) <= page and p[2][0] == p[0] for p in parts)
        numbers = [n for (b, _), run in sorted(runs.items()) if b == boot for n in run]
        starts, becomes = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        marks = np.array(probes(rng, numbers))
        assert interval_maps.applied(starts, becomes, marks).tolist() == [mark_after(numbers, h) for h in marks.tolist()]


def test_million_falling_numbers_and_a_jump(spark):
    """One arc per number: the case in which no slice's map is short."""
    n = 1_000_000
    numbers = F.when(F.col("id") == n // 2, F.lit(5)).otherwise(F.lit(HALF + 2 * n) - F.col("id"))
    rows = spark.range(n).select(
        F.lit(1).cast("bigint").alias("payload_id"), F.lit(1).cast("bigint").alias("boot_id"),
        numbers.alias("sequence_number"), F.col("id").alias("received_us"), F.col("id").alias("delivery_id"),
    )
    begin = time.time()
    disposed = sequence.sequence_disposition(rows, slices=9)
    got = {r.sequence_disposition: (r.n, r.missing) for r in disposed.groupBy("sequence_disposition").agg(
        F.count("*").alias("n"), F.sum("missing_before").alias("missing")).collect()}
    wall = time.time() - begin
    want = {}
    for d, m, _ in fold([5 if i == n // 2 else HALF + 2 * n - i for i in range(n)]):
        count, missing = want.get(d, (0, 0))
        want[d] = (count + 1, missing + m)
    assert got == want and wall < 120


def test_missing_ranges(spark):
    disposed = run(spark, {1: [3, 4, 9, 8], 2: [0, 1]})
    got = sorted(tuple(r)[1:] for r in sequence.missing_ranges(disposed).collect())
    assert got == [(1, 3, 0, 2, 3), (1, 9, 5, 8, 4)]


def test_loads_continue_from_stored_state(spark):
    rng = random.Random(3)
    sessions = {
        boot: unique(max(0, 50 + i + rng.choice([0, 0, -20, 7])) for i in range(80)) for boot in range(1, 6)
    }
    sessions[6] = unique(rng.randrange(MOD) for _ in range(80))
    rows = [(1, b, s, 1000 + at, 10_000 * b + at) for b, n in sessions.items() for at, s in enumerate(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in sequence.KEPT))
    whole = sequence.sequence_disposition(df, block_rows=16, slices=2)
    first, second = df.where("received_us < 1030"), df.where("received_us >= 1030")
    one = sequence.sequence_disposition(first.where("boot_id <> 5"), block_rows=16, slices=2)
    state = sequence.sequence_state(one)
    late_session = second.unionByName(first.where("boot_id = 5"))
    two = sequence.sequence_disposition(late_session, state, block_rows=16, slices=2)
    columns = ["delivery_id", "sequence_disposition", "missing_before", "high_water_before"]
    parts = one.select(*columns).unionByName(two.select(*columns))
    assert sorted(map(tuple, parts.collect()), key=str) == sorted(
        map(tuple, whole.select(*columns).collect()), key=str
    )
    after = sequence.merged_state(state, two)
    assert sorted(map(tuple, after.collect())) == sorted(
        tuple(r) for r in sequence.sequence_state(whole).select(*after.columns).collect()
    )
