"""Blocked and sliced ordered operators against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from telemark.operators import scale
from telemark.session import settle


def sample(spark, n=400, keys=3, seed=1):
    rng = random.Random(seed)
    # one key holds most rows, order numbers have holes
    rows = [(rng.choice([0, 0, 0, *range(keys)]), i * rng.randrange(1, 4) + i * 3, rng.randrange(99))
            for i in range(n)]
    rows = list({o: (k, o, v) for k, o, v in rows}.values())
    return rows, spark.createDataFrame(rows, "k bigint, o bigint, v bigint")


def by_key(rows):
    groups = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(k, []).append((o, v))
    return groups


def test_blocked_row_number(spark):
    rows, df = sample(spark)
    got = {(r.k, r.o): r.n for r in scale.blocked_row_number(df, ["k"], "o", "n", 32).collect()}
    assert got == {(k, o): i for k, g in by_key(rows).items() for i, (o, _) in enumerate(g)}


def test_blocked_lag(spark):
    rows, df = sample(spark, seed=2)
    got = {(r.k, r.o): r.p for r in scale.blocked_lag(df, ["k"], "o", "v", "p", 32).collect()}
    want = {}
    for k, g in by_key(rows).items():
        for i, (o, _) in enumerate(g):
            want[(k, o)] = g[i - 1][1] if i else None
    assert got == want


def test_ordered_lag_with_ties(spark):
    rows, df = sample(spark, seed=3)
    tied = df.withColumn("t", F.col("o") % 2)
    got = {(r.k, r.o): r.p for r in scale.ordered_lag(tied, ["k"], ["t", "o"], "v", "p", 6).collect()}
    want = {}
    for k, g in by_key(rows).items():
        g = sorted(g, key=lambda r: (r[0] % 2, r[0]))
        for i, (o, _) in enumerate(g):
            want[(k, o)] = g[i - 1][1] if i else None
    assert got == want


def test_group_facts_with_null_keys(spark):
    rows = spark.createDataFrame([(i, i % 3 or None) for i in range(30)], "id bigint, k bigint")
    facts = spark.createDataFrame([(1, 10, "one")], "k bigint, n bigint, f string").select(
        "k", "n", F.struct("f").alias("fact"))
    got = {r.id: r.fact for r in scale.attach_group_facts(rows, facts, ["k"], row_id="id").collect()}
    assert len(got) == 30
    assert all((v is not None and v.f == "one") == (i % 3 == 1) for i, v in got.items())


def test_settle_uses_the_configured_folder(spark):
    table = settle(spark.range(5), "probe")
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert all(folder in f for f in table.inputFiles()) and table.count() == 5
