"""Which keys are stored, and by whom, without reading what they belong to.

A ledger holds one small row per key: the key, its owner and the owner's digest. Each load adds a level: rows in hash buckets, as many
buckets as keep ``BUCKET_KEYS`` rows in one, sorted by key, and a Bloom filter per bucket. Levels of like size are
merged, so there are as many as the logarithm of the number of keys. A lookup asks the filters first, bucket by bucket; only keys that may be
there are joined, and only with the buckets that they fall into.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemark.sources.schemas import struct
from telemark.streaming.commits import Commits, Load, Snapshot

#: Keys of a bucket, the most buckets of a level, and a level's size over the next one's from which they stay apart.
BUCKET_KEYS, MOST_BUCKETS, APART = 1_000_000, 1 << 16, 4
#: Bits of a filter per key, and positions set for each: one absent key in a hundred passes.
BITS, PROBES = 10, 7
BLOOM = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())])


def _positions(h: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return (h.view(np.uint64) + steps * (g.view(np.uint64) | np.uint64(1))) % np.uint64(size)


def _filter(pdf: pd.DataFrame) -> pd.DataFrame:
    size = max(64, -(-len(pdf) * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    bits[_positions(pdf["_h"].to_numpy(), pdf["_g"].to_numpy(), size).ravel().astype(np.int64)] = True
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})


def _may_hold(asked: pa.Table, filters: pa.Table) -> pa.Table:
    if not filters.num_rows or not asked.num_rows:
        return asked.slice(0, 0)
    bits = np.unpackbits(np.frombuffer(filters.column("bits")[0].as_py(), np.uint8)).astype(bool)
    at = _positions(asked.column("_h").to_numpy(), asked.column("_g").to_numpy(), len(bits)).astype(np.int64)
    return asked.filter(pa.array(bits[at].all(axis=0)))


class KeyLedger:
    """The keys of one kind under a ``Commits``. ``keys`` and ``values`` are DDL; a key has one row."""

    def __init__(self, commits: Commits, name: str, keys: str, values: str) -> None:
        self.commits, self.name = commits, name
        self.keys = struct(keys)
        self.schema = T.StructType([*self.keys.fields, *struct(values).fields])
        self.columns, self.key = self.schema.names, self.keys.names

    def _hashed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_h": F.xxhash64(*self.key), "_g": F.xxhash64(F.lit(self.name), *self.key)})

    def _levels(self, at: Snapshot) -> list[dict]:
        """Newest first: folder, rows and buckets of each level."""
        return [json.loads(level) for level in at.folders.get(self.name, [])]

    def _rows(self, level: dict) -> DataFrame:
        wide = T.StructType([*self.schema.fields, T.StructField("bucket", T.LongType())])
        return self.commits.spark.read.schema(wide).parquet(f"{self.commits.root}/{level['folder']}/rows")

    def lookup(self, asked: DataFrame, at: Snapshot) -> DataFrame:
        """Rows of the asked keys (``asked``: the key columns) that are stored."""
        asked = self._hashed(asked.select(*self.key).dropna().distinct())
        found = self.commits.spark.createDataFrame([], self.schema)
        for level in self._levels(at):
            placed = asked.withColumn("bucket", F.pmod("_h", F.lit(level["buckets"])))
            filters = self.commits.spark.read.schema(BLOOM).parquet(f"{self.commits.root}/{level['folder']}/filters")
            maybe = placed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_may_hold, placed.schema).persist()
            # at most ``MOST_BUCKETS`` numbers; the rows' folders are pruned by them
            met = [r.bucket for r in maybe.select("bucket").distinct().collect()]
            rows = self._rows(level).where(F.col("bucket").isin(met)) if met else self._rows(level).where("false")
            found = found.unionByName(rows.join(maybe.select("bucket", *self.key), ["bucket", *self.key], "left_semi").select(*self.columns))
        return found

    def add(self, load: Load, rows: DataFrame) -> None:
        """One more level from ``rows``, whose keys are not stored yet; levels of like size become one."""
        rows, size = rows.select(*self.columns), rows.count()
        levels = self._levels(load.seen)
        if not size:
            return
        while levels and levels[0]["rows"] < APART * size:
            rows = rows.unionByName(self._rows(levels[0]).select(*self.columns))
            size += levels.pop(0)["rows"]
        buckets = min(MOST_BUCKETS, -(-size // BUCKET_KEYS))
        folder = load.new_folder(self.name)
        path = f"{self.commits.root}/{folder}"
        placed = self._hashed(rows).withColumn("bucket", F.pmod("_h", F.lit(buckets)))
        sorted_rows = placed.drop("_h", "_g").repartition(buckets, "bucket").sortWithinPartitions("bucket", *self.key)
        sorted_rows.write.partitionBy("bucket").parquet(f"{path}/rows")
        level = {"folder": folder, "rows": size, "buckets": buckets}
        written = self._hashed(self._rows(level)).select("bucket", "_h", "_g")
        written.groupBy("bucket").applyInPandas(_filter, BLOOM).write.parquet(f"{path}/filters")
        load.folders[self.name] = [json.dumps(level), *(json.dumps(old) for old in levels)]
