"""Arrow batches in and out of Python tasks, and whole-text helpers shared by the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of texts handled at once inside a task, one row at least; an Arrow batch may hold more.
SLICE, SLICE_BYTES = 1024, 4 << 20
#: Ids that may be broadcast: about 24 MB as a hashed relation.
BROADCAST_IDS = 1_000_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of up to ``SLICE`` rows and ``SLICE_BYTES`` of texts."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy()
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        end = min(max(upto, at + 1), at + SLICE)
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Memory that a worker holds but no longer uses, back to the system: workers live longer than tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` takes the columns of one of the ``slices`` as lists and yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from work(*(c.to_pylist() for c in part.columns))
        give_back()

    return df.mapInArrow(run, schema)


def only(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (one distinct long column of that name, already
    written). Broadcast up to ``BROADCAST_IDS`` of them by count, an ordinary semi join beyond."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split on space and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_FACTORS = np.random.default_rng(5).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` make one
    shingle of the whole sequence, no words make none."""
    found = words(text)
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    take = min(width, n)
    s = np.full(n - take + 1, take, np.uint64)
    for j in range(take):
        s += h[j : n - take + 1 + j] * _FACTORS[j]
    return np.unique(mixed(s))


@cache
def _permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, k, dtype=np.uint64)[:, None]


def permuted(s: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """``k`` min-hashes of a non-empty shingle set."""
    a, b = _permutations(k, seed)
    out = None
    for at in range(0, len(s), 4096):
        x = a * s[at : at + 4096]
        x += b
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        low = x.min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def bands(signature: np.ndarray, rows: int) -> list[int]:
    """One signed 64-bit key per band of ``rows`` min-hashes; the band number is part of it."""
    raw, step = signature.tobytes(), 8 * rows
    return [xxhash.xxh3_64_intdigest(raw[at : at + step], seed=at) - 2**63 for at in range(0, len(raw) - step + 1, step)]


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, for sorted distinct arrays that are not empty."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of whole texts. Arrow batches get as many rows as are handled at once: by default they hold 10,000 texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE))
    return spark.read.parquet(f"{folder}/{table}.parquet")
