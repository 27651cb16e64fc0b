"""How five filters overlap, in every order: Lehmer-rank difference arrays.

A document's failures are a mask of five bits. In the order of lexicographic rank r the document goes at the first
step whose filter is in the mask. The orders that begin with the same filters are consecutive ranks, so "gone at step s by
filter f" covers, for each prefix of s - 1 filters outside the mask followed by f, one interval of (5 - s)! ranks. A mask's
count is added where an interval begins and taken off where it ends; a running sum over the 120 ranks gives the removals
of every order at once. Counts of masks (32 at most, four kinds of labels) are all that a part sends to this step.

Copies are found by a 128-bit hash of the text. Rows are first counted per text, id and labels, then per text and labels, so a
text that a third of all rows share leaves each task as a few rows.

Defined results: a null text is an empty one, a null source the part of the empty string; rows repeating one id and text
do not fail E by each other; a row with a null id neither fails E nor makes another fail it, and has no
labels; rows of one id with different texts stand each for themselves; repeated label rows count once, as 1 if any of
them says 1; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm.rows import map_arrow
from telemark.session import settle

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FLAGS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
AUDIT = pa.schema([
    ("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), ("kept", pa.int64()), ("removed", pa.int64()),
    ("redundant", pa.int64()), ("unique_fails", pa.int64()), ("good_lost", pa.int64()), ("toxic_lost", pa.int64()), ("shapley", pa.int64()),
])
AUDIT_DDL = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def failures(text: str) -> int:
    """Bits 0 to 3: the conditions A to D."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (n < 50)
        | (100 * len(set(words)) < 65 * n) << 1
        | (100 * capitals > 5 * len(text)) << 2
        | (SYMBOLS.search(raw) is not None) << 3
    )


def _flags(ids, sources, texts):
    out: tuple[list, ...] = ([], [], [], [], [])
    for i, source, text in zip(ids, sources, texts, strict=True):
        h = xxhash.xxh3_128_intdigest((text or "").encode("utf-8", "surrogatepass"))
        for column, value in zip(out, (i, source or "", failures(text or ""), (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63), strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, FLAGS, strict=True)], schema=FLAGS)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by failures (bits A to E) and labels."""
    flags = map_arrow(docs.select("doc_id", "source", "text"), _flags, "doc_id long, part string, mask int, high long, low long")
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(
        *(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic")))
    )
    text, kind = ["high", "low"], ["part", "mask", "good", "toxic"]
    zero = F.lit(0)
    rows = flags.join(marked, "doc_id", "left").withColumns({"good": F.coalesce("good", zero), "toxic": F.coalesce("toxic", zero)})
    by_id = rows.groupBy(*text, *kind, "doc_id").agg(F.count("*").alias("c"))
    grouped = settle(
        by_id.groupBy(*text, *kind).agg(
            F.sum("c").alias("n"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("c"))).alias("no_id"),
            F.min("doc_id").alias("first"), F.min_by("c", "doc_id").alias("at_first"),
        ),
        "texts",
    )
    firsts = grouped.groupBy(*text).agg(F.min("first").alias("_first"), F.count("*").alias("_kinds")).where("_kinds > 1").drop("_kinds")
    # the smallest id of a text is one of its own kind's ids unless the text has several kinds
    least = F.coalesce("_first", "first")
    stays = F.when(F.col("first") == least, F.col("at_first")).otherwise(zero) + F.coalesce("no_id", zero)
    split = grouped.join(firsts, text, "left").select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), F.coalesce(stays, zero).cast("long").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.coalesce(stays, zero)).cast("long").alias("n")),
        )).alias("m"),
    )
    return split.groupBy("part", F.col("m.mask").alias("mask"), "good", "toxic").agg(F.sum("m.n").alias("n"))


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of all orders that remove the mask at that step (from 0)."""
    n, out = len(FILTERS), []

    def grow(prefix: tuple[int, ...], start: int) -> None:
        step = len(prefix)
        for nth, f in enumerate(f for f in range(n) if f not in prefix):
            width = factorial(n - 1 - step)
            begin = start + nth * width
            out.extend((mask, step, begin, begin + width) for mask in range(1 << n) if mask >> f & 1 and not any(mask >> p & 1 for p in prefix))
            grow((*prefix, f), begin)

    grow((), 0)
    return out


def removals(counts: np.ndarray) -> np.ndarray:
    """``counts`` [..., mask] -> [..., step, rank]: what each step of each order removes."""
    mask, step, begin, end = np.array(intervals()).T
    steps, ranks = len(FILTERS), len(ORDERS)
    change = np.zeros((steps * (ranks + 1), *counts.shape[:-1]), np.int64)
    gain = np.moveaxis(counts[..., mask], -1, 0)
    np.add.at(change, step * (ranks + 1) + begin, gain)
    np.subtract.at(change, step * (ranks + 1) + end, gain)
    change = change.reshape(steps, ranks + 1, *counts.shape[:-1]).cumsum(axis=1)[:, :ranks]
    return np.moveaxis(change, (0, 1), (-2, -1))


#: The filter at each step of each order.
_AT = np.array([[FILTERS.index(o[s]) for o in ORDERS] for s in range(len(FILTERS))])


def _audited(parts, kinds):
    """Up to ``SLICE`` parts at once are cut into a few, since each makes 600 rows."""
    steps, ranks = _AT.shape
    for begin in range(0, len(parts), 64):
        some = parts[begin : begin + 64]
        counts = np.zeros((len(some), 3, 1 << steps), np.int64)
        for k, part in enumerate(kinds[begin : begin + 64]):
            for r in part:
                counts[k, :, r["mask"]] += np.array([1, r["good"], r["toxic"]]) * r["n"]
        gone = removals(counts)  # part, kind, step, rank
        every = counts[:, 0]
        fails = np.stack([every[:, [m for m in range(1 << steps) if m >> f & 1]].sum(axis=1) for f in range(steps)], axis=1)
        alone = every[:, [1 << f for f in range(steps)]]
        removed = gone[:, 0]
        shapley = np.stack([(removed * (f == _AT)).sum(axis=(1, 2)) for f in range(steps)], axis=1)
        kept = every.sum(axis=1)[:, None, None] - removed.cumsum(axis=1)
        values = [kept, removed, fails[:, _AT] - removed, alone[:, _AT], gone[:, 1], gone[:, 2], shapley[:, _AT]]
        columns = [
            pa.array(np.repeat(np.array(some, object), steps * ranks), pa.string()),
            pa.array(ORDERS * (steps * len(some)), pa.string()),
            pa.array(np.tile(np.repeat(np.arange(1, steps + 1), ranks), len(some)), pa.int32()),
            *(pa.array(v.ravel(), pa.int64()) for v in values),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see ``AUDIT``. ``shapley`` is the sum over all orders of what the step's filter removes."""
    counts = mask_counts(docs, labels)
    # 128 entries a part at most: 32 masks, four kinds of labels
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("kinds"))
    return map_arrow(parts, _audited, AUDIT_DDL)


AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    concat(CASE WHEN len(w) < 50 THEN 'A' ELSE '' END,
           CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
           CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END,
           CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
           CASE WHEN d.doc_id > first_id THEN 'E' ELSE '' END) AS fails
  FROM worded d LEFT JOIN marked m ON d.doc_id = m.doc_id),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, s::INT AS step, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS earlier FROM orders, range(1, 6) r(s)),
passed AS (
  SELECT part, o, step, f, n, good, toxic, fails,
    fails LIKE '%' || f || '%' AS hit, len(translate(earlier, fails, '')) < len(earlier) AS gone
  FROM counted, steps),
summed AS (
  SELECT part, o, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost
  FROM passed GROUP BY part, o, step, f)
SELECT part, o AS filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""
