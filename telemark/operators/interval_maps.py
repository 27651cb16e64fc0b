"""What a run of numbers does to any incoming high-water mark, as interval maps composed in a tree.

A map covers the marks 0 .. 2^32 - 1 with arcs; an arc says what its marks become, or that they stay as they are. The map of
a slice is built from its last number back: number s sends every mark it advances to what the rest of the slice makes of s, which is
one bisection and one half circle overwritten. A falling run leaves one arc per number, so maps are kept in pages of bounded
size: ``(low, until, starts, becomes)`` covers the marks from ``low`` to before ``until``.

Maps of neighbouring slices are composed pairwise in rounds, as many as the number of slices has binary digits. In a round a left page
is cut at the right map's page bounds, asks the right pages that its arcs lead to, and the answers form pages again; no task
holds more than two pages' arcs and the list of one map's page bounds. Going back down, the mark that enters a right sibling
is the left sibling's map at the mark that enters their parent: one page is read per slice and round.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.session import settle

MODULUS, HALF_RANGE = 1 << 32, 1 << 31
#: Arcs of a page.
PAGE = 1 << 18
SAME = -1
SESSION = ["payload_id", "boot_id"]
MAP_DDL = "payload_id bigint, boot_id bigint, node bigint, low bigint, until bigint, starts binary, becomes binary"


def transfer(numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, becomes) of the arcs over all marks; ``SAME`` where a mark stays."""
    starts, becomes = [0], [SAME]

    def overwrite(first: int, last: int, value: int) -> None:
        i = bisect_left(starts, first)
        j = bisect_right(starts, last + 1)
        after = [] if last + 1 == MODULUS or (j and starts[j - 1] == last + 1) else [last + 1]
        tail = becomes[j - 1]
        j = j if after else bisect_left(starts, last + 1)
        starts[i:j] = [first, *after]
        becomes[i:j] = [value, *([tail] if after else [])]

    for s in reversed(numbers):
        value = becomes[bisect_right(starts, s) - 1]
        value = s if value == SAME else value
        first, last = (s - HALF_RANGE + 1) % MODULUS, (s - 1) % MODULUS
        if first <= last:
            overwrite(first, last, value)
        else:
            overwrite(first, MODULUS - 1, value)
            overwrite(0, last, value)
    return merged(np.array(starts, np.int64), np.array(becomes, np.int64))


def merged(starts: np.ndarray, becomes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.r_[True, becomes[1:] != becomes[:-1]]
    return starts[keep], becomes[keep]


def pages(starts: np.ndarray, becomes: np.ndarray, until: int, size: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    for at in range(0, len(starts), size):
        end = int(starts[at + size]) if at + size < len(starts) else until
        yield int(starts[at]), end, starts[at : at + size].tobytes(), becomes[at : at + size].tobytes()


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def slice_maps(slices: DataFrame, order: list[str], page: int | None = None) -> DataFrame:
    """``slices`` (session, node, number and ``order``), a bounded number of rows per node -> pages."""
    size = page or PAGE

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        numbers = pdf.sort_values(order)["sequence_number"].tolist()
        rows = list(pages(*transfer(numbers), MODULUS, size))
        out = pd.DataFrame(rows, columns=["low", "until", "starts", "becomes"])
        for k, name in enumerate([*SESSION, "node"]):
            out.insert(k, name, pdf[name].iloc[0])
        return out

    return slices.groupBy(*SESSION, "node").applyInPandas(run, MAP_DDL)


# -- one round up -------------------------------------------------------------

_ROUTED = [*SESSION, "node", "region", "until", "asked", "at", "first", "last"]
_ROUTED_DDL = (
    "payload_id bigint, boot_id bigint, node bigint, region bigint, until bigint, asked bigint, at binary, first binary, last binary"
)


def _route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a left page at the right map's bounds and sorts its arcs by the right page they lead to.

    An arc that becomes v asks for v alone (``first`` = v, ``last`` = -1); an arc that stays asks for its own marks. Without a
    right sibling the arcs are their own answers (``asked`` is NULL, ``first`` is what they become)."""
    for batch in batches:
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            starts, becomes = _array(row["starts"]), _array(row["becomes"])
            own = [row["payload_id"], row["boot_id"], row["node"] // 2]
            out = []
            if row["lows"] is None:
                out.append([*own, row["low"], row["until"], None, starts.tobytes(), becomes.tobytes(), b""])
            else:
                lows = np.array(row["lows"], np.int64)
                cuts = lows[(lows > row["low"]) & (lows < row["until"])]
                ends = np.r_[starts[1:], row["until"]] - 1
                bounds = np.unique(np.r_[starts, cuts])
                arc = np.searchsorted(starts, bounds, side="right") - 1
                last = np.minimum(ends[arc], np.r_[bounds[1:], row["until"]] - 1)
                fixed = becomes[arc] != SAME
                first = np.where(fixed, becomes[arc], bounds)
                last = np.where(fixed, SAME, last)
                regions = np.r_[row["low"], cuts]
                region = np.searchsorted(regions, bounds, side="right") - 1
                asked = np.searchsorted(lows, first, side="right") - 1
                order = np.lexsort((bounds, asked, region))
                change = np.flatnonzero(np.r_[True, (np.diff(region[order]) != 0) | (np.diff(asked[order]) != 0)])
                for part in np.split(order, change[1:]):
                    r = int(region[part[0]])
                    end = int(regions[r + 1]) if r + 1 < len(regions) else row["until"]
                    out.append([
                        *own, int(regions[r]), end, int(lows[asked[part[0]]]),
                        bounds[part].tobytes(), first[part].tobytes(), last[part].tobytes(),
                    ])
            columns = list(zip(*out, strict=True))
            types = [pa.int64()] * 6 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_ROUTED)


def applied(starts: np.ndarray, becomes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    value = becomes[np.searchsorted(starts, marks, side="right") - 1]
    return np.where(value == SAME, marks, value)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the right page makes of the arcs that ask it."""
    for batch in batches:
        for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
            at, first, last = (_array(row[c]) for c in ("at", "first", "last"))
            if row["asked"] is None:
                begin, value = at, first
            else:
                starts, becomes = _array(row["starts"]), _array(row["becomes"])
                fixed = last == SAME
                lo = np.searchsorted(starts, first[~fixed], side="right") - 1
                hi = np.searchsorted(starts, last[~fixed], side="right")
                arc = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                begin = np.r_[at[fixed], np.maximum(starts[arc], np.repeat(first[~fixed], hi - lo))]
                value = np.r_[applied(starts, becomes, first[fixed]), becomes[arc]]
            yield pa.RecordBatch.from_pydict({
                **{c: [row[c]] for c in (*SESSION, "node", "region", "until")}, "starts": [begin.tobytes()], "becomes": [value.tobytes()],
            })


def _assembled(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        starts, becomes = (np.concatenate([_array(raw) for raw in pdf[c]]) for c in ("starts", "becomes"))
        order = np.argsort(starts, kind="stable")
        rows = list(pages(*merged(starts[order], becomes[order]), int(pdf["until"].iloc[0]), size))
        out = pd.DataFrame(rows, columns=["low", "until", "starts", "becomes"])
        for k, name in enumerate([*SESSION, "node"]):
            out.insert(k, name, pdf[name].iloc[0])
        return out

    return run


def composed(maps: DataFrame, page: int | None = None) -> DataFrame:
    """Maps of the next level: node n is node 2n, then node 2n + 1."""
    left, right = maps.where("node % 2 = 0"), maps.where("node % 2 = 1").withColumn("node", F.col("node") - 1)
    bounds = right.groupBy(*SESSION, "node").agg(F.sort_array(F.collect_list("low")).alias("lows"))
    routed = left.join(bounds, [*SESSION, "node"], "left").select(*left.columns, "lows").mapInArrow(_route, _ROUTED_DDL)
    answering = right.select(*SESSION, F.expr("node div 2").alias("node"), F.col("low").alias("asked"), "starts", "becomes")
    answered = routed.join(answering, [*SESSION, "node", "asked"], "left").select(*_ROUTED, "starts", "becomes").mapInArrow(
        _answer, "payload_id bigint, boot_id bigint, node bigint, region bigint, until bigint, starts binary, becomes binary"
    )
    return answered.groupBy(*SESSION, "node", "region").applyInPandas(_assembled(page or PAGE), MAP_DDL)


# -- and down -----------------------------------------------------------------


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [
            int(applied(_array(starts), _array(becomes), np.array([entry]))[0])
            for entry, starts, becomes in zip(*(batch.column(c).to_pylist() for c in ("entry", "starts", "becomes")), strict=True)
        ]
        kept = [batch.column(c) for c in SESSION]
        node = [n + 1 for n in batch.column("node").to_pylist()]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(node, pa.int64()), pa.array(out, pa.int64())], names=[*SESSION, "node", "entry"])


def entries(maps: DataFrame, marks: DataFrame, top: int, page: int | None = None) -> DataFrame:
    """The mark that enters each node of ``maps`` (0 .. top), given the ``entry`` of each session: (session, node, entry)."""
    levels = [settle(maps, "maps")]
    while top:
        top //= 2
        levels.append(settle(composed(levels[-1], page), "maps"))
    known = marks.withColumn("node", F.lit(0).cast("bigint")).select(*SESSION, "node", "entry")
    for level in reversed(levels[:-1]):
        known = known.withColumn("node", F.col("node") * 2)
        own = level.where("node % 2 = 0").join(known, [*SESSION, "node"]).where("low <= entry and entry < until")
        after = own.select(*SESSION, "node", "entry", "starts", "becomes").mapInArrow(
            _entered, "payload_id bigint, boot_id bigint, node bigint, entry bigint"
        )
        present = level.where("node % 2 = 1 and low = 0").select(*SESSION, "node")
        known = settle(known.unionByName(after.join(present, [*SESSION, "node"], "left_semi")), "entries")
    return known
