"""Hard negatives by threshold joins in the manner of L2AP.

Scores are integer inner products. Rows with the same vector and label are one class, and a class shows at most as many of its
ids as a list can take; anchors with the same vector and label ask once. Blocks of anchors meet blocks of rows, one task for
each two blocks. In a task:

* **Index.** Dimensions go by falling energy, in groups. A row is indexed up to the group from which the norm of its rest is below
  the lowest threshold over an anchor's norm; the dimensions after it are covered by that bound and left out, whole rows
  included. Rows sorted by what is indexed make every group's list a prefix.
* **Search.** Groups' products add up to partial scores. After each group a row goes when for no anchor its partial score plus the product
  of the norms of both rests reaches the anchor's threshold. What is left is scored exactly.
* **Thresholds.** Each anchor starts near the top of its windows and goes on with lower thresholds only while a window holds too few.

Positives come first: per anchor class the best same-label rows of score 0 or more (a negative score admits no
negatives). A first join with one block of rows each, chosen by hash, gives every window a score that its last place has at least;
the join with all blocks does not go below it. Each block's best are merged by rank.

Defined results: see ``usable`` for what takes no part; rows equal in id, label and vector are one row; anchors
of one id with different vectors or labels ask each for themselves, and may be positives or negatives of each other; vectors meet only vectors of the same length (others have no inner product); an empty vector scores 0; rows whose integers have a squared norm of 2^62 or
more take no part, since their scores would leave the long range; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemark.llm.rows import map_arrow
from telemark.session import settle

POSITIVES, NEGATIVES, LABELS = 5, 10, 10
#: Percent of the positive's score that a negative must and may have at most.
LOW, HIGH = 30, 90
#: Dimensions of an index group, anchors searched at once, and rows of a block: the fewest and the most.
GROUP, CHUNK, FEWEST, MOST = 8, 32, 2048, 65_536
#: Blocks that a table is cut into while that keeps blocks between these bounds.
BLOCKS = 48
#: Share of the way from the top of the scores to their floor at which each search stops.
LEVELS = (0.2, 0.45, 0.7, 1.0)
SLACK = 1e-9
ROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("dims", pa.int32()), ("x", pa.binary())])
FOUND = pa.schema([(n, pa.int64()) for n in ("high", "low", "positive_score", "vec_id", "score", "row_high", "row_low")])
FOUND_DDL = "high long, low long, positive_score long, vec_id long, score long, row_high long, row_low long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, high, low, dims, x): rows with an id, a label and finite components, as integers; ``high`` and ``low`` name the class.

    Where ``vec_id`` is divisible by 7 the label is another one, so that lists hold rows marked wrongly."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % LABELS).otherwise(label)
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return map_arrow(rows, _integers, "vec_id long, label long, high long, low long, dims int, x binary")


def _integers(ids, labels, vectors):
    out: tuple[list, ...] = ([], [], [], [], [], [])
    for i, label, vector in zip(ids, labels, vectors, strict=True):
        x = np.array(vector, float)  # null becomes nan
        if not np.isfinite(x).all():
            continue
        x = np.floor(256 * x)
        if x @ x >= 2.0**62:
            continue
        raw = x.astype("<i8").tobytes()
        h = xxhash.xxh3_128_intdigest(raw + label.to_bytes(8, "little", signed=True))
        for column, value in zip(out, (i, label, (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, len(x), raw), strict=True):
            column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ROW, strict=True)], schema=ROW)


class Index:
    """Rows' leading dimension groups, as far as no bound covers the rest; ``floor`` is the lowest threshold over an anchor's norm."""

    def __init__(self, rows: np.ndarray, floor: float) -> None:
        n, dims = rows.shape
        self.cuts = list(range(0, dims, GROUP)) + [dims]
        self.order = np.argsort(-np.einsum("ij,ij->j", rows, rows), kind="stable")
        rows = rows[:, self.order]
        rest = self.rests(rows)
        # suffix norms fall, so the groups whose own suffix reaches the floor come first
        indexed = (rest[:, :-1] * (1 + SLACK) >= floor).sum(axis=1)
        if floor <= 0:
            indexed[:] = len(self.cuts) - 1
            self.kept = np.arange(n)
        else:
            self.kept = np.argsort(-indexed, kind="stable")[: int((indexed > 0).sum())]
        self.rows, self.rest, self.indexed = rows[self.kept], rest[self.kept], indexed[self.kept]

    def rests(self, rows: np.ndarray) -> np.ndarray:
        """[row, group]: the norm of the dimensions from that group on; 0 at the end."""
        squares = np.stack([np.einsum("ij,ij->i", rows[:, a:], rows[:, a:]) for a in self.cuts], axis=1)
        return np.sqrt(squares)

    def search(self, anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, row) places of all pairs whose score may reach the anchor's threshold, few others."""
        anchors = anchors[:, self.order]
        own = self.rests(anchors)
        bound = least - SLACK * (1 + np.abs(least)) - SLACK * own[:, 0] * (self.rest[:, 0].max() if len(self.rest) else 0.0)
        alive, indexed = np.arange(len(self.kept)), self.indexed
        partial = np.zeros((len(anchors), len(alive)))
        for g in range(len(self.cuts) - 1):
            part = slice(self.cuts[g], self.cuts[g + 1])
            have = int(np.searchsorted(-indexed[alive], -g, side="left"))  # rows with more than g groups indexed
            if not have:
                break
            partial[:, :have] += anchors[:, part] @ self.rows[alive[:have], part].T
            upto = np.minimum(indexed[alive], g + 1)
            able = (partial + own[:, upto] * self.rest[alive, upto] >= bound[:, None]).any(axis=0)
            alive, partial = alive[able], partial[:, able]
        upto = indexed[alive]
        a, b = np.nonzero(partial + own[:, upto] * self.rest[alive, upto] >= bound[:, None])
        return a, self.kept[alive[b]]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows."""
    return np.einsum("ij,ij->i", a, b)


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group: highest score, then smallest id."""
    order = np.lexsort((ids, -score, group))
    ranked = group[order]
    begin = np.r_[0, np.flatnonzero(np.diff(ranked)) + 1] if len(ranked) else np.empty(0, np.int64)
    rank = np.arange(len(ranked)) - np.repeat(begin, np.diff(np.r_[begin, len(ranked)]))
    return order[rank < k]


def _windows_of(anchors: int, window_anchor: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, pair): every window of each pair's anchor; windows are sorted by anchor."""
    begin = np.searchsorted(window_anchor, np.arange(anchors + 1))
    times = np.diff(begin)[a]
    pair = np.repeat(np.arange(len(a)), times)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
    return begin[a][pair] + nth, pair


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dims)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def block_search(anchors: np.ndarray, windows: tuple[np.ndarray, ...], anchor_label: np.ndarray, rows: np.ndarray, row_label: np.ndarray, row_id: np.ndarray, same: bool, k: int):
    """(window, row) places of each window's first ``k`` rows of the block.

    ``windows`` are the anchor's place (sorted), lowest and highest score allowed, and the score below which nothing is asked for."""
    owner, lowest, highest, floor = windows
    floor = np.maximum(lowest, floor)
    real, table = anchors.astype(float), rows.astype(float)
    norm = np.sqrt(_exact(real, real))
    base = np.full(len(anchors), np.inf)
    np.minimum.at(base, owner, floor)
    top = np.full(len(anchors), -np.inf)
    np.maximum.at(top, owner, highest)
    wide = np.sqrt(_exact(table, table)).max(initial=0.0) if len(table) else 0.0
    top = np.minimum(top, norm * wide * (1 + SLACK) + 1)
    asks = np.flatnonzero((base <= top) & np.isfinite(base))
    if not len(asks) or not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    index = Index(table, float(np.min(base[asks] / np.maximum(norm[asks], 1e-300))))
    out_w, out_r = [], []
    for at in range(0, len(asks), CHUNK):
        open_ones = asks[at : at + CHUNK]
        for level in LEVELS:
            least = np.floor(top[open_ones] + (base[open_ones] - top[open_ones]) * level) if level < 1 else base[open_ones]
            a, r = index.search(real[open_ones], least)
            a = open_ones[a]
            ok = (anchor_label[a] == row_label[r]) == same
            a, r = a[ok], r[ok]
            score = _exact(anchors[a], rows[r])
            w, pair = _windows_of(len(anchors), owner, a)
            inside = (floor[w] <= score[pair]) & (score[pair] <= highest[w])
            w, pair = w[inside], pair[inside]
            best = _best(w, score[pair], row_id[r[pair]], k)
            w, pair = w[best], pair[best]
            # a window is settled when the k best at or above the threshold are there, or the threshold is its floor
            threshold = np.full(len(anchors), np.inf)
            threshold[open_ones] = least
            full = np.bincount(w[score[pair] >= threshold[owner[w]]], minlength=len(owner)) >= k
            done = full | (floor >= threshold[owner]) | ~np.isin(owner, open_ones)
            settled = np.ones(len(anchors), bool)
            np.logical_and.at(settled, owner, done)
            finished = settled[a[pair]]
            out_w.append(w[finished])
            out_r.append(r[pair][finished])
            open_ones = open_ones[~settled[open_ones]]
            if not len(open_ones):
                break
    return np.concatenate(out_w), np.concatenate(out_r)


def _joined(same: bool, k: int):
    """Cogrouped blocks: windows of anchors (with vectors) on the left, rows on the right."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        dims = left.column("dims")[0].as_py()
        high, low, owner_first = _column(left, "high"), _column(left, "low"), None
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        fresh = np.r_[True, (np.diff(high) != 0) | (np.diff(low) != 0)]
        owner, owner_first = np.cumsum(fresh) - 1, order[fresh]
        take = lambda n: _column(left, n)[order]
        w, r = block_search(
            _matrix(left.column("x").take(pa.array(owner_first)), dims),
            (owner, take("lowest"), take("highest"), take("floor")), _column(left, "label")[owner_first],
            _matrix(right.column("x"), dims), _column(right, "label"), _column(right, "vec_id"), same, k,
        )
        x, y = _matrix(left.column("x"), dims)[order[w]], _matrix(right.column("x").take(pa.array(r)), dims)
        columns = [high[w], low[w], take("positive_score")[w], _column(right, "vec_id")[r], _exact(x, y), _column(right, "row_high")[r], _column(right, "row_low")[r]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=FOUND)

    return run


def _join(windows: DataFrame, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """``windows`` carries ``block`` (rows to meet) and ``part`` (its own block of anchors), ``rows`` carries ``block`` and ``part`` too."""
    keys = ["dims", "block", "part"]
    return windows.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_joined(same, k), FOUND_DDL)


def _blocks(n: int) -> int:
    return max(1, -(-n // max(FEWEST, min(MOST, -(-n // BLOCKS)))))


def _every(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors: ids divisible by ``every``."""
    key = ["high", "low"]
    rows = settle(usable(vectors).groupBy("vec_id", *key).agg(*(F.first(c).alias(c) for c in ("label", "dims", "x"))), "vectors")
    shown = Window.partitionBy(*key).orderBy("vec_id")
    kept = rows.withColumn("nth", F.row_number().over(shown)).where(F.col("nth") <= max(negatives, positives + 1))
    blocks = _blocks(rows.count())
    kept = settle(kept.drop("nth").withColumn("block", F.pmod(F.xxhash64("vec_id", *key), F.lit(blocks)).cast("int")), "rows")
    anchors = settle(rows.where(F.col("vec_id") % every == 0).select("vec_id", *key), "anchors")
    asked = settle(rows.where(F.col("vec_id") % every == 0).groupBy(*key).agg(*(F.first(c).alias(c) for c in ("label", "dims", "x"))), "asked")
    parts = _blocks(asked.count())
    asked = asked.withColumn("part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))
    met = kept.select("vec_id", F.col("high").alias("row_high"), F.col("low").alias("row_low"), "label", "dims", "x", "block", _every(parts).alias("part"))
    home = F.pmod(F.xxhash64("low", "high"), F.lit(blocks)).cast("int")
    zero, none = F.lit(0).cast("long"), F.lit(-(2**62)).cast("long")

    def both(asks: DataFrame, same: bool, k: int) -> DataFrame:
        """The first ``k`` of every window, after a first look at one block."""
        window = [*key, "positive_score"]
        first = settle(_join(asks.withColumns({"block": home, "floor": none}), met, same, k), "first")
        filled = first.groupBy(*window).agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
        asks = asks.join(filled, window, "left").withColumn("floor", F.coalesce("floor", none))
        found = _join(asks.withColumn("block", _every(blocks)), met, same, k)
        return _ranked(found, window, k)

    # positives: one window of all scores from 0, under the name of score 0
    open_asks = asked.withColumns({"positive_score": zero, "lowest": zero, "highest": F.lit(2**62).cast("long")})
    near = settle(both(open_asks, True, positives + 1).select(*key, F.col("vec_id").alias("positive_id"), "score", "row_high", "row_low"), "near")
    scores = near.select(*key, F.col("score").alias("positive_score")).distinct()
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * percent / 100
    bounds = {"lowest": F.ceil(share(LOW)).cast("long"), "highest": F.floor(share(HIGH)).cast("long")}
    windows = settle(asked.join(scores, key).withColumns(bounds).where("lowest <= highest"), "windows")
    hard = settle(both(windows, False, negatives), "hard")
    own = Window.partitionBy("vec_id", *key).orderBy(F.col("score").desc(), "positive_id")
    chosen = (
        anchors.join(near, key).where("not (positive_id = vec_id and row_high = high and row_low = low)")
        .withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= positives)
        .select(F.col("vec_id").alias("anchor_id"), "positive_id", *key, F.col("score").alias("positive_score"))
    )
    return chosen.join(hard, [*key, "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


NEGATIVES_SQL = f"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS place
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same
  WHERE {LOW} * positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, place::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE place <= {NEGATIVES}
"""
