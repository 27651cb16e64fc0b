"""Quality by a linear-chain conditional random field over lines.

A text is the chain of its lines, each good or bad. A line's features are binned measures of its own and of the
lines before and after it; the chain adds a weight for each pair of neighbouring labels. Every line of a
labelled document carries the document's label in training. The score of a document is the
mean of its lines' forward-backward marginals of "good", weighted by line length.

Weights are fitted on the driver from at most ``most`` labelled documents (the first by a hash of their id), of which only the
lines' bins travel; everything else runs in tasks over whole texts.

Defined results: a null text or an empty one is one empty line and is scored like any line; a row with a null id is scored and never
learned from; ids labelled both ways are not learned from; without rows of both labels every
score is the share of good labels (0.5 if there are none); repeated rows are scored each; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemark.llm.rows import give_back, map_arrow, slices
from telemark.session import settle

#: Labelled documents to learn from, at most, and their lines; one document may bring a 400th of the lines.
MOST_LEARNED, MOST_LINES = 6000, 400_000
BINS = 8

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_POINTS = b".,;:?'\"()-"
_SYMBOLS = b"!#$%&*+/<=>@[\\]^_`{|}~"
_HIGH = bytes(range(128, 256))
#: Upper bounds of the bins of each measure.
_SHARE = (0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.6)
_EDGES = np.array([
    (0, 12, 30, 80, 200, 500, 1500),  # characters
    (0, 1, 3, 8, 20, 60, 200),  # words
    (1, 2, 3.5, 4.5, 5.5, 7, 10),  # mean word length
    _SHARE, _SHARE, _SHARE, _SHARE, _SHARE,  # upper, digits, points, symbols, bytes beyond ASCII
    (0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),  # distinct words
    _SHARE,  # words equal to the one before
    _SHARE,  # words that end in a symbol
    (0, 0.1, 0.2, 0.3, 0.45, 0.6, 0.9),  # words of up to three letters
    (0, 1, 2, 3, 4, 5, 6),  # ends in a full stop
    (0, 1, 2, 4, 8, 16, 64),  # equal lines before it
])
MEASURES = len(_EDGES)


def _measures(line: str, seen: int) -> tuple:
    raw = line.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    share = lambda kind: (len(raw) - len(raw.translate(None, kind))) / n
    found = raw.split()
    k = max(1, len(found))
    same = sum(a == b for a, b in zip(found, found[1:], strict=False))
    ends = b" ".join([x[-1:] for x in found])
    return (
        len(raw), len(found), sum(map(len, found)) / k, share(_UPPER), share(_DIGIT), share(_POINTS), share(_SYMBOLS), share(_HIGH),
        len(set(found)) / k, same / k, (len(ends) - len(ends.translate(None, _SYMBOLS))) / k,
        sum(len(x) < 4 for x in found) / k, 1 if line.rstrip().endswith((".", "?", "。")) else 0, seen,
    )


def _lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bins [lines, MEASURES], weights) of a text."""
    seen: dict[str, int] = {}
    rows, size = [], []
    for line in (text or "").split("\n"):
        key = line if len(line) < 4096 else str(hash(line))
        at = seen.get(key, 0)
        seen[key] = at + 1
        rows.append(_measures(line, at))
        size.append(len(line) + 1)
    x = np.array(rows, np.float64)
    return (x[:, :, None] > _EDGES[None]).sum(axis=2).astype(np.uint8), np.array(size, np.float64)


@dataclass
class Model:
    weights: np.ndarray | None  # [3 places, MEASURES, BINS + 1]; bin BINS: no such line
    pairs: np.ndarray  # [2, 2]
    bias: float
    prior: float

    def unary(self, bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Weight of "good" of each line; ``first`` and ``last`` mark the ends of the chains."""
        return self.bias + sum(
            self.weights[p, m, around[:, m]] for p, around in enumerate(_around(bins, first, last)) for m in range(MEASURES)
        )


def _around(bins, first, last):
    """A line's own bins, those of the line before and those of the line after."""
    none = np.uint8(BINS)
    before, after = np.roll(bins, 1, axis=0), np.roll(bins, -1, axis=0)
    return bins, np.where(first[:, None], none, before), np.where(last[:, None], none, after)


def _chains(lengths: np.ndarray):
    """Chains by falling length: (starts, lengths), so that the active ones are a prefix at every step."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    return starts[order], lengths[order]


def _marginals(u: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, want_pairs: bool = False):
    """P(good) of every line and, on request, the expected counts of label pairs."""
    starts, sizes = _chains(lengths)
    good = 1 / (1 + np.exp(-np.clip(u, -30, 30)))
    e, m = np.stack([1 - good, good], axis=1), np.exp(pairs)
    alpha, scale = np.empty_like(e), np.empty(len(e))
    steps = int(sizes[0]) if len(sizes) else 0
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # chains longer than t
    for t in range(steps):
        at = starts[: live[t]] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ m) * e[at]
        c = a.sum(axis=1)
        alpha[at], scale[at] = a / c[:, None], c
    beta, expected = np.ones_like(e), np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        ahead = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = ahead @ m.T
        if want_pairs:
            expected += np.einsum("ni,ij,nj->ij", alpha[at], m, ahead)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), expected


def fit(bins: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 120, rate: float = 0.15, ridge: float = 2.0) -> Model:
    """Maximum likelihood with a ridge, by Adam; chains count by the root of their length."""
    good = float(np.mean(labels == 1)) if len(labels) else 0.5
    if len(labels) == 0 or good in (0.0, 1.0):
        return Model(None, np.zeros((2, 2)), 0.0, good)
    model = Model(np.zeros((3, MEASURES, BINS + 1)), np.zeros((2, 2)), 0.0, good)
    ends = np.cumsum(lengths)
    first, last = np.zeros(len(bins), bool), np.zeros(len(bins), bool)
    first[ends - lengths], last[ends - 1] = True, True
    around = [a.astype(np.int64) for a in _around(bins, first, last)]
    y, share = np.repeat(labels, lengths), np.repeat(1 / np.sqrt(lengths), lengths)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (lengths[labels == k] - 1).sum()
    flat = np.zeros(3 * MEASURES * (BINS + 1) + 5)
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for i in range(1, rounds + 1):
        p, expected = _marginals(model.unary(bins, first, last), lengths, model.pairs, True)
        rest = (y - p) * share
        grad = np.concatenate([
            *(np.bincount(a[:, m], rest, BINS + 1) for a in around for m in range(MEASURES)),
            ((seen - expected) / np.sqrt(lengths.mean())).ravel(), [rest.sum()],
        ]) - ridge * flat
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        flat = flat + rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
        flat[-5:-1] = np.clip(flat[-5:-1], -1.5, 1.5)
        model.weights, model.pairs, model.bias = flat[:-5].reshape(3, MEASURES, BINS + 1), flat[-5:-1].reshape(2, 2), float(flat[-1])
    return model


def _described(ids, texts):
    bins = [_lines(t)[0] for t in texts]
    yield pa.RecordBatch.from_pydict({"doc_id": ids, "bins": [b.tobytes() for b in bins]}, pa.schema([("doc_id", pa.int64()), ("bins", pa.binary())]))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LEARNED) -> Model:
    """``labels`` (doc_id, quality 0 or 1), those to learn from only."""
    named = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    taken = settle(named.where("quality = _most").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "learned")
    texts = docs.select("doc_id", "text").join(F.broadcast(taken.select("doc_id")), "doc_id", "left_semi")
    rows = map_arrow(texts, _described, "doc_id long, bins binary").join(F.broadcast(taken), "doc_id").where(F.length("bins") <= MEASURES * MOST_LINES // 400)
    got = rows.orderBy(F.xxhash64("doc_id"), "bins").limit(most).toPandas()
    bins = [np.frombuffer(b, np.uint8).reshape(-1, MEASURES) for b in got["bins"]]
    lengths = np.array([len(b) for b in bins], np.int64)
    keep = np.cumsum(lengths) <= MOST_LINES
    return fit(np.concatenate([np.empty((0, MEASURES), np.uint8), *(b for b, k in zip(bins, keep, strict=True) if k)]), lengths[keep], got["quality"].to_numpy(np.int64)[keep])


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.weights is None:
        return np.full(len(texts), model.prior)
    found = [_lines(t) for t in texts]
    lengths = np.array([len(b) for b, _ in found], np.int64)
    if not len(lengths):
        return np.empty(0)
    bins, size = np.concatenate([b for b, _ in found]), np.concatenate([w for _, w in found])
    ends = np.cumsum(lengths)
    first, last = np.zeros(len(bins), bool), np.zeros(len(bins), bool)
    first[ends - lengths], last[ends - 1] = True, True
    p, _ = _marginals(model.unary(bins, first, last), lengths, model.pairs)
    return np.clip(np.add.reduceat(p * size, ends - lengths) / np.add.reduceat(size, ends - lengths), 0.0, 1.0)


def held_out(column: str = "doc_id") -> Column:
    """Rows kept for the test: crc32 of the id as text leaves 1 by 3."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def crf_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LEARNED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = learn(docs, labels.where(~held_out()), most)

    def work(ids, texts):
        s = scores(model, texts)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": ids, "held_out": [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids], "score": s, "predicted": (s >= 0.5).astype(np.int32)},
            pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]),
        )

    return map_arrow(docs.select("doc_id", "text"), work, "doc_id long, held_out boolean, score double, predicted int")


def good_only(docs: DataFrame, labels: DataFrame, most: int = MOST_LEARNED) -> DataFrame:
    """The rows of ``docs`` the field does not reject, with their own columns only."""
    model = learn(docs, labels.where(~held_out()), most)
    schema = docs.schema
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                keep = scores(model, part.column(names.index("text")).to_pylist()) >= 0.5
                yield part.filter(pa.array(keep))
        give_back()

    return docs.mapInArrow(run, schema)
