"""Cross-entropy difference: a target and a background bigram model over one vocabulary score each document.

Both models interpolate a bigram and a unigram in the logarithm: MIX log p(w | v) + (1 - MIX) log p(v), up to what both share, with
p(w | v) = (n(vw) + m u(w)) / (c(v) + m), backed by a unigram u(w) = (c(w) + 1) / (N + V) that both models share, and p(v) = (c(v) + m) / (N + m V)
of their own. Unigrams are counted over the words that have a successor; V is the number of distinct words and the sentence mark. MIX is small,
since bigrams of few documents tell more about what was seen than about what is alike.
The models are matched: the background's counts are scaled to the target's number of words, or smoothing would favour the smaller one
wherever both know little. The target's counts come from the documents named in ``target``, the background's from all documents, and
**each document is scored without its own counts**, in both models: a target document gets what it would get had it been held out. A document's
score is the mean over its words of the target's loss less the background's, in nats: lower is closer to the target.

The loss difference is a sum of one term per bigram and one per context word. Tasks send every document's distinct grams, packed, to
buckets by hash, bigrams by that of their second word, whose own count is there too (for a frequent second word, by their own: its count is
broadcast); a bucket adds up the counts, works out each gram's term and returns partial sums per document. A bucket tells
words by 32 bits of hash more than its own, and a word's bigrams by 30. No text is
moved and no model is broadcast. Words and bigrams that make up 1 / HOT of all words or
more are at most HOT each by arithmetic; they are counted beforehand, broadcast and never sent, so a
pair that stands in every document is no hot bucket.

Defined results: null and empty texts and texts of white space have no words and score 0.0; each row is scored
on its own, so repeated rows repeat in the result and count twice in the models; rows with a null id are scored and
are never targets; without targets the target model is uniform; copies of a document keep their counts, a row leaves out its own only; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm.rows import _FACTORS, BROADCAST_IDS, give_back, mixed, slices
from telemark.session import settle

PRIOR, MIX = 1.0, 0.1
HOT = 4096
#: Grams that one task holds together.
BUCKET = 1_500_000
START = np.uint64(0x51_7C_C1_B7_27_22_0A_95)


def _hashed(text: str | None) -> np.ndarray:
    found = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def _grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, bigrams) of a text, one of each per word."""
    return _grams_of(_hashed(text))


def _grams_of(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.concatenate([[START], w[:-1]]) if len(w) else w
    return v, mixed(v * _FACTORS[0] + w * _FACTORS[1])


def _tally(keys: np.ndarray, target: np.ndarray):
    gram, at = np.unique(keys, return_inverse=True)
    return gram, np.bincount(at, minlength=len(gram)), np.bincount(at, weights=target, minlength=len(gram)).astype(np.int64)


COUNTS = pa.schema([("bucket", pa.int64()), ("gram", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])


def _sent(gram, n, t, buckets: int) -> pa.RecordBatch:
    at = (gram >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(at, kind="stable")
    gram, n, t, at = gram[order], n[order].astype(np.uint32), t[order].astype(np.uint32), at[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    ends = np.r_[starts[1:], len(at)] if len(at) else starts
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int64()), *(pa.array(cut(x), pa.binary()) for x in (gram, n, t))], schema=COUNTS)


def _words_counted(buckets: int):
    def work(batches):
        for b in batches:
            kept = [_grams(x)[0] for x in b.column(1).to_pylist()]
            target = np.repeat(b.column(2).to_numpy(zero_copy_only=False).astype(np.float64), [len(x) for x in kept])
            yield _sent(*_tally(np.concatenate([*kept, np.empty(0, np.uint64)]), target), buckets)

    return work


def _pairs_counted(buckets: int, hot):
    def work(batches):
        words = hot.value
        for b in batches:
            kept, target = [np.empty(0, np.uint64)], [np.empty(0)]
            for text, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                v, g = _grams(text)
                if len(v):
                    often = np.isin(v, words)
                    kept.append(g[often])
                    target.append(np.full(len(kept[-1]), float(t)))
            yield _sent(*_tally(np.concatenate(kept), np.concatenate(target)), buckets)

    return work


def _totals(pdf: pd.DataFrame) -> pd.DataFrame:
    gram = np.frombuffer(b"".join(pdf["gram"]), np.uint64)
    n, t = (np.frombuffer(b"".join(pdf[k]), np.uint32).astype(np.float64) for k in ("n", "t"))
    gram, at = np.unique(gram, return_inverse=True)
    return pd.DataFrame({"gram": gram.view(np.int64), "n": np.bincount(at, n, len(gram)).astype(np.int64), "t": np.bincount(at, t, len(gram)).astype(np.int64)})


class _Terms:
    """The loss difference's terms: of a bigram's counts and of a context's, without the document's own."""

    def __init__(self, vocabulary: int, prior: float, words: int, target_words: int) -> None:
        self.prior, self.all = prior, max(1, words + vocabulary)
        self.scale = target_words / words if target_words else 1.0

    def __call__(self, context: np.ndarray, n: np.ndarray, t: np.ndarray, low: np.ndarray) -> np.ndarray:
        """``low``: how often the bigram's second word is a context."""
        plus = np.where(context, self.prior, self.prior * (low + 1) / self.all)
        out = np.log(n * self.scale + plus)
        out -= np.log(t + plus)
        # a context is the bigram's condition and a word of the unigram
        return out * np.where(context, 1 - 2 * MIX, MIX)


MOVED = pa.schema([("bucket", pa.int64()), ("batch", pa.string()), ("docs", pa.binary()), ("words", pa.binary()), ("key", pa.binary()), ("at", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])
PARTIAL = "batch string, docs binary, words binary, sums binary"


def _places(sorted_values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked value stands, and whether it does."""
    if not len(sorted_values):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    place = np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)
    return place, sorted_values[place] == asked


def _moved(buckets: int, hot, terms: _Terms):
    """Per batch of rows: a head row with the ids, word counts and the hot grams' sums, and a row for each bucket met."""

    def work(batches):
        grams, totals, targets, often, often_n = hot.value
        number = 0
        for whole in batches:
            for b in slices(whole):
                name = f"{TaskContext.get().partitionId()}-{number}"
                number += 1
                key, to, doc, count, target, sums, n_words = [], [], [], [], [], np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
                for i, (text, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    w = _hashed(text)
                    v, g = _grams_of(w)
                    n_words[i] = len(v)
                    # the lowest bit tells contexts from bigrams
                    found, first, n = np.unique(np.concatenate([v | np.uint64(1), g & ~np.uint64(1)]), return_index=True, return_counts=True)
                    context = first < len(v)
                    second = np.where(context, found, np.concatenate([v, w])[first] | np.uint64(1))
                    at_word, frequent = _places(often, second)
                    place, known = _places(grams, found)
                    known &= context | frequent
                    if known.any():
                        at, own = place[known], n[known]
                        value = terms(context[known], totals[at] - own, targets[at] - own * t, often_n[at_word[known]])
                        sums[i] = (value * own).sum()
                    sent = ~known
                    found, context, second, frequent = found[sent], context[sent], second[sent], frequent[sent] & ~context[sent]
                    low = np.where(context, np.uint64(1), (found & np.uint64(0xFFFFFFFC)) | frequent.astype(np.uint64) << np.uint64(1))
                    key.append(second >> np.uint64(32) << np.uint64(32) | low)
                    to.append((mixed(np.where(frequent, found, second)) >> np.uint64(20)) % np.uint64(buckets))
                    doc.append(np.full(len(found), i, np.uint16))
                    count.append(n[sent])
                    target.append(np.full(len(found), t, np.uint8))
                key, to, doc, count, target = map(np.concatenate, (key, to, doc, count, target))
                # a count takes one byte; a larger one is several entries
                more = (np.maximum(count, 1) + 254) // 255
                if len(more) and more.max() > 1:
                    rest = count - 255 * (more - 1)
                    last = np.cumsum(more) - 1
                    key, to, doc, target, count = *(np.repeat(x, more) for x in (key, to, doc, target)), np.full(more.sum(), 255)
                    count[last] = rest
                order = np.argsort(to, kind="stable")
                key, doc, count, target, to = (x[order] for x in (key, doc, count.astype(np.uint8), target, to.astype(np.int64)))
                ids = np.array([-1 if x is None else x for x in b.column(0).to_pylist()], np.int64)
                nulls = np.array([x is None for x in b.column(0).to_pylist()], np.uint8)
                rows = [(xxhash.xxh3_64_intdigest(name) % buckets, name, ids.tobytes() + nulls.tobytes(), n_words.tobytes(), sums.tobytes(), b"", b"", b"")]
                starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
                for x, y in zip(starts, [*starts[1:], len(to)], strict=False):
                    rows.append((int(to[x]), name, None, None, key[x:y].tobytes(), doc[x:y].tobytes(), count[x:y].tobytes(), target[x:y].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MOVED, strict=True)], schema=MOVED)
        give_back()

    return work


def _summed(terms: _Terms, hot):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = pdf["docs"].notna()
        out = pdf.loc[heads, ["batch", "docs", "words", "key"]].rename(columns={"key": "sums"})
        body = pdf[~heads]
        if not len(body):
            return out
        read = lambda k, t: np.frombuffer(b"".join(body[k]), t)
        key = read("key", np.uint64)
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        distinct = key[starts]
        del key
        n = read("n", np.uint8)
        total = np.add.reduceat(n[order], starts, dtype=np.int64)
        # the counts of the bigrams' second words: here, or among the frequent ones
        word = distinct >> np.uint64(32)
        at, here = _places(distinct, word << np.uint64(32) | np.uint64(1))
        low = np.where(here, total[at], 0)
        _, _, _, often, often_n = hot.value
        if len(often):
            by = np.argsort(often >> np.uint64(32))
            at, known = _places((often >> np.uint64(32))[by], word)
            frequent = known & (distinct >> np.uint64(1) & np.uint64(1)).astype(bool)
            low = np.where(frequent, often_n[by][at], low)
        context = (distinct & np.uint64(1)).astype(bool)
        t, doc = read("t", np.uint8), read("at", np.uint16)
        ends = np.cumsum([len(x) // 2 for x in body["at"]])
        own = n[order].astype(np.int32)
        group = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(order)]))
        target = np.add.reduceat(own * t[order], starts, dtype=np.int64)
        # a count of over 254 is several entries of one document, which leave out all of them
        split = np.flatnonzero(np.isin(group, group[own == 255]))
        if len(split):
            row = np.searchsorted(ends, order[split], side="right") << 16 | doc[order[split]]
            _, at = np.unique(np.stack([group[split], row]), axis=1, return_inverse=True)
            own[split] = np.bincount(at.ravel(), own[split])[at.ravel()]
        value = np.empty(len(order))
        value[order] = terms(context[group], total[group] - own, target[group] - own * t[order], low[group])
        value *= n
        sums = []
        for a, z in zip([0, *ends[:-1]], ends, strict=True):
            sums.append(np.bincount(doc[a:z], value[a:z], int(doc[a:z].max()) + 1).tobytes())
        out = pd.concat([out, pd.DataFrame({"batch": body["batch"], "docs": None, "words": None, "sums": sums})])
        give_back()
        return out

    return work


def _scored(pdf: pd.DataFrame) -> pd.DataFrame:
    """One batch's rows: partial sums of each bucket, in the order of the sums' bytes so that addition repeats."""
    head = pdf[pdf["docs"].notna()].iloc[0]
    words = np.frombuffer(head["words"], np.int64)
    ids = np.frombuffer(head["docs"][: 8 * len(words)], np.int64)
    nulls = np.frombuffer(head["docs"][8 * len(words) :], np.uint8).astype(bool)
    total = np.zeros(len(words))
    for raw in sorted(pdf["sums"]):
        x = np.frombuffer(raw, np.float64)
        total[: len(x)] += x
    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "score": total / np.maximum(1, words), "n_words": words})
    out.loc[nulls, "doc_id"] = pd.NA
    return out


def marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, text, target): target ids are broadcast up to a counted bound and joined otherwise."""
    ids = settle(target.where("doc_id is not null").select("doc_id").distinct(), "target").withColumn("_t", F.lit(1))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left").select(
        "doc_id", "text", F.coalesce("_t", F.lit(0)).alias("target")
    )


def cross_entropy_difference(docs: DataFrame, target: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(doc_id, score, n_words) of every row of ``docs``; ``target`` has the ids of the target's documents."""
    spark = docs.sparkSession
    rows = marked(docs, target)
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = "bucket long, gram binary, n binary, t binary"
    words = settle(rows.mapInArrow(_words_counted(wide), counted).groupBy("bucket").applyInPandas(_totals, "gram long, n long, t long"), "words")
    vocabulary, total, aimed = words.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "t"))).first()
    least = max(1, total / HOT)
    often = words.where(F.col("n") >= least).toPandas()  # at most HOT rows
    hot = spark.sparkContext.broadcast(np.sort(often["gram"].to_numpy(np.int64).view(np.uint64)))
    pairs = rows.mapInArrow(_pairs_counted(wide, hot), counted).groupBy("bucket").applyInPandas(_totals, "gram long, n long, t long").where(F.col("n") >= least).toPandas()
    terms = _Terms(vocabulary, prior, total, aimed)
    gram = np.concatenate([often["gram"].to_numpy(np.int64).view(np.uint64) | np.uint64(1), pairs["gram"].to_numpy(np.int64).view(np.uint64) & ~np.uint64(1)])
    n, t = (np.concatenate([often[k], pairs[k]]).astype(np.int64) for k in ("n", "t"))
    order = np.argsort(gram)
    by = np.argsort(often["gram"].to_numpy(np.int64).view(np.uint64) | np.uint64(1))
    frequent = (often["gram"].to_numpy(np.int64).view(np.uint64) | np.uint64(1))[by], often["n"].to_numpy(np.int64)[by]
    table = spark.sparkContext.broadcast((gram[order], n[order], t[order], *frequent))
    buckets = max(wide, math.ceil(2 * total / BUCKET))
    moved = rows.mapInArrow(_moved(buckets, table, terms), "bucket long, batch string, docs binary, words binary, key binary, at binary, n binary, t binary")
    partial = moved.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_summed(terms, table), PARTIAL)
    return partial.groupBy("batch").applyInPandas(_scored, "doc_id long, score double, n_words long")
