"""Exact n-gram Jaccard join of whole texts by a token-group matrix.

Texts with equal shingle sets form one class, and the class's smallest id stands for it. Classes that
collide in min-hash bands are compared with one leader per bucket, a star and never all
pairs; what links becomes a provisional component, and what collides, linked or not, a family. Families are cut into groups of some 32
classes, of one component where that is large. Groups of one family are compared with each other directly, a row for
each two groups. Across families, the matrix holds the shingles that occur in more than one family. If two sets reach the threshold t, at least l of the
first ``n - ceil(t n) + l`` shingles of each, in a common order, are in both; l is a twentieth
of n, so a class meets a member of a group only if t/20 of its size lies in the group's token union within
these rows of the matrix. For each group that this leaves, the overlap with the whole union bounds every member's
overlap; only groups that pass are opened and their members compared exactly. One link to a group suffices, as its members are already connected.

The order puts the shingles that many classes share last. It is only an order: any common order finds
every link, so a bounded list of such shingles loses nothing.

Defined results: a null text, an empty one and one of white space have no shingles and are linked with
nothing; rows with a null id come back with a null component, all in one row; several rows
of one id count as one document with all their links (``n_shingles`` is the largest);
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemark.llm.components import components
from telemark.llm.rows import alike, bands, map_arrow, only, permuted, shingles
from telemark.session import settle

#: Min-hashes of the grouping bands, and rows per band.
HASHES, BAND_ROWS = 32, 4
GROUP = 32
#: Shingles below this share of the hash range are counted for the order: a prefix takes a quarter of a text, and
#: reaches past that share only where more than three fifths of the text are common shingles. It costs time, never a link.
COUNTED = 0.62
#: The part of a set that must be met in the matrix.
MET = 20
#: A shingle of at least so many classes goes to the end of the order; the list's largest size (2 MB).
COMMON, MOST_COMMON = 24, 2**18
#: Matrix entries and counted shingles that one task holds together.
BUCKET = 2_000_000


def _described(width: int):
    def work(ids, texts):
        out = {"doc_id": [], "n": [], "sig": [], "bands": []}
        for i, text in zip(ids, texts, strict=True):
            s = shingles(text, width)
            out["doc_id"].append(i)
            out["n"].append(len(s))
            out["sig"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["bands"].append(bands(permuted(s, HASHES), BAND_ROWS) if len(s) else None)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))]))

    return work


def _split(values: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by multiplication, so that a low part of the range spreads too."""
    return ((values * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)).astype(np.int64) % buckets


def _counted(width: int, buckets: int):
    limit = np.uint64(int(COUNTED * 2**64))

    def work(texts):
        low = [s[: np.searchsorted(s, limit)] for s in (shingles(t, width) for t in texts)]
        token, n = np.unique(np.concatenate(low), return_counts=True)
        at = _split(token, buckets)
        order = np.argsort(at, kind="stable")
        token, n, at = token[order], np.minimum(n[order], 255).astype(np.uint8), at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        ends = [*starts[1:], len(at)]
        yield pa.RecordBatch.from_pydict(
            {"bucket": [int(at[a]) for a in starts], "token": [token[a:b].tobytes() for a, b in zip(starts, ends, strict=False)], "n": [n[a:b].tobytes() for a, b in zip(starts, ends, strict=False)]},
            pa.schema([("bucket", pa.int64()), ("token", pa.binary()), ("n", pa.binary())]),
        )

    return work


def _common_of(pdf: pd.DataFrame) -> pd.DataFrame:
    token = np.frombuffer(b"".join(pdf["token"]), np.uint64)
    n = np.frombuffer(b"".join(pdf["n"]), np.uint8)
    token, at = np.unique(token, return_inverse=True)
    n = np.bincount(at, weights=n, minlength=len(token)).astype(np.int64)
    keep = n >= COMMON
    return pd.DataFrame({"token": token[keep].view(np.int64), "n": n[keep]})


def _prefix(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + l shingles, the common ones last and each part by hash."""
    n = len(s)
    take = n - -(-percent * n // 100) + max(1, n // MET)
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    late = common[at] == s if len(common) else np.zeros(n, bool)
    return np.concatenate([s[~late][:take], s[late]])[:take]


def _entries(width: int, percent: int, buckets: int, common):
    def work(ids, texts):
        last = common.value
        token, doc, size = [], [], []
        for i, text in zip(ids, texts, strict=True):
            s = shingles(text, width)
            if len(s):
                p = _prefix(s, last, percent)
                token.append(p)
                doc.append(np.full(len(p), i, np.int64))
                size.append(np.full(len(p), len(s), np.int32))
        if not token:
            return
        token, doc, size = map(np.concatenate, (token, doc, size))
        at = _split(token, buckets)
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        ends = [*starts[1:], len(at)]
        cut = lambda x: [x[order][a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"bucket": [int(at[a]) for a in starts], "token": cut(token), "doc": cut(doc), "size": cut(size)},
            pa.schema([("bucket", pa.int64()), *((k, pa.binary()) for k in ("token", "doc", "size"))]),
        )

    return work


def _shared_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entries of the shingles that stand in more than one document."""
    token = np.frombuffer(b"".join(pdf["token"]), np.uint64)
    doc = np.frombuffer(b"".join(pdf["doc"]), np.int64)
    size = np.frombuffer(b"".join(pdf["size"]), np.int32)
    _, at, n = np.unique(token, return_inverse=True, return_counts=True)
    keep = n[at] > 1
    return pd.DataFrame({"token": token[keep].view(np.int64), "doc_id": doc[keep], "size": size[keep]})


def _candidates_of(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(query, group) of the entries of one bucket and how many shingles they share there: rows at every distance
    within a shingle's run that lie in different families and pass the size filter."""
    pdf = pdf.sort_values(["token", "family", "doc_id"], kind="stable")
    token, family, comp = pdf["token"].to_numpy(), pdf["family"].to_numpy(), pdf["component"].to_numpy()
    doc, group = pdf["doc_id"].to_numpy(), pdf["grp"].to_numpy()
    size = pdf["size"].to_numpy().astype(np.int64)
    found, step = [], 1
    rows = np.arange(max(0, len(pdf) - 1))
    while len(rows):
        rows = rows[rows + step < len(token)]
        rows = rows[token[rows] == token[rows + step]]
        a, b = rows, rows + step
        ok = (family[a] != family[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
        a, b = a[ok], b[ok]
        if len(a):
            found.append(np.stack([doc[b], comp[b], group[a], size[b], token[a]], axis=1))
            if sum(map(len, found)) > 4_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
        step += 1
    if not found:
        return pd.DataFrame({k: [] for k in ("query", "mine", "grp", "size", "hits")})
    hits = pd.DataFrame(np.concatenate(found), columns=["query", "mine", "grp", "size", "token"]).drop_duplicates()
    return hits.groupby(["query", "mine", "grp", "size"], as_index=False).agg(hits=("token", "size"))


def _arrays(width: int):
    def work(ids, texts):
        yield pa.RecordBatch.from_pydict(
            {"doc_id": ids, "s": [shingles(t, width).tobytes() for t in texts]},
            pa.schema([("doc_id", pa.int64()), ("s", pa.binary())]),
        )

    return work


def _met(s: np.ndarray, i: int, mine: int, union: np.ndarray, ids, comps, sets, percent: int, known: dict):
    """Links of one set to the members of a group, at most one to each component; none without opening it if the union's bound rules it out."""
    if len(sets) > 1 and 100 * np.isin(s, union, assume_unique=True).sum() < percent * len(s):
        return
    for j, c, x in zip(ids, comps, sets, strict=True):
        a, b = _root(known, mine), _root(known, c)
        if a != b and alike(s, x, percent):
            known[max(a, b)] = min(a, b)
            yield i, j


def _root(known: dict, x: int) -> int:
    while x in known:
        x = known[x]
    return x


def _sets_of(raws) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in raws]


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _opened(percent: int):
    def work(queries, mine, arrays, ids, comps, sets):
        out = []
        for q, own, raw, i, c, x in zip(queries, mine, arrays, ids, comps, sets, strict=True):
            parts = _sets_of(x)
            union = np.unique(np.concatenate(parts))
            out += _met(np.frombuffer(raw, np.uint64), q, own, union, i, c, parts, percent, {})
        yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, LINKS)

    return work


def _compared(percent: int):
    """Every set of one group against another group (or its own)."""

    def work(ids, comps, sets, other_ids, other_comps, other_sets):
        out = []
        for i, c, x, j, d, y in zip(ids, comps, sets, other_ids, other_comps, other_sets, strict=True):
            parts, known = _sets_of(y), {}
            union = np.unique(np.concatenate(parts))
            for k, mine, s in zip(i, c, _sets_of(x), strict=True):
                out += _met(s, k, mine, union, j, d, parts, percent, known)
        yield pa.RecordBatch.from_pydict({"a": [a for a, _ in out], "b": [b for _, b in out]}, LINKS)

    return work


def _fetched(texts: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, s) of the ids asked for."""
    return settle(map_arrow(only(texts, settle(ids.distinct(), "need")).select("doc_id", "text"), _arrays(width), "doc_id long, s binary"), "sets")


def _unions(members: DataFrame, arrays: DataFrame) -> DataFrame:
    """One row per group: at most some 32 members, by the groups' making."""
    rows = members.join(arrays, "doc_id").groupBy("grp").agg(F.collect_list(F.struct("doc_id", "component", "s")).alias("m"))
    return rows.select("grp", F.col("m.doc_id").alias("ids"), F.col("m.component").alias("comps"), F.col("m.s").alias("sets"))


def _links(texts: DataFrame, asked: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """``asked`` (query, mine, grp) against the members in ``groups`` (grp, doc_id, component)."""
    members = asked.select("grp").distinct().join(groups, "grp")
    arrays = _fetched(texts, asked.select(F.col("query").alias("doc_id")).union(members.select("doc_id")), width)
    rows = asked.join(arrays.withColumnRenamed("doc_id", "query"), "query").join(_unions(members, arrays), "grp").select("query", "mine", "s", "ids", "comps", "sets")
    return settle(map_arrow(rows, _opened(percent), "a long, b long"), "links")


def _family_links(texts: DataFrame, groups: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between the groups of a family, where these hold more than one component."""
    blocks = groups.groupBy("family", "grp").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = blocks.groupBy("family").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("family")
    blocks = settle(blocks.join(mixed, "family"), "blocks")
    other = blocks.select("family", F.col("grp").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = blocks.join(other, "family").where("grp <= other and not (low = high and low2 = high2 and low = low2)").select("grp", "other")
    members = blocks.select("grp").join(groups.select("grp", "doc_id", "component"), "grp")
    unions = settle(_unions(members, _fetched(texts, members.select("doc_id"), width)), "unions")
    second = unions.select(F.col("grp").alias("other"), F.col("ids").alias("ids2"), F.col("comps").alias("comps2"), F.col("sets").alias("sets2"))
    rows = pairs.join(unions, "grp").join(second, "other").select("ids", "comps", "sets", "ids2", "comps2", "sets2")
    return settle(map_arrow(rows, _compared(percent), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document id; see the module's text."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    described = settle(map_arrow(docs, _described(width), "doc_id long, n long, sig binary, bands array<long>"), "described")
    named = described.where("doc_id is not null and sig is not null")
    firsts = named.groupBy("sig").agg(F.min("doc_id").alias("rep"))
    classes = settle(named.select("doc_id", "n", "sig").join(firsts, "sig").select("doc_id", "rep", "n").distinct(), "classes")
    reps = classes.where("doc_id = rep").select("doc_id").distinct()
    copies = classes.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    banded = (
        named.select("doc_id", "sig", F.explode("bands").alias("band"))
        .join(reps.select("doc_id"), "doc_id", "left_semi")
        .select("doc_id", "band")
    )
    leaders = banded.groupBy("band").agg(F.min_by("doc_id", F.xxhash64("doc_id", "band")).alias("leader"), F.count("*").alias("size")).where("size > 1")
    stars = settle(banded.join(leaders, "band").where("doc_id <> leader").select("doc_id", "leader").distinct(), "stars")
    texts = docs.where("doc_id is not null")
    asked = stars.select(F.col("doc_id").alias("query"), F.col("doc_id").alias("mine"), F.col("leader").alias("grp"))
    own = stars.select(F.col("leader").alias("grp"), F.col("leader").alias("doc_id"), F.col("leader").alias("component")).distinct()
    linked = _links(texts, asked, own, width, percent)
    start = components(linked)
    families = components(stars.select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))).select(F.col("id").alias("doc_id"), F.col("component").alias("family"))

    placed = (
        reps.join(start.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(families, "doc_id", "left")
        .select("doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("family", "doc_id").alias("family"))
    )
    sizes = start.groupBy("component").agg(F.count("*").alias("size"))
    placed = placed.join(sizes, "component", "left").withColumn("large", F.coalesce(F.col("size") > GROUP, F.lit(False)))
    rest = placed.where("not large").groupBy("family").agg(F.count("*").alias("rest")).where(F.col("rest") > 1)
    # large components in groups of their own, what is left of a family in common ones
    alone = F.xxhash64("component", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / GROUP)))
    common_ones = F.xxhash64("family", F.lit("rest"), F.pmod(F.xxhash64("component"), F.ceil(F.coalesce("rest", F.lit(1)) / GROUP)))
    groups = settle(
        placed.join(rest, "family", "left").select("doc_id", "component", "family", F.when(F.col("large"), alone).otherwise(common_ones).alias("grp")), "groups"
    )
    within = _family_links(texts, groups, width, percent)

    total = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * COUNTED / BUCKET))
    counts = map_arrow(texts.select("text"), _counted(width, buckets), "bucket long, token binary, n binary")
    ranked = counts.groupBy("bucket").applyInPandas(_common_of, "token long, n long").orderBy(F.desc("n"), "token")
    common = ranked.limit(MOST_COMMON).toPandas()["token"].to_numpy(np.int64)
    common = spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))
    entries = map_arrow(texts, _entries(width, percent, buckets, common), "bucket long, token binary, doc binary, size binary")
    shared = entries.groupBy("bucket").applyInPandas(_shared_of, "token long, doc_id long, size int")
    matrix = shared.join(groups, "doc_id").dropDuplicates(["token", "doc_id"])
    spread = matrix.groupBy("token").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low < high")
    crossing = matrix.join(spread.select("token"), "token").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)))
    met = crossing.groupBy("bucket").applyInPandas(lambda pdf: _candidates_of(pdf, percent), "query long, mine long, grp long, size long, hits long")
    least = F.greatest(F.lit(1), F.floor(F.col("size") * percent / 100 / MET))
    asked = met.groupBy("query", "mine", "grp", "size").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= least)
    asked = settle(asked.select("query", "mine", "grp").distinct(), "asked")
    found = _links(texts, asked, groups.select("grp", "doc_id", "component"), width, percent)
    ends = components(linked.unionByName(within).unionByName(found).unionByName(copies))
    sized = described.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    return sized.join(ends.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
