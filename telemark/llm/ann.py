"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are taken relative to the nearest of some centroids, turned by a random rotation and kept as the signs of
their components, packed, with two scalars: the distance to the centroid and the inner product of the code with the unit
vector it stands for. A query meets the codes of the centroids it probes in blocks of bounded size. The
inner product of its rotated residual with a code, divided by the code's scalar, estimates the distance, and the estimator's
error bound gives a lower and an upper limit. Every vector whose lower limit is not above the
k-th smallest upper limit of its block is measured exactly on the original components; the nearest of all blocks are the answer.

Centroids are fitted on at most ``sample`` distinct vectors (the first by a hash of their smallest id); every vector is indexed. How many centroids a query
probes is calibrated on the same sample: the fewest that hold ``recall`` of the true neighbours of every rank within it. A query whose
centroids hold fewer than k candidates goes on to all others. Equal vectors
share one code: of their ids only the k + 1 smallest can be among a query's k nearest, and only those are indexed, which loses nothing.

Defined results: null, zero and non-finite vectors, vectors with null components, and rows with a null id take no part, as queries or candidates; vectors of another
length than the most frequent one (the smaller of equals) take no part either; of several rows with one id the one with the
smallest vector counts; ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemark.session import settle

SAMPLE, RECALL = 16_384, 0.97
#: Vectors to a centroid of the sample, vectors and queries to a block.
PER_CENTROID, MOST_CENTROIDS, BLOCK, QUERY_BLOCK = 64, 256, 4096, 1024
#: Width of the error bound in standard deviations.
EPSILON = 2.5
K = 10


@dataclass
class Index:
    centroids: np.ndarray  # [c, d]
    rotation: np.ndarray  # [d, d]
    probes: int

    def assigned(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest centroids of each row, nearest first."""
        d = (self.centroids**2).sum(axis=1) - 2 * (x @ self.centroids.T)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def codes(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed signs, distance to the centroid, <code, unit residual>)."""
        r = x - self.centroids[at]
        length = np.linalg.norm(r, axis=1)
        turned = (r / np.where(length > 0, length, 1)[:, None]) @ self.rotation
        factor = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
        return np.packbits(turned > 0, axis=1), length, np.where(length > 0, factor, 1.0)


def _estimates(signs: np.ndarray, length: np.ndarray, factor: np.ndarray, queries: np.ndarray, centroid: np.ndarray, rotation: np.ndarray):
    """(lower, upper) limits of the squared distances, [queries, codes]."""
    d = queries.shape[1]
    r = queries - centroid
    far = np.linalg.norm(r, axis=1)
    turned = (r / np.where(far > 0, far, 1)[:, None]) @ rotation
    bits = np.unpackbits(signs, axis=1, count=d).astype(np.float64) * 2 - 1
    inner = (turned @ bits.T) / np.sqrt(d) / factor
    error = EPSILON * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / np.sqrt(max(1, d - 1))
    base, scale = far[:, None] ** 2 + length**2, 2 * far[:, None] * length
    return base - scale * np.minimum(1.0, inner + error) , base - scale * np.maximum(-1.0, inner - error)


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(((queries - vectors) ** 2).sum(axis=1))


def fit(sample: np.ndarray, k: int = K, recall: float = RECALL, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    c = max(1, min(MOST_CENTROIDS, n // PER_CENTROID))
    centroids = sample[rng.choice(n, c, replace=False)].copy()
    for _ in range(8):
        near = np.argmin((centroids**2).sum(axis=1) - 2 * (sample @ centroids.T), axis=1)
        count = np.bincount(near, minlength=c)
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        centroids = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], centroids)
    index = Index(centroids, rotation, c)
    asked = sample[:512]
    apart = (asked**2).sum(axis=1)[:, None] + (sample**2).sum(axis=1) - 2 * asked @ sample.T
    apart[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(apart, axis=1)[:, : min(k, max(0, n - 1))]
    rank = np.argsort(index.assigned(asked, c), axis=1)  # place of each centroid in a query's order
    home = index.assigned(sample, 1)[:, 0]
    needed = np.sort(np.take_along_axis(rank, home[near], axis=1), axis=0)
    if needed.size:
        index.probes = int(needed[int(np.ceil(recall * len(needed))) - 1].max()) + 1
    return index


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0.0))
    length = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.size("embedding") == (length.d if length else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _coded(index: Index):
    schema = pa.schema([("cluster", pa.int32()), ("vec_id", pa.int64()), ("code", pa.binary()), ("length", pa.float64()), ("factor", pa.float64()), ("embedding", pa.list_(pa.float64()))])

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            at = index.assigned(x, 1)[:, 0]
            signs, length, factor = index.codes(x, at)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), pa.array([s.tobytes() for s in signs], pa.binary()), pa.array(length), pa.array(factor), pa.array(list(x), pa.list_(pa.float64()))], schema=schema)

    return work


def _probed(index: Index, begin: int, end: int):
    """Queries at their nearest centroids from place ``begin`` to before ``end``."""
    schema = pa.schema([("cluster", pa.int32()), ("query_id", pa.int64()), ("query", pa.list_(pa.float64()))])

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            at = index.assigned(x, end)[:, begin:]
            n = at.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel(), pa.int32()), pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(list(np.repeat(x, n, axis=0)), pa.list_(pa.float64()))], schema=schema)

    return work


def _searched(index: Index, k: int):
    def work(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(codes):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, x = np.stack(queries["query"].to_list()), np.stack(codes["embedding"].to_list())
        ids, asked = codes["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        signs = np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1)
        lower, upper = _estimates(signs, codes["length"].to_numpy(), codes["factor"].to_numpy(), q, index.centroids[int(codes["cluster"].iloc[0])], index.rotation)
        own = asked[:, None] == ids
        lower[own] = upper[own] = np.inf
        least = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(q), np.inf)
        out = []
        for i in range(len(q)):
            take = np.flatnonzero((lower[i] <= least[i] * (1 + 1e-9) + 1e-12) & ~own[i])
            d = _exact(q[i], x[take])
            best = np.lexsort((ids[take], d))[:k]
            out.append(pd.DataFrame({"query_id": asked[i], "vec_id": ids[take][best], "score": d[best]}))
        return pd.concat(out)

    return work


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest of ``vectors`` to each vector of ``queries``, both (vec_id, embedding)."""
    vectors = settle(valid(vectors), "vectors")
    queries = valid(queries) if queries.columns != ["vec_id"] else vectors.join(queries.distinct(), "vec_id", "left_semi")
    queries = settle(queries, "queries")
    # the few smallest ids of equal vectors; the limit works before the shuffle too
    same = Window.partitionBy("embedding").orderBy("vec_id")
    kept = settle(vectors.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1), "kept")
    # copies would crowd out the rest of the sample
    taken = kept.where("_n = 1").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()["embedding"]
    if not len(taken):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(np.stack(taken.to_list()), k, recall)
    coded = "cluster int, vec_id long, code binary, length double, factor double, embedding array<double>"
    coded = settle(kept.drop("_n").mapInArrow(_coded(index), coded), "codes")
    found = settle(_found(index, coded, queries, 0, index.probes, k), "found")
    most = len(index.centroids)
    if index.probes < most:
        # own rows are no candidates
        enough = min(k, kept.limit(k + 1).count() - 1)
        full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
        short = settle(queries.join(full.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "short")
        if not short.isEmpty():
            found = found.unionByName(_found(index, coded, short, index.probes, most, k))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(index: Index, coded: DataFrame, queries: DataFrame, begin: int, end: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest of every block that a query meets."""
    asked = settle(queries.mapInArrow(_probed(index, begin, end), "cluster int, query_id long, query array<double>"), "asked")
    size = coded.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    many = asked.groupBy("cluster").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("_parts"))
    # one row per centroid
    plan = F.broadcast(size.join(many, "cluster"))
    left = (
        asked.join(plan, "cluster").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_parts")))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_parts", "_blocks")
    )
    right = (
        coded.join(plan, "cluster").withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")))
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts", "_blocks")
    )
    key = ["cluster", "_block", "_part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_searched(index, k), "query_id long, vec_id long, score double")
