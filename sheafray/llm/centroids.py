"""Centroid clustering (operator 11): Lloyd's rounds with annulus search.

A vector x has some centroid at distance u: the one it was assigned to last, or
at first the one whose norm is nearest to its own. By the triangle inequality a
centroid c at most as far away has a norm in [|x| - u, |x| + u], an annulus. So
centroids are sorted by norm, two binary searches give each vector's
candidates, and only those are compared, exactly: components are whole numbers
and squared distances are computed in 64-bit integers, so that ties are ties,
those on the annulus' border included, and go to the smaller number. Bounds
are widened by more than the rounding of the norms.

A round writes each vector with its centroid, and Spark sums components by
centroid, partially before the shuffle; what meets is one row a centroid and
task. New centroids are the driver's: ``k`` vectors, whatever the input. A
centroid that holds a third of all vectors is no burden, as vectors never move.

Defined cases: a vector that is null, or has another number of components, or a
null or non-finite one, is left out; fewer vectors than ``k`` make as many
centroids, and none an empty result; a null vec_id is assigned but starts no
centroid; rows that share a vec_id are vectors each, and as starts ordered by
their components; components beyond +-2**27 count as that, so that distances
are 64-bit, and sums of distances end at 2**63 - 1; further columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

K = 16
ROUNDS = 3
DIM = 64
#: Components are multiplied by this and rounded down.
SCALE = 64
LARGEST = 1 << 27
#: Vector and candidate pairs that are compared at a time.
PAIRS = 1 << 16


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors that are fit, in whole numbers."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    whole = lambda c: F.floor(F.least(F.greatest(F.lit(scale) * c.cast("double"), F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("int")
    return vectors.where(fine).select("vec_id", F.transform(x, whole).alias("v"))


def starts(vectors: DataFrame, k: int = K) -> np.ndarray:
    """The ``k`` vectors whose ids have the least hashes, in that order."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid (ties: the smaller number), the squared
    distance, and how many pairs were compared. ``guess`` has a centroid for
    each row whose distance bounds the search."""
    norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norm, kind="stable")
    ring = norm[order]
    own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    if guess is None:
        after = np.minimum(np.searchsorted(ring, own), len(ring) - 1)
        before = np.maximum(after - 1, 0)
        guess = order[np.where(np.abs(ring[before] - own) <= np.abs(ring[after] - own), before, after)]
    best, at = np.empty(len(x), np.int64), guess.astype(np.int64)
    for lo in range(0, len(x), PAIRS):
        d = x[lo : lo + PAIRS] - centroids[at[lo : lo + PAIRS]]
        best[lo : lo + PAIRS] = np.einsum("ij,ij->i", d, d)
    reach = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (own + reach + 1)
    low = np.searchsorted(ring, own - reach - slack, "left")
    n = np.searchsorted(ring, own + reach + slack, "right") - low
    ends = np.cumsum(n)
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        some = n[lo:hi]
        row = np.repeat(np.arange(lo, hi), some)
        first = np.cumsum(some) - some
        which = order[np.repeat(low[lo:hi] - first, some) + np.arange(len(row))]
        d = x[row] - centroids[which]
        d = np.einsum("ij,ij->i", d, d)
        # The guess is among the candidates, so every row has one.
        least = np.minimum.reduceat(d, first)
        number = np.where(d == np.repeat(least, some), which, len(centroids))
        best[lo:hi], at[lo:hi] = least, np.minimum.reduceat(number, first)
        lo = hi
    return at, best, int(ends[-1]) if len(x) else 0


def _assign(centroids: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("v")
            x = lists.flatten().to_numpy().reshape(batch.num_rows, centroids.shape[1]).astype(np.int64)
            guess = batch.column("cluster").to_numpy() if "cluster" in batch.schema.names else None
            at, distance, pairs = nearest(x, centroids, guess)
            share = np.zeros(batch.num_rows, np.int64)
            share[:1] = pairs
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists, pa.array(at.astype(np.int32)), pa.array(distance), pa.array(share)], names=["vec_id", "v", "cluster", "distance", "pairs"])

    return run


def cluster(vectors: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, v, cluster, distance (squared) and pairs (compared in its batch,
    told by the first row) after ``rounds`` of Lloyd's algorithm over
    ``vectors`` (vec_id, v), and the centroids: floored means, those without
    vectors unchanged."""
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, v array<int>, cluster int, distance long, pairs long"
    dim = centroids.shape[1]
    centroids, told = centroids.copy(), vectors
    for n in range(rounds + 1):
        told = materialize(told.select("vec_id", "v", *(["cluster"] if n else [])).mapInArrow(_assign(centroids), schema), "assigned")
        if n < rounds:
            sums = told.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(k))).alias(f"s{k}") for k in range(dim)])
            for row in sums.collect():  # at most one row a centroid
                centroids[row["cluster"]] = [row[f"s{k}"] // row["n"] for k in range(dim)]
    return told, centroids


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = materialize(whole_vectors(vectors, dim), "whole-vectors")
    seeds = starts(rows, k)
    if not len(seeds):
        none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return rows.where("false").select("vec_id", *none)
    told, centroids = cluster(rows, seeds, rounds)
    digests = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_cluster = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = by_cluster.agg(F.sum("own").alias("all"))
    # Both sides have a row a centroid at most.
    known = by_cluster.crossJoin(F.broadcast(total)).join(F.broadcast(digests), "cluster").select("cluster", F.least("own", most).cast("long").alias("cluster_inertia"), F.least("all", most).cast("long").alias("inertia"), "centroid_sha256")
    return told.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def centroid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: sixteen clusters of the embeddings after three rounds."""
    return centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(n: int) -> str:
    """Assignment to the centroids c<n>, and the centroids after it."""
    return f"""
a{n} AS (SELECT i, arg_min(k, [d, k]) AS k, min(d) AS d FROM (
  SELECT v.i, c.k, list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j])))::BIGINT AS d FROM v, c{n} c) GROUP BY i),
m{n} AS (SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.k, unnest(range(1, 65)) AS j, unnest(v.v) AS x FROM a{n} a JOIN v USING (i)) GROUP BY k, j),
c{n + 1} AS (SELECT c.k, coalesce(z.v, c.v) AS v FROM c{n} c LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM m{n} GROUP BY k) z ON c.k = z.k)"""


CENTROID_SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS k, v FROM v WHERE vec_id IS NOT NULL QUALIFY k < {K}),
{",".join(_round_sql(n) for n in range(ROUNDS + 1))}
SELECT v.vec_id, a.k::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (i) JOIN c{ROUNDS} c ON a.k = c.k
"""
