"""Embedding near-dedup (operator 6): spherical-cap filters.

Filter directions form a product code: the space is cut in two halves, each
half has a small random code, and every pair of code words is a direction. A
vector passes the filters whose direction it is within a cap of; because a
direction's score is the sum of two halves' scores, those filters are listed
from two sorted lists without scoring the others. Several independent codes
are used, of a size at which vectors with cosine ``threshold`` pass some filter
together almost surely; pairs are found by a join on (label, filter) and
verified by their cosine in double precision. The number of vectors of the
largest label sets the codes' size, by the scores' own distribution at the
vectors' dimension (tails on the sphere are lighter than normal ones), or, in
few dimensions with very many rows, where caps that hold few vectors no longer
hold a pair, all vectors of a label are compared block by block; recall
is tested against brute force, and of pairs at the threshold for labels of up
to 1e8 vectors. Vectors are turned at random before each code, so that no
vector's halves are uneven in all of them.

A filter's vectors are compared in blocks of at most ``BLOCK``: a crowded
filter becomes one task per pair of blocks, so no task grows. Pairs are never
listed: a block yields for each vector how many others it links with, counting
a pair only at the first filter both passed, and the links of a spanning
forest. Equal vectors of a label are one node with a multiplicity.

Defined cases: a vector that is null, zero, or holds a null or non-finite
component, and one whose label is null, links with nothing; vectors of
different lengths do not link; repeated rows are copies (the id they share is
counted once as a class, each as a neighbour); an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .components import components

THRESHOLD = 0.93
#: Vectors of one label that a filter should hold, about.
CROWD = 128
#: Independent codes. Directions of one code share halves, so what a pair
#: shares in one comes in clusters; several codes even that out.
CODES = 4
#: Filters of each code that a pair at the threshold shares, on average.
SHARED = 4.0
#: Directions drawn to size the codes.
DRAWS = 40_000
#: Shorter vectors are all compared, block by block.
LEAST_DIM = 8
BLOCK = 2048


@lru_cache(maxsize=64)
def code_size(dim: int, rows: int, threshold: float = THRESHOLD, crowd: int = CROWD, shared: float = SHARED) -> tuple[float, int]:
    """The cap's least score, which crowd of ``rows`` vectors reach on average,
    and the words of each half, with which a pair at the threshold shares
    ``shared`` filters on average. Seeded Monte Carlo with directions drawn
    near the vectors and weighted, as caps are rare. In so few dimensions that
    halves have hardly any directions, one filter holds all vectors."""
    if dim < LEAST_DIM:
        return float("-inf"), 1
    rng = np.random.default_rng([20_241, dim])
    part = min(0.05, crowd / max(rows, 1))
    far = NormalDist().inv_cdf(1 - part)
    half = dim // 2
    one, joint = [], []
    for n in [min(DRAWS, 1 + 4_000_000 // dim)] * ceil(DRAWS / min(DRAWS, 1 + 4_000_000 // dim)):
        x, y, g = (rng.standard_normal((n, dim)) for _ in range(3))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        y = threshold * x + sqrt(1 - threshold**2) * y

        def drawn(shift: np.ndarray, *vectors: np.ndarray) -> np.ndarray:
            """Scores of the vectors under shifted directions, and weights."""
            d = g + shift  # noqa: B023
            weight = np.exp((shift * shift).sum(axis=1) / 2 - (d * shift).sum(axis=1))
            for h in (slice(0, half), slice(half, dim)):
                d[:, h] *= sqrt((h.stop - h.start) / dim) / np.maximum(np.linalg.norm(d[:, h], axis=1, keepdims=True), 1e-300)
            return np.stack([(d * v).sum(axis=1) for v in vectors] + [weight])

        one.append(drawn(far * x, x))
        joint.append(drawn(far / (1 + threshold) * (x + y), x, y))
    score, weight = np.concatenate(one, axis=1)
    order = np.argsort(-score)
    reached = np.cumsum(weight[order]) / len(order)
    cut = float(score[order[min(int(np.searchsorted(reached, part)), len(order) - 1)]])
    a, b, weight = np.concatenate(joint, axis=1)
    both = float((weight * (np.minimum(a, b) >= cut)).mean())
    words = max(4, ceil(sqrt(shared / max(both, 1e-300))))
    # Where no direction is near enough to both vectors of a pair, or filters
    # would outnumber 32 bits, no code finds all pairs, and all are compared.
    if cut >= sqrt((1 + threshold) / 2) or CODES * words * words >= 2**31:
        return float("-inf"), 1
    return cut, words


class ProductCode:
    """Filter directions for vectors of ``dim`` components."""

    def __init__(self, dim: int, rows: int, threshold: float = THRESHOLD, crowd: int = CROWD, shared: float = SHARED, seed: int = 0, size: tuple[float, int] | None = None) -> None:
        self.cut, self.words = size or code_size(dim, rows, threshold, crowd, shared)
        self.halves = (dim // 2, dim - dim // 2)
        rng = np.random.default_rng([20_240, dim, seed])
        code = [rng.standard_normal((self.words, h)) for h in self.halves]
        # Both halves have the length their share of the components gives them.
        self.code = [c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) * sqrt(h / dim) for c, h in zip(code, self.halves, strict=True)]
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector its filters, ascending: list decoding."""
        a, b = unit[:, : self.halves[0]] @ self.code[0].T, unit[:, self.halves[0] :] @ self.code[1].T
        order = np.argsort(-b, axis=1)
        falling = -np.take_along_axis(b, order, axis=1)  # ascending
        out = []
        for k in range(len(unit)):
            upto = np.searchsorted(falling[k], a[k] - self.cut, "right")
            first = np.flatnonzero(upto)
            n = upto[first]
            at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.sort(np.repeat(first, n) * self.words + order[k][at]).astype(np.int32))
        return out


def _decode(rows: dict[int, int]):
    """Give each vector its filters; ``rows`` has the largest label's vectors
    by the number of components."""
    # Sized here, once, so that all executors have the same codes.
    sizes = {dim: code_size(dim, n) for dim, n in rows.items()}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codes = {dim: [ProductCode(dim, n, seed=k, size=sizes[dim]) for k in range(CODES)] for dim, n in rows.items()}
        for batch in batches:
            lists = batch.column("vector")
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            dims = np.diff(bounds)
            found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = np.stack([flat[bounds[k] : bounds[k + 1]] for k in at])
                few = max(16, min(1000, 2_000_000 // sizes[dim][1]))
                for lo in range(0, len(at), few):
                    unit = x[lo : lo + few]
                    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                    passed = [[f + n * code.words**2 for f in code.filters(unit @ code.turn)] for n, code in enumerate(codes[dim])]
                    for k, *own in zip(at[lo : lo + few].tolist(), *passed, strict=True):
                        found[k] = np.concatenate(own).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            filters = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "label", "copies", "vector")] + [filters], names=["node", "label", "copies", "vector", "filters"])

    return run


def _block(threshold: float):
    """Links within one pair of blocks of a filter."""

    def run(table):
        import pyarrow as pa

        node = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        own = table.column("block").to_numpy()
        this = table.column("filter")[0].as_py()
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        x = np.array(table.column("vector").to_pylist(), np.float64)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        lists = table.column("filters").to_pylist()
        passed = np.full((len(lists), max(map(len, lists))), -1, np.int32)
        for k, f in enumerate(lists):
            passed[k, : len(f)] = f
        rows, columns = np.flatnonzero(own == one), np.flatnonzero(own == two)
        links = np.zeros(len(node), np.int64)
        root = np.arange(len(node))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for lo in range(0, len(rows), 256):
            some = rows[lo : lo + 256]
            a, b = np.nonzero(x[some] @ x[columns].T >= threshold)
            a, b = some[a], columns[b]
            if one == two:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), 20_000):
                p, q = a[at : at + 20_000], b[at : at + 20_000]
                # The first filter that both passed, as lists ascend.
                first = np.full(len(p), np.iinfo(np.int32).max, np.int32)
                for c in range(passed.shape[1]):
                    mine = passed[p, c]
                    hit = (mine >= 0) & (first > mine) & (passed[q] == mine[:, None]).any(axis=1)
                    first[hit] = mine[hit]
                new = first == this
                np.add.at(links, p[new], copies[q[new]])
                np.add.at(links, q[new], copies[p[new]])
                for u, v in zip(p[new].tolist(), q[new].tolist(), strict=True):
                    u, v = find(u), find(v)
                    if u != v:
                        lead = (u, v) if node[u] < node[v] else (v, u)
                        root[lead[1]] = lead[0]
        hit = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[hit]), "links": pa.array(links[hit]), "lead": pa.array(np.array([node[find(k)] for k in hit.tolist()], np.int64))})

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``
    (vec_id, embedding, label)."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(fine, F.lit(False)), value).alias("vector"))
    good = rows.where("vector is not null and vec_id is not null")
    nodes = materialize(good.groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "vectors")
    crowd = {r["d"]: r["n"] for r in nodes.groupBy("label", F.size("vector").alias("d")).count().groupBy("d").agg(F.max("count").alias("n")).collect()}
    schema = f"node long, label {dict(vectors.dtypes)['label']}, copies long, vector array<double>, filters array<int>"
    decoded = materialize(nodes.select("node", "label", "copies", "vector").mapInArrow(_decode(crowd), schema), "vectors-filters")
    placed = decoded.withColumn("filter", F.explode("filters")).withColumn("dim", F.size("vector"))
    sizes = placed.groupBy("label", "dim", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = (
        placed.join(sizes, ["label", "dim", "filter"])
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "dim", "filter", "node", "copies", "vector", "filters", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    )
    found = materialize(pairs.groupBy("label", "dim", "filter", "one", "two").applyInArrow(_block(threshold), "node long, links long, lead long"), "vectors-links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    stars = components(found.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    known = materialize(
        nodes.join(counted, "node", "left").join(stars, "node", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "vectors-known"
    )
    out = rows.join(known, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: near-equal vectors within each label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


EMBEDDING_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT u, count(*) AS n_links FROM p GROUP BY u),
r(u, w) AS (SELECT u, u FROM n UNION SELECT r.u, p.w FROM r JOIN p ON r.w = p.u),
c AS (SELECT u, min(w) AS component_id FROM r GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.u LEFT JOIN c ON e.vec_id = c.u
"""
