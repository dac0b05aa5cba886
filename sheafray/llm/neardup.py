"""MinHash near-dedup (operator 3): BagMinHash signatures, bands, verification.

A document is the multiset of its shingles of five words. BagMinHash gives it
registers such that two documents agree in a register with a probability equal
to their weighted Jaccard similarity. Every unit of a shingle's count is a
level; levels are held in shells that double in width, [0,1) [1,2) [2,4) ...,
and each (shingle, shell) has one Poisson process whose rate is the shell's
width, so a shingle that occurs a thousand times costs ten processes, not a
thousand. A point carries a uniform level within its shell, and counts only if
that level is below the shingle's count; it goes to a random register, which
keeps its earliest point. Points are drawn only up to the time by which all
registers are expected to be full; a document with an empty one draws on.

Bands of registers make buckets. Exact copies are one node. Each bucket links
its members to its least one, each link is verified by exact multiset overlap
of the two whole texts, and components are built. Members of a bucket that are
then still apart are compared by exact overlap too, a block of members of
different components at a time as one matrix product, so no link between
different texts that share a bucket is lost, and no group, however large, is
expanded into rows of pairs.

Defined cases: null, empty and blank texts link with nothing; a text of one to
four words has one shingle, all of it; repeated rows are copies; rows that
share an id but not their text are judged each by its text, and ``near_stage``
keeps each that no other text's class holds; a row with a null id has the class
null and stays; an empty table gives no rows; further columns are not read, and
``near_stage`` carries them whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize
from .components import components, partial_components
from .rolling import mix64, text_buffer, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 7
REGISTERS = BANDS * ROWS
#: Members of a bucket, at most, that are compared at once, and rows of members
#: that a task takes, about.
BLOCK = 1024
SLOT = 4000
#: Nodes from here on stand for texts whose id another text has as well.
FRESH = 1 << 61


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes of all texts, and where each text's begin."""
    words, first = word_hashes(data, bounds)
    n = np.diff(first)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    length = np.repeat(np.minimum(n, SHINGLE), count)
    out = words[at]
    for k in range(1, SHINGLE):
        longer = slice(None) if length.min(initial=SHINGLE) > k else np.flatnonzero(length > k)
        out[longer] = mix64(out[longer] ^ words[at[longer] + k], 17 + k)
    return out, begin


def _uniform(x: np.ndarray) -> np.ndarray:
    """Of a 64-bit hash a number in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def bag_signatures(hashes: np.ndarray, begin: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of ``registers`` numbers for each multiset of hashes; equal
    numbers are equal points. Empty multisets have infinities."""
    docs = len(begin) - 1
    out = np.full((docs, registers), np.inf)
    owner = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(begin))
    bits = np.uint64(max(1, int(docs).bit_length()))
    keys = np.sort((owner << (np.uint64(64) - bits)) | (hashes >> bits))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(keys)))
    owner = (keys[at] >> (np.uint64(64) - bits)).astype(np.int64)
    element = mix64(_element(keys[at], bits), 19)
    weight = np.bincount(owner, weights=count, minlength=docs)
    # Shells that each element reaches: [0,1), [1,2), [2,4), ...
    depth = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64), 0) + 1
    which = np.repeat(np.arange(len(count)), depth)
    shell = np.arange(len(which)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(shell > 0, 2.0 ** (shell - 1), 0.0)
    width = np.where(shell > 0, 2.0 ** (shell - 1), 1.0)
    seed = mix64(element[which] + shell.astype(np.uint64), 23)
    doc, most = owner[which], count[which].astype(np.float64)
    full = log(registers) + 3.5
    todo = np.flatnonzero(weight > 0)
    factor = 1.0
    while len(todo):
        limit = np.zeros(docs)
        limit[todo] = factor * full * registers / weight[todo]
        open_ = limit[doc] > 0
        d, s, w, lo, c = doc[open_], seed[open_], width[open_], low[open_], most[open_]
        time = np.zeros(len(d))
        out[todo] = np.inf
        step = 0
        while len(d):
            h = mix64(s, 29 + step)
            time = time - np.log(_uniform(h)) / w
            going = time <= limit[d]
            d, s, w, lo, c, time, h = d[going], s[going], w[going], lo[going], c[going], time[going], h[going]
            g = mix64(h, 31)
            counts = lo + np.floor((g >> np.uint64(40)).astype(np.float64) * 2.0**-24 * w) < c
            register = ((g & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(out.reshape(-1), d[counts] * registers + register[counts], time[counts])
            step += 1
        todo = todo[~np.isfinite(out[todo]).all(axis=1)]
        factor *= 2
    return out


def _element(keys: np.ndarray, bits: np.uint64) -> np.ndarray:
    """The 40 high bits of a shingle's hash, which a batch of any size keeps."""
    return (keys << bits) >> np.uint64(24)


def _sign(batches: Iterator) -> Iterator:
    import hashlib

    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            data, bounds = text_buffer(some.column("text"))
            hashes, begin = shingles(data, bounds)
            signature = bag_signatures(hashes, begin)
            raw, edges = data.tobytes(), bounds.tolist()
            digest = [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(edges, edges[1:], strict=False)]
            points = mix64(signature.view(np.uint64).reshape(-1), 37).reshape(signature.shape)
            bands = np.zeros((len(points), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix64(bands + points[:, r::ROWS], 41 + r)
            bands = mix64(bands + np.arange(BANDS, dtype=np.uint64), 59)
            some_bands = [b.view(np.int64) if k else None for b, k in zip(bands, np.diff(begin).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id").cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(some_bands, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "bands"],
            )


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of hashes."""
    if not len(a) or not len(b):
        return 0.0
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    common = int(np.minimum(ca[ia], cb[ib]).sum())
    return common / (len(a) + len(b) - common)


def _verify(threshold: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                left, right = (shingles(*text_buffer(some.column(c))) for c in ("text_a", "text_b"))
                keep = [
                    overlap(left[0][a0:a1], right[0][b0:b1]) >= threshold
                    for a0, a1, b0, b1 in zip(left[1][:-1].tolist(), left[1][1:].tolist(), right[1][:-1].tolist(), right[1][1:].tolist(), strict=True)
                ]
                where = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([some.column(c).take(where) for c in ("a", "b")], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of the pairs (a, b) of ids those whose whole texts are similar.

    The second text joins where the first is, by id, so that a document in
    very many pairs is a key that can be split. ``texts`` has id, text.
    """
    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    return materialize(two.mapInArrow(_verify(threshold), "a long, b long"), "near-verified")


def _levels(hashes: np.ndarray) -> np.ndarray:
    """A multiset as a set: each copy of a hash is another number, so that
    common numbers count what the multisets share."""
    ordered = np.sort(hashes)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    level = np.arange(len(ordered)) - np.repeat(at, np.diff(np.append(at, len(ordered))))
    return np.where(level == 0, ordered, mix64(ordered + level.astype(np.uint64), 61))


def similar(one: list[np.ndarray], two: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of the sets reach the threshold, as a matrix.

    Numbers that only one set holds add to no pair; the others are columns of
    two 0/1 matrices, taken a few thousand at a time, whose product counts
    what each pair shares.
    """
    sets = [*one, *two]
    size = np.array([len(x) for x in sets], np.float64)
    row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = held[column] > 1
    rank = np.cumsum(held > 1) - 1
    row, column = row[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        at = slice(*np.searchsorted(column, [lo, lo + 4096]))
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[row[at], column[at] - lo] = 1
        shared += dense[: len(one)] @ dense[len(one) :].T
    return shared >= threshold * (size[: len(one), None] + size[None, len(one) :] - shared)


def _across(threshold: float):
    """Links between the components that meet in a bucket: a union-find over
    verified pairs, of which only those that join two sets are told."""

    def run(table):
        import pyarrow as pa

        found: list[tuple[int, int]] = []
        table = table.combine_chunks()
        hashes, begin = shingles(*text_buffer(table.column("text")))
        node, component, block, one, two, bucket = (table.column(c).to_numpy() for c in ("node", "component", "block", "one", "two", "bucket"))
        for key in np.unique(np.stack([bucket, one, two], axis=1), axis=0).tolist():
            rows = np.flatnonzero((bucket == key[0]) & (one == key[1]) & (two == key[2]))
            left, right = rows[block[rows] == key[1]], rows[block[rows] == key[2]]
            if not len(left) or not len(right):
                continue
            sets = {k: _levels(hashes[begin[k] : begin[k + 1]]) for k in rows.tolist()}
            hit = similar([sets[k] for k in left.tolist()], [sets[k] for k in right.tolist()], threshold)
            parent: dict[int, int] = {}

            def find(x: int, parent: dict[int, int] = parent) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            hit &= component[left][:, None] != component[right][None, :]
            for i, j in zip(*np.nonzero(hit), strict=True):
                a, b = find(int(component[left[i]])), find(int(component[right[j]]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((int(node[left[i]]), int(node[right[j]])))
        return pa.table({"a": pa.array([min(f) for f in found], pa.int64()), "b": pa.array([max(f) for f in found], pa.int64())})

    return run


def _lots(apart: DataFrame) -> DataFrame:
    """(bucket, node, component, block, one, two): the blocks of members that
    are to be compared, each as two lots, and who is in them.

    A component of over ``BLOCK`` members of a bucket has lots of its own, and
    all others share lots. Lots of one component never meet, so a bucket that
    is one component but for a few members sends each text about once. Lots go
    by a hash; two with the same one are compared as one, which loses nothing.
    """
    large = F.col("n") > BLOCK
    count = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = apart.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    held = sizes.groupBy("bucket").agg(count(F.sum(F.when(large, 0).otherwise(F.col("n")))).alias("mixed"), F.collect_list(F.when(large, F.struct("component", count(F.col("n")).alias("lots")))).alias("large"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    none = F.lit(None).cast("long")
    own = F.get(F.filter("large", lambda x: x["component"] == F.col("component")), F.lit(0))
    place = F.when(own.isNull(), F.xxhash64(none, F.pmod(F.xxhash64("node"), F.col("mixed")).cast("int"))).otherwise(F.xxhash64("component", F.pmod(F.xxhash64("node"), own["lots"]).cast("int")))
    mixed = F.transform(upto(F.col("mixed")), lambda k: F.xxhash64(none, k))
    others = F.flatten(F.transform(F.filter("large", lambda x: x["component"] != F.col("component")), lambda x: F.transform(upto(x["lots"]), lambda k: F.xxhash64(x["component"], k))))
    met = apart.join(held, "bucket").withColumn("block", place).withColumn("other", F.explode(F.concat(mixed, others)))
    return met.select("bucket", "node", "component", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))


def _links_across(shared: DataFrame, stars: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified links between members of a bucket that are in different
    components so far.

    A bucket's members are compared by a matrix product, in lots of about
    ``BLOCK`` members, and no pair becomes a row.
    """
    label = shared.join(stars, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = label.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    members = materialize(_lots(materialize(label.join(several, "bucket"), "near-apart")), "near-members")
    slots = max(1, members.count() // SLOT)
    slot = F.pmod(F.xxhash64("bucket", "one", "two"), F.lit(slots))
    return materialize(members.join(texts.withColumnRenamed("id", "node"), "node").withColumn("slot", slot).groupBy("slot").applyInArrow(_across(threshold), "a long, b long"), "near-across")


def text_digest(text: Column) -> Column:
    """128 bits of a text's SHA-256, as ``_sign`` makes them."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _nodes(signed: DataFrame) -> DataFrame:
    """One row for each different text: digest, id (the least it has), node
    and bands. The node is the id, or where texts share it, for all but one of
    them a number beyond ``FRESH`` made of the text."""
    copies = materialize(signed.where("doc_id is not null and bands is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "near-copies")
    twice = copies.groupBy("id").agg(F.min("digest").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "lead")
    if not twice.head(1):
        return copies.withColumn("node", F.col("id"))
    fresh = F.lit(FRESH) + F.pmod(F.xxhash64("digest"), F.lit(FRESH))
    node = F.when(F.col("lead").isNull() | (F.col("lead") == F.col("digest")), F.col("id")).otherwise(fresh)
    return materialize(copies.join(twice, "id", "left").withColumn("node", node).drop("lead"), "near-nodes")


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (doc_id, digest), digest null without words, and for each
    digest its id, node and class, a node."""
    signed = materialize(docs.select("doc_id", "text").mapInArrow(_sign, "doc_id long, digest binary, bands array<long>"), "near-signed")
    # Exact copies are one node; their bands are equal.
    copies = _nodes(signed)
    banded = copies.select("node", F.explode("bands").alias("bucket"))
    leaders = materialize(banded.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("bucket", "lead"), "near-leaders")
    shared = materialize(banded.join(leaders, "bucket"), "near-shared")
    # Whole texts move once, by id, at any size; later joins see those of documents that share a bucket.
    members = shared.select("node").distinct().join(copies.select("node", F.col("id").alias("_id"), "digest"), "node").hint("merge")
    same = (F.col("doc_id") == F.col("_id")) & (text_digest(F.col("text")) == F.col("digest"))
    texts = materialize(docs.select("doc_id", "text").join(members, same).select(F.col("node").alias("id"), "text"), "near-texts")
    first = shared.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = verified(first, texts, threshold)
    more = _links_across(shared, materialize(partial_components(links), "near-parts"), texts, threshold)
    stars = materialize(components(links.unionByName(more)), "near-stars")
    by_text = materialize(copies.join(stars, "node", "left").select("digest", "id", "node", F.coalesce("component", "node").alias("class")), "near-classes")
    return signed.select("doc_id", F.when(F.col("bands").isNotNull(), F.col("digest")).alias("digest")), by_text


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs`` (doc_id, text): the least
    id of the documents it is linked with, directly or through others."""
    rows, by_text = _classes(docs, threshold)
    # A class of nodes beyond FRESH alone goes by its texts' id.
    by_text = by_text.select("digest", F.when(F.col("class") >= FRESH, F.col("id")).otherwise(F.col("class")).alias("class"))
    return rows.join(by_text, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id"))


def near_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document with its class of near duplicates."""
    return classes(documents(spark, sf_dir)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates one row stays, that of
    the document with the least id; documents without an id and those without
    words stay."""
    _, by_text = _classes(docs, THRESHOLD)
    lead = by_text.where("node = class").select(F.col("id").alias("_id"), F.col("digest").alias("_lead"))
    named = docs.where("doc_id is not null").withColumn("_digest", text_digest(F.col("text"))).join(lead, (F.col("doc_id") == F.col("_id")) & (F.col("_digest") == F.col("_lead")))
    plain = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return named.dropDuplicates(["doc_id", "_digest"]).select(*docs.columns).unionByName(docs.where(plain))
