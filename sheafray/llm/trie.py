"""Conversation prefix trie (operator 12): rolling fingerprints, verified.

Every distinct sequence of the first d turns of some conversation is a node;
conversations that share a beginning share its nodes. Turns are put in order by
ranges of (conversation, turn), so that a conversation of any length is many
tasks' work, and numpy scans over the ordered rows give each prefix a
polynomial fingerprint modulo 2**61 - 1 in two lanes; the terms of a
conversation's earlier partitions are added afterwards, one row a partition.

Equal (depth, fingerprint) makes a candidate group. Each group is verified
against its representative, the least conversation: a member's parent prefix
and its own turn (role and text, not a hash of them) must be the
representative's, which by induction over the depth compares whole prefixes.
Members that branched off the same original turn need no comparison. Where a
group differs, its contents are numbered, and a prefix is told from then on by
its fingerprint and the numbers other than 0 that it met, which is exact.

Sums over subtrees need no walk from level to level. A node is owned by its
least member, and what a conversation owns is a tail of its path. So the sum of
a value over a node's subtree is the sum, over the node's members, of what each
owns at or below that depth: everything for members other than the owner, and
for the owner a running sum. Ends are hashed in pieces: ids are sorted by
ranges of (node, id), joined in pieces of 1,024, and the pieces of a node
stream through one SHA-256, whose state is all that a task holds.

Defined cases: a null role or text is empty; a null turn comes first; rows with
equal turns are in order of role and text, repeated rows are turns each; rows
without a conv_id belong to no conversation and are left out; an empty table
has no nodes, not even a root; an original turn list is one of the table's own
conversations, and one that is absent has no turns; ids below 0 branch off
``c - c mod 100`` with the remainder from 0 to 99; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: The modulus of fingerprints, a Mersenne prime, and the lanes' bases.
P = (1 << 61) - 1
BASES = (1_234_567_890_123_456_789, 987_654_321_987_654_321)
#: Conversations branch off the first one of their hundred after at most so
#: many turns less one.
HUNDRED = 100
BRANCHES = 6
#: Ids of a piece that is hashed as a whole.
PIECE = 1024

_NODE = ["depth", "h1", "h2", "path"]
_M31, _M30, _P = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(P)


def reduced(x: np.ndarray) -> np.ndarray:
    """Any unsigned 64-bit numbers modulo 2**61 - 1."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, of reduced numbers, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _M31, b >> np.uint64(31), b & _M31
    middle = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _M30) << np.uint64(31)) + a0 * b0)


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**61 - 1."""
    out = np.ones(len(exponents), np.uint64)
    for bit in range(int(exponents.max(initial=0)).bit_length()):
        odd = (exponents >> bit) & 1 == 1
        out[odd] = product(out[odd], np.full(int(odd.sum()), base % P, np.uint64))
        base = base * base % P
    return out


def running(terms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of reduced terms from the latest ``first`` on, reduced."""
    low, high = np.cumsum(terms & _M31), np.cumsum(terms >> np.uint64(31))
    sums = reduced(product(reduced(high), np.full(len(terms), 1 << 31, np.uint64)) + reduced(low))
    before = np.concatenate([[np.uint64(0)], sums[:-1]])[np.maximum.accumulate(np.where(first, np.arange(len(terms)), 0))]
    return reduced(sums + _P - before)


def _scan(spread: int, bases: tuple[int, ...]):
    """Adds to ordered rows the fingerprints of each prefix (h1, h2) and of the
    one before it (p1, p2), from the partition's first row on."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, carried = None, [np.uint64(0)] * len(bases)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            depth = batch.column("depth").to_numpy()
            first = np.ones(len(conv), bool)
            first[1:] = conv[1:] != conv[:-1]
            more = first.cumsum() == 1 if conv[0] == last else np.zeros(len(conv), bool)
            out = {n: batch.column(n) for n in batch.schema.names if n not in ("v1", "v2")}
            for lane, base in enumerate(bases):
                value = batch.column(f"v{lane + 1}").to_numpy().view(np.uint64)
                terms = product(reduced(value % np.uint64(spread)), power(base, depth))
                h = running(terms, first)
                h[more] = reduced(h[more] + carried[lane])
                carried[lane] = h[-1]
                out[f"h{lane + 1}"] = pa.array(h.astype(np.int64))
                out[f"p{lane + 1}"] = pa.array(reduced(h + _P - terms).astype(np.int64))
            last = conv[-1]
            yield pa.RecordBatch.from_pydict(out)

    return run


def ordered_turns(conversations: DataFrame, name: str = "turns") -> DataFrame:
    """One row per turn: conv_id, role, text, v1 and v2 (hashes of both), size
    (code points) and seq, which ascends by conversation and turn. Written."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("_any"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_any"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    value = [F.xxhash64(F.lit(lane), "role", "text").alias(f"v{lane}") for lane in (1, 2)]
    return materialize(placed.select("conv_id", "role", "text", *value, F.length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("seq")), name)


def _part(seq: Column) -> Column:
    """The partition that a seq was numbered in."""
    return F.shiftright(seq, 33)


def paths(turns: DataFrame, branched: bool) -> DataFrame:
    """Rows (conv_id, depth, v1, v2, size, seq, is_end) of every conversation's
    path, a row of depth 0 included; seq is the original turn.

    ``branched``: the first h turns are those of conversation c - c mod 100,
    h being crc32(c) mod 6, and c's own follow from its turn h on.
    """
    pieces = turns.groupBy("conv_id", _part(F.col("seq")).alias("part")).agg(F.min("seq").alias("least"), F.count(F.lit(1)).alias("n"))
    # A conversation has at most one row here for each partition of turns.
    w = Window.partitionBy("conv_id")
    earlier = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = materialize(pieces.select("conv_id", "part", (F.col("least") - earlier).alias("zero"), F.sum("n").over(w).alias("own")), "turn-pieces")
    convs = pieces.select("conv_id", "own").distinct()
    if branched:
        head = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(HUNDRED))
        asked = (F.crc32(F.col("conv_id").cast("string")) % BRANCHES).cast("long")
        wanted = convs.select("conv_id", "own", head.alias("head"), asked.alias("h"))
        known = convs.select(F.col("conv_id").alias("head"), F.col("own").alias("there"))
        convs = wanted.join(known, "head", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    else:
        convs = convs.select("conv_id", "own", F.col("conv_id").alias("head"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("taken"))
    convs = materialize(convs.select("conv_id", "head", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    known = pieces.select("conv_id", "part", "zero").join(convs.select("conv_id", "h", "taken", "total"), "conv_id")
    slim = turns.select("conv_id", "v1", "v2", "size", "seq", _part(F.col("seq")).alias("part"))
    placed = slim.join(known, ["conv_id", "part"]).withColumn("place", F.col("seq") - F.col("zero"))
    columns = ["conv_id", "depth", "v1", "v2", "size", "seq", (F.col("depth") == F.col("total")).alias("is_end")]
    own = placed.where("place >= h").withColumn("depth", F.col("taken") + F.col("place") - F.col("h") + 1).select(*columns)
    root = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "v1", "v2", "size")], F.lit(-1).cast("long").alias("seq"), (F.col("total") == 0).alias("is_end"))
    if not branched:
        return own.unionByName(root)
    # At most HUNDRED conversations take at most BRANCHES - 1 turns of one.
    lent = placed.where(F.col("place") < BRANCHES - 1).select(F.col("conv_id").alias("head"), "place", "v1", "v2", "size", "seq")
    heads = lent.join(convs.where("taken > 0").select("conv_id", "head", "taken", "total"), "head").where("place < taken").withColumn("depth", F.col("place") + 1)
    return own.unionByName(heads.select(*columns)).unionByName(root)


def fingerprints(rows: DataFrame, spread: int = P, bases: tuple[int, int] = BASES) -> DataFrame:
    """``rows`` with h1, h2, p1, p2 in place of v1, v2. Written.
    ``spread`` bounds the turns' hashes; tests make prefixes collide by it and
    by weak bases."""
    dealt = rows.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth").withColumn("part", F.spark_partition_id())
    schema = "conv_id long, depth long, size long, seq long, is_end boolean, part int, h1 long, p1 long, h2 long, p2 long"
    local = materialize(dealt.mapInArrow(_scan(spread, bases), schema), "prefixes")
    # What a conversation has in earlier partitions; only the first one of a
    # partition goes on from them, so there is at most one row for each.
    ends = local.groupBy("conv_id", "part").agg(F.max_by(F.struct("h1", "h2"), "depth").alias("h"))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda lane: (F.sum(F.col(f"h.h{lane}").cast("decimal(38,0)")).over(w) % P).cast("long").alias(f"b{lane}")
    carried = ends.select("conv_id", "part", before(1), before(2)).where("b1 is not null")
    both = local.join(F.broadcast(carried), ["conv_id", "part"], "left")
    add = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise((F.col(a) + F.col(b)) % P).alias(a)
    return both.select("conv_id", "depth", "size", "seq", "is_end", add("h1", "b1"), add("h2", "b2"), add("p1", "b1"), add("p2", "b2"))


def _split(prefixes: DataFrame, turns: DataFrame) -> DataFrame:
    """``prefixes`` with path and parent_path, the numbers of the contents they
    met in groups that hold more than one; empty where fingerprints suffice."""
    group = ["depth", "h1", "h2"]
    contents = materialize(prefixes.where("depth > 0").groupBy(*group, "p1", "p2", "seq").agg(F.min("conv_id").alias("least")), "prefix-contents")
    lead = F.min(F.struct("least", "p1", "p2", "seq"))
    leads = materialize(contents.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), lead.alias("lead")).where("n > 1"), "prefix-leads")
    member = materialize(contents.join(leads, group).where(F.col("seq") != F.col("lead.seq")).select(*group, "p1", "p2", "seq", "lead"), "prefix-members")
    said = turns.select("seq", "role", "text")
    pairs = member.select("seq", F.col("lead.seq").alias("other")).distinct()
    told = pairs.join(said, "seq").join(said.select(F.col("seq").alias("other"), F.col("role").alias("other_role"), F.col("text").alias("other_text")), "other")
    unlike = told.where((F.col("role") != F.col("other_role")) | (F.col("text") != F.col("other_text"))).select("seq", "other")
    # A content may differ from the lead's by its parent alone, with the same turn.
    parents = contents.join(leads, group).where((F.col("p1") != F.col("lead.p1")) | (F.col("p2") != F.col("lead.p2"))).select(*group)
    texts = member.withColumn("other", F.col("lead.seq")).join(unlike, ["seq", "other"], "left_semi").select(*group)
    mixed = materialize(parents.unionByName(texts).distinct(), "prefix-collisions")
    if not mixed.head(1):
        return prefixes.withColumn("path", F.lit("")).withColumn("parent_path", F.lit(""))
    known = materialize(contents.join(mixed, group).join(said, "seq"), "prefix-texts")
    content = [*group, "p1", "p2", "role", "text"]
    number = F.row_number().over(Window.partitionBy(*group).orderBy("first")) - 1
    numbered = known.groupBy(*content).agg(F.min(F.struct("least", "seq")).alias("first")).withColumn("number", number).where("number > 0")
    marks = known.join(numbered.drop("first"), content).select(*group, "p1", "p2", "seq", "number")
    met = materialize(prefixes.join(marks, [*group, "p1", "p2", "seq"]).select("conv_id", F.col("depth").alias("at"), "number"), "prefix-marks")
    until = lambda column, hit: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("at", "number")))), lambda x: F.concat_ws(":", x["at"], x["number"])), ",").alias(column)
    own = prefixes.select("conv_id", "depth").join(met, "conv_id").where("at <= depth").groupBy("conv_id", "depth").agg(until("path", F.col("at") <= F.col("depth")), until("parent_path", F.col("at") < F.col("depth")))
    return prefixes.join(own, ["conv_id", "depth"], "left").fillna("", ["path", "parent_path"])


def running_sum(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` over the rows of the same
    key that come first in order; a key's rows are dealt by ranges."""
    dealt = materialize(rows.repartitionByRange(key, order).withColumn("part", F.spark_partition_id()), "running")
    w = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(key, "part").agg(F.sum(value).alias("whole")).select(key, "part", F.coalesce(F.sum("whole").over(w), F.lit(0)).alias("earlier"))
    local = Window.partitionBy(key, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("local", F.coalesce(F.sum(value).over(local), F.lit(0))).join(parts, [key, "part"]).withColumn("before", F.col("earlier") + F.col("local")).drop("part", "local", "earlier")


def _pieces(batches: Iterator) -> Iterator:
    """Ids in order, joined in pieces of one node each."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*[batch.column(c).to_pylist() for c in _NODE], strict=True))
        ids = batch.column("conv_id").to_pylist()
        cuts, start = [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or keys[k] != keys[start] or k - start == PIECE:
                cuts.append((start, k))
                start = k
        out = {c: [keys[lo][n] for lo, _ in cuts] for n, c in enumerate(_NODE)}
        yield pa.RecordBatch.from_pydict(out | {"least": [ids[lo] for lo, _ in cuts], "ids": [",".join(map(str, ids[lo:hi])) for lo, hi in cuts]}, schema=pa.schema([("depth", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("path", pa.string()), ("least", pa.int64()), ("ids", pa.string())]))


def _digests(batches: Iterator) -> Iterator:
    """A node's pieces in order, through one hash."""
    import pyarrow as pa

    schema = pa.schema([("depth", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("path", pa.string()), ("ends_sha256", pa.string())])
    last, state, rows = None, None, []
    for batch in batches:
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*_NODE, "ids")], strict=True):
            if key == last:
                state.update(b",")
            else:
                if state:
                    rows.append((*last, state.hexdigest()))
                last, state = key, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(schema.names)}, schema=schema)
        rows = []
    if state:
        yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(schema.names, (*last, state.hexdigest()), strict=True)}, schema=schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from rows (node, conv_id)."""
    dealt = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    pieces = dealt.mapInArrow(_pieces, "depth long, h1 long, h2 long, path string, least long, ids string")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "least").mapInArrow(_digests, "depth long, h1 long, h2 long, path string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, branched: bool = False, spread: int = P, bases: tuple[int, int] = BASES) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256; see ``paths`` for
    ``branched``."""
    turns = ordered_turns(conversations)
    prefixes = fingerprints(paths(turns, branched), spread, bases)
    prefixes = materialize(_split(materialize(prefixes, "prefixes-whole"), turns), "prefixes-told")
    nodes = prefixes.groupBy(*_NODE).agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.count_if("is_end").alias("ends"), F.max("size").alias("size"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("parent_path").alias("parent_path")
    )
    nodes = materialize(nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("size")), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2"), F.col("parent_path").alias("path")]
    below = nodes.where("depth > 0")
    children = below.select(*up).groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_children"))
    owners = materialize(nodes.select(*_NODE, F.col("owner").alias("parent_conv_id")), "node-owners")
    parents = below.select(*[F.col(c).alias(f"_{c}") for c in _NODE], *up).join(owners, _NODE).select(*[F.col(f"_{c}").alias(c) for c in _NODE], "parent_conv_id")
    # What a conversation owns: all it saves, and its end if that is a leaf.
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saves").alias("all"), F.max((F.col("n_convs") == F.col("ends")).cast("int")).alias("leaf"))
    sums = prefixes.select(*_NODE, "conv_id").join(materialize(owned, "owned"), "conv_id", "left").groupBy(*_NODE).agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("all"), F.lit(0)).alias("members"))
    # Of the owner only what lies at this depth or below: less what is above.
    shared = running_sum(nodes.where("n_convs > 1").select(*_NODE, "owner", "saves"), "owner", "depth", "saves").select(*_NODE, "before")
    digests = ends_digests(prefixes.where("is_end").select(*_NODE, "conv_id"))
    out = nodes.select(*_NODE, "owner", "n_convs").join(children, _NODE, "left").join(sums, _NODE).join(shared, _NODE, "left").join(digests, _NODE, "left").join(parents, _NODE, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        F.when(F.col("n_convs") > 1, F.col("members") - F.col("before")).otherwise(F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def trie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the trie of all conversations, each branched off its hundred's first."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), branched=True)


#: CRC-32 bit by bit, as DuckDB has none.
TRIE_SQL = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns FROM o GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, conv_id - ((conv_id % 100) + 100) % 100 AS head,
         (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 6)::BIGINT AS h
  FROM l),
r AS (SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN l b ON a.head = b.conv_id),
p AS (SELECT conv_id, d, turns[1:d] AS prefix, d = len(turns) AS is_end FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '') AS ends,
             CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[d].text) END AS saves FROM p GROUP BY d, prefix),
k AS (SELECT d, prefix, prefix[1:d - 1] AS above FROM n WHERE d > 0),
c AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM k GROUP BY d, above),
w AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON n.d = c.d AND n.prefix = c.prefix),
s AS (SELECT a.d, a.prefix, sum((b.n_children = 0)::INT) AS n_leaves, sum(b.saves) AS saved_tokens FROM w a JOIN w b ON b.d >= a.d AND b.prefix[1:a.d] = a.prefix GROUP BY a.d, a.prefix)
SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s ON w.d = s.d AND w.prefix = s.prefix LEFT JOIN w u ON w.d > 0 AND u.d = w.d - 1 AND u.prefix = w.prefix[1:w.d - 1]
"""
