"""Packing (operator 7): mixture-controlled windows by deficit round-robin.

Every source is a queue of its documents' tokens, cut into packets of at most
``packet`` tokens, and has a target: the tokens it is to have in a window for
those of the others. A queue with the target w earns w tokens of credit a
round, and sends its next packet when its credit reaches that packet's middle;
so a packet is sent in round (its middle's place in the queue) / w. The order
by rounds is the round-robin's order, and each queue's deficit stays below one
packet at any point, across windows and across partitions, though no task sees
more than its own slice of rounds. A queue that runs out leaves the others in
their proportions.

Tokens stand in that order without gaps; a window is each next ``window`` of
them. A slice is as many rounds as hold about ``slice_tokens`` while all queues
last; sums of tokens by slice give each slice's first place, and every slice
cuts its packets at window ends on its own. Where given targets let queues run
out, the rounds that are left hold fewer tokens, and neighbouring slices are
cut together, up to twice ``slice_tokens``.

Targets are by default what the input holds, so that all queues last to the
end. All documents are packed whatever the targets; to drop or repeat some
towards a mixture, mix first (operator 9).

Defined cases: a null or empty text is its end id alone; a null source is a
queue of its own; sources that ``targets`` does not name have the target 1; a
target that is not positive is an error; repeated rows are packed each; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize
from .tokens import encoder, vocabulary

WINDOW = 4096
PACKET = 256
#: Tokens of one slice of time, about.
SLICE_TOKENS = 1 << 19

_TOKENS = "doc_id long, source string, part int, queue_start long, n long, ids binary"
_PACKETS = "slice long, sent double, source string, queue_at long, doc_id long, start long, n int, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encode(path: str, kind: str, end: int, width: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, stop = encoder(path, kind), np.array([end], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        queued: dict[str | None, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                packed = [x + stop for x in enc.encode_batch(some.column("text").to_pylist())]
                n = [len(x) // 4 for x in packed]
                starts = []
                for source, k in zip(some.column("source").to_pylist(), n, strict=True):
                    starts.append(queued.get(source, 0))
                    queued[source] = starts[-1] + k
                ids = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in packed]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("source").cast(pa.string()), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "part", "queue_start", "n", "ids"])

    return run


def _packets(packet: int, width: int):
    """Cut documents into packets and give each its round and slice."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.column("n").to_numpy()
            begin = batch.column("queue_at").to_numpy()
            target, rounds = batch.column("target").to_numpy(), batch.column("rounds").to_numpy()
            for at in range(0, len(n), 500):
                rows = slice(at, at + 500)
                count = -(-n[rows] // packet)
                doc = np.repeat(np.arange(len(count)), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * packet
                size = np.minimum(packet, n[rows][doc] - start)
                place = begin[rows][doc] + start
                sent = (place + size / 2) / target[rows][doc]
                ids = batch.column("ids").slice(at, 500).to_pylist()
                cut = [ids[d][width * s : width * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
                take = pa.array(doc + at)
                which = (sent / rounds[rows][doc]).astype("i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which), pa.array(sent), batch.column("source").take(take), pa.array(place), batch.column("doc_id").take(take), pa.array(start), pa.array(size.astype("i4")), pa.array(n[rows][doc]), pa.array(cut, pa.binary())],
                    names=["slice", "sent", "source", "queue_at", "doc_id", "start", "n", "doc_tokens", "ids"],
                )

    return run


def _cut(window: int, width: int):
    """The packets of a slice, or of some on end, in order, cut at window ends;
    neighbouring packets of a document in the same window are one piece."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("sent", "ascending"), ("source", "ascending"), ("queue_at", "ascending")]).combine_chunks()
        base = table.column("slice_start")[0].as_py()
        queue_at, start, n = (table.column(c).to_numpy() for c in ("queue_at", "start", "n"))
        source = table.column("source").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        place = np.cumsum(n, dtype=np.int64) - n
        total = int(n.sum())
        # A packet goes on where its forerunner ended: the same queue, and not a document's start.
        on = np.zeros(len(n), bool)
        on[1:] = (source[1:] == source[:-1]) & (queue_at[1:] == queue_at[:-1] + n[:-1]) & (start[1:] > 0)
        begin = np.union1d(place[~on], np.arange(-base % window, total, window))
        packet = np.searchsorted(place, begin, "right") - 1
        length = np.diff(np.append(begin, total))
        ids = memoryview(np.frombuffer(b"".join(table.column("ids").to_pylist()), f"<u{width}").astype("<u4")).cast("B")
        crc = [zlib.crc32(ids[4 * a : 4 * (a + k)]) for a, k in zip(begin.tolist(), length.tolist(), strict=True)]
        at = base + begin
        columns = [table.column("doc_id").take(pa.array(packet)), pa.array(start[packet] + begin - place[packet]), pa.array(length), pa.array(crc, pa.int64()), table.column("doc_tokens").take(pa.array(packet)), pa.array(at // window), pa.array(at % window)]
        return pa.table(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def id_width(tokenizer: str, kind: str, end: int) -> int:
    """Bytes that hold any id."""
    return 2 if max(encoder(tokenizer, kind).tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4


def _running(counts: DataFrame, key: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """``key`` with the sum of ``value`` over all smaller keys, by blocks of
    keys: no task sees more than a block or one row of each block."""
    blocked = counts.withColumn("_block", F.floor(F.col(key) / block))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocked.groupBy("_block").agg(F.sum(value).alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("_block"))), F.lit(0)).alias("_base"))
    own = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("_block").orderBy(key))), F.lit(0))
    return blocked.withColumn("_own", own).join(blocks, "_block").select(key, (F.col("_own") + F.col("_base")).alias(name))


def _together(starts: DataFrame, slice_tokens: int) -> DataFrame:
    """``starts`` (slice, slice_start) with ``lot``: slices that begin within
    the same ``slice_tokens`` tokens."""
    return starts.withColumn("lot", F.floor(F.col("slice_start") / slice_tokens).cast("long"))


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end: int = 2, window: int = WINDOW, packet: int = PACKET, slice_tokens: int = SLICE_TOKENS, targets: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. ``targets`` has the sources' proportions of tokens,
    by default those of the input."""
    if any(not w > 0 for w in (targets or {}).values()):
        raise ValueError("targets are to be positive")
    width = id_width(tokenizer, kind, end)
    tokens = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(_encode(tokenizer, kind, end, width), _TOKENS), "pack-tokens")
    # One row per source and part: where the part's documents stand in the queue.
    queue = Window.partitionBy("source").orderBy("part")
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    target = F.sum("n").over(Window.partitionBy("source")).cast("double")
    if targets is not None:
        named = F.create_map(*[F.lit(x) for s, w in targets.items() if s is not None for x in (s, float(w))]) if any(s is not None for s in targets) else F.lit(None).cast("map<string,double>")
        target = F.when(F.col("source").isNull(), F.lit(float(targets.get(None, 1.0)))).otherwise(F.coalesce(named[F.col("source")], F.lit(1.0)))
    places = materialize(sums.select("source", "part", F.coalesce(F.sum("n").over(queue.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), target.alias("target")), "pack-places")
    every = places.groupBy("source").agg(F.first("target").alias("w")).agg(F.sum("w")).first()[0] or 1.0
    t, p = tokens.alias("t"), places.alias("p")
    placed = t.join(p, (F.col("t.part") == F.col("p.part")) & F.col("t.source").eqNullSafe(F.col("p.source"))).select(
        "t.doc_id", "t.source", (F.col("t.queue_start") + F.col("p.before")).alias("queue_at"), "p.target", "t.n", F.lit(slice_tokens / float(every)).alias("rounds"), "t.ids"
    )
    # The same arithmetic without ids, for the first place of each slice.
    light = placed.select("queue_at", "target", "n", "rounds", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))).alias("start"))
    size = F.least(F.lit(packet), F.col("n") - F.col("start"))
    sent = (F.col("queue_at") + F.col("start") + size / 2) / F.col("target")
    by_slice = light.select((sent / F.col("rounds")).cast("long").alias("slice"), size.alias("k")).groupBy("slice").agg(F.sum("k").alias("k"))
    starts = _running(by_slice, "slice", "k", "slice_start")
    packets = placed.mapInArrow(_packets(packet, width), _PACKETS)
    if targets is None:
        # All queues last to the end, and all slices are full.
        return packets.join(starts, "slice").groupBy("slice").applyInArrow(_cut(window, width), _PIECES)
    return packets.join(_together(starts, slice_tokens), "slice").groupBy("lot").applyInArrow(_cut(window, width), _PIECES)


def pack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents packed."""
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of the documents that are left."""
    return pack(docs, vocabulary("word_bpe_49k.json"))
