"""Token-ID output (operator 5): Parquet list columns that can be read in part.

``write_tokens`` range-partitions the documents by id, encodes every whole
text and writes one row per document: its id, the file part, its first token's
place within the part, its token count, and the ids as a list of 32-bit
integers. Parts ascend by id. Ids are dictionary encoded (a vocabulary of 2**16
at most needs two bytes an id), or delta encoded with ``encoding="delta"``; row
groups and pages are small, and the page index lets a reader fetch the
metadata columns or a few documents without touching other ids.

``document_starts`` turns the places within parts into places in the whole
corpus from one sum per part.

Defined cases: a null or empty text is the end id alone; a null doc_id stands
before all others; rows with the same id are ordered by their text's hash;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch_path
from .tokens import encoder, vocabulary

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10


def _encode(path: str, kind: str, end: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, stop = encoder(path, kind), np.array([end], "<u4").tobytes()
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                packed = enc.encode_batch(some.column("text").to_pylist())
                n = np.fromiter((len(x) // 4 + 1 for x in packed), np.int64, len(packed))
                ids = np.frombuffer(stop.join([*packed, b""]), "<i4")
                bounds = np.concatenate([[0], np.cumsum(n)])
                starts = place + bounds[:-1]
                place += int(bounds[-1])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([part] * len(n), pa.int32()), pa.array(starts), pa.array(n), lists], names=["doc_id", "part", "part_start", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, kind: str = "byte", end: int = 0, encoding: str = "dictionary") -> None:
    """Encode ``docs`` (doc_id, text) and write the token files to ``path``."""
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dictionary = encoding == "dictionary"
    (
        ordered.mapInArrow(_encode(tokenizer, kind, end), FILE_SCHEMA)
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .option("parquet.writer.version", "PARQUET_1_0" if dictionary else "PARQUET_2_0")
        .option("compression", "zstd")
        .parquet(path)
    )


def part_offsets(files: DataFrame) -> DataFrame:
    """Where each file part begins in the whole corpus: a running sum over one
    row per part."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_offset"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The token files with each document's ``start`` in the whole corpus."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    return files.join(part_offsets(files), "part").select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("ids")
        bounds = lists.offsets.to_numpy()
        raw = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "part", "part_start")], pa.array(np.diff(bounds).astype("i8")), pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids as read back; ids
    are summed where they are read and do not move."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    read = files.select("doc_id", "part", "part_start", "ids").mapInArrow(_checksums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return read.join(part_offsets(files), "part").select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document encoded, written, and read back."""
    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return token_digests(spark, path)
