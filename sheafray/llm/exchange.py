"""Which numbers occur in two places: a set exchange between groups of rows.

Rows are dealt into groups of a few megabytes. Each group sends the distinct
numbers it holds, packed, to buckets by value; a bucket sees each number once
per group, so no number is hot, and answers each group with those of its
numbers that another group holds too, or that it holds twice itself. What is
shuffled is eight or sixteen bytes a distinct number; what a task holds is one
group or one bucket.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a group and, through the numbers made of them, in a bucket.
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 48 << 20
LEAST_BUCKETS = 16

SENT = "_bucket int, _group int, values binary, more binary, counts binary"
ANSWER = "_group int, kind int, values binary"


def deal(docs: DataFrame, groups: int) -> DataFrame:
    """Add ``_group``: rows spread evenly, whatever their ids or texts."""
    return docs.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))


def send(group: int, values: np.ndarray, more: np.ndarray | None, buckets: int):
    """The rows that carry a group's numbers to their buckets.

    ``more`` holds 64 further bits of each number, or is None.
    """
    import pyarrow as pa

    if more is None:
        uniq, count = np.unique(values, return_counts=True)
        rest = None
    else:
        order = np.lexsort((more, values))
        values, more = values[order], more[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (more[1:] != more[:-1])
        at = np.flatnonzero(new)
        uniq, rest, count = values[at], more[at], np.diff(np.append(at, len(values)))
    # Values ascend, so each bucket takes one stretch of them.
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    cuts = [0, *np.searchsorted(uniq, np.array(edges, np.uint64)).tolist(), len(uniq)]
    rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
    counts = np.minimum(count, 2**31).astype(np.uint32)
    return pa.table(
        {
            "_bucket": pa.array([b for b, _, _ in rows], pa.int32()),
            "_group": pa.array([group] * len(rows), pa.int32()),
            "values": pa.array([uniq[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
            "more": pa.array([rest[lo:hi].tobytes() if rest is not None else b"" for _, lo, hi in rows], pa.binary()),
            "counts": pa.array([counts[lo:hi].tobytes() for _, lo, hi in rows], pa.binary()),
        }
    )


def counted(kind: int, hot: int | None = None) -> Callable:
    """What a bucket answers to the groups that sent it numbers."""

    def run(table):
        import pyarrow as pa

        groups = table.column("_group").to_pylist()
        blobs = table.column("values").to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(b) // 8 for b in blobs])])
        values = np.frombuffer(b"".join(blobs), np.uint64)
        wide = b"".join(table.column("more").to_pylist())
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32).astype(np.int64)
        order = np.argsort(values, kind="stable")
        new = np.ones(len(values), bool)
        new[1:] = values[order][1:] != values[order][:-1]
        if wide:
            more = np.frombuffer(wide, np.uint64)
            if ((more[order][1:] != more[order][:-1]) & ~new[1:]).any():
                order = np.lexsort((more, values))
                new[1:] = values[order][1:] != values[order][:-1]
            new[1:] |= more[order][1:] != more[order][:-1]
        at = np.flatnonzero(new)
        total = np.empty(len(values), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.append(at, len(values)))) if len(at) else 0
        rows = []
        for g, lo, hi in zip(groups, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = total[lo:hi]
            own = np.stack([values[lo:hi], more[lo:hi]], axis=1) if wide else values[lo:hi]
            rows.append((g, kind, own[(n > 1) if hot is None else (n > 1) & (n <= hot)]))
            if hot is not None:
                rows.append((g, kind + 1, own[n > hot]))
        rows = [r for r in rows if len(r[2])]
        return pa.table(
            {
                "_group": pa.array([r[0] for r in rows], pa.int32()),
                "kind": pa.array([r[1] for r in rows], pa.int32()),
                "values": pa.array([r[2].tobytes() for r in rows], pa.binary()),
            }
        )

    return run


def shared(sent: DataFrame, kind: int = 0, hot: int | None = None) -> DataFrame:
    """``ANSWER`` rows: for each group its numbers that occur elsewhere too,
    or twice in it; those with over ``hot`` occurrences in all as ``kind`` + 1.
    128-bit numbers come back whole, half by half (``answered_wide``).
    """
    return sent.groupBy("_bucket").applyInArrow(counted(kind, hot), ANSWER)


def answered_wide(table, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All 128-bit numbers of an answer that one group got."""
    halves = answered(table, kind).reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def answered(table, kind: int = 0) -> np.ndarray:
    """All numbers of an answer that one group got."""
    return np.frombuffer(b"".join(v for v, k in zip(table.column("values").to_pylist(), table.column("kind").to_pylist(), strict=True) if k == kind), np.uint64)
