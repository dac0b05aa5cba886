"""Substring dedup over words (operator 2): difference-cover anchors.

A difference cover of a period p holds, for any two offsets, a shift that
brings both onto it. So if two windows of ``window`` words are equal, they
share an anchor, the ``window - p + 1`` words at a cover position, at the same
shift below p. Only anchors at cover positions are hashed and exchanged, five
in twenty-one; an anchor that occurs twice extends to the windows around it;
these alone are hashed whole, at 128 bits, and exchanged. Equal windows are
found in both directions, within a document too, with no pair ever listed, and
a passage that a third of all documents share costs each group one number.

Defined cases: a null or empty text has no words and nothing removed; texts
shorter than a window stay; repeated rows are copies of each other, so their
windows go; an empty table gives no rows; further columns are carried by
``remove_repeats`` under their own names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import documents, groups_for, settled
from .rolling import Members, cover, run_hashes, text_buffer, within, word_hashes

WINDOW = 35
#: A perfect difference set of the period 21 (any residue is the
#: difference of two of its members).
PERIOD = 21
COVER = (3, 6, 7, 12, 14)


class _Group:
    """The words of one group's texts, and hashes of their spans."""

    def __init__(self, table, window: int, text: str = "_text") -> None:
        self.data, self.bounds = text_buffer(table.column(text))
        self.words, self.first = word_hashes(self.data, self.bounds)
        self.window = window

    def both(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows that start at ``at``: the
        second lane, of the bytes too, is made only where there are any."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        second, _ = word_hashes(self.data, self.bounds, lane=1)
        return run_hashes(self.words, self.window)[at], run_hashes(second, self.window, 1)[at]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the anchors, places counted over all texts."""
        length = self.window - PERIOD + 1
        inside = within(self.first, length)
        local = np.arange(len(inside)) - np.repeat(self.first[:-1], np.diff(self.first))[: len(inside)]
        on = np.zeros(PERIOD, bool)
        on[list(COVER)] = True
        at = np.flatnonzero(inside & on[local % PERIOD])
        return at, run_hashes(self.words, length)[at]

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors at a shift below
        the period."""
        inside = within(self.first, self.window)
        near = cover(len(self.words) + 1, np.maximum(anchors - PERIOD + 1, 0), anchors + 1)[: len(inside)]
        return np.flatnonzero(inside & near)


def _send_anchors(window: int, buckets: int):
    def run(table):
        group = _Group(table, window)
        return exchange.send(table.column("_group")[0].as_py(), group.anchors()[1], None, buckets)

    return run


def _send_windows(window: int, buckets: int):
    def run(table, answer):
        group = _Group(table, window) if table.num_rows else None
        starts = np.zeros(0, np.int64)
        if group is not None and answer.num_rows:
            at, hashes = group.anchors()
            starts = group.around(at[Members(exchange.answered(answer)).of(hashes)])
        none = np.zeros(0, np.uint64)
        first, more = group.both(starts) if len(starts) else (none, none)
        return exchange.send(table.column("_group")[0].as_py() if table.num_rows else 0, first, more, buckets)

    return run


def _removed(group: _Group, answer) -> np.ndarray:
    """Which words of the group's texts go."""
    inside = within(group.first, group.window)
    if not answer.num_rows or not len(inside):
        return np.zeros(len(group.words), bool)
    # The first lane leaves few windows to be told by both.
    first, more = exchange.answered_wide(answer)
    near = np.flatnonzero(inside & Members(first).of(run_hashes(group.words, group.window)))
    starts = near[Members(first, more).of(*group.both(near))]
    return cover(len(group.words), starts, starts + group.window)


def _digest(window: int):
    def run(table, answer):
        import pyarrow as pa

        group = _Group(table, window)
        gone = _removed(group, answer)
        upto = np.concatenate([[0], np.cumsum(gone)])
        n_removed = upto[group.first[1:]] - upto[group.first[:-1]]
        digests, raw = [], group.data.tobytes()
        for k in range(table.num_rows):
            words = raw[group.bounds[k] : group.bounds[k + 1]].split()
            if n_removed[k]:
                words = [w for w, g in zip(words, gone[group.first[k] : group.first[k + 1]].tolist(), strict=True) if not g]
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "n_words": pa.array(np.diff(group.first)), "n_removed": pa.array(n_removed.astype(np.int64)), "kept_sha256": pa.array(digests, pa.string())})

    return run


def _rewrite(window: int):
    """The texts without the words that go and the white space behind them."""

    def run(table, answer):
        import pyarrow as pa

        from .rolling import Words

        group = _Group(table, window)
        gone = _removed(group, answer)
        texts = table.column("_text").to_pylist()
        for k in np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(gone)])[group.first])).tolist():
            raw = group.data[group.bounds[k] : group.bounds[k + 1]]
            words = Words(raw, np.array([0, len(raw)]))
            go = gone[group.first[k] : group.first[k + 1]]
            after = np.append(words.start[1:], len(raw))
            texts[k] = raw[~cover(len(raw), words.start[go], after[go])].tobytes().decode()
        rest = [c for c in table.column_names if c not in ("_group", "_text")]
        return pa.table({**{c: table.column(c) for c in rest}, "_text": pa.array(texts, pa.string())})

    return run


def _dealt(docs: DataFrame, carry: list, window: int) -> tuple[DataFrame, DataFrame]:
    """The dealt rows, and for each group the hashes of its repeated windows."""
    docs = settled(docs)
    groups, size = groups_for(docs, exchange.GROUP_BYTES)
    buckets = max(exchange.LEAST_BUCKETS, size // exchange.BUCKET_BYTES)
    dealt = exchange.deal(docs.select(*carry, F.col("text").alias("_text")), groups)
    anchors = exchange.shared(dealt.groupBy("_group").applyInArrow(_send_anchors(window, buckets), exchange.SENT))
    windows = exchange.shared(dealt.groupBy("_group").cogroup(anchors.groupBy("_group")).applyInArrow(_send_windows(window, buckets), exchange.SENT))
    return dealt, windows


def repeat_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of what is kept."""
    dealt, windows = _dealt(docs, [F.col("doc_id")], window)
    return dealt.groupBy("_group").cogroup(windows.groupBy("_group")).applyInArrow(_digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with the repeated words cut out of
    ``text``; ``n_chars``, where there is one, follows the new text."""
    rest = [c for c in docs.columns if c != "text"]
    dealt, windows = _dealt(docs, [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")] if rest else [F.lit(1).alias("_row")], window)
    out = dealt.groupBy("_group").cogroup(windows.groupBy("_group")).applyInArrow(_rewrite(window), dealt.select("_row", "_text").schema)
    value = lambda c: F.col("_text") if c == "text" else F.length("_text").cast("long") if c == "n_chars" else F.col(f"_row.`{c}`")
    return out.select(*[value(c).alias(c) for c in docs.columns])


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: repeated 35-word windows of all documents."""
    return repeat_digests(documents(spark, sf_dir))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without the passages that repeat."""
    return remove_repeats(docs)


SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
x AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM x) GROUP BY r),
k AS (SELECT d.r, string_agg(word, ' ' ORDER BY p) AS kept FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d) AS d
      LEFT JOIN g ON d.r = g.r WHERE g.gone IS NULL OR NOT list_contains(g.gone, d.p) GROUP BY d.r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r LEFT JOIN k ON d.r = k.r
"""
