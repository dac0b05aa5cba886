"""Suffix-array dedup over bytes (operator 4): maximal repeat groups from the
common-prefix interval tree of enhanced suffix arrays.

A suffix array of a whole corpus fits no task, so its suffixes are dealt by
content. Every window of a given length has one anchor, its least 80-byte gram
by hash; equal windows have equal anchors at equal places, so all windows of an
anchor are judged together and no repeat is split. Anchors that occur once are
dropped by a set exchange before any text moves. What is left are segments, the
bytes under the windows of one anchor.

For each anchor an enhanced suffix array (suffixes in order, and the common
prefix of neighbours) is built over its distinct segments and scanned with a
stack. Every interval of the scan with a common prefix of at least a window
holds all occurrences of one repeated string; if the bytes before its
occurrences differ, the string cannot be extended to the left for all of them
and the interval is a maximal repeat group, which covers its occurrences.
Other intervals lie inside such a group. A segment that occurs twice whole is
an interval by itself.

Two lengths are judged at once. ``length`` decides what is removed; ``least``,
half of it, is what counts as a passage: fifty short words are less than 400
bytes. The anchors of the longer windows are among those of the shorter ones.

An anchor with over ``HOT`` occurrences (a line that very many documents quote
among different words) would make one unbounded array. It is split by what
stands around it, at once to the end: into its windows, each of which is, as an
anchor with its whole context, an interval that needs no scan. Windows meet by
128-bit hashes in a set exchange, where each group sends a number once. Both
ways are exact and give the same spans.

Very long texts are read in slices of ``CHUNK_BYTES`` that overlap by a window;
each anchor belongs to one slice, so the arrays of a task stay small.

Defined cases: a null or empty text has no bytes; texts shorter than a window
stay; repeated rows are copies of each other; an empty table gives no rows;
further columns are carried by ``remove_repeats`` under their own names and
not read by the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import documents, groups_for, settled
from .rolling import Members, SpanHash, byte_codes, byte_runs, cover, mix64, sliding_argmin, text_buffer, text_chunks, within

LENGTH = 400
#: What counts as a passage.
LEAST = LENGTH // 2
GRAM = 80
#: An anchor's occurrences, at most, for a suffix array.
HOT = 256
CHUNK_BYTES = 1 << 20
#: Kinds of answers to a group: segments covered whole, segments covered in
#: part, and windows of each of the two lengths. 0 and 1: anchors, hot anchors.
WHOLE, PART, WINDOWS = 10, 11, 12

#: What groups send: windows as ``exchange.SENT`` has them, or segments, with
#: anchors as values and sizes as more.
_TOLD = exchange.SENT + ", places binary, data binary"


def common_prefix(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def maximal_repeats(strings: list[bytes], starts: list[list[int]], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeat groups of at least ``length`` bytes among the suffixes
    of ``strings`` that begin in ``starts``: (bytes, [(string, start), ...])."""
    suffixes = sorted((s[k:], i, k) for i, (s, ks) in enumerate(zip(strings, starts, strict=True)) for k in ks)
    n = len(suffixes)
    # left[j]: how many times the byte before a suffix differs from its forerunner's, up to j.
    left, before = [0] * n, None
    for j, (_, i, k) in enumerate(suffixes):
        byte = strings[i][k - 1] if k else None
        left[j] = (left[j - 1] if j else 0) + (byte is None or byte != before)
        before = byte
    groups, stack = [], []
    for j in range(1, n + 1):
        lcp = 0
        if j < n and suffixes[j][0][:length] == suffixes[j - 1][0][:length]:
            lcp = common_prefix(suffixes[j - 1][0], suffixes[j][0])
        first = j - 1
        while stack and stack[-1][0] > lcp:
            depth, first = stack.pop()
            if left[j - 1] > left[first]:
                groups.append((depth, [(i, k) for _, i, k in suffixes[first:j]]))
        if lcp >= length and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, first))
    return groups


def repeated_parts(segments: list[bytes], places: list[int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The maximal repeat groups among an anchor's distinct segments.

    ``places`` has the anchor's place in each. A window is repeated only if
    some other segment agrees with it left and right of the anchor. A group
    that cannot be extended to the left begins where two segments cease to
    agree, and how far any two agree is how far some neighbours in sorted
    order do; so few suffixes are worth sorting.
    """
    n = len(segments)
    right, left = [0] * n, [0] * n
    ceases: list[set[int]] = [set(), set()]
    sides = [s[p:] for s, p in zip(segments, places, strict=True)], [s[:p][::-1] for s, p in zip(segments, places, strict=True)]
    for best, keys, seen in zip((right, left), sides, ceases, strict=True):
        order = sorted(range(n), key=keys.__getitem__)
        for a, b in zip(order, order[1:], strict=False):
            k = common_prefix(keys[a], keys[b])
            best[a], best[b] = max(best[a], k), max(best[b], k)
            seen.add(k)
    back = sorted(ceases[1])
    starts = [[p - k for k in back if length - hi <= k <= lo] for p, lo, hi in zip(places, left, right, strict=True)]
    return maximal_repeats(segments, starts, length)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _digest(segment: bytes) -> bytes:
    return blake2b(segment, digest_size=16).digest()


class _Chunk:
    """Anchors, segments and windows of some texts, or of a slice of one.

    ``start`` and ``end`` are a segment's bytes, ``place`` its anchor's;
    ``long`` tells which anchors have windows of ``length``, that start from
    ``first`` to ``last``, and ``lo`` to ``hi`` are those of ``least``.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, least: int, length: int, keep: tuple[int, int]) -> None:
        self.data, self.least, self.length = data, least, length
        grams = mix64(SpanHash(byte_codes(data)).windows(GRAM))
        self.place, self.lo, self.hi = self._anchors(grams, bounds, least, keep)
        place, self.first, self.last = self._anchors(grams, bounds, length, keep)
        self.long = np.searchsorted(self.place, place)
        self.anchors = mix64(grams[self.place], 3)
        self.start, self.end = self.lo.copy(), self.hi + least
        self.start[self.long] = np.minimum(self.lo[self.long], self.first)
        self.end[self.long] = np.maximum(self.end[self.long], self.last + length)

    @staticmethod
    def _anchors(grams: np.ndarray, bounds: np.ndarray, length: int, keep: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The anchors' places, and the first and last window of each."""
        starts = np.flatnonzero(within(bounds, length))
        anchor = sliding_argmin(grams, length - GRAM + 1)[starts]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        place, first = anchor[at], starts[at]
        last = starts[np.append(at[1:], len(anchor)) - 1] if len(at) else starts
        own = (place >= keep[0]) & (place < keep[1])
        return place[own], first[own], last[own]

    def windows(self, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For both lengths the starts and 128-bit hashes of the windows of
        the anchors that ``hot`` marks."""
        if not hot.any():
            return
        mask = cover(len(self.data), self.start[hot], self.end[hot])
        compact, to = self.data[mask], np.cumsum(mask) - 1
        which = hot[self.long]
        levels = [(self.length, self.first[which], self.last[which])]
        if self.least < self.length:
            levels.append((self.least, self.lo[hot], self.hi[hot]))
        for length, lo, hi in levels:
            n = hi - lo + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            if len(at):
                yield length, at, *(byte_runs(compact, length, lane)[to[at]] for lane in (0, 1))


def _chunks(data: np.ndarray, bounds: np.ndarray, least: int, length: int) -> Iterator[tuple[int, _Chunk]]:
    """Chunks and where they begin: texts together, long ones in slices. A
    slice has all windows of the anchors that lie in its own part."""
    for lo, hi in text_chunks(bounds, CHUNK_BYTES):
        a, b = int(bounds[lo]), int(bounds[hi])
        if hi - lo > 1 or b - a <= 2 * CHUNK_BYTES:
            yield a, _Chunk(data[a:b], bounds[lo : hi + 1] - a, least, length, (0, b - a))
            continue
        for own in range(a, b, CHUNK_BYTES):
            c, d = max(a, own - length), min(b, own + CHUNK_BYTES + length)
            yield c, _Chunk(data[c:d], np.array([0, d - c]), least, length, (own - c, min(b, own + CHUNK_BYTES) - c))


def _group_of(table) -> int:
    return table.column("_group")[0].as_py() if table.num_rows else 0


def _send_anchors(least: int, length: int, buckets: int):
    def run(table):
        found = [c.anchors for _, c in _chunks(*text_buffer(table.column("_text")), least, length)]
        return exchange.send(_group_of(table), np.concatenate(found or [np.zeros(0, np.uint64)]), None, buckets)

    return run


def _tell(least: int, length: int, buckets: int, wide: int):
    """The distinct segments of a group's repeated anchors, packed by bucket,
    and behind those buckets the hashes of the windows of hot anchors."""

    def run(table, answer):
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        first, more = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        normal, hot = Members(exchange.answered(answer, 0)), Members(exchange.answered(answer, 1))
        for _, c in _chunks(*text_buffer(table.column("_text")), least, length) if answer.num_rows else ():
            hit = np.flatnonzero(normal.of(c.anchors))
            raw = c.data.tobytes() if len(hit) else b""
            for h, p, a, b in zip(c.anchors[hit].tolist(), c.place[hit].tolist(), c.start[hit].tolist(), c.end[hit].tolist(), strict=True):
                seen = held.setdefault((h * buckets) >> 64, {}).setdefault((h, raw[a:b]), [p - a, 0])
                seen[1] += 1
            for _, _, one, two in c.windows(hot.of(c.anchors)):
                first.append(one)
                more.append(two)
        group = _group_of(table)
        rows = []
        for bucket, segments in sorted(held.items()):
            keys, notes = list(segments), list(segments.values())
            rows.append(
                (
                    bucket,
                    group,
                    np.array([h for h, _ in keys], np.uint64).tobytes(),
                    np.array([len(s) for _, s in keys], np.int32).tobytes(),
                    np.array([n for _, n in notes], np.int32).tobytes(),
                    np.array([p for p, _ in notes], np.int32).tobytes(),
                    b"".join(s for _, s in keys),
                )
            )
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        names = ("_bucket", "_group", "values", "more", "counts", "places", "data")
        told = pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(names, kinds, strict=True))})
        windows = exchange.send(group, np.concatenate(first), np.concatenate(more), wide)
        none = pa.array([b""] * windows.num_rows, pa.binary())
        windows = windows.set_column(0, "_bucket", pc.add(windows.column("_bucket"), pa.scalar(buckets, pa.int32())))
        return pa.concat_tables([told, windows.append_column("places", none).append_column("data", none)])

    return run


def _scan(table, least: int, length: int, every: bool):
    """Judge a bucket's segments, anchor by anchor.

    Groups are told the digests of segments that are covered whole, and of
    others what is covered, by strings of ``least`` bytes and by those of
    ``length``. With ``every`` each group's part of each segment is told, and
    the digest of the repeated string.
    """
    import pyarrow as pa

    blob = lambda c: b"".join(table.column(c).to_pylist())
    anchors = np.frombuffer(blob("values"), np.uint64)
    sizes, places, counts = (np.frombuffer(blob(c), np.int32) for c in ("more", "places", "counts"))
    groups = np.repeat(np.array(table.column("_group").to_pylist(), np.int32), [len(x) // 8 for x in table.column("values").to_pylist()])
    data = blob("data")
    ends = np.cumsum(sizes, dtype=np.int64)
    order = np.argsort(anchors, kind="stable").tolist()
    whole: dict[int, list[bytes]] = {}
    part: dict[int, list[bytes]] = {}
    ends_, sizes_, anchors_, counts_, places_, groups_ = (x.tolist() for x in (ends, sizes, anchors, counts, places, groups))
    at = 0
    while at < len(order):
        stop = at
        distinct: dict[bytes, list] = {}
        while stop < len(order) and anchors_[order[stop]] == anchors_[order[at]]:
            j = order[stop]
            note = distinct.setdefault(data[ends_[j] - sizes_[j] : ends_[j]], [0, places_[j], [], []])
            note[0] += counts_[j]
            note[2].append(groups_[j])
            stop += 1
        at = stop
        notes = list(distinct.values())
        if len(notes) > 1 and (every or any(note[0] == 1 for note in notes)):
            for depth, where in repeated_parts(list(distinct), [note[1] for note in notes], least):
                for i, k in where:
                    notes[i][3].append((k, k + depth))
        for segment, note in distinct.items():
            own = _digest(segment)
            if note[0] > 1:
                for g in note[2]:
                    whole.setdefault(g, []).append(own)
            if every:
                told = [own + np.array([lo, hi, 0], np.uint64).tobytes() + _digest(segment[lo:hi]) for lo, hi in note[3]]
            elif note[0] == 1:
                long = merged([s for s in note[3] if s[1] - s[0] >= length])
                short = [s for s in merged(note[3]) if s not in long]
                told = [own + np.array([lo, hi, kind], np.uint64).tobytes() for kind, spans in ((0, short), (1, long)) for lo, hi in spans]
            else:
                told = []
            for g in note[2] if told else ():
                part.setdefault(g, []).extend(told)
    rows = [(g, kind, b"".join(v)) for kind, held in ((WHOLE, whole), (PART, part)) for g, v in held.items()]
    return pa.table({"_group": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "values": pa.array([r[2] for r in rows], pa.binary())})


def _judge(least: int, length: int, buckets: int, every: bool):
    """A bucket's answers: of segments by their scan, of windows by count."""
    count = exchange.counted(WINDOWS)

    def run(table):
        return count(table) if table.column("_bucket")[0].as_py() >= buckets else _scan(table, least, length, every)

    return run


def _found(data: np.ndarray, bounds: np.ndarray, answer, least: int, length: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
    """Starts and ends of what a group's answers cover, and whether strings of
    ``length`` do; with ``every`` the digests of the strings instead."""
    normal, hot = Members(exchange.answered(answer, 0)), Members(exchange.answered(answer, 1))
    windows = Members(*exchange.answered_wide(answer, WINDOWS))
    whole = {x.tobytes() for x in exchange.answered(answer, WHOLE).reshape(-1, 2)}
    part: dict[bytes, list[tuple]] = {}
    for x in exchange.answered(answer, PART).reshape(-1, 7 if every else 5):
        part.setdefault(x[:2].tobytes(), []).append((int(x[2]), int(x[3]), x[5:].tobytes() if every else bool(x[4])))
    starts, ends, notes = [], [], []
    for base, c in _chunks(data, bounds, least, length) if len(normal.values) or len(hot.values) else ():
        hit = np.flatnonzero(normal.of(c.anchors)) if whole or part else ()
        raw = c.data.tobytes() if len(hit) else b""
        for a, b in zip(c.start[hit].tolist(), c.end[hit].tolist(), strict=True) if len(hit) else ():
            own = _digest(raw[a:b])
            if own in whole:
                starts.append(base + a)
                ends.append(base + b)
                notes.append(own if every else b - a >= length)
            for lo, hi, note in part.get(own, ()):
                starts.append(base + a + lo)
                ends.append(base + a + hi)
                notes.append(note)
        for size, at, one, two in c.windows(hot.of(c.anchors)):
            ok = windows.of(one, two)
            starts.extend((base + at[ok]).tolist())
            ends.extend((base + at[ok] + size).tolist())
            notes.extend((x.tobytes() for x in np.stack([one[ok], two[ok]], axis=1)) if every else [size >= length] * int(ok.sum()))
    return np.array(starts, np.int64), np.array(ends, np.int64), notes


def _runs(gone: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text how many bytes ``gone`` marks, and in how many runs."""
    upto = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(gone))]
    begins[inner] = gone[inner]
    runs = np.concatenate([[0], np.cumsum(begins)])
    return upto[bounds[1:]] - upto[bounds[:-1]], runs[bounds[1:]] - runs[bounds[:-1]]


def _report(least: int, length: int):
    def run(table, answer):
        import pyarrow as pa

        data, bounds = text_buffer(table.column("_text"))
        starts, ends, enough = _found(data, bounds, answer, least, length)
        enough = np.array(enough, bool)
        gone = cover(len(data), starts[enough], ends[enough])
        removed, spans = _runs(gone, bounds)
        repeated, passages = _runs(cover(len(data), starts, ends), bounds)
        digests = []
        for a, b, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), removed.tolist(), strict=True):
            digests.append(sha256((data[a:b][~gone[a:b]] if k else data[a:b]).tobytes()).hexdigest())
        numbers = {"n_bytes": np.diff(bounds), "n_removed": removed, "n_spans": spans}
        more = {"n_repeated": repeated, "n_passages": passages}
        whole = lambda held: {k: pa.array(v.astype(np.int64)) for k, v in held.items()}
        return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), **whole(numbers), "kept_sha256": pa.array(digests, pa.string()), **whole(more)})

    return run


def _groups(least: int, length: int):
    def run(table, answer):
        import pyarrow as pa

        data, bounds = text_buffer(table.column("_text"))
        starts, ends, names = _found(data, bounds, answer, least, length, every=True)
        text = np.searchsorted(bounds, starts, "right") - 1
        # Slices and anchors may tell of one occurrence twice.
        rows = sorted({(n.hex(), k, s - int(bounds[k]), e - s) for n, k, s, e in zip(names, text.tolist(), starts.tolist(), ends.tolist(), strict=True)})
        ids = table.column("doc_id").to_pylist()
        return pa.table(
            {
                "repeat_id": pa.array([r[0] for r in rows], pa.string()),
                "doc_id": pa.array([ids[r[1]] for r in rows], pa.int64()),
                "start": pa.array([r[2] for r in rows], pa.int64()),
                "length": pa.array([r[3] for r in rows], pa.int64()),
            }
        )

    return run


def _cut(least: int, length: int):
    def run(table, answer):
        import pyarrow as pa

        data, bounds = text_buffer(table.column("_text"))
        starts, ends, enough = _found(data, bounds, answer, least, length)
        enough = np.array(enough, bool)
        gone = cover(len(data), starts[enough], ends[enough])
        texts = table.column("_text").to_pylist()
        for k in np.flatnonzero(_runs(gone, bounds)[0]).tolist():
            a, b = bounds[k], bounds[k + 1]
            texts[k] = data[a:b][~gone[a:b]].tobytes().decode(errors="ignore")
        rest = [c for c in table.column_names if c not in ("_group", "_text")]
        return pa.table({**{c: table.column(c) for c in rest}, "_text": pa.array(texts, pa.string())})

    return run


def _judged(docs: DataFrame, carry: list, least: int, length: int, hot: int, every: bool = False):
    """The dealt rows, and for each group the answers about its text."""
    if not GRAM <= least <= length:
        raise ValueError(f"least is to be from {GRAM} to length")
    docs = settled(docs)
    groups, size = groups_for(docs, exchange.GROUP_BYTES)
    buckets = max(exchange.LEAST_BUCKETS, size // exchange.GROUP_BYTES)
    dealt = exchange.deal(docs.select(*carry, F.col("text").alias("_text")), groups)
    by_group = lambda df: df.groupBy("_group")
    wide = max(exchange.LEAST_BUCKETS, size // exchange.BUCKET_BYTES)
    anchors = exchange.shared(by_group(dealt).applyInArrow(_send_anchors(least, length, wide), exchange.SENT), hot=hot)
    told = by_group(dealt).cogroup(by_group(anchors)).applyInArrow(_tell(least, length, buckets, wide), _TOLD)
    judged = told.groupBy("_bucket").applyInArrow(_judge(least, length, buckets, every), exchange.ANSWER)
    return by_group(dealt), by_group(anchors.unionByName(judged))


def repeat_digests(docs: DataFrame, length: int = LENGTH, hot: int = HOT, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is kept when
    strings of ``length`` bytes that occur again are removed; n_repeated and
    n_passages: bytes under strings of ``least`` bytes that occur again, and
    their maximal runs."""
    dealt, answers = _judged(docs, [F.col("doc_id")], least, length, hot)
    return dealt.cogroup(answers).applyInArrow(_report(least, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, n_passages long")


def repeat_groups(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(repeat_id, doc_id, start, length): all occurrences, in bytes, of the
    repeat groups of at least ``length`` bytes that are maximal within the
    reach of an anchor. Rows with one repeat_id are one string; repeats at a
    hot anchor are told by their windows."""
    dealt, answers = _judged(docs, [F.col("doc_id").cast("long").alias("doc_id")], length, length, hot, every=True)
    return dealt.cogroup(answers).applyInArrow(_groups(length, length), "repeat_id string, doc_id long, start long, length long")


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """All rows and columns of ``docs`` without the bytes under strings of
    ``length`` bytes that occur again; of a character cut in two nothing is
    left. ``n_chars``, where there is one, follows the new text."""
    rest = [c for c in docs.columns if c != "text"]
    carry = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")] if rest else [F.lit(1).alias("_row")]
    schema = docs.select(*carry, F.col("text").alias("_text")).schema
    dealt, answers = _judged(docs, carry, length, length, hot)
    out = dealt.cogroup(answers).applyInArrow(_cut(length, length), schema)
    value = lambda c: F.col("_text") if c == "text" else F.length("_text").cast("long") if c == "n_chars" else F.col(f"_row.`{c}`")
    return out.select(*[value(c).alias(c) for c in docs.columns])


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: repeated 400-byte strings of all documents."""
    return repeat_digests(documents(spark, sf_dir))
