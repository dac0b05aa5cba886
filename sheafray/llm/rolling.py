"""Array kernels shared by the duplicate operators: hashes of words, of runs
of a given length, and sliding minima.

What decides whether two strings are equal is mixed, not summed: a word's
bytes go through a bijective mixer eight at a time, and a run's hash mixes
those of its two halves. Two lanes of different seeds give 128 bits.
``SpanHash``, a sum of code(x_i) * B**i modulo 2**64, is cheaper and tells
long strings of a special make apart badly; it only chooses anchors.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Odd multipliers.
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finalizer: equal inputs, and only they, give equal outputs."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        z ^= z >> np.uint64(30)
        z *= _M1
        z ^= z >> np.uint64(27)
        z *= _M2
        z ^= z >> np.uint64(31)
        return z


class SpanHash:
    """Hashes of spans of one long sequence of symbols."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, codes: np.ndarray, lane: int = 0) -> None:
        base = int(mix64(np.array([977 + lane], np.uint64))[0]) | 1
        n = len(codes) + 1
        up, down = self._powers.get(lane, (np.ones(1, np.uint64), np.ones(1, np.uint64)))
        if len(up) < n:
            size = max(n, 2 * len(up))
            up, down = self._table(base, size), self._table(pow(base, -1, 2**64), size)
            self._powers[lane] = (up, down)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(n, np.uint64)
            np.cumsum(codes * up[: n - 1], out=self.sums[1:])
        self.down = down

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(out, dtype=np.uint64)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, length: int) -> np.ndarray:
        """The hash of each window of ``length`` symbols, by its start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def byte_codes(data: np.ndarray, lane: int = 0) -> np.ndarray:
    """A random 64-bit code for each byte."""
    return mix64(np.arange(256, dtype=np.uint64), 11 + lane)[data]


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray((max(0, len(data) - 7),), np.dtype("<u8"), np.ascontiguousarray(data), strides=(1,))


#: Of a number its first k bytes.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def run_hashes(codes: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """The hash of each run of ``length`` numbers, by its start, from the
    hashes of runs of half that length. ``codes`` are themselves mixed."""
    if len(codes) < length:
        return np.zeros(0, np.uint64)
    h, n = codes if lane == 0 else mix64(codes, lane), 1
    while n < length:
        step = min(n, length - n)
        with np.errstate(over="ignore"):
            h = mix64(h[:-step] + h[step:] * _M3, 101 + lane)
        n += step
    return h


def byte_runs(data: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """The hash of each run of ``length`` bytes, at least eight, by its start."""
    h, n = mix64(octets(data), 211 + lane), 8
    while n < length and len(h):
        step = min(n, length - n)
        with np.errstate(over="ignore"):
            h = mix64(h[:-step] + h[step:] * _M3, 223 + lane)
        n += step
    return h


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Words:
    """The words of many texts that lie one behind another in ``data``.

    ``bounds`` has the texts' byte offsets, one more than there are texts.
    ``start`` and ``end`` are the words' bytes, ``first`` the number of words
    before each text, again one more than there are texts.
    """

    LONG = 64

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_IS_SPACE[data]
        begins = solid[1:] & ~solid[:-1]  # at i: a word may start at byte i
        ends = ~solid[1:] & solid[:-1]  # at i: a word ends before byte i
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        cut = inner[solid[inner] & solid[inner + 1]]  # texts that meet without a space between
        begins[cut] = True
        ends[cut] = True
        self.data, self.bounds = data, bounds
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A hash of each word's bytes. Words of up to eight bytes are mixed
        as one number, longer ones number by number, those over ``LONG`` bytes
        by a cryptographic hash."""
        size = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = octets(padded)
        out = mix64(eight[self.start] & _MASK[np.minimum(size, 8)], 3 + lane)
        more, k = np.flatnonzero((size > 8) & (size <= self.LONG)), 8
        while len(more):
            out[more] = mix64(out[more] ^ (eight[self.start[more] + k] & _MASK[np.minimum(size[more] - k, 8)]), 3 + lane)
            k += 8
            more = more[size[more] > k]
        for j in np.flatnonzero(size > self.LONG).tolist():
            out[j] = int.from_bytes(blake2b(self.data[self.start[j] : self.end[j]], digest_size=8, salt=bytes([lane])).digest(), "little")
        return mix64(out + size.astype(np.uint64), 5 + lane)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string or binary column and the values' offsets;
    null values are empty.

    Workers are reused from stage to stage, so this, the start of each batch of
    the duplicate operators, gives back what a tokenizing stage left.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    from .tokens import release

    release()

    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def within(first: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``length`` symbols lie inside one text, by start.

    ``first`` has the number of symbols before each text, and in all. A window
    is cut by a border at b if its start is in (b - length, b).
    """
    n = max(0, int(first[-1]) - length + 1)
    inner, size = first[1:-1], int(first[-1]) + 2
    edge = np.bincount(np.maximum(inner - length + 1, 0), minlength=size) - np.bincount(inner, minlength=size)
    return np.cumsum(edge[:n]) == 0


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any span [start, end)."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of a least value in each window of ``width``, which depends
    on the window's values alone.

    Values are compared by their high 32 bits and then by place, so equal
    windows choose alike wherever they stand. ``values`` has under 2**32.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64(0xFFFFFFFF)
    blocks = -(-len(values) // width)
    keys = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    keys[: len(values)] = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    grid = keys.reshape(blocks, width)
    prefix = np.minimum.accumulate(grid, axis=1).ravel()
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n]) & low).astype(np.int64)


class Members:
    """A set of 64-bit numbers, or of 128-bit ones if ``more`` has their
    second halves, to test arrays against."""

    BITS = 20

    def __init__(self, values: np.ndarray, more: np.ndarray | None = None) -> None:
        self.more = None
        if more is None:
            self.values = np.unique(values)
        else:
            order = np.lexsort((more, values))
            self.values, self.more = values[order], more[order]
            # How many may share a first half, which is 1 but for chance.
            self.most = int(np.unique(self.values, return_counts=True)[1].max(initial=1)) if len(values) else 1
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(self.values >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def of(self, values: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """Which values are in the set: a bitmap lookup settles most."""
        out = np.zeros(len(values), bool)
        if not len(self.values):
            return out
        maybe = np.flatnonzero(self.seen[(values >> np.uint64(64 - self.BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, values[maybe]), len(self.values) - 1)
        if self.more is None:
            out[maybe] = self.values[at] == values[maybe]
            return out
        for k in range(self.most):
            j = np.minimum(at + k, len(self.values) - 1)
            out[maybe] |= (self.values[j] == values[maybe]) & (self.more[j] == more[maybe])
        return out


def text_chunks(bounds: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each, to bound what byte-wise
    arrays take; a longer text is a range of its own."""
    out, lo = [], 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray, chunk: int = 2 << 20, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, and the number of words before
    each text, with one more entry for all."""
    parts, counts = [], []
    for lo, hi in text_chunks(bounds, chunk):
        words = Words(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        parts.append(words.hashes(lane))
        counts.append(np.diff(words.first))
    first = np.zeros(len(bounds), np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=first[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), first
