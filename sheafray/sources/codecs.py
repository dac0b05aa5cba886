"""Codecs and filters of chunks: what a chunk's bytes become, and back.

The entropy coders are Python's and pyarrow's; only their framing is read
here. blosclz streams are not read.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib

import numpy as np

#: Fixed values of the blosc 1 frame: the stream's coder by the top three bits
#: of its flags.
BLOSC_CODERS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
#: A block is split by bytes of an element up to this size of element, and
#: from this many elements on.
BLOSC_MOST_SPLITS, BLOSC_LEAST_ELEMENTS = 16, 128
BYTE_SHUFFLE, PLAIN_COPY, BIT_SHUFFLE, NOT_SPLIT = 0x01, 0x02, 0x04, 0x10


def _inflate(coder: str, data: bytes, size: int) -> bytes:
    if coder == "zlib":
        return zlib.decompress(data)
    import pyarrow as pa

    return pa.Codec(coder).decompress(data, size).to_pybytes()


def _shuffled(data: bytes, width: int) -> bytes:
    """All first bytes of the elements, then all second ones, and so on; bytes
    after the last whole element stay behind."""
    whole = len(data) // width * width
    return np.frombuffer(data[:whole], np.uint8).reshape(-1, width).T.tobytes() + data[whole:]


def _unshuffled(data: bytes, width: int) -> bytes:
    whole = len(data) // width * width
    return np.frombuffer(data[:whole], np.uint8).reshape(width, -1).T.tobytes() + data[whole:]


def _bits_unshuffled(data: bytes, width: int) -> bytes:
    n = len(data) // width
    if n % 8:
        return data
    bits = np.unpackbits(np.frombuffer(data[: n * width], np.uint8).reshape(8 * width, -1), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * width :]


def blosc_decode(data: bytes) -> bytes:
    """The content of a blosc 1 frame."""
    flags, width = data[2], data[3]
    size, block, _ = struct.unpack("<III", data[4:16])
    if flags & PLAIN_COPY:
        return data[16 : 16 + size]
    if not size:
        return b""
    coder = BLOSC_CODERS.get(flags >> 5)
    if coder is None:
        raise ValueError("a blosc stream with a coder that is not available")
    out = []
    for k, at in enumerate(struct.unpack(f"<{-(-size // block)}I", data[16 : 16 + 4 * -(-size // block)])):
        n = min(block, size - k * block)
        split = not flags & NOT_SPLIT and width <= BLOSC_MOST_SPLITS and block // width >= BLOSC_LEAST_ELEMENTS and n == block
        parts = []
        for _ in range(width if split else 1):
            length, whole = struct.unpack("<I", data[at : at + 4])[0], n // width if split else n
            stored = data[at + 4 : at + 4 + length]
            parts.append(stored if length == whole else _inflate(coder, stored, whole))
            at += 4 + length
        content = b"".join(parts)
        if flags & BIT_SHUFFLE:
            content = _bits_unshuffled(content, width)
        elif flags & BYTE_SHUFFLE and width > 1:
            content = _unshuffled(content, width)
        out.append(content)
    return b"".join(out)


def blosc_encode(data: bytes, width: int = 1) -> bytes:
    """A blosc 1 frame of one block: shuffled by bytes, LZ4."""
    import pyarrow as pa

    packed = pa.Codec("lz4_raw").compress(_shuffled(data, width) if width > 1 else data).to_pybytes()
    if 24 + len(packed) >= 16 + len(data):
        return bytes([2, 1, PLAIN_COPY | 1 << 5, width]) + struct.pack("<III", len(data), len(data), 16 + len(data)) + data
    head = bytes([2, 1, BYTE_SHUFFLE | NOT_SPLIT | 1 << 5, width]) + struct.pack("<III", len(data), len(data), 24 + len(packed))
    return head + struct.pack("<II", 20, len(packed)) + packed


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _lz4(data: bytes) -> bytes:
    return _inflate("lz4_raw", data[4:], struct.unpack("<I", data[:4])[0])


DECODE = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "lzma": lzma.decompress, "blosc": blosc_decode, "zstd": _zstd, "lz4": _lz4}
ENCODE = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "bz2": bz2.compress, "lzma": lzma.compress, "blosc": blosc_encode}


def _delta(data: bytes, f: dict) -> bytes:
    return np.cumsum(np.frombuffer(data, f.get("astype") or f["dtype"]), dtype=f["dtype"]).astype(f["dtype"]).tobytes()


def _scaled(data: bytes, f: dict) -> bytes:
    stored = np.frombuffer(data, f.get("astype") or f["dtype"])
    return (stored / f["scale"] + f["offset"]).astype(f["dtype"]).tobytes()


def _cast(data: bytes, f: dict) -> bytes:
    return np.frombuffer(data, f["encode_dtype"]).astype(f["decode_dtype"]).tobytes()


def _bits(data: bytes, f: dict) -> bytes:
    """The first byte tells how many bits of the last are padding."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=1))
    return bits[: len(bits) - data[0]].tobytes()


def _checked(data: bytes, f: dict) -> bytes:
    if struct.unpack("<I", data[:4])[0] != zlib.crc32(data[4:]):
        raise ValueError("a chunk has another checksum than it says")
    return data[4:]


#: Rounding filters change nothing when read.
FILTERS = {
    "delta": _delta,
    "fixedscaleoffset": _scaled,
    "astype": _cast,
    "shuffle": lambda data, f: _unshuffled(data, f.get("elementsize", 4)),
    "packbits": _bits,
    "crc32": _checked,
    "quantize": lambda data, f: data,
    "bitround": lambda data, f: data,
}


def decode_chunk(data: bytes, codec: str | None, filters: list[dict]) -> bytes:
    """A chunk's values: the codec is undone first, then the filters from the
    last to the first."""
    data = DECODE[codec](data)
    for f in reversed(filters):
        data = FILTERS[f["id"]](data, f)
    return data
