"""Raster images as rows: PNG files of masks, labels and predictions.

Files are read with Spark's binaryFile source, an image is decoded on one
executor, and pixels become rows there.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel by colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Weights of red, green and blue in a grey value, of 65536.
_LUMA = (19595, 38470, 7471)


def _unfiltered(raw: bytes, rows: int, width: int, pixel: int) -> np.ndarray:
    """A PNG's rows of ``width`` bytes, whose filters refer to the byte a pixel
    before, the one above, and the one above that."""
    lines = np.frombuffer(raw, np.uint8, rows * (width + 1)).reshape(rows, width + 1)
    out = np.zeros((rows + 1, width), np.uint8)
    for r in range(rows):
        kind, line, above = lines[r, 0], lines[r, 1:], out[r]
        if kind == 0:
            out[r + 1] = line
        elif kind == 1:
            pad = -width % pixel
            steps = np.concatenate([line, np.zeros(pad, np.uint8)]).reshape(-1, pixel)
            out[r + 1] = np.cumsum(steps, axis=0, dtype=np.uint8).ravel()[:width]
        elif kind == 2:
            out[r + 1] = line + above
        elif kind in (3, 4):
            now, up = bytearray(line.tobytes()), above.tobytes()
            for k in range(width):
                left, corner = (now[k - pixel], up[k - pixel]) if k >= pixel else (0, 0)
                if kind == 3:
                    guess = (left + up[k]) // 2
                else:
                    p = left + up[k] - corner
                    guess = min((left, up[k], corner), key=lambda v: abs(p - v))
                now[k] = (now[k] + guess) & 255
            out[r + 1] = np.frombuffer(bytes(now), np.uint8)
        else:
            raise ValueError(f"a PNG with the filter {kind}")
    return out[1:]


def decode_png(data: bytes) -> np.ndarray:
    """The grey values of a PNG that is not interlaced, by row and column:
    colours by their luma, palettes looked up, transparency left out, 16 bits
    by their upper byte."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, [], None, None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(part)
        elif kind == b"IEND":
            break
        at += 12 + n
    columns, rows, depth, colour, _, _, interlaced = head
    if interlaced or colour not in _SAMPLES:
        raise ValueError("an interlaced PNG, or one of an unknown colour type")
    samples = _SAMPLES[colour]
    width = -(-columns * samples * depth // 8)
    lines = _unfiltered(zlib.decompress(b"".join(body)), rows, width, max(1, samples * depth // 8))
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)[:, :columns]
        values = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)
        if colour == 0:
            values = values * 255 // ((1 << depth) - 1)
    else:
        values = lines[:, :: depth // 8].reshape(rows, columns, samples).astype(int)
        values = values[..., 0] if samples < 3 else values
    if colour == 3:
        values = palette[values].astype(int)
    if values.ndim == 3:
        values = (sum(w * values[..., k] for k, w in enumerate(_LUMA)) + (1 << 15)) >> 16
    return values.astype(np.uint8)


def encode_png(image: np.ndarray) -> bytes:
    """A grey PNG of whole bytes, rows unfiltered."""
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((len(image), 1), np.uint8), image.astype(np.uint8)], axis=1)
    return _SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def read_rasters(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(path, i, j, v, on) of every pixel of the PNG files at ``path``, a file,
    folder or pattern; ``on`` says that the grey value reaches ``least``."""

    def run(batches):
        import pandas as pd

        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                image = decode_png(bytes(content))
                i, j = np.indices(image.shape).reshape(2, -1)
                # A few rows of pixels at a time.
                for lo in range(0, len(i), 1 << 18):
                    v = image.ravel()[lo : lo + (1 << 18)].astype(int)
                    yield pd.DataFrame({"path": name, "i": i[lo : lo + (1 << 18)], "j": j[lo : lo + (1 << 18)], "v": v, "on": v >= least})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, i int, j int, v int, on boolean")
