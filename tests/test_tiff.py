"""Packed TIFF images, written here strip by strip or tile by tile."""

import struct
import zlib

import numpy as np
import pytest

from sheafray.sources import arrays


def _lzw(data: bytes) -> bytes:
    """The encoder: codes widen when the table holds one less than they tell."""
    codes, table, word = [(256, 9)], {bytes([k]): k for k in range(256)}, b""
    width, n = 9, 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        codes.append((table[word], width))
        table[word + bytes([b])] = n
        n += 1
        if n == 1 << width and width < 12:
            width += 1
        if n == 4094:
            codes.append((256, width))
            table, width, n = {bytes([k]): k for k in range(256)}, 9, 258
        word = bytes([b])
    if word:
        codes.append((table[word], width))
    codes.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def _packbits(data: bytes) -> bytes:
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return out


def _predicted(block: np.ndarray, predictor: int) -> bytes:
    if predictor == 2:
        first = block.astype(block.dtype.newbyteorder("="))
        return np.concatenate([first[:, :1], np.diff(first, axis=1)], axis=1).astype(block.dtype).tobytes()
    if predictor == 3:
        big = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8).reshape(*block.shape, -1)
        planes = big.transpose(0, 2, 1).reshape(len(block), -1)
        return np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).tobytes()
    return block.tobytes()


def _tiff(image: np.ndarray, packing: int, predictor: int, tile: int | None, end: str) -> bytes:
    image = image.astype(image.dtype.newbyteorder(end))
    pack = {1: bytes, 5: _lzw, 8: zlib.compress, 32946: zlib.compress, 32773: _packbits}[packing]
    if tile:
        wide = np.pad(image, [(0, -n % tile) for n in image.shape])
        blocks = [wide[r : r + tile, c : c + tile] for r in range(0, wide.shape[0], tile) for c in range(0, wide.shape[1], tile)]
    else:
        blocks = [image[r : r + 5] for r in range(0, len(image), 5)]
    parts = [pack(_predicted(np.ascontiguousarray(b), predictor)) for b in blocks]
    at, offsets = 8, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    lists = struct.pack(f"{end}{len(parts)}I", *offsets), struct.pack(f"{end}{len(parts)}I", *map(len, parts))
    where = (at, at + len(lists[0]))
    value = lambda k: where[k] if len(parts) > 1 else struct.unpack(f"{end}I", lists[k])[0]
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags = [(256, 4, 1, image.shape[1]), (257, 4, 1, image.shape[0]), (258, 3, 1, 8 * image.itemsize), (259, 3, 1, packing), (317, 3, 1, predictor), (339, 3, 1, kind)]
    tags += [(322, 4, 1, tile), (323, 4, 1, tile), (324, 4, len(parts), value(0)), (325, 4, len(parts), value(1))] if tile else [(273, 4, len(parts), value(0)), (278, 4, 1, 5), (279, 4, len(parts), value(1))]
    start = where[1] + len(lists[1])
    body = b"".join(struct.pack(end + "HHI", t, k, n) + (struct.pack(end + "I", v) if k == 4 else struct.pack(end + "HH", v, 0)) for t, k, n, v in sorted(tags))
    mark = b"II*\0" if end == "<" else b"MM\0*"
    return mark + struct.pack(end + "I", start) + b"".join(parts) + lists[0] + lists[1] + struct.pack(end + "H", len(tags)) + body + struct.pack(end + "I", 0)


@pytest.mark.parametrize("packing", [1, 5, 8, 32946, 32773])
@pytest.mark.parametrize("tile", [None, 16])
def test_packed_images(packing, tile):
    rng = np.random.default_rng(packing)
    for end in "<>":
        for image, predictors in ((rng.normal(size=(23, 37)).astype(np.float32), (1, 3)), (rng.integers(0, 9, (23, 37)).astype(np.uint8), (1, 2)), (rng.integers(-900, 900, (12, 40)).astype(np.int16), (1, 2)), (np.full((30, 60), -1, np.float32), (1, 3))):
            for predictor in predictors:
                got = arrays.decode_tiff(_tiff(image, packing, predictor, tile, end))
                assert got.shape == image.shape and (got == image).all()


def test_what_is_not_known_raises():
    image = np.zeros((6, 6), np.uint8)
    with pytest.raises(ValueError, match="predictor"):
        arrays.decode_tiff(_tiff(image, 8, 3, None, "<").replace(struct.pack("<HHI", 317, 3, 1) + struct.pack("<HH", 3, 0), struct.pack("<HHI", 317, 3, 1) + struct.pack("<HH", 7, 0)))
    with pytest.raises(ValueError, match="compression"):
        arrays.decode_tiff(_tiff(image, 1, 1, None, "<").replace(struct.pack("<HHI", 259, 3, 1) + struct.pack("<HH", 1, 0), struct.pack("<HHI", 259, 3, 1) + struct.pack("<HH", 7, 0)))
