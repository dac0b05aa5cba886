import http.server
import struct
import threading
import zlib

import numpy as np
import pytest

from sheafray.operators import volume
from sheafray.sources import ingest, raster


def _png(image: np.ndarray, depth: int, colour: int, filters: list[int], palette: bytes = b"") -> bytes:
    """Rows filtered by the textbook formulas, byte by byte."""
    rows, pixel = image.shape[0], max(1, depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] // 8)
    flat = image.reshape(rows, -1)
    if depth < 8:
        bits = (flat[..., None] >> np.arange(depth)[::-1]) & 1
        lines = np.packbits(bits.reshape(rows, -1).astype(np.uint8), axis=1)
    else:
        lines = flat.astype(">u2").view(np.uint8) if depth == 16 else flat.astype(np.uint8)
    out, above = b"", [0] * lines.shape[1]
    for r in range(rows):
        line, kind = [int(v) for v in lines[r]], filters[r % len(filters)]
        coded = []
        for k, v in enumerate(line):
            a, b, c = (line[k - pixel] if k >= pixel else 0), above[k], (above[k - pixel] if k >= pixel else 0)
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded.append((v - [0, a, b, (a + b) // 2, nearest][kind]) % 256)
        out += bytes([kind, *coded])
        above = line
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(out)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], rows, depth, colour, 0, 0, 0)) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", packed[:50]) + part(b"IDAT", packed[50:]) + part(b"IEND", b"")


def test_png_depths_colours_and_filters():
    rng = np.random.default_rng(1)
    every = [0, 1, 2, 3, 4]
    grey = rng.integers(0, 256, (11, 13))
    assert (raster.decode_png(_png(grey, 8, 0, every)) == grey).all() and (raster.decode_png(raster.encode_png(grey)) == grey).all()
    wide = rng.integers(0, 65536, (7, 5))
    assert (raster.decode_png(_png(wide, 16, 0, every)) == wide >> 8).all()
    for depth in (1, 2, 4):
        few = rng.integers(0, 1 << depth, (6, 11))
        assert (raster.decode_png(_png(few, depth, 0, every)) == few * 255 // ((1 << depth) - 1)).all()
    rgb = rng.integers(0, 256, (9, 4, 3))
    luma = (rgb @ [19595, 38470, 7471] + 32768) >> 16
    assert (raster.decode_png(_png(rgb, 8, 2, every)) == luma).all()
    assert (raster.decode_png(_png(np.concatenate([rgb, rgb[..., :1]], axis=2), 8, 6, every)) == luma).all()
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    index = rng.integers(0, 16, (5, 9))
    assert (raster.decode_png(_png(index, 4, 3, [0], palette.tobytes())) == (palette[index].astype(int) @ [19595, 38470, 7471] + 32768) >> 16).all()
    with pytest.raises(ValueError, match="not a PNG"):
        raster.decode_png(b"GIF89a")


def test_rasters_as_rows(spark, tmp_path):
    images = {n: np.random.default_rng(k).integers(0, 3, (6 + k, 5)) for k, n in enumerate("ab")}
    for n, image in images.items():
        (tmp_path / f"{n}.png").write_bytes(raster.encode_png(image))
    (tmp_path / "c.txt").write_text("no image")
    got = raster.read_rasters(spark, str(tmp_path)).collect()
    assert len(got) == sum(v.size for v in images.values())
    for r in got:
        assert r.v == images[r.path[-5]][r.i, r.j] and r.on == (r.v > 0)


class _Flaky(http.server.BaseHTTPRequestHandler):
    asked: dict = {}

    def do_GET(self):
        n = self.asked[self.path] = self.asked.get(self.path, 0) + 1
        if self.path == "/gone":
            self.send_error(404)
        elif self.path == "/down" or (self.path == "/late" and n < 3):
            self.send_error(503)
        else:
            body = self.path.encode() * (1 if self.path == "/short" and n == 1 else 2)
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_ingest_resumes(spark, tmp_path):
    _Flaky.asked = {}
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Flaky)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        names = ["good", "late", "gone", "down", "short", "deep/one"]
        objects = spark.createDataFrame([(f"{url}/{n}", f"x/{n}", None if n in ("gone", "good") else 2 * (len(n) + 1)) for n in names], "url string, path string, size long").repartition(3)
        got = {r.path[2:]: (r.status, r.bytes, r.tries) for r in ingest.ingest(objects, str(tmp_path), attempts=3, pause=0.01).collect()}
        assert got == {"good": ("fetched", 10, 1), "late": ("fetched", 10, 3), "gone": ("missing", 0, 1), "down": ("failed", 0, 3), "short": ("fetched", 12, 2), "deep/one": ("fetched", 18, 1)}
        assert (tmp_path / "x/deep/one").read_bytes() == b"/deep/one" * 2
        (tmp_path / "x/late").write_bytes(b"cut")  # another size than it should have
        asked = dict(_Flaky.asked)
        got = {r.path[2:]: r.status for r in ingest.ingest(objects, str(tmp_path), attempts=1).collect()}
        assert got == {"good": "present", "late": "fetched", "gone": "missing", "down": "failed", "short": "present", "deep/one": "present"}
        assert {k for k in asked if _Flaky.asked[k] > asked[k]} == {"/late", "/gone", "/down"}
        assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["good", "late", "one", "short"]
    finally:
        server.shutdown()


def test_rounded_and_nearest_samples(spark):
    rng = np.random.default_rng(9)
    v = rng.integers(0, 256, (6, 5, 4))
    voxels = spark.createDataFrame([(*map(int, k), int(n)) for k, n in np.ndenumerate(v)] and [(int(a), int(b), int(c), int(v[a, b, c])) for a, b, c in np.ndindex(v.shape)], "z int, y int, x int, v int")
    at = np.concatenate([rng.uniform(-1, 6, (200, 3)), np.array([[0, 0, 0], [5, 4, 3], [2.5, 1.5, 0.5], [5.0, 2.2, 3.0], [5.01, 0, 0]])])
    rows = [(k, *map(float, p), bool(k % 9)) for k, p in enumerate(at)] + [(900, None, 1.0, 1.0, True), (901, float("nan"), 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "key int, z double, y double, x double, ok boolean")
    for sampling in ("nearest", "trilinear"):
        got = {r.key: (r.value, r.inside) for r in volume.sample_coords(df, voxels, "key", v.shape, sampling, (0, 6)).collect()}
        assert len(got) == len(rows) and got[900] == got[901] == (0, False)
        for k, p in enumerate(at):
            inside = bool(k % 9) and all(0 <= a <= n - 1 for a, n in zip(p, v.shape, strict=True))
            want = 0
            if inside and sampling == "nearest":
                want = v[tuple(np.rint(p).astype(int))]
            elif inside:
                low = np.minimum(np.floor(p).astype(int), np.array(v.shape) - 2)
                f = p - low
                want = int(np.floor(sum(v[tuple(low + c)] * np.prod(np.where(c, f, 1 - f)) for c in np.ndindex(2, 2, 2)) + 0.5))
            assert got[k] == (want, inside)
