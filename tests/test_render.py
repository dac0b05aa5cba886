"""Rendered surfaces against whole-array versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafray.functions.expr import gaussian_kernel
from sheafray.operators import render


def _blur(a: np.ndarray, sigma: float) -> np.ndarray:
    k = gaussian_kernel(sigma)
    m = len(k) // 2
    for axis in (0, 1):
        a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, m, mode="symmetric"), k, "valid"), axis, a)
    return a


def _mesh(rows: int, cols: int, seed: int = 0):
    rng = np.random.default_rng(seed)
    p = np.stack([*np.meshgrid(np.arange(rows) * 4.0, np.arange(cols) * 4.0, indexing="ij"), rng.normal(size=(rows, cols))], axis=-1)
    return p, rng.random((rows, cols)) > 0.1


def _rows(spark, p, valid, winding: int = 1):
    return spark.createDataFrame([(winding, r, c, *map(float, p[r, c][::-1]), bool(valid[r, c])) for r in range(p.shape[0]) for c in range(p.shape[1])], "winding int, r int, c int, x double, y double, z double, valid boolean")


@pytest.mark.parametrize(("rows", "cols", "sigma"), [(23, 17, 1.0), (5, 31, 2.5), (1, 9, 1.0)])
def test_smoothing_by_blocks_equals_the_whole(spark, rows, cols, sigma):
    p, valid = _mesh(rows, cols)
    w = _blur(valid.astype(float), sigma)
    want = p.copy()
    for k in range(3):
        want[..., k] = np.where(valid, _blur(np.where(valid, p[..., k], 0.0), sigma) / np.maximum(w, 1e-9), p[..., k])
    # Rows of the table that are not there are vertices that are not valid.
    mesh = _rows(spark, p, valid).where("valid or r = 0 or c = 0 or r = %d or c = %d" % (rows - 1, cols - 1))
    for block in (8, 64):
        got = render.smooth_grid(mesh, sigma, block).collect()
        assert len(got) == mesh.count()
        for r in got:
            assert (r.z, r.y, r.x) == pytest.approx(tuple(want[r.r, r.c]), abs=1e-9)


@pytest.mark.parametrize(("rows", "cols", "step"), [(9, 7, 4.0), (12, 5, 1.5), (2, 3, 3.0), (1, 4, 2.0)])
def test_dense_points_and_normals(spark, rows, cols, step):
    p, valid = _mesh(rows, cols, 1)
    high, wide = int((rows - 1) * step) + 1, int((cols - 1) * step) + 1
    at = [np.linspace(0, n - 1, m) for n, m in ((rows, high), (cols, wide))]
    low = [np.clip(np.floor(a).astype(int), 0, max(0, n - 2)) for a, n in zip(at, (rows, cols), strict=True)]
    f, g = (at[0] - low[0])[:, None, None], (at[1] - low[1])[None, :, None]
    up, right = np.minimum(low[0] + 1, rows - 1), np.minimum(low[1] + 1, cols - 1)
    d = (p[np.ix_(low[0], low[1])] * (1 - f) + p[np.ix_(up, low[1])] * f) * (1 - g) + (p[np.ix_(low[0], right)] * (1 - f) + p[np.ix_(up, right)] * f) * g
    soft = np.stack([_blur(d[..., k], 3.0) for k in range(3)], axis=-1)
    n = np.zeros_like(soft)
    if min(high, wide) > 1:
        n = np.cross(np.gradient(soft, axis=0), np.gradient(soft, axis=1))
        n /= np.maximum(np.linalg.norm(n, axis=-1, keepdims=True), 1e-9)
    for block in (8, 64):
        got = render.dense_surface(_rows(spark, p, valid), step, 3.0, block).collect()
        assert len({(r.i, r.j) for r in got}) == len(got) == high * wide
        for r in got:
            assert (r.z, r.y, r.x) == pytest.approx(tuple(d[r.i, r.j]), abs=1e-9)
            assert (r.nz, r.ny, r.nx) == pytest.approx(tuple(n[r.i, r.j]), abs=1e-7)
            assert r.ok == valid[math.floor(at[0][r.i] + 0.5), math.floor(at[1][r.j] + 0.5)]


def test_contrast_of_a_flat_surface_between_sheets(spark):
    """Sheets 8 apart in x; a plane three off a crest, and one with noise that
    smoothing takes away again."""
    shape = (24, 24, 64)
    planes = spark.range(shape[0]).select(F.col("id").cast("int").alias("cz"), F.lit(0).alias("cy"), F.lit(0).alias("cx"), F.lit([100 + 80 * math.cos(2 * math.pi * x / 8) for _ in range(shape[1]) for x in range(shape[2])]).alias("data"))
    rng = np.random.default_rng(5)
    p = np.stack([*np.meshgrid(np.arange(0, 24, 2.0), np.arange(0, 24, 2.0), indexing="ij"), np.full((12, 12), 29.0)], axis=-1)
    noisy = p + rng.normal(size=p.shape) * [0, 0, 1.2]
    mesh = _rows(spark, p, np.ones((12, 12), bool)).unionByName(_rows(spark, noisy, np.ones((12, 12), bool), 2))
    periods = tuple(6 + k / 4 for k in range(20))
    got = {(r.winding, r.sigma): r for r in render.render_contrast(mesh, planes, shape, (1, 24, 64), 2.0, (0.0, 2.0), tile=10, periods=periods).collect()}
    flat = got[1, 0.0]
    # The nearest crest is at x = 32, three along the normal or against it.
    assert flat.tiles == 4 and flat.offset_median == pytest.approx(3.0, abs=0.05) and flat.phase_R > 0.999
    assert flat.contrast_median == pytest.approx((180 - 20) / 200, abs=0.02) and flat.roughness_u == pytest.approx(0, abs=1e-9)
    assert got[2, 2.0].roughness_u < 0.3 * got[2, 0.0].roughness_u and got[2, 2.0].contrast_median > got[2, 0.0].contrast_median
    none = render.render_contrast(_rows(spark, p[:3, :3], np.ones((3, 3), bool)), planes, shape, (1, 24, 64), 2.0, tile=10, periods=periods).collect()
    assert [r.tiles for r in none] == [0] and none[0].contrast_median is None
