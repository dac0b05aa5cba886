"""Rendering a surface: smoothing, refinement, normals, layers, tile figures.

A mesh is dealt into square blocks, each with a margin as wide as the kernel,
so that one shuffle serves a whole two-dimensional convolution; a block's
arrays are of a fixed size whatever the mesh. Beyond the mesh's own ends values
are mirrored. Layers are sampled where a block meets the chunks it needs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import gaussian_kernel
from .lineage import cut
from .statistics import circular_concentration, exact_percentiles

#: Cells of a block's side, without its margin.
BLOCK = 64
LAYERS = tuple(range(-14, 14))


def _blurred(a: np.ndarray, kernel: list[float], pads: tuple) -> np.ndarray:
    """Both first axes of ``a`` convolved where the kernel fits, after
    mirroring by ``pads``."""
    a = np.pad(a, [*pads, *[(0, 0)] * (a.ndim - 2)], mode="symmetric")
    for axis in (0, 1):
        n = a.shape[axis] - len(kernel) + 1
        a = sum(w * np.take(a, range(k, k + n), axis) for k, w in enumerate(kernel))
    return a


def _shaped(mesh: DataFrame) -> DataFrame:
    """``mesh`` with its winding's numbers of rows and columns."""
    shape = mesh.groupBy("winding").agg((F.max("r") + 1).cast("int").alias("rows"), (F.max("c") + 1).cast("int").alias("cols"))
    return mesh.select("winding", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "x", "y", "z", "valid").join(shape, "winding")


def _grid(part, first: tuple[int, int], shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates (z, y, x) and validity of a part of a mesh as arrays;
    vertices that are not there are not valid and 0."""
    at = (part["r"].to_numpy() - first[0], part["c"].to_numpy() - first[1])
    inside = (at[0] >= 0) & (at[0] < shape[0]) & (at[1] >= 0) & (at[1] < shape[1])
    at = (at[0][inside], at[1][inside])
    p, valid = np.zeros((*shape, 3)), np.zeros(shape, bool)
    p[at] = np.nan_to_num(part[["z", "y", "x"]].to_numpy(float)[inside])
    valid[at] = part["valid"].to_numpy(bool)[inside]
    return p, valid


def smooth_grid(mesh: DataFrame, sigma: float, block: int = BLOCK) -> DataFrame:
    """Gaussian low-pass of the vertices, ``sigma`` in grid cells, with the
    weights of valid ones alone; others stay as they are."""
    columns = ("winding", "r", "c", "x", "y", "z", "valid")
    if sigma <= 0:
        return mesh.select(*columns)
    kernel = gaussian_kernel(sigma)
    margin = len(kernel) // 2
    reach = lambda a, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(a) - margin) / block)), F.least(F.floor((F.col(n) - 1) / block), F.floor((F.col(a) + margin) / block))))
    dealt = _shaped(mesh).withColumn("br", reach("r", "rows")).withColumn("bc", reach("c", "cols"))

    def run(part):
        b = [int(part["br"].iloc[0]), int(part["bc"].iloc[0])]
        n = [int(part["rows"].iloc[0]), int(part["cols"].iloc[0])]
        core = [(k * block, min((k + 1) * block, m)) for k, m in zip(b, n, strict=True)]
        lo, hi = [max(0, c[0] - margin) for c in core], [min(m, c[1] + margin) for c, m in zip(core, n, strict=True)]
        p, valid = _grid(part, tuple(lo), (hi[0] - lo[0], hi[1] - lo[1]))
        pads = tuple((margin - (c[0] - a), margin - (e - c[1])) for c, a, e in zip(core, lo, hi, strict=True))
        w = _blurred(valid.astype(float), kernel, pads)
        q = _blurred(np.where(valid[..., None], p, 0.0), kernel, pads) / np.maximum(w, 1e-9)[..., None]
        own = part[(part["r"] >= core[0][0]) & (part["r"] < core[0][1]) & (part["c"] >= core[1][0]) & (part["c"] < core[1][1])]
        at = q[own["r"].to_numpy() - core[0][0], own["c"].to_numpy() - core[1][0]]
        out = own[list(columns)].copy()
        for k, a in enumerate("zyx"):
            out[a] = np.where(own["valid"].to_numpy(bool), at[:, k], own[a].to_numpy(float))
        return out

    kind = dict(mesh.dtypes)["winding"]
    return dealt.groupBy("winding", "br", "bc").applyInPandas(run, f"winding {kind}, r int, c int, x double, y double, z double, valid boolean")


def _fine_blocks(mesh: DataFrame, step: float, margin: int, block: int) -> DataFrame:
    """The vertices that each block (bi, bj) of refined points needs, with the
    mesh's numbers of rows, cols and refined points, high and wide."""
    shaped = _shaped(mesh)
    fine = lambda n: F.floor((F.col(n) - 1) * F.lit(float(step))).cast("int") + 1
    shaped = shaped.withColumn("high", fine("rows")).withColumn("wide", fine("cols"))

    def reach(a: str, n: str, m: str) -> Column:
        """The blocks that need a vertex: those of points less than a cell away."""
        ratio = F.greatest(F.col(n) - 1, F.lit(1)) / F.greatest(F.col(m) - 1, F.lit(1))
        lo, hi = F.floor((F.ceil((F.col(a) - 1) / ratio) - margin) / block), F.floor((F.floor((F.col(a) + 1) / ratio) + margin) / block)
        return F.explode(F.sequence(F.greatest(F.lit(0), lo), F.least(F.floor((F.col(m) - 1) / block), hi)))

    return shaped.withColumn("bi", reach("r", "rows", "high")).withColumn("bj", reach("c", "cols", "wide"))


def _refined(part, kernel: list[float], block: int):
    """Of a block's vertices: the rows and columns of its points, their
    positions and normals (z, y, x), and whether they are on the mesh."""
    margin = len(kernel) // 2 + 1
    n, m = [int(part[k].iloc[0]) for k in ("rows", "cols")], [int(part[k].iloc[0]) for k in ("high", "wide")]
    sides = []
    for k, name in enumerate(("bi", "bj")):
        own = int(part[name].iloc[0])
        core = (own * block, min((own + 1) * block, m[k]))
        lo, hi = max(0, core[0] - margin), min(m[k], core[1] + margin)
        at = np.arange(lo, hi) * ((n[k] - 1) / (m[k] - 1) if m[k] > 1 else 0.0)
        low = np.clip(np.floor(at).astype(int), 0, max(0, n[k] - 2))
        sides.append((core, lo, hi, low, at - low, np.clip(np.floor(at + 0.5).astype(int), 0, n[k] - 1)))
    first = tuple(int(s[3].min()) for s in sides)
    shape = tuple(int(min(n[k] - 1, s[3].max() + 1)) - first[k] + 1 for k, s in enumerate(sides))
    p, valid = _grid(part, first, shape)
    a, b = (s[3] - o for s, o in zip(sides, first, strict=True))
    up, right = np.minimum(a + 1, shape[0] - 1), np.minimum(b + 1, shape[1] - 1)
    f, g = sides[0][4][:, None, None], sides[1][4][None, :, None]
    d = (p[np.ix_(a, b)] * (1 - f) + p[np.ix_(up, b)] * f) * (1 - g) + (p[np.ix_(a, right)] * (1 - f) + p[np.ix_(up, right)] * f) * g
    ok = valid[np.ix_(sides[0][5] - first[0], sides[1][5] - first[1])]
    pads = tuple((margin - 1 if s[1] == 0 else 0, margin - 1 if s[2] == m[k] else 0) for k, s in enumerate(sides))
    soft = _blurred(d, kernel, pads)
    # Where the block's margin was not cut off, its outer points are gone.
    begin = [s[1] if s[1] == 0 else s[1] + margin - 1 for s in sides]
    normal = np.zeros_like(soft)
    if min(soft.shape[:2]) > 1:
        normal = np.cross(np.gradient(soft, axis=0), np.gradient(soft, axis=1))
        normal /= np.maximum(np.linalg.norm(normal, axis=-1, keepdims=True), 1e-9)
    (i0, i1), (j0, j1) = sides[0][0], sides[1][0]
    inside = np.s_[i0 - sides[0][1] : i1 - sides[0][1], j0 - sides[1][1] : j1 - sides[1][1]]
    i, j = np.meshgrid(np.arange(i0, i1), np.arange(j0, j1), indexing="ij")
    return i.ravel(), j.ravel(), d[inside].reshape(-1, 3), normal[i0 - begin[0] : i1 - begin[0], j0 - begin[1] : j1 - begin[1]].reshape(-1, 3), ok[inside].ravel()


def dense_surface(mesh: DataFrame, step: float, sigma: float = 3.0, block: int = BLOCK) -> DataFrame:
    """The mesh at ``step`` points a grid cell: (winding, i, j, z, y, x, nz,
    ny, nx, ok). Positions are bilinear in the vertices, ``ok`` is the nearest
    vertex's validity, and normals are the cross product of the gradients of
    the points smoothed by ``sigma``."""
    kernel = gaussian_kernel(sigma)

    def run(part):
        import pandas as pd

        i, j, own, normal, ok = _refined(part, kernel, block)
        return pd.DataFrame({"winding": part["winding"].iloc[0], "i": i, "j": j} | {name: v[:, k] for v, names in ((own, "zyx"), (normal, ("nz", "ny", "nx"))) for k, name in enumerate(names)} | {"ok": ok})

    kind = dict(mesh.dtypes)["winding"]
    return _fine_blocks(mesh, step, len(kernel) // 2 + 1, block).groupBy("winding", "bi", "bj").applyInPandas(run, f"winding {kind}, i int, j int, z double, y double, x double, nz double, ny double, nx double, ok boolean")


class Chunks:
    """Some chunks of a volume, to be sampled; missing ones are 0."""

    def __init__(self, keys: np.ndarray, data: list, shape: tuple, chunk: tuple, dtype: str) -> None:
        self.shape, self.chunk, self.first = shape, np.array(chunk), keys.min(axis=0) if len(keys) else np.zeros(3, int)
        size = keys.max(axis=0) - self.first + 1 if len(keys) else np.ones(3, int)
        # The last row stands for chunks that are not there.
        self.row = np.full(tuple(size), len(keys))
        self.values = np.zeros((len(keys) + 1, int(np.prod(chunk))))
        if len(keys):
            self.row[tuple((keys - self.first).T)] = np.arange(len(keys))
        for k, raw in enumerate(data):
            self.values[k] = np.frombuffer(raw, dtype) if isinstance(raw, bytes | bytearray) else np.asarray(raw, float)

    def sample(self, points: np.ndarray) -> np.ndarray:
        """Trilinear; lower corners are held within the volume, fractions are
        the points' own."""
        sides = []
        for k, n in enumerate(self.shape):
            low = np.floor(points[:, k])
            f = points[:, k] - low
            low = np.clip(low, 0, n - 2).astype(np.int64)
            ends = []
            for at, w in ((low, 1 - f), (low + 1, f)):
                key = at // self.chunk[k] - self.first[k]
                there = (key >= 0) & (key < self.row.shape[k])
                ends.append((np.where(there, key, 0), there, at % self.chunk[k], w))
            sides.append(ends)
        out, missing = np.zeros(len(points)), len(self.values) - 1
        for kz, tz, z, wz in sides[0]:
            for ky, ty, y, wy in sides[1]:
                w, there, base = wz * wy, tz & ty, (z * self.chunk[1] + y) * self.chunk[2]
                for kx, tx, x, wx in sides[2]:
                    out += w * wx * self.values[np.where(there & tx, self.row[kz, ky, kx], missing), base + x]
        return out


def tile_profiles(mesh: DataFrame, chunks: DataFrame, shape: tuple[int, int, int], chunk: tuple[int, int, int], step: float, layers: tuple[int, ...] = LAYERS, tile: int = 128, sigma: float = 3.0, least_ok: float = 0.9, most_zero: float = 0.05, dtype: str = "uint8", block: int = BLOCK) -> DataFrame:
    """Mean value by layer of the tiles (winding, ti, tj, t, value) of the
    refined mesh that are whole, on the mesh and inside the volume.

    ``chunks`` has cz, cy, cx and data, bytes or an array. A block of the mesh
    asks for the chunks that its valid vertices come near; both meet by block,
    points and samples stay there, and what leaves it is sums by tile and layer.
    """
    kernel = gaussian_kernel(sigma)
    dealt = _fine_blocks(mesh, step, len(kernel) // 2 + 1, block)
    by, keys = ["winding", "bi", "bj"], ["cz", "cy", "cx"]
    reach = max(map(abs, layers)) + 2
    asked = dealt.where("valid").groupBy(*by).agg(*[f(a).alias(f"{n}_{a}") for a in "zyx" for n, f in (("lo", F.min), ("hi", F.max))])
    for a, n, c in zip("zyx", shape, chunk, strict=True):
        held = lambda at, n=n, c=c: F.floor(F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)) / c).cast("int")
        asked = asked.withColumn(f"c{a}", F.explode(F.sequence(held(F.col(f"lo_{a}") - reach), held(F.col(f"hi_{a}") + reach))))
    near = asked.select(*[F.col(c).alias(f"_{c}") for c in by], *keys).join(chunks.select(*keys, "data"), keys)

    def run(part, held):
        import pandas as pd

        names = ["winding", "ti", "tj", "t", "total", "zeros", "n", "whole"]
        if not len(part):
            return pd.DataFrame({n: [] for n in names})
        i, j, own, normal, ok = _refined(part, kernel, block)
        volume = Chunks(held[keys].to_numpy(int).reshape(-1, 3), list(held["data"]), shape, chunk, dtype)
        i, j, own, normal = i[ok] // tile, j[ok] // tile, own[ok], normal[ok]
        across = int(part["wide"].iloc[0]) // tile + 1
        which, inverse = np.unique(i * across + j, return_inverse=True)
        out = []
        for t in layers:
            v = volume.sample(own + t * normal)
            sums = [np.bincount(inverse, w, len(which)) for w in (v, (v == 0).astype(float), np.ones(len(v)))]
            out.append(pd.DataFrame({"ti": which // across, "tj": which % across, "t": t, "total": sums[0], "zeros": sums[1].astype(int), "n": sums[2].astype(int)}))
        out = pd.concat(out)
        whole = ((out["ti"] + 1) * tile <= int(part["high"].iloc[0])) & ((out["tj"] + 1) * tile <= int(part["wide"].iloc[0]))
        return out.assign(winding=part["winding"].iloc[0], whole=whole)[names]

    kind = dict(mesh.dtypes)["winding"]
    sums = dealt.groupBy(*by).cogroup(near.groupBy(*[f"_{c}" for c in by])).applyInPandas(run, f"winding {kind}, ti int, tj int, t int, total double, zeros long, n long, whole boolean").where("whole")
    tiles = sums.groupBy("winding", "ti", "tj", "t").agg(F.sum("total").alias("total"), F.sum("zeros").alias("zeros"), F.sum("n").alias("n")).where(F.col("n") >= least_ok * tile * tile)
    w = Window.partitionBy("winding", "ti", "tj")
    inside = F.sum("zeros").over(w) <= most_zero * F.sum("n").over(w)
    return tiles.withColumn("inside", inside).where("inside").select("winding", "ti", "tj", "t", (F.col("total") / F.col("n")).alias("value"))


def tile_figures(profiles: DataFrame, layers: tuple[int, ...], periods: tuple[float, ...]) -> DataFrame:
    """By tile its contrast, (max - min) / (max + min), and the offset of the
    nearest bright layer with its period: the best fit of a wave of one of
    ``periods`` to the profile (ties: the shorter)."""
    by = ["winding", "ti", "tj"]
    centred = profiles.withColumn("v", F.col("value") - F.avg("value").over(Window.partitionBy(*by)))
    figures = profiles.groupBy(*by).agg(F.max("value").alias("hi"), F.min("value").alias("lo")).select(*by, ((F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo") + 1e-6)).alias("contrast"))
    rows = []
    for p in periods:
        c, s = [math.cos(2 * math.pi * t / p) for t in layers], [math.sin(2 * math.pi * t / p) for t in layers]
        rows.append(F.struct(F.lit(float(p)).alias("p"), *[F.lit(sum(x * y for x, y in zip(a, b, strict=True))).alias(k) for k, a, b in (("cc", c, c), ("cs", c, s), ("ss", s, s))]))
    wave = centred.withColumn("w", F.explode(F.array(*rows)))
    turn = 2 * math.pi * F.col("t") / F.col("w.p")
    sums = wave.groupBy(*by, F.col("w.p").alias("period"), *[F.col(f"w.{k}").alias(k) for k in ("cc", "cs", "ss")]).agg(F.sum(F.col("v") * F.cos(turn)).alias("xc"), F.sum(F.col("v") * F.sin(turn)).alias("xs"), F.sum(F.col("v") * F.col("v")).alias("xx"))
    det = F.nullif(F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs"), F.lit(0.0))
    fit = sums.withColumn("b", (F.col("xc") * F.col("ss") - F.col("xs") * F.col("cs")) / det).withColumn("a", (F.col("xs") * F.col("cc") - F.col("xc") * F.col("cs")) / det)
    left = F.round(F.col("xx") - F.col("b") * F.col("xc") - F.col("a") * F.col("xs"), 6)
    best = fit.where("b is not null").groupBy(*by).agg(F.min_by(F.struct("period", "a", "b"), F.struct(left, F.col("period"))).alias("f"))
    return figures.join(best.select(*by, "f.period", (F.col("f.period") * F.atan2("f.a", "f.b") / (2 * math.pi)).alias("offset")), by)


def render_contrast(mesh: DataFrame, chunks: DataFrame, shape: tuple[int, int, int], chunk: tuple[int, int, int], step: float, sigmas: tuple[float, ...] = (0.0,), layers: tuple[int, ...] = LAYERS, tile: int = 128, periods: tuple[float, ...] = tuple(8 + k / 4 for k in range(89)), normal_sigma: float = 3.0) -> DataFrame:
    """By winding and ``sigma`` of smoothing: the roughness that is left, how
    many tiles the render has, their median contrast and the share above 0.2,
    and the sheets' offset with its concentration. Windings without tiles have
    their roughness alone."""
    from .mesh import bends

    rough, tiles = None, None
    for sigma in sigmas:
        surface = cut(smooth_grid(mesh, sigma)) if sigma > 0 else mesh
        mark = F.lit(float(sigma)).alias("sigma")
        own = bends(surface, float(step)).select("winding", mark, F.col("rms_u_normalised").alias("roughness_u"), F.col("rms_v_normalised").alias("roughness_v"))
        found = tile_figures(tile_profiles(surface, chunks, shape, chunk, step, layers, tile, normal_sigma), layers, periods).withColumn("sigma", mark)
        rough, tiles = (own, found) if rough is None else (rough.unionByName(own), tiles.unionByName(found))
    tiles = cut(tiles)
    by = ["winding", "sigma"]
    plain = tiles.groupBy(*by).agg(F.count(F.lit(1)).alias("tiles"), F.avg((F.col("contrast") > 0.2).cast("int").cast("double")).alias("tiles_above_0_2"), circular_concentration(F.col("offset") / F.col("period")).alias("phase_R"))
    medians = [exact_percentiles(tiles.withColumn("at", at), "at", {name: 0.5}, *by).drop("n") for name, at in (("contrast_median", F.col("contrast")), ("offset_median", F.abs("offset")))]
    out = rough.join(plain, by, "left")
    for m in medians:
        out = out.join(m, by, "left")
    return out.withColumn("tiles", F.coalesce("tiles", F.lit(0)))
