"""Operators on grid meshes: (winding, r, c, x, y, z, valid), one row a vertex.

Neighbours come from windows over a grid line, guarded by the neighbour's own
index, so holes and missing rows never join vertices that are apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, cross, norm, radius, wrap
from .statistics import exact_percentiles

#: What counts as a valid vertex differs between formats; pass the name.
VALIDITY = {
    "nonnegative": lambda: (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("z") >= 0),
    "positive": lambda: (F.col("x") > 0) & (F.col("y") > 0) & (F.col("z") > 0),
    "positive_z": lambda: (F.col("z") > 0) & (F.col("x") >= 0) & (F.col("y") >= 0),
    "above_half": lambda: (F.col("x") > -0.5) & (F.col("y") > -0.5) & (F.col("z") > -0.5),
}


def with_validity(mesh: DataFrame, rule: str) -> DataFrame:
    """Set ``valid`` by a named rule; null and NaN coordinates are invalid."""
    finite = ~(F.isnan("x") | F.isnan("y") | F.isnan("z"))
    return mesh.withColumn("valid", F.coalesce(VALIDITY[rule]() & finite, F.lit(False)))


def _neighbour(axis: str, step: int, mesh_key: str = "winding") -> Column:
    """The struct (x, y, z, valid) of the vertex ``step`` along an axis, null
    if it is not there."""
    other = "c" if axis == "r" else "r"
    w = Window.partitionBy(mesh_key, other).orderBy(axis)
    shift = F.lead if step > 0 else F.lag
    found = shift(F.struct(axis, "x", "y", "z", "valid"), abs(step)).over(w)
    return F.when(found[axis] == F.col(axis) + step, found)


def with_neighbours(mesh: DataFrame) -> DataFrame:
    """The four neighbours as struct columns up, down (r) and left, right (c)."""
    return mesh.withColumn("up", _neighbour("r", -1)).withColumn("down", _neighbour("r", 1)).withColumn("left", _neighbour("c", -1)).withColumn("right", _neighbour("c", 1))


def to_level(mesh: DataFrame, level: int, micron: float | None = None) -> DataFrame:
    """Coordinates in voxels of a coarser level, or in microns from voxels of
    ``micron`` microns at level 0; vertices that are not valid become -1."""
    factor = F.lit(micron if micron is not None else 2.0**-level)
    return mesh.withColumns({a: F.when(F.col("valid"), F.col(a) * factor).otherwise(F.lit(-1.0)) for a in "xyz"})


def _xyz(name: str) -> tuple[Column, Column, Column]:
    prefix = f"{name}." if name else ""
    return F.col(prefix + "x"), F.col(prefix + "y"), F.col(prefix + "z")


def _difference(a: str, b: str) -> tuple[Column, Column, Column]:
    return tuple(p - q for p, q in zip(_xyz(a), _xyz(b), strict=True))


def _as_normal(rows: DataFrame, along_r, along_c, ok: Column, least: float, order: str) -> DataFrame:
    """Unit cross products; ``order`` is the axis order ("xyz" or "zyx") the
    product is taken in, which decides its sign."""
    a, b = (along_r, along_c) if order == "xyz" else (along_r[::-1], along_c[::-1])
    n = cross(a, b)
    n = n if order == "xyz" else n[::-1]
    rows = rows.withColumns({"_nx": n[0], "_ny": n[1], "_nz": n[2]})
    length = norm((F.col("_nx"), F.col("_ny"), F.col("_nz")))
    return (
        rows.withColumn("_len", length)
        .where(ok & (F.col("_len") > least))
        .withColumns({"nx": F.col("_nx") / F.col("_len"), "ny": F.col("_ny") / F.col("_len"), "nz": F.col("_nz") / F.col("_len")})
        .drop("_nx", "_ny", "_nz", "_len")
    )


def normals_interior(mesh: DataFrame, order: str = "zyx") -> DataFrame:
    """Normals by central differences, only where all four neighbours are
    valid."""
    n = with_neighbours(mesh)
    ok = F.col("valid") & F.coalesce(F.col("up.valid") & F.col("down.valid") & F.col("left.valid") & F.col("right.valid"), F.lit(False))
    return _as_normal(n, _difference("down", "up"), _difference("right", "left"), ok, 1e-6, order)


def normals_onesided(mesh: DataFrame, order: str = "xyz") -> DataFrame:
    """Normals by central differences, one-sided at borders and holes."""
    n = with_neighbours(mesh)

    def along(before: str, after: str):
        has_b = F.col("valid") & F.coalesce(F.col(f"{before}.valid"), F.lit(False))
        has_a = F.col("valid") & F.coalesce(F.col(f"{after}.valid"), F.lit(False))
        mid, fwd, bwd = _difference(after, before), _difference(after, ""), _difference("", before)
        return tuple(F.when(has_b & has_a, m / 2).when(has_a, f).when(has_b, b) for m, f, b in zip(mid, fwd, bwd, strict=True)), has_a | has_b

    (dr, hr), (dc, hc) = along("up", "down"), along("left", "right")
    return _as_normal(n, dr, dc, F.col("valid") & hr & hc, 1e-9, order)


def bends(mesh: DataFrame, nominal: float = 20.0) -> DataFrame:
    """Root mean square of second differences along the normal, raw and scaled
    to the nominal step, by winding."""
    v = normals_interior(mesh)
    n = (F.col("nx"), F.col("ny"), F.col("nz"))

    def second(a: str, b: str) -> tuple[Column, Column]:
        bend = sum(((p - 2 * q + r) * k for p, q, r, k in zip(_xyz(b), _xyz(""), _xyz(a), n, strict=True)), F.lit(0.0))
        step = 0.5 * (norm(_difference(b, "")) + norm(_difference("", a)))
        scale = F.lit(nominal) / F.greatest(step, F.lit(1e-6))
        return bend, bend * scale * scale

    u, un = second("left", "right")
    w, wn = second("up", "down")
    rms = lambda c: F.sqrt(F.avg(c * c))
    return v.groupBy("winding").agg(F.count(F.lit(1)).alias("vertices"), rms(u).alias("rms_u"), rms(w).alias("rms_v"), rms(un).alias("rms_u_normalised"), rms(wn).alias("rms_v_normalised"))


def roughness(mesh: DataFrame, nominal: float = 20.0) -> DataFrame:
    """``bends``, and percentiles of the column step."""
    steps = mesh.withColumn("right", _neighbour("c", 1)).where(F.col("valid") & F.coalesce(F.col("right.valid"), F.lit(False))).withColumn("step", norm(_difference("right", "")))
    return bends(mesh, nominal).join(exact_percentiles(steps, "step", {"step_median": 0.5, "step_p5": 0.05, "step_p95": 0.95}, "winding").drop("n"), "winding")


def distortion(mesh: DataFrame, step: float = 20.0) -> DataFrame:
    """Steps along columns and rows over the nominal step, and the angle
    between both directions, as percentiles by winding."""
    n = mesh.withColumn("down", _neighbour("r", 1)).withColumn("right", _neighbour("c", 1)).where("valid")
    dc, dr = _difference("right", ""), _difference("down", "")
    ok_c, ok_r = F.coalesce(F.col("right.valid"), F.lit(False)), F.coalesce(F.col("down.valid"), F.lit(False))
    cosine = F.abs(sum((a * b for a, b in zip(dc, dr, strict=True)), F.lit(0.0))) / (norm(dc) * norm(dr) + 1e-9)
    figures = {"col": F.when(ok_c, norm(dc) / step), "row": F.when(ok_r, norm(dr) / step), "angle": F.when(ok_c & ok_r, F.degrees(F.acos(clip(cosine, 0, 1))))}
    rows = n.select("winding", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("at")) for k, v in figures.items()])).alias("f")).select("winding", "f.*")
    found = exact_percentiles(rows, "at", {"p5": 0.05, "p50": 0.5, "p95": 0.95}, "winding", "name")
    p = lambda k, q: F.max(F.when(F.col("name") == k, F.col(q))).alias(f"{k}_{q}")
    return found.groupBy("winding").agg(*[p(k, q) for k in ("col", "row") for q in ("p5", "p50", "p95")], p("angle", "p5"))


def axis_intervals(axis: DataFrame) -> DataFrame:
    """The axis polyline as z-intervals, the ends reaching out: lo, hi and the
    points to interpolate between. A handful of rows."""
    w = Window.orderBy("z")
    a = axis.withColumns({"z1": F.lead("z").over(w), "y1": F.lead("y").over(w), "x1": F.lead("x").over(w), "first": F.row_number().over(w) == 1})
    inner = a.where("z1 is not null")
    last = F.row_number().over(Window.orderBy(F.desc("z"))) == 1
    ends = inner.withColumn("last", last)
    return ends.select(F.when(F.col("first"), F.lit(float("-inf"))).otherwise(F.col("z")).alias("lo"), F.when(F.col("last"), F.lit(float("inf"))).otherwise(F.col("z1")).alias("hi"), F.col("z").alias("z0"), "z1", F.col("y").alias("y0"), "y1", F.col("x").alias("x0"), "x1")


def with_axis(rows: DataFrame, axis: DataFrame, z: str = "z") -> DataFrame:
    """Add axis_y and axis_x at each row's z, clamped at the ends.

    The axis has tens of control points by nature; its intervals are
    broadcast.
    """
    k = F.broadcast(axis_intervals(axis))
    part = clip((F.col(z) - F.col("z0")) / (F.col("z1") - F.col("z0")), 0, 1)
    joined = rows.join(k, (rows[z] >= k["lo"]) & (rows[z] < k["hi"]), "left").withColumn("_p", part)
    return joined.withColumn("axis_y", F.col("y0") + F.col("_p") * (F.col("y1") - F.col("y0"))).withColumn("axis_x", F.col("x0") + F.col("_p") * (F.col("x1") - F.col("x0"))).drop("lo", "hi", "z0", "z1", "y0", "y1", "x0", "x1", "_p")


def outward_fraction(mesh: DataFrame, axis: DataFrame) -> DataFrame:
    """Share of normals that point away from the axis, and the direction that
    implies."""
    n = with_axis(normals_interior(mesh, "xyz"), axis)
    out = F.col("nx") * (F.col("x") - F.col("axis_x")) + F.col("ny") * (F.col("y") - F.col("axis_y")) > 0
    agg = n.groupBy("winding").agg(F.avg(out.cast("int").cast("double")).alias("outward"), F.count(F.lit(1)).alias("n"))
    return agg.withColumn("direction", F.when(F.col("outward") < 0.5, "forward").otherwise("reverse"))


def radius_by_winding(mesh: DataFrame, axis: DataFrame, least: int = 10) -> DataFrame:
    v = with_axis(mesh.where("valid"), axis).withColumn("radius", radius(F.col("y"), F.col("x"), F.col("axis_y"), F.col("axis_x")))
    return exact_percentiles(v.select("winding", F.col("radius").alias("at")), "at", {"radius": 0.5}, "winding").where(F.col("n") >= least)


def polyline(mesh: DataFrame, plane_z: float) -> DataFrame:
    """Where each grid column first crosses a z-plane: winding, c, x, y."""
    n = mesh.withColumn("down", _neighbour("r", 1)).where(F.col("valid") & F.coalesce(F.col("down.valid"), F.lit(False)))
    a, b = F.col("z") - plane_z, F.col("down.z") - plane_z
    hit = n.where(((a <= 0) & (b > 0)) | ((a > 0) & (b <= 0))).withColumn("_p", a / (a - b))
    first = F.row_number().over(Window.partitionBy("winding", "c").orderBy("r"))
    return hit.withColumn("_r", first).where("_r = 1").select("winding", "c", (F.col("x") + F.col("_p") * (F.col("down.x") - F.col("x"))).alias("x"), (F.col("y") + F.col("_p") * (F.col("down.y") - F.col("y"))).alias("y"))


def full_blocks(mesh: DataFrame, size: int, stride: int = 3) -> DataFrame:
    """Corners (every ``stride`` cells) of size x size blocks that are valid
    throughout, by running sums along both axes."""
    v = mesh.withColumn("ok", F.col("valid").cast("int"))
    down = v.withColumn("col_ok", F.sum("ok").over(Window.partitionBy("winding", "c").orderBy("r").rangeBetween(0, size - 1)))
    block = down.withColumn("block_ok", F.sum("col_ok").over(Window.partitionBy("winding", "r").orderBy("c").rangeBetween(0, size - 1)))
    return block.where((F.col("block_ok") == size * size) & (F.col("r") % stride == 0) & (F.col("c") % stride == 0)).select("winding", "r", "c")


def spaced_blocks(blocks: DataFrame, n: int = 3) -> DataFrame:
    """Of each winding's blocks, in order of row and column, ``n`` at even
    distances from the first to the last (fewer if it has fewer).

    Rows of blocks are counted first, so that only the rows that a pick lies
    in are numbered block by block.
    """
    order = Window.partitionBy("winding").orderBy("r")
    rows = blocks.groupBy("winding", "r").agg(F.count(F.lit(1)).alias("own"))
    rows = rows.withColumn("before", F.sum("own").over(order) - F.col("own")).withColumn("all", F.sum("own").over(Window.partitionBy("winding")))
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("all") - 1) / max(1, n - 1))))
    asked = rows.withColumn("pick", F.explode(picks)).where((F.col("pick") >= F.col("before")) & (F.col("pick") < F.col("before") + F.col("own")))
    numbered = blocks.withColumn("at", F.row_number().over(Window.partitionBy("winding", "r").orderBy("c")) - 1)
    return numbered.join(asked.select("winding", "r", (F.col("pick") - F.col("before")).alias("at")), ["winding", "r", "at"]).select("winding", "r", "c")


def band_rows(mesh: DataFrame, low: float, high: float, margin: float = 40.0) -> DataFrame:
    """The rows of each winding from the first to the last that reach into the
    band of z, widened by ``margin``, and a row more on either side: what rays
    within the band can meet."""
    inside = F.col("valid") & F.col("z").between(low - margin, high + margin)
    reach = mesh.where(inside).groupBy("winding").agg((F.min("r") - 1).alias("_first"), (F.max("r") + 1).alias("_last"))
    return mesh.join(reach, "winding").where(F.col("r").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def valid_tiles(mesh: DataFrame, tile: int, dark: Column, least: float = 0.9, most_dark: float = 0.05) -> DataFrame:
    """Tiles (winding, tr, tc) whose vertices are valid for at least the share
    ``least`` and of which valid ones are ``dark`` for at most ``most_dark``,
    with both shares."""
    share = lambda c: F.avg(c.cast("int").cast("double"))
    tiles = mesh.groupBy("winding", F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc"))
    return tiles.agg(share(F.col("valid")).alias("valid_share"), share(F.when(F.col("valid"), dark)).alias("dark_share")).where((F.col("valid_share") >= least) & (F.col("dark_share") <= most_dark))


def quantile_windings(mesh: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """The windings at shares of their number, in order: one row a winding
    passes through the window."""
    order = Window.orderBy("winding")
    ranked = mesh.select("winding").distinct().withColumn("_at", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    wanted = F.array(*[F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q))) for q in shares])
    return ranked.where(F.array_contains(wanted, F.col("_at").cast("long"))).select("winding")


def triangulate(mesh: DataFrame) -> DataFrame:
    """Two triangles for each cell whose corners allow: winding, r, c, half,
    and v0, v1, v2 as (x, y, z)."""
    w = Window.partitionBy("winding", "c").orderBy("r")
    point = lambda p: F.struct(*[F.col(f"{p}{k}").alias(k) for k in ("x", "y", "z")])
    n = mesh.withColumn("right", _neighbour("c", 1))
    n = n.withColumn("_d", F.lead(F.struct("r", "x", "y", "z", "valid", "right")).over(w)).withColumn("down", F.when(F.col("_d.r") == F.col("r") + 1, F.col("_d")))
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    corner = F.col("down.right")
    diagonal = F.struct(*[corner[k].alias(k) for k in ("x", "y", "z")])
    first = F.when(F.col("valid") & ok("down.valid") & ok("right.valid"), F.struct(F.lit(0).alias("half"), point("").alias("v0"), point("down.").alias("v1"), point("right.").alias("v2")))
    second = F.when(ok("down.valid") & F.coalesce(corner["valid"], F.lit(False)) & ok("right.valid"), F.struct(F.lit(1).alias("half"), point("down.").alias("v0"), diagonal.alias("v1"), point("right.").alias("v2")))
    both = n.select("winding", "r", "c", F.explode(F.array(first, second)).alias("t")).where("t is not null")
    return both.select("winding", "r", "c", "t.half", "t.v0", "t.v1", "t.v2")


def upsample(mesh: DataFrame, factor: int) -> DataFrame:
    """Bilinear refinement of every cell with four valid corners: row and
    column in fractions of the grid."""
    w = Window.partitionBy("winding", "c").orderBy("r")
    n = mesh.withColumn("right", _neighbour("c", 1))
    n = n.withColumn("_d", F.lead(F.struct("r", "x", "y", "z", "valid", "right")).over(w)).where((F.col("_d.r") == F.col("r") + 1) & F.col("valid") & F.col("_d.valid") & F.coalesce(F.col("right.valid"), F.lit(False)) & F.coalesce(F.col("_d.right.valid"), F.lit(False)))
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    fine = n.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    a, b = F.col("i") / F.lit(float(factor)), F.col("j") / F.lit(float(factor))
    value = lambda k: (1 - a) * (1 - b) * F.col(k) + a * (1 - b) * F.col(f"_d.{k}") + (1 - a) * b * F.col(f"right.{k}") + a * b * F.col(f"_d.right.{k}")
    return fine.select("winding", (F.col("r") + a).alias("r"), (F.col("c") + b).alias("c"), *[value(k).alias(k) for k in ("x", "y", "z")])


def drift(samples: DataFrame, least: int = 10, break_after: int = 3) -> DataFrame:
    """Layers that each grid row slides: steps of ``delta`` along the row,
    wrapped by the local ``spacing``, summed where neighbours are at most
    ``break_after`` columns apart. (winding, r, c, delta, spacing)."""
    w = Window.partitionBy("winding", "r").orderBy("c")
    s = samples.withColumn("_dc", F.col("c") - F.lag("c").over(w)).withColumn("_step", F.col("delta") - F.lag("delta").over(w))
    step = F.when(F.col("_dc") <= break_after, F.when(F.col("spacing") > 0, wrap(F.col("_step"), F.col("spacing"))).otherwise(F.col("_step")))
    return s.groupBy("winding", "r").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(step), F.lit(0.0)).alias("slide"), F.count(step).alias("steps")).where(F.col("n") >= least)


def tile_means(rows: DataFrame, tile: int, value: str, *by: str) -> DataFrame:
    """Means over tile x tile cells: (winding, tr, tc, *by, mean, n)."""
    tr, tc = F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc")
    return rows.groupBy("winding", tr, tc, *by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def tile_median(tiles: DataFrame, value: str = "mean", rounds: int = 1, least: int = 3) -> DataFrame:
    """Replace each tile by the median of its 3 x 3 neighbourhood (itself
    included) where at least ``least`` are present, all at once, ``rounds``
    times. A tile reaches its neighbours by an equi-join on their places."""
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    out = tiles.select("winding", "tr", "tc", F.col(value).alias("value"))
    for _ in range(rounds):
        sent = out.withColumn("s", shifts).select("winding", (F.col("tr") + F.col("s.a")).alias("tr"), (F.col("tc") + F.col("s.b")).alias("tc"), F.col("value").alias("v"))
        med = sent.groupBy("winding", "tr", "tc").agg(F.percentile("v", F.lit(0.5)).alias("m"), F.count("v").alias("k"))
        out = out.join(med, ["winding", "tr", "tc"]).select("winding", "tr", "tc", F.when(F.col("k") >= least, F.col("m")).otherwise(F.col("value")).alias("value"))
    return out


def tile_smooth(tiles: DataFrame, sigma: float, value: str = "mean") -> DataFrame:
    """Normalised Gaussian smoothing of a tile grid: weights of present tiles
    alone, over the kernel's whole square."""
    from ..functions.expr import gaussian_kernel

    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    weights = F.explode(F.array(*[F.struct(F.lit(k - r).alias("d"), F.lit(w).alias("w")) for k, w in enumerate(kernel)]))
    rows = tiles.select("winding", "tr", "tc", F.col(value).alias("num"), F.lit(1.0).alias("den"))
    for axis in ("tr", "tc"):
        other = "tc" if axis == "tr" else "tr"
        sent = rows.withColumn("k", weights)
        rows = sent.groupBy("winding", (F.col(axis) + F.col("k.d")).alias(axis), other).agg(F.sum(F.col("num") * F.col("k.w")).alias("num"), F.sum(F.col("den") * F.col("k.w")).alias("den"))
    return tiles.select("winding", "tr", "tc").join(rows, ["winding", "tr", "tc"]).select("winding", "tr", "tc", (F.col("num") / F.greatest("den", F.lit(1e-6))).alias("smooth"))
