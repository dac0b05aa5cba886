"""Queries over grid meshes (view MESH) and the axis (UMB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import radius, sector
from ..operators import mesh as ms
from ..operators import spatial as sp
from ..operators import statistics as st
from .ray_queries import _rounded
from .views import MESH, UMB, axis, mesh, table, with_

RADIUS_STEP = 20.0


def mesh_normals_interior(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ms.normals_interior(mesh(spark, sf_dir))
    return _rounded(n.select("winding", "r", "c", "nx", "ny", "nz"))


def mesh_normals_onesided(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ms.normals_onesided(mesh(spark, sf_dir))
    return _rounded(n.select("winding", "r", "c", "nx", "ny", "nz"))


def mesh_roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ms.roughness(mesh(spark, sf_dir)))


def grid_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ms.distortion(mesh(spark, sf_dir)), 5)


def outward_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ms.outward_fraction(mesh(spark, sf_dir), axis(spark)))


def radius_by_winding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ms.radius_by_winding(mesh(spark, sf_dir), axis(spark)))


def sector_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between the same vertex of neighbouring windings by sector
    around the axis, sectors with at least 50 vertices."""
    m = mesh(spark, sf_dir).where("valid")
    nxt = m.select((F.col("winding") - 1).alias("winding"), "r", "c", F.struct("x", "y", "z").alias("n"))
    d = ms.with_axis(m.join(nxt, ["winding", "r", "c"]), axis(spark))
    gap = F.sqrt(sum(((F.col(a) - F.col(f"n.{a}")) * (F.col(a) - F.col(f"n.{a}")) for a in "xyz"), F.lit(0.0)))
    rows = d.withColumn("gap", gap).withColumn("sector", sector(F.col("y") - F.col("axis_y"), F.col("x") - F.col("axis_x")))
    return _rounded(st.exact_percentiles(rows, "gap", {"gap_p50": 0.5}, "winding", "sector").where("n >= 50"))


def plane_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ms.polyline(mesh(spark, sf_dir), 1000.0))


def full_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.full_blocks(mesh(spark, sf_dir), 5)


def triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ms.triangulate(mesh(spark, sf_dir))
    area = (F.col("v1.x") - F.col("v0.x")) * (F.col("v2.y") - F.col("v0.y")) - (F.col("v1.y") - F.col("v0.y")) * (F.col("v2.x") - F.col("v0.x"))
    return _rounded(t.select("winding", "r", "c", "half", (F.abs(area) / 2).alias("area"), ((F.col("v0.z") + F.col("v1.z") + F.col("v2.z")) / 3).alias("mean_z")))


def ray_triangle_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical rays, one a supplier, through all windings."""
    t = ms.triangulate(mesh(spark, sf_dir)).withColumn("tri_id", F.col("r") * 1000 + F.col("c") * 2 + F.col("half"))
    key = F.col("s_suppkey")
    point = lambda z, y, x: F.struct(z.cast("double").alias("z"), y.cast("double").alias("y"), x.cast("double").alias("x"))
    rays = table(spark, sf_dir, "supplier").select(key.alias("ray_id"), point(F.lit(900), (key * 37) % 800 + 0.37, (key * 91) % 1200 + 0.41).alias("origin"), point(F.lit(1), F.lit(0), F.lit(0)).alias("direction"), F.lit(200.0).alias("length"))
    hits = sp.ray_triangle_hits(rays, t, cell=32.0)
    return _rounded(hits.groupBy("ray_id").agg(F.count(F.lit(1)).alias("hits"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("winding").alias("windings")))


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh(spark, sf_dir).where("valid").withColumn("key", F.col("winding") * F.lit(10**12) + F.col("r") * 1000 + F.col("c"))


def winding_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from a winding's vertices to the nearest vertex of the next."""
    v = _vertices(spark, sf_dir)
    d = sp.nearest_vertex(v.select("key", "winding", "x", "y", "z"), v.select((F.col("winding") - 1).alias("winding"), "x", "y", "z"), cell=20.0)
    gaps = st.exact_percentiles(d, "distance", {"gap_p10": 0.1, "gap_p50": 0.5, "gap_p90": 0.9}, "winding")
    return _rounded(gaps.join(d.groupBy("winding").agg(F.avg((F.col("distance") < 10).cast("int").cast("double")).alias("below_half")), "winding"))


def own_other_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a vertex's three nearest planes of the next two windings come
    within 6: the next ("own"), the one after ("other") or none."""
    v = _vertices(spark, sf_dir)
    sites = ms.normals_interior(mesh(spark, sf_dir)).select("winding", "x", "y", "z", "nx", "ny", "nz")
    # Both windings in one search: sites, which go to several cells, move once.
    points = v.select("key", F.col("winding").alias("at"), "x", "y", "z", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).withColumn("winding", F.col("at") + F.col("k"))
    near = sp.nearest_within(points, sites, 60.0, k=3)
    plane = F.abs(sum(((F.col(a) - F.col(f"site.{a}")) * F.col(f"site.n{a}") for a in "xyz"), F.lit(0.0)))
    found = near.groupBy("key", "at").agg(*[F.round(F.min(F.when(F.col("k") == k, plane)), 9).alias(name) for k, name in ((1, "own"), (2, "other"))])
    own, other = (F.coalesce(name, F.lit(1e9)) for name in ("own", "other"))
    close = F.least(own, other) <= 6
    kinds = {"own": close & (own <= other), "other": close & (own > other)}
    by_winding = found.groupBy(F.col("at").alias("winding")).agg(*[F.count(F.when(c, 1)).alias(kind) for kind, c in kinds.items()])
    # The rest of a winding has none near, found or not.
    counts = v.groupBy("winding").agg(F.count(F.lit(1)).alias("all")).join(by_winding, "winding", "left").fillna(0, [*kinds])
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), n.alias("n")) for kind, n in (*((k, F.col(k)) for k in kinds), ("none", F.col("all") - F.col("own") - F.col("other")))])
    return counts.select("winding", F.inline(rows)).where("n > 0")


def grid_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = ms.upsample(mesh(spark, sf_dir), 4)
    return _rounded(u.groupBy("winding").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"), F.max("z").alias("max_z"), F.avg(F.col("x") * F.col("z")).alias("mean_xz")), 3)


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.tile_means(mesh(spark, sf_dir).where("valid"), 8, "z").where("n >= 16")


def tile_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_tiles(spark, sf_dir))


def tile_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(max - min) / (max + min) of a tile row's means."""
    t = _tiles(spark, sf_dir).groupBy("winding", "tr").agg(F.max("mean").alias("hi"), F.min("mean").alias("lo"))
    return _rounded(t.select("winding", "tr", ((F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo") + 1e-6)).alias("contrast")), 8)


def tile_median3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ms.tile_median(_tiles(spark, sf_dir), rounds=2))


def tile_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ms.tile_smooth(_tiles(spark, sf_dir), 1.0))


def drift_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers each row slides, delta being z less 1000 at spacing 14."""
    s = mesh(spark, sf_dir).where("valid").select("winding", "r", "c", (F.col("z") - 1000).alias("delta"), F.lit(14.0).alias("spacing"))
    return _rounded(ms.drift(s).select("winding", "r", "n", "steps", (F.col("slide") / 14.0).alias("layers")), 5)


def sight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit radius of rays from the axis to the box's nearest side, by z and
    angle: two sequences and an arithmetic bound."""
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(2000), F.lit(250))).alias("z")).withColumn("z", F.col("z").cast("double")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    a = ms.with_axis(grid, axis(spark)).withColumn("a", F.col("k") * (2 * F.pi() / 16) + 0.1)
    c, s = F.cos("a"), F.sin("a")
    tx = F.when(c > 0, (1000 - F.col("axis_x")) / c).otherwise(-F.col("axis_x") / c)
    ty = F.when(s > 0, (800 - F.col("axis_y")) / s).otherwise(-F.col("axis_y") / s)
    return _rounded(a.select("z", "k", (F.least(tx, ty) - 1).alias("radius")))


def axis_distance_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ms.with_axis(mesh(spark, sf_dir).where("valid"), axis(spark)).withColumn("radius", radius(F.col("y"), F.col("x"), F.col("axis_y"), F.col("axis_x")))
    return st.histogram(v, "radius", 0.0, 1000.0, 10, "winding")


def spaced_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three full blocks of each winding, evenly spaced in order."""
    return ms.spaced_blocks(ms.full_blocks(mesh(spark, sf_dir), 4), 3)


def band_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each winding rays between 1052 and 1060 can meet."""
    rows = ms.band_rows(mesh(spark, sf_dir), 1052.0, 1060.0)
    return rows.groupBy("winding").agg(F.min("r").alias("first_row"), F.max("r").alias("last_row"), F.count(F.lit(1)).alias("vertices"), F.count(F.when(F.col("valid"), 1)).alias("valid"))


def valid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ms.valid_tiles(mesh(spark, sf_dir), 8, F.col("z") < 993.0))


def quantile_windings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windings at a fifth to four fifths of their number, and their vertices."""
    picked = ms.quantile_windings(mesh(spark, sf_dir), (0.2, 0.4, 0.6, 0.8))
    return mesh(spark, sf_dir).join(F.broadcast(picked), "winding").groupBy("winding").agg(F.count(F.lit(1)).alias("vertices"))


def level_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of the windings at level 2 and in microns of 2.4 a voxel."""
    m = mesh(spark, sf_dir)
    coarse, metric = ms.to_level(m, 2), ms.to_level(m, 0, micron=2.4)
    part = lambda d, name: d.groupBy("winding").agg(*[F.max(a).alias(f"{name}_{a}") for a in "xyz"], F.count(F.when(F.col("x") == -1, 1)).alias(f"{name}_missing"))
    return _rounded(part(coarse, "level2").join(part(metric, "micron"), "winding"))


def tile_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase concentration of the windings and of their tiles, a phase being
    what z is above 1000 in sheets of 14."""
    phase = F.when(F.col("valid"), (F.col("z") - 1000) / 14)
    return _rounded(st.tile_concentration(mesh(spark, sf_dir).withColumn("phase", phase)))


QUERIES = {
    f.__name__: f
    for f in (
        mesh_normals_interior, mesh_normals_onesided, mesh_roughness, grid_distortion, outward_fraction, radius_by_winding, sector_gaps, plane_polyline,
        full_blocks, triangulate, ray_triangle_hits, winding_pitch, own_other_none, grid_upsample, tile_profile, tile_contrast, tile_median3x3, tile_smooth,
        drift_unwrap, axis_distance_hist, spaced_blocks, band_rows, valid_tiles, quantile_windings, level_units, tile_phase,
    )
} | {"shell_exit": sight_lines}


def _nb(alias: str, dr: int, dc: int) -> str:
    return f"LEFT JOIN mesh {alias} ON {alias}.winding = m.winding AND {alias}.r = m.r + {dr} AND {alias}.c = m.c + {dc}"


_FOUR = " ".join([_nb("u", -1, 0), _nb("d", 1, 0), _nb("l", 0, -1), _nb("g", 0, 1)])


def _cross_sql(a: str, b: str) -> str:
    """nx, ny, nz of the cross product of columns a* and b* in zyx order."""
    return f"{a}y * {b}z - {a}z * {b}y AS x0, {a}z * {b}x - {a}x * {b}z AS y0, {a}x * {b}y - {a}y * {b}x AS z0"


# In zyx order the product has the opposite sign.
_DIFF = "di AS (SELECT m.*, " + ", ".join(f"d.{k} - u.{k} AS a{k}, g.{k} - l.{k} AS q{k}, u.{k} AS u{k}, d.{k} AS d{k}, l.{k} AS l{k}, g.{k} AS g{k}" for k in "xyz") + f" FROM mesh m {_FOUR} WHERE m.valid AND u.valid AND d.valid AND l.valid AND g.valid)"
_CROSS = f"cr AS (SELECT *, {_cross_sql('a', 'q')} FROM di)"
_NORMAL = "nrm AS (SELECT *, -x0 / len AS nx, -y0 / len AS ny, -z0 / len AS nz FROM (SELECT *, sqrt(x0*x0 + y0*y0 + z0*z0) AS len FROM cr) WHERE len > 1e-6)"
_INTERIOR = [MESH, _DIFF, _CROSS, _NORMAL]


def _one(axis_: str, before: str, after: str, k: str) -> str:
    return f"CASE WHEN {before}.valid AND {after}.valid THEN ({after}.{k} - {before}.{k}) / 2 WHEN {after}.valid THEN {after}.{k} - m.{k} WHEN {before}.valid THEN m.{k} - {before}.{k} END AS {axis_}{k}"


_ONESIDED = [
    MESH,
    "di AS (SELECT m.*, " + ", ".join([_one("a", "u", "d", k) for k in "xyz"] + [_one("q", "l", "g", k) for k in "xyz"]) + f" FROM mesh m {_FOUR} WHERE m.valid AND (coalesce(u.valid, false) OR coalesce(d.valid, false)) AND (coalesce(l.valid, false) OR coalesce(g.valid, false)))",
    _CROSS,
    "nrm AS (SELECT *, x0 / len AS nx, y0 / len AS ny, z0 / len AS nz FROM (SELECT *, sqrt(x0*x0 + y0*y0 + z0*z0) AS len FROM cr) WHERE len > 1e-9)",
]
_NXYZ = "SELECT winding, r, c, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM nrm"


def _dist(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}{k} - {b}{k}) ** 2" for k in "xyz") + ")"


_AXIS = "(SELECT CASE WHEN {z} <= 0 THEN 300.0 WHEN {z} < 1000 THEN 300 + ({z} / 1000) * 40 WHEN {z} < 2000 THEN 340 + (({z} - 1000) / 1000) * -60 ELSE 280 END)::DOUBLE AS hy, (SELECT CASE WHEN {z} <= 0 THEN 500.0 WHEN {z} < 1000 THEN 500 + ({z} / 1000) * 120 WHEN {z} < 2000 THEN 620 + (({z} - 1000) / 1000) * 80 ELSE 700 END)::DOUBLE AS hx"
_TILES = "tl AS (SELECT winding, (r // 8)::INT AS tr, (c // 8)::INT AS tc, avg(z) AS mean, count(z) AS n FROM mesh WHERE valid GROUP BY ALL HAVING count(z) >= 16)"
_TRI = [
    MESH,
    f"ce AS (SELECT m.winding, m.r, m.c, m.valid AS mv, m.x AS mx, m.y AS my, m.z AS mz, d.valid AS dv, d.x AS dx, d.y AS dy, d.z AS dz, g.valid AS gv, g.x AS gx, g.y AS gy, g.z AS gz, e.valid AS ev, e.x AS ex, e.y AS ey, e.z AS ez FROM mesh m {_nb('d', 1, 0)} {_nb('g', 0, 1)} {_nb('e', 1, 1)})",
    "tr AS (SELECT winding, r, c, 0 AS half, mx AS x0, my AS y0, mz AS z0, dx AS x1, dy AS y1, dz AS z1, gx AS x2, gy AS y2, gz AS z2 FROM ce WHERE mv AND dv AND gv UNION ALL SELECT winding, r, c, 1, dx, dy, dz, ex, ey, ez, gx, gy, gz FROM ce WHERE dv AND ev AND gv)",
]
_SMOOTH_W = "kw AS (SELECT unnest(range(-4, 5)) AS d, exp(-0.5 * unnest(range(-4, 5)) ** 2) AS w)"

_EXTENT = "SELECT winding, {0} FROM mesh GROUP BY winding"
ORACLE_SQL = {
    "spaced_blocks": with_(
        MESH,
        "b AS (SELECT m.winding, m.r, m.c FROM mesh m JOIN mesh b ON b.winding = m.winding AND b.r BETWEEN m.r AND m.r + 3 AND b.c BETWEEN m.c AND m.c + 3 WHERE m.r % 3 = 0 AND m.c % 3 = 0 GROUP BY m.winding, m.r, m.c HAVING sum(b.valid::INT) = 16)",
        "n AS (SELECT *, row_number() OVER (PARTITION BY winding ORDER BY r, c) - 1 AS k, count(*) OVER (PARTITION BY winding) AS n FROM b)",
    )
    + "SELECT winding, r, c FROM n WHERE k IN (0, (n - 1) // 2, n - 1)",
    "tile_phase": with_(
        MESH,
        "ph AS (SELECT winding, r, c, 2 * pi() * (z - 1000) / 14 AS a FROM mesh WHERE valid)",
        "sh AS (SELECT winding, max(r) + 1 AS rows, max(c) + 1 AS cols FROM mesh GROUP BY winding)",
        "al AS (SELECT winding, sqrt(avg(cos(a)) ** 2 + avg(sin(a)) ** 2) AS phase_R FROM ph GROUP BY winding)",
        "tl AS (SELECT winding, r // 5 AS tr, c // 5 AS tc, sqrt(avg(cos(a)) ** 2 + avg(sin(a)) ** 2) AS v FROM ph GROUP BY ALL HAVING count(*) >= 15)",
        "md AS (SELECT winding, count(*) AS tiles, median(v) AS m FROM tl JOIN sh USING (winding) WHERE (tr + 1) * 5 <= rows AND (tc + 1) * 5 <= cols GROUP BY winding)",
    )
    + "SELECT winding, round(phase_R, 6) AS phase_R, coalesce(tiles, 0) AS tiles, round(m, 6) AS phase_R_tile_median FROM al LEFT JOIN md USING (winding)",
    "band_rows": with_(MESH, "e AS (SELECT winding, min(r) - 1 AS lo, max(r) + 1 AS hi FROM mesh WHERE valid AND z BETWEEN 1012 AND 1100 GROUP BY winding)")
    + "SELECT m.winding, min(r) AS first_row, max(r) AS last_row, count(*) AS vertices, count(*) FILTER (valid) AS valid FROM mesh m JOIN e ON m.winding = e.winding WHERE r BETWEEN lo AND hi GROUP BY m.winding",
    "valid_tiles": with_(MESH, "t AS (SELECT winding, (r // 8)::INT AS tr, (c // 8)::INT AS tc, avg(valid::INT) AS v, avg(CASE WHEN valid THEN (z < 993)::INT END) AS d FROM mesh GROUP BY ALL)")
    + "SELECT winding, tr, tc, round(v, 6) AS valid_share, round(d, 6) AS dark_share FROM t WHERE v >= 0.9 AND d <= 0.05",
    "quantile_windings": with_(MESH, "w AS (SELECT winding, row_number() OVER (ORDER BY winding) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT winding FROM mesh))")
    + "SELECT winding, count(*) AS vertices FROM mesh WHERE winding IN (SELECT winding FROM w WHERE k IN (least(n - 1, floor(n * 0.2::DOUBLE)), least(n - 1, floor(n * 0.4::DOUBLE)), least(n - 1, floor(n * 0.6::DOUBLE)), least(n - 1, floor(n * 0.8::DOUBLE)))) GROUP BY winding",
    "level_units": with_(MESH)
    + _EXTENT.format(", ".join([f"round(max(CASE WHEN valid THEN {a} * {f} ELSE -1 END), 6) AS {n}_{a}" for n, f in (("level2", "0.25::DOUBLE"), ("micron", "2.4::DOUBLE")) for a in "xyz"] + [f"count(*) FILTER (NOT valid OR x * {f} = -1) AS {n}_missing" for n, f in (("level2", "0.25::DOUBLE"), ("micron", "2.4::DOUBLE"))])),
    "mesh_normals_interior": with_(*_INTERIOR) + _NXYZ,
    "mesh_normals_onesided": with_(*_ONESIDED) + _NXYZ,
    "mesh_roughness": with_(*_INTERIOR, "be AS (SELECT winding, (gx - 2*x + lx) * nx + (gy - 2*y + ly) * ny + (gz - 2*z + lz) * nz AS su, (dx - 2*x + ux) * nx + (dy - 2*y + uy) * ny + (dz - 2*z + uz) * nz AS sv, " + f"0.5 * ({_dist('g', '')} + {_dist('', 'l')}) AS hu, 0.5 * ({_dist('d', '')} + {_dist('', 'u')}) AS hv FROM nrm)", "ag AS (SELECT winding, count(*) AS vertices, sqrt(avg(su*su)) AS rms_u, sqrt(avg(sv*sv)) AS rms_v, sqrt(avg((su * (20 / greatest(hu, 1e-6)) ** 2) ** 2)) AS rms_u_normalised, sqrt(avg((sv * (20 / greatest(hv, 1e-6)) ** 2) ** 2)) AS rms_v_normalised FROM be GROUP BY winding)", f"stp AS (SELECT m.winding, {_dist('g.', 'm.')} AS step FROM mesh m {_nb('g', 0, 1)} WHERE m.valid AND g.valid)", "sa AS (SELECT winding, median(step) AS step_median, quantile_cont(step, 0.05) AS step_p5, quantile_cont(step, 0.95) AS step_p95 FROM stp GROUP BY winding)")
    + "SELECT winding, vertices, " + ", ".join(f"round({k}, 6) AS {k}" for k in ("rms_u", "rms_v", "rms_u_normalised", "rms_v_normalised", "step_median", "step_p5", "step_p95")) + " FROM ag JOIN sa USING (winding)",
    "grid_distortion": with_(MESH, f"e AS (SELECT m.winding, CASE WHEN g.valid THEN {_dist('g.', 'm.')} / 20 END AS col, CASE WHEN d.valid THEN {_dist('d.', 'm.')} / 20 END AS row_, CASE WHEN g.valid AND d.valid THEN degrees(acos(least(greatest(abs((g.x-m.x)*(d.x-m.x) + (g.y-m.y)*(d.y-m.y) + (g.z-m.z)*(d.z-m.z)) / ({_dist('g.', 'm.')} * {_dist('d.', 'm.')} + 1e-9), 0), 1))) END AS angle FROM mesh m {_nb('g', 0, 1)} {_nb('d', 1, 0)} WHERE m.valid)")
    + "SELECT winding, " + ", ".join(f"round(quantile_cont({c}, {q}), 5) AS {n}_p{int(100 * q)}" for c, n, qs in (("col", "col", (0.05, 0.5, 0.95)), ("row_", "row", (0.05, 0.5, 0.95)), ("angle", "angle", (0.05,))) for q in qs) + " FROM e GROUP BY winding",
    "outward_fraction": with_(*_INTERIOR, f"oa AS (SELECT *, {_AXIS.format(z='z')} FROM nrm)", "ou AS (SELECT winding, avg((-nx * (x - hx) - ny * (y - hy) > 0)::INT) AS outward, count(*) AS n FROM oa GROUP BY winding)") + "SELECT winding, round(outward, 6) AS outward, n, CASE WHEN outward < 0.5 THEN 'forward' ELSE 'reverse' END AS direction FROM ou",
    "radius_by_winding": with_(MESH, f"a AS (SELECT *, {_AXIS.format(z='z')} FROM mesh WHERE valid)") + "SELECT winding, count(*) AS n, round(median(sqrt((y - hy) ** 2 + (x - hx) ** 2)), 6) AS radius FROM a GROUP BY winding HAVING count(*) >= 10",
    "sector_gaps": with_(MESH, f"a AS (SELECT m.winding, {_dist('m.', 'n.')} AS gap, m.x, m.y, {_AXIS.format(z='m.z')} FROM mesh m JOIN mesh n ON n.winding = m.winding + 1 AND n.r = m.r AND n.c = m.c WHERE m.valid AND n.valid)") + "SELECT winding, floor(((degrees(atan2(y - hy, x - hx)) % 360) + 360) % 360 / 90)::INT AS sector, count(*) AS n, round(median(gap), 6) AS gap_p50 FROM a GROUP BY ALL HAVING count(*) >= 50",
    "plane_polyline": with_(MESH, f"h AS (SELECT m.winding, m.c, m.r, (m.z - 1000) / ((m.z - 1000) - (d.z - 1000)) AS p, m.x AS x, m.y AS y, d.x AS dx, d.y AS dy FROM mesh m {_nb('d', 1, 0)} WHERE m.valid AND d.valid AND ((m.z - 1000 <= 0 AND d.z - 1000 > 0) OR (m.z - 1000 > 0 AND d.z - 1000 <= 0)))") + "SELECT winding, c, round(x + p * (dx - x), 6) AS x, round(y + p * (dy - y), 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY winding, c ORDER BY r) AS rn FROM h) WHERE rn = 1",
    "full_blocks": with_(MESH) + "SELECT m.winding, m.r, m.c FROM mesh m JOIN mesh b ON b.winding = m.winding AND b.r BETWEEN m.r AND m.r + 4 AND b.c BETWEEN m.c AND m.c + 4 WHERE m.r % 3 = 0 AND m.c % 3 = 0 GROUP BY m.winding, m.r, m.c HAVING sum(b.valid::INT) = 25",
    "triangulate": with_(*_TRI) + "SELECT winding, r, c, half, round(abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 2, 6) AS area, round((z0 + z1 + z2) / 3, 6) AS mean_z FROM tr",
    "ray_triangle_hits": with_(*_TRI, "ra AS (SELECT s_suppkey AS ray_id, (s_suppkey * 37) % 800 + 0.37::DOUBLE AS oy, (s_suppkey * 91) % 1200 + 0.41::DOUBLE AS ox FROM supplier)", "ba AS (SELECT *, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) AS det, ((ox - x0) * (y2 - y0) - (x2 - x0) * (oy - y0)) AS pu, ((x1 - x0) * (oy - y0) - (ox - x0) * (y1 - y0)) AS pv FROM ra JOIN tr ON ox BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2) AND oy BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2))", "hi AS (SELECT ray_id, winding, z0 + pu / det * (z1 - z0) + pv / det * (z2 - z0) - 900 AS t FROM ba WHERE abs(det) > 1e-9 AND pu / det >= 0 AND pv / det >= 0 AND pu / det + pv / det <= 1)")
    + "SELECT ray_id, count(*) AS hits, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t, sum(winding)::BIGINT AS windings FROM hi WHERE t BETWEEN 0 AND 200 GROUP BY ray_id",
    "winding_pitch": with_(MESH, f"d AS (SELECT m.winding, m.r, m.c, min({_dist('m.', 'n.')}) AS distance FROM mesh m JOIN mesh n ON n.winding = m.winding + 1 WHERE m.valid AND n.valid GROUP BY ALL)") + "SELECT winding, count(*) AS n, round(quantile_cont(distance, 0.1), 6) AS gap_p10, round(quantile_cont(distance, 0.5), 6) AS gap_p50, round(quantile_cont(distance, 0.9), 6) AS gap_p90, round(avg((distance < 10)::INT), 6) AS below_half FROM d GROUP BY winding",
    "own_other_none": with_(*_INTERIOR, "pt AS (SELECT * FROM mesh WHERE valid)", f"pr AS (SELECT p.winding, p.r, p.c, s.winding - p.winding AS k, {_dist('p.', 's.')} AS distance, abs((p.x - s.x) * s.nx + (p.y - s.y) * s.ny + (p.z - s.z) * s.nz) AS plane, row_number() OVER (PARTITION BY p.winding, p.r, p.c, s.winding ORDER BY {_dist('p.', 's.')}, s.x, s.y, s.z) AS rn FROM pt p JOIN nrm s ON s.winding IN (p.winding + 1, p.winding + 2))", "be AS (SELECT winding, r, c, round(min(plane) FILTER (k = 1), 9) AS own, round(min(plane) FILTER (k = 2), 9) AS other FROM pr WHERE rn <= 3 AND distance <= 60 GROUP BY ALL)")
    + "SELECT p.winding, CASE WHEN least(coalesce(own, 1e9), coalesce(other, 1e9)) > 6 THEN 'none' WHEN coalesce(own, 1e9) <= coalesce(other, 1e9) THEN 'own' ELSE 'other' END AS kind, count(*) AS n FROM pt p LEFT JOIN be USING (winding, r, c) GROUP BY ALL",
    "grid_upsample": with_(MESH, f"ce AS (SELECT m.winding, m.x, m.z AS z00, d.z AS z10, g.z AS z01, e.z AS z11 FROM mesh m {_nb('d', 1, 0)} {_nb('g', 0, 1)} {_nb('e', 1, 1)} WHERE m.valid AND d.valid AND g.valid AND e.valid)", "st AS (SELECT unnest(range(4)) / 4.0::DOUBLE AS f)", "fi AS (SELECT winding, x + 20 * b.f AS x, (1-a.f)*(1-b.f)*z00 + a.f*(1-b.f)*z10 + (1-a.f)*b.f*z01 + a.f*b.f*z11 AS z FROM ce, st a, st b)") + "SELECT winding, count(*) AS n, round(avg(z), 3) AS mean_z, round(max(z), 3) AS max_z, round(avg(x * z), 3) AS mean_xz FROM fi GROUP BY winding",
    "tile_profile": with_(MESH, _TILES) + "SELECT winding, tr, tc, round(mean, 6) AS mean, n FROM tl",
    "tile_contrast": with_(MESH, _TILES) + "SELECT winding, tr, round((max(mean) - min(mean)) / (max(mean) + min(mean) + 1e-6), 8) AS contrast FROM tl GROUP BY winding, tr",
    "tile_median3x3": with_(MESH, _TILES, "m1 AS (SELECT a.winding, a.tr, a.tc, CASE WHEN count(*) >= 3 THEN median(b.mean) ELSE any_value(a.mean) END AS v FROM tl a JOIN tl b ON a.winding = b.winding AND abs(a.tr - b.tr) <= 1 AND abs(a.tc - b.tc) <= 1 GROUP BY ALL)") + "SELECT a.winding, a.tr, a.tc, round(CASE WHEN count(*) >= 3 THEN median(b.v) ELSE any_value(a.v) END, 6) AS value FROM m1 a JOIN m1 b ON a.winding = b.winding AND abs(a.tr - b.tr) <= 1 AND abs(a.tc - b.tc) <= 1 GROUP BY ALL",
    "tile_smooth": with_(MESH, _TILES, _SMOOTH_W) + "SELECT a.winding, a.tr, a.tc, round(sum(b.mean * p.w * q.w) / sum(p.w * q.w), 6) AS smooth FROM tl a JOIN tl b ON a.winding = b.winding JOIN kw p ON p.d = b.tr - a.tr JOIN kw q ON q.d = b.tc - a.tc GROUP BY ALL",
    "drift_unwrap": with_(MESH, "s AS (SELECT winding, r, z - 1000 - lag(z - 1000) OVER o AS step, c - lag(c) OVER o AS dc FROM mesh WHERE valid WINDOW o AS (PARTITION BY winding, r ORDER BY c))", "w AS (SELECT winding, r, CASE WHEN dc <= 3 THEN step + 7 - 14 * floor((step + 7) / 14) - 7 END AS st FROM s)") + "SELECT winding, r, count(*) AS n, count(st) AS steps, round(coalesce(sum(st), 0) / 14, 5) AS layers FROM w GROUP BY winding, r HAVING count(*) >= 10",
    "axis_distance_hist": with_(MESH, f"a AS (SELECT *, {_AXIS.format(z='z')} FROM mesh WHERE valid)", "d AS (SELECT winding, sqrt((y - hy) ** 2 + (x - hx) ** 2) AS radius FROM a)") + "SELECT winding, least(floor(radius / 100), 9)::INT AS bin, count(*) AS n FROM d WHERE radius BETWEEN 0 AND 1000 GROUP BY ALL",
    "shell_exit": with_(UMB, f"g AS (SELECT z, k, {_AXIS.format(z='z')}, k * (2 * pi() / 16) + 0.1 AS a FROM (SELECT unnest(range(0, 2001, 250))::DOUBLE AS z), (SELECT unnest(range(16)) AS k))") + "SELECT z, k, round(least(CASE WHEN cos(a) > 0 THEN (1000 - hx) / cos(a) ELSE -hx / cos(a) END, CASE WHEN sin(a) > 0 THEN (800 - hy) / sin(a) ELSE -hy / sin(a) END) - 1, 6) AS radius FROM g",
}
