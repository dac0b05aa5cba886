"""Queries over rendered surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import gaussian_kernel
from ..operators import render as rn
from .ray_queries import _rounded
from .views import mesh, table, with_

STEP, TILE, SIGMAS, LAYERS = 2.0, 16, (0.0, 1.0), tuple(range(-4, 4))
PERIODS = tuple(3 + k / 4 for k in range(25))
FIGURES = ("roughness_u", "roughness_v", "tiles_above_0_2", "phase_R", "contrast_median", "offset_median")


def within_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windings of MESH laid through the volume of VOX."""
    e = (F.col("z") - 1000) / 40
    return mesh(spark, sf_dir).select("winding", "r", "c", (3.5 + 2 * e).alias("x"), (F.col("c") / F.lit(9.0)).alias("y"), (9.0 * F.col("r") + 5.37).alias("z"), "valid")


def planes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """VOX as chunks of a plane each, and its shape."""
    e = table(spark, sf_dir, "embeddings")
    value = lambda v: F.floor(F.least(F.greatest(128 + 200 * v.cast("double"), F.lit(0.0)), F.lit(255.0))).cast("int")
    last = e.agg(F.max("vec_id").alias("z")).first()["z"]
    return e.select(F.col("vec_id").cast("int").alias("cz"), F.lit(0).alias("cy"), F.lit(0).alias("cx"), F.transform("embedding", value).alias("data")), ((last or 0) + 1, 8, 8)


def render_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast and phase of the windings' tiles, as given and smoothed."""
    volume, shape = planes(spark, sf_dir)
    return _rounded(rn.render_contrast(within_volume(spark, sf_dir), volume, shape, (1, 8, 8), STEP, SIGMAS, LAYERS, TILE, PERIODS))


QUERIES = {"render_contrast": render_contrast}


def _kernel(name: str, sigma: float) -> str:
    k = gaussian_kernel(sigma)
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({n - len(k) // 2}, {w!r}::DOUBLE)" for n, w in enumerate(k)) + ") AS v(d, w))"


def _mirror(at: str, n: str) -> str:
    m = f"((({at}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END"


def _gradient(axis: str, other: str, a: str) -> str:
    w = f"OVER (PARTITION BY sigma, winding, {other} ORDER BY {axis})"
    return f"CASE WHEN lag({a}) {w} IS NULL THEN lead({a}) {w} - {a} WHEN lead({a}) {w} IS NULL THEN {a} - lag({a}) {w} ELSE (lead({a}) {w} - lag({a}) {w}) / 2 END"


_CORNERS = [(dz, dy, dx) for dz in (0, 1) for dy in (0, 1) for dx in (0, 1)]
_TRILINEAR = " + ".join("*".join(f"f{a}" if d else f"(1 - f{a})" for a, d in zip("zyx", k, strict=True)) + " * v{}{}{}.v".format(*k) for k in _CORNERS)
_VOXELS = " ".join("JOIN vo v{0}{1}{2} ON v{0}{1}{2}.k = voxel + {3}".format(*k, 64 * k[0] + 8 * k[1] + k[2]) for k in _CORNERS)


_ONES = ", ".join(f"({t})" for t in LAYERS)
_WAVES = ", ".join(f"({p!r}::DOUBLE)" for p in PERIODS)
#: Smoothing, refinement, normals, sampling and tiles, each from its definition.
RENDER = [
    "me AS MATERIALIZED (SELECT label AS winding, r, i AS c, e, 3.5 + 2 * e AS x, i / 9.0::DOUBLE AS y, 9.0::DOUBLE * r + 5.37::DOUBLE AS z, e > -0.2 AS valid FROM (SELECT label, r, i, embedding[i + 1]::DOUBLE AS e FROM (SELECT label, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS r, unnest(range(len(embedding)))::INT AS i FROM embeddings)))",
    "sh AS MATERIALIZED (SELECT winding, max(r) + 1 AS rows, max(c) + 1 AS cols FROM me GROUP BY winding)",
    _kernel("k1", 1.0),
    _kernel("k3", 3.0),
    "m1 AS MATERIALIZED (SELECT m.winding, " + _mirror("m.r + k.d", "s.rows") + " AS r, m.c, " + ", ".join(f"sum(CASE WHEN valid THEN k.w * {a} ELSE 0 END) AS {a}" for a in "xyz") + ", sum(CASE WHEN valid THEN k.w ELSE 0 END) AS w FROM me m JOIN sh s USING (winding), k1 k GROUP BY ALL)",
    "m2 AS MATERIALIZED (SELECT m.winding, m.r, " + _mirror("m.c + k.d", "s.cols") + " AS c, " + ", ".join(f"sum(k.w * m.{a}) AS {a}" for a in "xyzw") + " FROM m1 m JOIN sh s USING (winding), k1 k GROUP BY ALL)",
    "su AS MATERIALIZED (SELECT 0.0::DOUBLE AS sigma, winding, r, c, x, y, z, valid FROM me UNION ALL SELECT 1.0, m.winding, m.r, m.c, " + ", ".join(f"CASE WHEN m.valid THEN q.{a} / greatest(q.w, 1e-9) ELSE m.{a} END" for a in "xyz") + ", m.valid FROM me m JOIN m2 q USING (winding, r, c))",
    "hi AS MATERIALIZED (SELECT winding, rows, cols, 2 * (rows - 1) + 1 AS high, 2 * (cols - 1) + 1 AS wide FROM sh)",
    "d1 AS MATERIALIZED (SELECT a.sigma, h.winding, h.i, a.c, " + ", ".join(f"a.{k} * (1 - h.f) + b.{k} * h.f AS {k}" for k in "xyz") + " FROM (SELECT winding, i, least(floor(i * 0.5), rows - 2)::INT AS lo, i * 0.5 - least(floor(i * 0.5), rows - 2) AS f FROM (SELECT winding, rows, unnest(range(high)) AS i FROM hi)) h JOIN su a ON a.winding = h.winding AND a.r = h.lo JOIN su b ON b.winding = h.winding AND b.r = h.lo + 1 AND b.c = a.c AND b.sigma = a.sigma)",
    "d2 AS MATERIALIZED (SELECT a.sigma, h.winding, a.i, h.j, " + ", ".join(f"a.{k} * (1 - h.f) + b.{k} * h.f AS {k}" for k in "xyz") + " FROM (SELECT winding, j, least(floor(j * 0.5), cols - 2)::INT AS lo, j * 0.5 - least(floor(j * 0.5), cols - 2) AS f FROM (SELECT winding, cols, unnest(range(wide)) AS j FROM hi)) h JOIN d1 a ON a.winding = h.winding AND a.c = h.lo JOIN d1 b ON b.winding = h.winding AND b.i = a.i AND b.c = h.lo + 1 AND b.sigma = a.sigma)",
    "g1 AS MATERIALIZED (SELECT d.sigma, d.winding, " + _mirror("d.i + k.d", "h.high") + " AS i, d.j, " + ", ".join(f"sum(k.w * {a}) AS {a}" for a in "xyz") + " FROM d2 d JOIN hi h USING (winding), k3 k GROUP BY ALL)",
    "g2 AS MATERIALIZED (SELECT d.sigma, d.winding, d.i, " + _mirror("d.j + k.d", "h.wide") + " AS j, " + ", ".join(f"sum(k.w * {a}) AS {a}" for a in "xyz") + " FROM g1 d JOIN hi h USING (winding), k3 k GROUP BY ALL)",
    "gr AS MATERIALIZED (SELECT sigma, winding, i, j, " + ", ".join(f"{_gradient('i', 'j', a)} AS p{a}, {_gradient('j', 'i', a)} AS q{a}" for a in "xyz") + " FROM g2)",
    "nr AS MATERIALIZED (SELECT *, greatest(sqrt(n0 * n0 + n1 * n1 + n2 * n2), 1e-9) AS len FROM (SELECT sigma, winding, i, j, py * qx - px * qy AS n0, px * qz - pz * qx AS n1, pz * qy - py * qz AS n2 FROM gr))",
    "dp AS MATERIALIZED (SELECT d.*, n.n0 / n.len AS nz, n.n1 / n.len AS ny, n.n2 / n.len AS nx, (i + 1) // 2 AS vr, (j + 1) // 2 AS vc FROM d2 d JOIN nr n USING (sigma, winding, i, j))",
    "de AS MATERIALIZED (SELECT d.*, v.ok FROM dp d JOIN (SELECT winding, r AS vr, c AS vc, valid AS ok FROM me) v USING (winding, vr, vc))",
    "wh AS (SELECT sigma, winding, (i // 16)::INT AS ti, (j // 16)::INT AS tj FROM de GROUP BY ALL HAVING count(*) = 256 AND count(*) FILTER (ok) >= 0.9 * 256)",
    "vo AS MATERIALIZED (SELECT vec_id::INT * 64 + i AS k, floor(least(greatest(128 + 200 * embedding[i + 1]::DOUBLE, 0.0), 255.0)) AS v FROM (SELECT vec_id, embedding, unnest(range(64))::INT AS i FROM embeddings))",
    "po AS (SELECT sigma, winding, (i // 16)::INT AS ti, (j // 16)::INT AS tj, t, z + t * nz AS z, y + t * ny AS y, x + t * nx AS x FROM de, (VALUES " + _ONES + ") AS l(t) WHERE ok)",
    "pl AS MATERIALIZED (SELECT *, least(greatest(floor(z), 0), (SELECT max(vec_id) FROM embeddings) - 1)::INT * 64 + least(greatest(floor(y), 0), 6)::INT * 8 + least(greatest(floor(x), 0), 6)::INT AS voxel, z - floor(z) AS fz, y - floor(y) AS fy, x - floor(x) AS fx FROM po)",
    f"sa AS MATERIALIZED (SELECT sigma, winding, ti, tj, t, {_TRILINEAR} AS v FROM pl {_VOXELS})",
    "mn AS (SELECT sigma, winding, ti, tj, t, avg(v) AS v, count(*) FILTER (v = 0) AS zeros, count(*) AS n FROM sa GROUP BY ALL)",
    "pr AS MATERIALIZED (SELECT mn.* FROM mn JOIN wh USING (sigma, winding, ti, tj) QUALIFY sum(zeros) OVER (PARTITION BY sigma, winding, ti, tj) <= 0.05 * sum(n) OVER (PARTITION BY sigma, winding, ti, tj))",
    "ce AS (SELECT *, v - avg(v) OVER (PARTITION BY sigma, winding, ti, tj) AS x FROM pr)",
    "ft AS (SELECT sigma, winding, ti, tj, p, sum(x * cos(2 * pi() * t / p)) AS xc, sum(x * sin(2 * pi() * t / p)) AS xs, sum(x * x) AS xx, sum(cos(2 * pi() * t / p) ** 2) AS cc, sum(cos(2 * pi() * t / p) * sin(2 * pi() * t / p)) AS cs, sum(sin(2 * pi() * t / p) ** 2) AS ss FROM ce, (VALUES " + _WAVES + ") AS w(p) GROUP BY ALL)",
    "fi AS (SELECT *, (xc * ss - xs * cs) / (cc * ss - cs * cs) AS b, (xs * cc - xc * cs) / (cc * ss - cs * cs) AS a FROM ft)",
    "be AS (SELECT sigma, winding, ti, tj, p, p * atan2(a, b) / (2 * pi()) AS o FROM fi QUALIFY row_number() OVER (PARTITION BY sigma, winding, ti, tj ORDER BY round(xx - b * xc - a * xs, 6), p) = 1)",
    "co AS (SELECT sigma, winding, ti, tj, (max(v) - min(v)) / (max(v) + min(v) + 1e-6) AS contrast FROM pr GROUP BY ALL)",
]
_NB = " ".join(f"JOIN su {n} ON {n}.sigma = m.sigma AND {n}.winding = m.winding AND {n}.r = m.r + {dr} AND {n}.c = m.c + {dc}" for n, dr, dc in (("u", -1, 0), ("d", 1, 0), ("l", 0, -1), ("g", 0, 1)))
_LEN = lambda a, b: "sqrt(" + " + ".join(f"({a}.{k} - {b}.{k}) ** 2" for k in "xyz") + ")"
ROUGH = [
    f"nb AS (SELECT m.sigma, m.winding, " + ", ".join(f"m.{k} AS {k}, d.{k} - u.{k} AS a{k}, g.{k} - l.{k} AS q{k}, g.{k} - 2 * m.{k} + l.{k} AS su{k}, d.{k} - 2 * m.{k} + u.{k} AS sv{k}" for k in "xyz") + f", 0.5 * ({_LEN('g', 'm')} + {_LEN('m', 'l')}) AS hu, 0.5 * ({_LEN('d', 'm')} + {_LEN('m', 'u')}) AS hv FROM su m {_NB} WHERE m.valid AND u.valid AND d.valid AND l.valid AND g.valid)",
    "nn AS (SELECT *, ay * qz - az * qy AS n0, az * qx - ax * qz AS n1, ax * qy - ay * qx AS n2 FROM nb)",
    "ro AS (SELECT sigma, winding, " + ", ".join(f"sqrt(avg((({s}x * n0 + {s}y * n1 + {s}z * n2) / sqrt(n0 * n0 + n1 * n1 + n2 * n2) * (2 / greatest({h}, 1e-6)) ** 2) ** 2)) AS {n}" for s, h, n in (("su", "hu", "roughness_u"), ("sv", "hv", "roughness_v"))) + " FROM nn WHERE sqrt(n0 * n0 + n1 * n1 + n2 * n2) > 1e-6 GROUP BY ALL)",
    "ag AS (SELECT sigma, winding, count(*) AS tiles, avg((contrast > 0.2)::INT) AS tiles_above_0_2, sqrt(avg(cos(2 * pi() * o / p)) ** 2 + avg(sin(2 * pi() * o / p)) ** 2) AS phase_R, median(contrast) AS contrast_median, median(abs(o)) AS offset_median FROM co JOIN be USING (sigma, winding, ti, tj) GROUP BY ALL)",
]
ORACLE_SQL = {"render_contrast": with_(*RENDER, *ROUGH) + "SELECT sigma, winding, coalesce(tiles, 0) AS tiles, " + ", ".join(f"round({k}, 6) AS {k}" for k in FIGURES) + " FROM ro LEFT JOIN ag USING (sigma, winding)"}
