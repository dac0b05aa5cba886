"""Spatial joins: ray and triangle, nearest vertex, k nearest planes.

Geometry is bucketed into grid cells and joined by cell equality, so a pair is
only formed where both sides are near. Large triangles have cells of their own
size; searches that find nothing near go on in larger cells.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import cross, dot, minus
from .lineage import cut


def _vec(name: str, order: str = "zyx") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{name}.{a}") for a in order)


def hit_predicate(origin, direction, v0, v1, v2, length: Column, eps: float = 1e-9) -> tuple[Column, Column]:
    """Distance along the ray and whether it hits the triangle within length."""
    e1, e2 = minus(v1, v0), minus(v2, v0)
    h = cross(direction, e2)
    a = dot(e1, h)
    s = minus(origin, v0)
    f = 1 / F.nullif(a, F.lit(0.0))
    u = f * dot(s, h)
    q = cross(s, e1)
    v, t = f * dot(direction, q), f * dot(e2, q)
    return t, (F.abs(a) > eps) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0) & (t <= length)


def _stretches(size: Column) -> Column:
    """The cells of a ray in order: array of (from, to, cz, cy, cx).

    A ray passes from cell to cell where it crosses a plane of the grid; the
    middle between two crossings tells the cell.
    """

    def crossings(a: str) -> Column:
        o, d = F.col(f"origin.{a}"), F.col(f"direction.{a}")
        one, two = F.floor(o / size), F.floor((o + F.col("length") * d) / size)
        planes = F.transform(F.sequence(F.least(one, two), F.greatest(one, two) + 1), lambda k: (k * size - o) / d)
        return F.when(d != 0, F.filter(planes, lambda t: (t > 0) & (t < F.col("length")))).otherwise(F.array().cast("array<double>"))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("length").cast("double")), *[crossings(a) for a in "zyx"])))
    cell = lambda a, t: F.floor((F.col(f"origin.{a}") + t * F.col(f"direction.{a}")) / size)

    def stretch(lo: Column, hi: Column) -> Column:
        middle = (lo + F.coalesce(hi, lo)) / 2
        return F.struct(lo.alias("from"), hi.alias("to"), *[cell(a, middle).alias(f"c{a}") for a in "zyx"])

    # The last cut opens a stretch of its own: what is hit at the very end.
    return F.transform(cuts, lambda t, i: stretch(t, F.get(cuts, i + 1)))


def ray_triangle_hits(rays: DataFrame, triangles: DataFrame, cell: float) -> DataFrame:
    """(ray_id, winding, tri_id, t) of every hit.

    ``rays``: ray_id, origin, direction (z, y, x structs, unit), length.
    ``triangles``: winding, tri_id, v0, v1, v2. Triangles outside the box of
    all rays are dropped; others go to every cell that their bounding box
    touches, in a grid of ``cell`` or, if they are wider, of the power of two
    of it that holds them. A ray goes to the cells it passes. A hit counts in
    the stretch of the ray it lies in, hence once.
    """
    lo, hi = {}, {}
    for a in "zyx":
        corner = [F.col(f"{v}.{a}") for v in ("v0", "v1", "v2")]
        lo[a], hi[a] = F.least(*corner), F.greatest(*corner)
    end = lambda a: F.col(f"origin.{a}") + F.col("length") * F.col(f"direction.{a}")
    # One row.
    box = rays.agg(*[f(g(F.col(f"origin.{a}"), end(a))).alias(f"{n}_{a}") for a in "zyx" for n, f, g in (("least", F.min, F.least), ("most", F.max, F.greatest))])
    reached = triangles.join(F.broadcast(box), None, "cross")
    for a in "zyx":
        reached = reached.where((hi[a] >= F.col(f"least_{a}")) & (lo[a] <= F.col(f"most_{a}")))
    wide = F.greatest(*[hi[a] - lo[a] for a in "zyx"])
    classed = reached.select(*triangles.columns, F.when(wide <= 2 * cell, F.lit(float(cell))).otherwise(F.lit(float(cell)) * F.pow(F.lit(2.0), F.ceil(F.log2(wide / cell)))).alias("size"))
    cells, slack = classed, F.col("size") * 1e-9
    for a in "zyx":
        cells = cells.withColumn(f"c{a}", F.explode(F.sequence(F.floor((lo[a] - slack) / F.col("size")), F.floor((hi[a] + slack) / F.col("size")))))
    # A handful of size classes: powers of two of the cell.
    sizes = classed.select("size").distinct()
    passed = rays.crossJoin(F.broadcast(sizes)).select("ray_id", "origin", "direction", "length", "size", F.inline(_stretches(F.col("size"))))
    met = passed.join(cells, ["size", "cz", "cy", "cx"])
    t, hit = hit_predicate(_vec("origin"), _vec("direction"), _vec("v0"), _vec("v1"), _vec("v2"), F.col("length"))
    own = (F.col("t") >= F.col("from")) & (F.col("to").isNull() | (F.col("t") < F.col("to")))
    return met.where(hit).withColumn("t", t).where(own).select("ray_id", "winding", "tri_id", "t")


def _reached(df: DataFrame, radius: float) -> DataFrame:
    """Each row for every cell of twice the radius that its ball may touch: 8 at most."""
    for a in "xyz":
        df = df.withColumn(f"_c{a}", F.explode(F.sequence(*[F.floor((F.col(a) + r) / (2 * radius)).cast("long") for r in (-radius, radius)])))
    return df


def _placed(df: DataFrame, radius: float) -> DataFrame:
    return df.withColumns({f"_c{a}": F.floor(F.col(a) / (2 * radius)).cast("long") for a in "xyz"})


def by_locality(rays: DataFrame, cell: float, partitions: int) -> DataFrame:
    """Rays (origin) dealt by ranges of z, y, x cells and in that order within
    a partition, so that neighbours read the same chunks one after another."""
    cells = [F.floor(F.col(f"origin.{a}") / cell) for a in "zyx"]
    return rays.repartitionByRange(partitions, *cells).sortWithinPartitions(*cells, *[F.col(f"origin.{a}") for a in "zyx"])


#: Distinct sites of a cell that points may meet; cells with more are split.
CROWD = 1024
#: A cell's side over that of the cells in it, and how often cells are split
#: below the size asked for.
_SPLIT, _BELOW = 4, 12


def _parents(cells: list[str]) -> dict[str, Column]:
    """The cell that holds each cell, as columns of the names with _ in front."""
    return {f"_{c}": F.shiftright(c, _SPLIT.bit_length() - 1) for c in cells}


def _apart(one: str, two: str) -> tuple[Column, Column]:
    """The least and the largest squared distance of two boxes, whose bounds
    are the columns <name>lo_x, <name>hi_x and so on."""
    lo, hi = lambda n, a: F.col(f"{n}lo_{a}"), lambda n, a: F.col(f"{n}hi_{a}")
    gap = [F.greatest(lo(one, a) - hi(two, a), lo(two, a) - hi(one, a), F.lit(0.0)) for a in "xyz"]
    reach = [F.greatest(hi(one, a) - lo(two, a), hi(two, a) - lo(one, a)) for a in "xyz"]
    return sum((g * g for g in gap), F.lit(0.0)), sum((r * r for r in reach), F.lit(0.0))


def nearest_vertex(points: DataFrame, sites: DataFrame, cell: float, by: str = "winding") -> DataFrame:
    """Distance from each point (key, by, x, y, z) to the nearest site with
    the same ``by``, exact, at any distance.

    Occupied cells of eight times ``cell`` and their boxes are gathered into
    wider and wider ones on both sides. From the widest down, pairs of boxes
    are kept that may hold a nearest site: those no farther apart than the
    farthest corners of another. At the end a cell's points meet the sites of
    the cells, a quarter as wide, that are kept for them. The rounds are as
    many as the logarithm of the extent over ``cell``; cells with over
    ``CROWD`` sites are split on, points and sites alike.

    Points and sites with a null or non-finite coordinate are left out, and
    points of a ``by`` that is null or has no sites; equal sites count once.
    """
    finite = functools.reduce(lambda p, q: p & q, [F.coalesce(F.abs(F.col(a)) < float("inf"), F.lit(False)) for a in "xyz"])
    sites = cut(sites.where(finite).select(by, "x", "y", "z").distinct())
    points = cut(points.where(finite).select("key", by, "x", "y", "z"))
    # One row of each.
    ends = points.select("x", "y", "z").unionByName(sites.select("x", "y", "z")).agg(*[f(a).cast("double").alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends["lo_x"] is None:
        return points.select("key", by, F.lit(None).cast("double").alias("distance")).where("false")
    extent = max(ends[f"hi_{a}"] - ends[f"lo_{a}"] for a in "xyz")
    size = max(8.0 * cell, extent * 2.0**-32)
    wide = 0
    while size * _SPLIT**wide <= extent:
        wide += 1
    q, s = [f"q{a}" for a in "xyz"], [f"s{a}" for a in "xyz"]
    bounds = lambda side: [f"{side}{e}_{a}" for e in ("lo", "hi") for a in "xyz"]

    def placed(rows: DataFrame, side: str, level: int) -> DataFrame:
        return rows.withColumns({f"{side}{a}": F.floor((F.col(a) - ends[f"lo_{a}"]) / (size * float(_SPLIT) ** level)).cast("long") for a in "xyz"})

    def boxes(rows: DataFrame, side: str, level: int) -> DataFrame:
        """(by, cell, bounds, n) of the occupied cells of a level."""
        own = [f(a).alias(f"{side}{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"]
        return cut(placed(rows, side, level).groupBy(by, *[f"{side}{a}" for a in "xyz"]).agg(*own, F.count(F.lit(1)).alias(f"{side}n")))

    def wider(inner: DataFrame, side: str) -> DataFrame:
        cells = [f"{side}{a}" for a in "xyz"]
        own = [f(f"{side}{n}_{a}").alias(f"{side}{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"]
        return inner.withColumns(_parents(cells)).groupBy(by, *[F.col(f"_{c}").alias(c) for c in cells]).agg(*own, F.sum(f"{side}n").alias(f"{side}n"))

    def pruned(met: DataFrame) -> DataFrame:
        near, far = _apart("q", "s")
        most = F.min(far).over(Window.partitionBy(by, *q)) * (1 + 1e-9)
        return met.withColumn("_near", near).withColumn("_most", most).where("_near <= _most").select(by, *q, *bounds("q"), *s, "sn")

    def renamed(pairs: DataFrame, *cells: str) -> DataFrame:
        return pairs.select(by, *[F.col(c).alias(f"_{c}") if c in cells else c for c in (*q, *s)], *bounds("q"))

    q_level, s_level = {0: boxes(points, "q", 0)}, {-1: boxes(sites, "s", -1)}
    for level in range(max(1, wide)):
        s_level[level] = wider(s_level[level - 1], "s")
        if level:
            q_level[level] = wider(q_level[level - 1], "q")
    # The widest but one are 64 a side at most.
    level, found = max(0, wide - 1), []
    pairs = pruned(q_level[level].join(s_level[level], by))
    d2 = sum(((F.col(a) - F.col(f"at_{a}")) * (F.col(a) - F.col(f"at_{a}")) for a in "xyz"), F.lit(0.0))
    while True:
        if level <= 0:
            # Where few sites are left, points meet them.
            pairs = cut(pairs)
            more = level > -_BELOW and bool(pairs.where(F.col("sn") > CROWD).head(1))
            few = pairs.where(F.col("sn") <= CROWD) if more else pairs
            parts = s_level[level - 1].withColumns(_parents(s))
            kept = pruned(renamed(few, *s).join(parts, [by, *[f"_{c}" for c in s]])).select(by, *q, *s)
            at = placed(sites, "s", level - 1).select(by, *s, *[F.col(a).alias(f"at_{a}") for a in "xyz"])
            found.append(placed(points, "q", level).join(kept.join(at, [by, *s]).drop(*s), [by, *q]).groupBy("key", by).agg(F.min(d2).alias("d2")))
            if not more:
                break
            pairs = pairs.where(F.col("sn") > CROWD)
            left = placed(points, "q", level).join(pairs.select(by, *q).distinct(), [by, *q], "left_semi").select(*points.columns)
            q_level[level - 1] = boxes(left, "q", level - 1)
            s_level[level - 2] = boxes(sites, "s", level - 2)
        level -= 1
        inner = renamed(pairs, *q, *s).drop(*bounds("q"))
        met = inner.join(q_level[level].withColumns(_parents(q)), [by, *[f"_{c}" for c in q]])
        pairs = pruned(met.join(s_level[level].withColumns(_parents(s)), [by, *[f"_{c}" for c in s]]))
    out = functools.reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        out = out.groupBy("key", by).agg(F.min("d2").alias("d2"))
    return cut(out.select("key", by, F.sqrt("d2").alias("distance")))


#: Steps of the radius at which sites of a point's own cell are counted.
_STEPS = 8


def nearest_within(points: DataFrame, sites: DataFrame, radius: float, by: str = "winding", k: int = 1) -> DataFrame:
    """The k nearest sites at most ``radius`` away that share ``by``, exact.
    Adds site, distance and rank. The key tells points of a ``by`` apart.

    Sites go to every cell that a point that near may lie in, a point to its
    own cell. So all pairs of a point are made in one place, and the ranking
    moves none of them. A first join counts the sites that lie in a point's
    own cell by steps of the radius: where a step holds k, none beyond it is
    ranked. Sides are merged, never broadcast: Spark would plan by the size of
    the files read, which tells nothing of the copies in cells.
    """
    cells = ["_cx", "_cy", "_cz"]
    p = _placed(points, radius)
    d2 = lambda site: sum(((F.col(a) - F.col(site + a)) * (F.col(a) - F.col(site + a)) for a in "xyz"), F.lit(0.0))
    at = _placed(sites, radius).select(by, *cells, *[F.col(a).alias(f"_at_{a}") for a in "xyz"])
    steps = [radius * j / _STEPS for j in range(1, _STEPS)]
    held = {step: F.count(F.when(F.sqrt(d2("_at_")) <= step, 1)) for step in steps}
    enough = F.coalesce(*[F.when(n >= k, F.lit(step)) for step, n in held.items()], F.lit(float(radius)))
    p = p.join(at.hint("merge"), [by, *cells], "left").groupBy(*p.columns).agg(enough.alias("_enough"))
    s = _reached(sites, radius).select(by, *cells, F.struct([F.col(c) for c in sites.columns if c != by]).alias("site"))
    pairs = p.join(s.hint("merge"), [by, *cells]).withColumn("distance", F.sqrt(d2("site."))).where(F.col("distance") <= F.col("_enough"))
    # The key first: it tells most rows apart, the cell few that are sorted together.
    rank = F.row_number().over(Window.partitionBy("key", by, *cells).orderBy("distance", "site"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop(*cells, "_enough")
