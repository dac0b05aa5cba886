"""Ordered operators along rays: differences, interpolation, counting, nearest
and as-of joins, runs, smoothing.

Joins by order are a union and a window over each ray, not a range join: the
cost is a sort of both sides by (ray, t), whatever the overlap. Every window is
partitioned by the ray.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import linear


def _by(ray: str, *order: str) -> Window:
    return Window.partitionBy(ray).orderBy(*order)


def gaps(hits: DataFrame, ray: str = "ray_id", t: str = "t") -> DataFrame:
    """Distance to the ray's previous position, and whether both lie on one
    winding (if there is such a column)."""
    w = _by(ray, t)
    out = hits.withColumn("gap", F.col(t) - F.lag(t).over(w))
    if "winding" in hits.columns:
        out = out.withColumn("same_winding", F.col("winding") == F.lag("winding").over(w))
    return out.where("gap is not null")


def dedupe(hits: DataFrame, eps: float = 1e-6, ray: str = "ray_id", t: str = "t", label: str = "winding", tie: str | None = None) -> DataFrame:
    """Drop a hit that lies within eps of its forerunner on the same winding."""
    w = _by(ray, t, *([tie] if tie else []))
    repeated = ((F.col(t) - F.lag(t).over(w)) < eps) & (F.col(label) == F.lag(label).over(w))
    return hits.withColumn("_repeated", F.coalesce(repeated, F.lit(False))).where("not _repeated").drop("_repeated")


def local_gap(t: Column, window: Window) -> Column:
    """Half the distance between both neighbours, one-sided at the ends."""
    before, after = F.lag(t).over(window), F.lead(t).over(window)
    return F.coalesce((after - before) / 2, after - t, t - before)


def midpoints(hits: DataFrame, ray: str = "ray_id", t: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
    """Interior positions with the mid-points to both neighbours; rows of
    different values of ``by`` are no neighbours."""
    w = Window.partitionBy(ray, *by).orderBy(t)
    return (
        hits.withColumn("mid_left", (F.col(t) + F.lag(t).over(w)) / 2)
        .withColumn("mid_right", (F.col(t) + F.lead(t).over(w)) / 2)
        .where("mid_left is not null and mid_right is not null")
    )


def interpolate_at(knots: DataFrame, points: DataFrame, ray: str = "ray_id", t: str = "t", value: str = "v") -> DataFrame:
    """``points`` with a column ``value``: the knots' piecewise-linear curve at
    each point, clamped at its ends, null for a ray without knots."""
    carried = [c for c in points.columns if c not in (ray, t)]
    k = knots.select(F.col(ray), F.col(t), F.lit(0).alias("_q"), F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("_k"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried])
    q = points.select(ray, t, F.lit(1).alias("_q"), F.lit(None).cast(k.schema["_k"].dataType).alias("_k"), *carried)
    w = _by(ray, t, "_q")
    both = k.unionByName(q)
    before = F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_k", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_a", before).withColumn("_b", after).where("_q = 1")
    return found.withColumn(value, linear(F.col(t), F.col("_a.t"), F.col("_a.v"), F.col("_b.t"), F.col("_b.v"))).select(ray, t, *carried, value)


def count_before(points: DataFrame, hits: DataFrame, ray: str = "ray_id", t: str = "t") -> DataFrame:
    """``points`` with ``hits_before``: how many of the ray's hits have a
    strictly smaller t. Hits sort behind points of the same t."""
    carried = [c for c in points.columns if c not in (ray, t)]
    p = points.select(ray, t, F.lit(0).alias("_hit"), *carried)
    h = hits.select(F.col(ray), F.col(t), F.lit(1).alias("_hit"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried])
    w = _by(ray, t, "_hit").rowsBetween(Window.unboundedPreceding, 0)
    return p.unionByName(h).withColumn("hits_before", F.sum("_hit").over(w)).where("_hit = 0").drop("_hit")


def neighbours(points: DataFrame, sites: DataFrame, ray: str = "ray_id", t: str = "t") -> DataFrame:
    """``points`` with the ray's sites next to each: ``left`` (t at most) and
    ``right`` (t at least), null where there is none."""
    carried = [c for c in points.columns if c not in (ray, t)]
    s = sites.select(F.col(ray), F.col(t), F.lit(1).alias("_site"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried])
    both = points.select(ray, t, F.lit(0).alias("_site"), *carried).unionByName(s)
    at = F.when(F.col("_site") == 1, F.col(t))
    # Range frames: a site at the point's own t is on both sides.
    w = _by(ray, t)
    return (
        both.withColumn("left", F.max(at).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("right", F.min(at).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
        .where("_site = 0")
        .drop("_site")
    )


def nearest_distance(left: Column, t: Column, right: Column) -> Column:
    return F.least(F.abs(t - left), F.abs(right - t))


def nearest_site(left: Column, t: Column, right: Column) -> Column:
    """The nearer of both neighbours; a tie goes to the left one."""
    return F.when(left.isNull(), right).when(right.isNull(), left).when(t - left <= right - t, left).otherwise(right)


def runs(rows: DataFrame, ray: str, order: str, key: Column, name: str = "run") -> DataFrame:
    """Number the ray's runs of neighbouring rows with an equal key."""
    w = _by(ray, order)
    changed = F.when(F.lag(key).over(w).eqNullSafe(key) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_changed", changed).withColumn(name, F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def integer_runs(rows: DataFrame, group: str, index: str) -> DataFrame:
    """Contiguous integer runs as (group, first, last, n)."""
    island = F.col(index) - F.row_number().over(_by(group, index))
    return rows.withColumn("_island", island).groupBy(group, "_island").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def snap(points: DataFrame, crests: DataFrame, reach: float = 0.5, ray: str = "ray_id", t: str = "t", tie: str = "k") -> DataFrame:
    """Move each point to its nearest crest within reach x its local gap; a
    crest claimed twice goes to the nearer point, then to the earlier one.

    Adds gap, crest, t_new and status: snapped, no_crest or conflict.
    """
    w = _by(ray, t, tie)
    found = neighbours(points.withColumn("gap", local_gap(F.col(t), w)), crests, ray, t)
    found = found.withColumn("crest", nearest_site(F.col("left"), F.col(t), F.col("right"))).withColumn("move", F.abs(F.col("crest") - F.col(t)))
    ok = F.coalesce(F.col("move") <= reach * F.col("gap"), F.lit(False))
    claim = Window.partitionBy(ray, "_ok", "crest").orderBy("move", t, tie)
    return (
        found.withColumn("_ok", ok)
        .withColumn("_rank", F.row_number().over(claim))
        .withColumn("status", F.when(~F.col("_ok"), "no_crest").when(F.col("_rank") > 1, "conflict").otherwise("snapped"))
        .withColumn("t_new", F.when(F.col("status") == "snapped", F.col("crest")).otherwise(F.col(t)))
        .drop("_ok", "_rank", "left", "right", "move")
    )


def crest_runs(rows: DataFrame, crests: DataFrame) -> DataFrame:
    """The snapped ones of ``snap`` rows with a level, and their ``run``:
    neighbours whose number of crests before and whose level differ alike."""
    snapped = rows.where("status = 'snapped'").select("ray_id", F.col("t_new").alias("t"), F.col("t").alias("t_old"), "k", "level")
    numbered = count_before(snapped, crests)
    return runs(numbered.withColumn("diff", F.col("hits_before") - F.col("level")), "ray_id", "t_old", F.col("diff"))


def drop_unsnapped(rows: DataFrame, crests: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Each run of at least ``least`` crossings becomes a ray of its own:
    rays (ray, ray_id, run, offset, n, first_t, last_t), numbered from 0 with
    the crossings before each, and crossings (ray, place, ray_id, t, level).

    Numbers and offsets are prefix sums over parts of the table, so that no
    task sees it whole.
    """
    from .numbering import dense

    told = crest_runs(rows, crests)
    kept = told.groupBy("ray_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).where(F.col("n") >= least)
    rays = dense(kept, "ray_id", "run", number="ray", total="n")
    place = F.row_number().over(_by("ray", "t_old", "k")) - 1
    crossings = told.join(rays.select("ray_id", "run", "ray"), ["ray_id", "run"]).withColumn("place", place)
    return rays, crossings.select("ray", "place", "ray_id", "t", "level")


def snap_summary(rows: DataFrame, crests: DataFrame, near: float = 3.0, least: int = 2) -> DataFrame:
    """One row for a store's manifest: outcomes, moves and what runs keep.
    Sums meet by ray; percentiles are by ranges of counted values."""
    from .statistics import exact_percentiles

    s = F.col("status")
    part = lambda hit: F.count_if(hit)
    sums = rows.groupBy("ray_id").agg(F.count(F.lit(1)).alias("n"), *[part(s == k).alias(k) for k in ("snapped", "no_crest", "conflict")], part(F.abs(F.col("crest") - F.col("t")) <= near).alias("near"))
    total = sums.agg(F.count(F.lit(1)).alias("rays"), F.coalesce(F.sum("n"), F.lit(0)).alias("crossings"), *[F.sum(k).alias(k) for k in ("snapped", "no_crest", "conflict", "near")])
    kept = crest_runs(rows, crests).groupBy("ray_id", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).agg(F.count(F.lit(1)).alias("rays_out"), F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    moves = rows.where(s == "snapped").select(F.abs(F.col("t_new") - F.col("t")).alias("move"))
    shifts = exact_percentiles(moves, "move", {f"shift_p{q}": q / 100 for q in (25, 50, 75, 90)}).drop("n")
    gap = F.col("t") - F.lag("t").over(_by("ray_id", "t"))
    gaps = exact_percentiles(crests.select("ray_id", gap.alias("gap")), "gap", {"crest_gap_median": 0.5}).drop("n")
    # Each side is one row at most.
    one = total.crossJoin(F.broadcast(kept)).join(F.broadcast(shifts), F.lit(True), "left").join(F.broadcast(gaps), F.lit(True), "left")
    share_ = lambda n: n / F.nullif(F.col("crossings"), F.lit(0))
    fractions = {f"{k}_frac": share_(F.col(k)) for k in ("snapped", "no_crest", "conflict", "near", "kept")} | {"inconsistent_frac": share_(F.col("snapped") - F.col("kept"))}
    return one.select("rays", "crossings", *[c.alias(k) for k, c in fractions.items()], "rays_out", *[f"shift_p{q}" for q in (25, 50, 75, 90)], "crest_gap_median")


def smooth(profile: DataFrame, sigma: float, group: str = "prof_id", index: str = "i", value: str = "raw", name: str = "smooth") -> DataFrame:
    """Gaussian smoothing of a long profile table, ends mirrored. A profile is
    gathered into one array, smoothed and dealt out again: it is short, and its
    neighbours are then an index away."""
    from ..functions.expr import smooth_array

    packed = profile.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v")))).alias("p"))
    smoothed = packed.select(group, F.col("p.i").alias("_i"), smooth_array(F.col("p.v"), sigma).alias("_v"))
    return smoothed.select(group, F.explode(F.arrays_zip("_i", "_v")).alias("z")).select(group, F.col("z._i").alias(index), F.col("z._v").alias(name))


def local_maxima(profile: DataFrame, height: Column, group: str = "prof_id", index: str = "i", value: str = "v") -> DataFrame:
    """Samples above their left neighbour, not below the right one, and above
    ``height``; with both neighbours' values."""
    w = _by(group, index)
    return profile.withColumn("left_v", F.lag(value).over(w)).withColumn("right_v", F.lead(value).over(w)).where((F.col(value) > F.col("left_v")) & (F.col(value) >= F.col("right_v")) & (F.col(value) > height))


def detrend(profile: DataFrame, group: str = "prof_id", t: str = "t", value: str = "v", name: str = "detrended") -> DataFrame:
    """Remove each profile's least-squares line."""
    w = Window.partitionBy(group)
    n, st, sv = F.count(F.col(value)).over(w), F.sum(F.col(t)).over(w), F.sum(F.col(value)).over(w)
    stt, stv = F.sum(F.col(t) * F.col(t)).over(w), F.sum(F.col(t) * F.col(value)).over(w)
    slope = (n * stv - st * sv) / F.nullif(n * stt - st * st, F.lit(0.0))
    slope = F.coalesce(slope, F.lit(0.0))
    return profile.withColumn("_slope", slope).withColumn("_mean", (sv - F.col("_slope") * st) / n).withColumn(name, F.col(value) - F.col("_mean") - F.col("_slope") * F.col(t)).drop("_slope", "_mean")
