"""Queries over crossing stores: rays derived again, and what snapping keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequence as seq
from ..operators import statistics as st
from ..operators import tolerance as tl
from .ray_queries import _SNAP, _kind, _pt, _rounded, _snapped
from .views import PT, with_


def _origins(rays: DataFrame, shift: Column) -> DataFrame:
    k = F.col("ray_id")
    return rays.select("ray_id", "crossings", (k * 37 % 800 + 0.25 + shift).alias("z"), (k * 91 % 1200 + 0.5).alias("y"), (k % 2000 - shift).alias("x"))


def store_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays derived again, a little off, against those of a store."""
    views = _kind(_pt(spark, sf_dir), "view", "event_id")
    stored = tl.levelled(views).withColumn("level", F.col("level") + F.when(F.col("ray_id") % 11 == 0, 1).otherwise(0))
    e = F.col("event_id") * 13
    off = F.when(e % 160 == 0, 0.05).otherwise((e % 7 - 3) * 0.005)
    derived = tl.levelled(views.select("ray_id", (F.col("t") + off).alias("t")))
    nothing = F.lit(0.0)
    shift = (F.col("ray_id") * 7 % 5 - 2) * 0.0006
    return tl.compare_stores(_origins(tl.path_order(derived), shift), _origins(tl.path_order(stored), nothing), relative=0.0)


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapped crossings, a level being half the number along the ray."""
    w = Window.partitionBy("ray_id").orderBy("t", "k")
    return _snapped(spark, sf_dir).withColumn("level", F.floor(F.row_number().over(w) / 2).cast("long"))


def drop_unsnapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rays of a store that keeps consistent runs alone."""
    rays, _ = seq.drop_unsnapped(_levelled(spark, sf_dir), _kind(_pt(spark, sf_dir), "purchase"))
    return _rounded(rays.select("ray", "ray_id", "offset", "n", "first_t", "last_t"))


def snap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that go into a snapped store's manifest."""
    return _rounded(seq.snap_summary(_levelled(spark, sf_dir), _kind(_pt(spark, sf_dir), "purchase")))


QUERIES = {f.__name__: f for f in (store_match, drop_unsnapped, snap_summary)}

_RUNS = [
    "lv AS (SELECT *, floor(row_number() OVER (PARTITION BY ray_id ORDER BY t, k) / 2)::BIGINT AS level FROM sp)",
    "nu AS (SELECT lv.*, (SELECT count(*) FROM cr WHERE cr.ray_id = lv.ray_id AND cr.t < lv.t_new) - level AS diff FROM lv WHERE status = 'snapped')",
    "ch AS (SELECT *, CASE WHEN lag(diff) OVER (PARTITION BY ray_id ORDER BY t) = diff THEN 0 ELSE 1 END AS changed FROM nu)",
    "ru AS (SELECT *, sum(changed) OVER (PARTITION BY ray_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM ch)",
    "kept AS (SELECT ray_id, run, count(*) AS n, min(t_new) AS first_t, max(t_new) AS last_t FROM ru GROUP BY ray_id, run HAVING count(*) >= 2)",
]
ORACLE_SQL = {
    "store_match": with_(
        PT,
        "v AS (SELECT ray_id, t, event_id * 13 AS e FROM pt WHERE kind = 'view')",
        "s AS (SELECT ray_id, t, row_number() OVER (PARTITION BY ray_id ORDER BY t) AS k, row_number() OVER (PARTITION BY ray_id ORDER BY t) + (ray_id % 11 = 0)::INT AS level FROM v)",
        "d AS (SELECT ray_id, t, row_number() OVER (PARTITION BY ray_id ORDER BY t) AS k FROM (SELECT ray_id, t + CASE WHEN e % 160 = 0 THEN 0.05::DOUBLE ELSE (e % 7 - 3) * 0.005::DOUBLE END AS t FROM v))",
        "o AS (SELECT ray_id, count(*) AS n, ray_id * 37 % 800 + 0.25::DOUBLE AS z, ray_id * 91 % 1200 + 0.5::DOUBLE AS y, (ray_id % 2000)::DOUBLE AS x, (ray_id * 7 % 5 - 2) * 0.0006::DOUBLE AS off FROM v GROUP BY ray_id)",
        "p AS (SELECT a.ray_id, any_value(a.n) AS n_derived, min(b.ray_id) AS stored_id FROM o a LEFT JOIN o b ON abs(a.z + a.off - b.z) <= 1e-3 AND abs(a.y - b.y) <= 1e-3 AND abs(a.x - a.off - b.x) <= 1e-3 GROUP BY a.ray_id)",
        "m AS (SELECT p.ray_id, count(*) FILTER (abs(d.t - s.t) <= 0.02 AND d.k = s.level) AS good FROM p JOIN d ON d.ray_id = p.ray_id JOIN s ON s.ray_id = p.stored_id AND s.k = d.k GROUP BY p.ray_id)",
    )
    + "SELECT p.ray_id, stored_id, n_derived::INT AS n_derived, coalesce(o.n, 0)::INT AS n_stored, CASE WHEN stored_id IS NULL THEN 'no ray' WHEN o.n = n_derived AND m.good = n_derived THEN 'match' ELSE 'diff' END AS status FROM p LEFT JOIN o ON o.ray_id = p.stored_id LEFT JOIN m ON m.ray_id = p.ray_id",
    "drop_unsnapped": with_(PT, *_SNAP, *_RUNS)
    + "SELECT row_number() OVER o - 1 AS ray, ray_id, coalesce(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset, n, round(first_t, 6) AS first_t, round(last_t, 6) AS last_t FROM kept WINDOW o AS (ORDER BY ray_id, run)",
    "snap_summary": with_(
        PT,
        *_SNAP,
        *_RUNS,
        "b AS (SELECT count(DISTINCT ray_id) AS rays, count(*) AS crossings, avg((status = 'snapped')::INT) AS snapped_frac, avg((status = 'no_crest')::INT) AS no_crest_frac, avg((status = 'conflict')::INT) AS conflict_frac, avg(coalesce(abs(crest - t) <= 3, false)::INT) AS near_frac, count(*) FILTER (status = 'snapped') AS snapped FROM sp)",
        "r AS (SELECT count(*) AS rays_out, coalesce(sum(n), 0) AS kept FROM kept)",
        "h AS (SELECT " + ", ".join(f"quantile_cont(abs(t_new - t), {q / 100}) AS shift_p{q}" for q in (25, 50, 75, 90)) + " FROM sp WHERE status = 'snapped')",
        "g2 AS (SELECT median(gap) AS crest_gap_median FROM (SELECT t - lag(t) OVER (PARTITION BY ray_id ORDER BY t) AS gap FROM cr) WHERE gap IS NOT NULL)",
    )
    + "SELECT rays, crossings, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("snapped_frac", "no_crest_frac", "conflict_frac", "near_frac", "shift_p25", "shift_p50", "shift_p75", "shift_p90", "crest_gap_median"))
    + ", round(kept::DOUBLE / crossings, 6) AS kept_frac, round((snapped - kept)::DOUBLE / crossings, 6) AS inconsistent_frac, rays_out FROM b, r, h, g2",
}
