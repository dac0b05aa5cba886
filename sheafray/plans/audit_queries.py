"""The whole audit of a fit as one table: report, part, item, value."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import share
from ..operators import mesh as ms
from ..operators import sequence as seq
from ..operators import statistics as st
from ..operators.lineage import cut
from . import mesh_queries as mq
from . import ray_queries as rq
from .views import PT, mesh, with_

CONTRAST = ("n", "median_c", "mean_c", "frac_c_pos", "frac_c_gt_0_1")
NULL = ("copies", "null_mean", "null_p2_5", "null_p97_5", "frac_at_or_above", "observed")
GAPS = ("n", "median", "frac_lt_half_median", "frac_lt_small", "frac_gt_1_5_median")
PHASE = ("n", "median", "frac_lt_0_15", "frac_mid")
AGREE = ("pairs_d1", "frac_exact_d1", "mean_abs_err_d1", "pairs_d5", "frac_exact_d5", "median_count_d5")
PITCH = ("n", "gap_p10", "gap_p50", "gap_p90", "below_half")
RADIUS = ("n", "radius")
TRACE = ("n", "mean_x", "mean_y")
DRIFT = ("rows", "median_layers")


def _items(frame: DataFrame, report: str, part: str | Column, items: tuple[str, ...]) -> DataFrame:
    """Each column of ``items`` as a row."""
    part = F.lit(part) if isinstance(part, str) else part.cast("string")
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("item"), F.round(F.col(i).cast("double"), 6).alias("value")) for i in items]))
    return frame.select(F.lit(report).alias("report"), part.alias("part"), pair.alias("p")).select("report", "part", "p.item", "p.value")


def _agreement(counted: DataFrame) -> DataFrame:
    w = Window.partitionBy("ray_id").orderBy("t", "event_id")
    ahead = lambda n: F.lead("hits_before", n).over(w) - F.col("hits_before")
    d1, d5 = F.col("d1"), F.col("d5")
    part = F.when(F.col("ray_id") % 2 == 0, "held").otherwise("train").alias("part")
    rows = counted.withColumn("d1", ahead(1)).withColumn("d5", ahead(5)).select(part, "d1", "d5")
    middle = st.exact_percentiles(rows, "d5", {"median_count_d5": 0.5}, "part").drop("n")
    told = rows.groupBy("part").agg(F.count(d1).alias("pairs_d1"), share(d1 == 1).alias("frac_exact_d1"), F.avg(F.abs(d1 - 1).cast("double")).alias("mean_abs_err_d1"), F.count(d5).alias("pairs_d5"), share(d5 == 5).alias("frac_exact_d5"))
    return told.join(middle, "part", "left")


def full_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays with an even number are the held-out store, odd ones the other.
    The fit, the model and the shifted copies meet the profiles in one pass,
    whose contrasts are cut and read by all reports on them."""
    pt = rq._pt(spark, sf_dir)
    hits, model = rq._kind(pt, "click"), rq._kind(pt, "view", "event_id")
    gaps = seq.gaps(hits)
    med = gaps.groupBy("ray_id").agg(F.percentile("gap", F.lit(0.5)).alias("g"), F.count("gap").alias("k")).where("k >= 2").select("ray_id", "g")
    turn = F.col("copy") * rq.GOLDEN
    moved = hits.join(med, "ray_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(rq.NULL_COPIES)))).select("ray_id", (F.col("t") + (turn - F.floor(turn) - 0.5) * F.col("g")).alias("t"), "copy")
    positions = hits.withColumn("copy", F.lit(0)).unionByName(model.select("ray_id", "t", F.lit(-1).alias("copy"))).unionByName(moved)
    c = cut(st.contrast(rq._knots(pt), positions, by=("copy",)))
    positive = share(F.col("c") > 0).alias("frac")
    surfaces = mesh(spark, sf_dir)
    slid = surfaces.where("valid").join(F.broadcast(ms.quantile_windings(surfaces, (0.2, 0.4, 0.6, 0.8))), "winding").select("winding", "r", "c", (F.col("z") - 1000).alias("delta"), F.lit(14.0).alias("spacing"))
    drift = ms.drift(slid).groupBy("winding").agg(F.count(F.lit(1)).alias("rows"), F.percentile(F.round(F.col("slide") / 14.0, 5), F.lit(0.5)).alias("median_layers"))
    trace = ms.polyline(surfaces, 1000.0).groupBy("winding").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    parts = [
        _items(_agreement(seq.count_before(model, hits)), "agreement", F.col("part"), AGREE),
        _items(st.summarise(c.where("copy <= 0").withColumn("part", F.when(F.col("copy") == 0, "fit").otherwise("model")), "part"), "contrast", F.col("part"), CONTRAST),
        _items(st.null_report(c.where("copy > 0").groupBy("copy").agg(positive), c.where("copy = 0").agg(positive)), "null", "fit", NULL),
        _items(st.gap_statistics(gaps), "gaps", "fit", GAPS),
        _items(rq.phase_to_fit(spark, sf_dir), "phase", "model", PHASE),
        _items(mq.winding_pitch(spark, sf_dir), "pitch", F.col("winding"), PITCH),
        _items(mq.radius_by_winding(spark, sf_dir), "radius", F.col("winding"), RADIUS),
        _items(trace, "trace", F.col("winding"), TRACE),
        _items(drift, "drift", F.col("winding"), DRIFT),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


QUERIES = {"full_audit": full_audit}


def _rows(report: str, part: str, items: tuple[str, ...], source: str) -> str:
    names, values = ", ".join(f"'{i}'" for i in items), ", ".join(f"round({i}::DOUBLE, 6)" for i in items)
    return f"SELECT '{report}' AS report, ({part})::VARCHAR AS part, unnest([{names}]) AS item, unnest([{values}]) AS value FROM ({source})"


_RAYS = [
    *rq._MOVED[:-1],
    "m AS (SELECT ray_id, t, event_id FROM pt WHERE kind = 'view')",
    "moved AS (SELECT ray_id, t, 0 AS copy FROM hits UNION ALL SELECT ray_id, t, -1 FROM m UNION ALL (WITH " + rq._MOVED[-1].replace("moved AS", "mv AS") + " SELECT ray_id, t, copy FROM mv))",
    *rq.contrast_ctes("moved"),
]
_SUMS = "count(c) AS n, median(c) AS median_c, avg(c) AS mean_c, avg((c > 0)::INT) AS frac_c_pos, avg((c > 0.1)::INT) AS frac_c_gt_0_1"
_NULLS = (
    "SELECT count(*) AS copies, avg(frac) AS null_mean, quantile_cont(frac, 0.025) AS null_p2_5, quantile_cont(frac, 0.975) AS null_p97_5, avg((frac >= observed)::INT) AS frac_at_or_above, any_value(observed) AS observed "
    "FROM (SELECT copy, avg((c > 0)::INT) AS frac FROM c WHERE copy > 0 GROUP BY copy), (SELECT avg((c > 0)::INT) AS observed FROM c WHERE copy = 0)"
)
_D = [
    PT,
    rq.HITS,
    "m AS (SELECT ray_id, t, event_id FROM pt WHERE kind = 'view')",
    "n AS (SELECT m.*, (SELECT count(*) FROM hits h WHERE h.ray_id = m.ray_id AND h.t < m.t) AS b FROM m)",
    "d AS (SELECT CASE WHEN ray_id % 2 = 0 THEN 'held' ELSE 'train' END AS part, lead(b) OVER o - b AS d1, lead(b, 5) OVER o - b AS d5 FROM n WINDOW o AS (PARTITION BY ray_id ORDER BY t, event_id))",
]
_AGREED = "SELECT part, count(d1) AS pairs_d1, avg((d1 = 1)::INT) AS frac_exact_d1, avg(abs(d1 - 1)) AS mean_abs_err_d1, count(d5) AS pairs_d5, avg((d5 = 5)::INT) AS frac_exact_d5, median(d5) AS median_count_d5 FROM d GROUP BY part"
ORACLE_SQL = {
    "full_audit": " UNION ALL ".join(
        [
            _rows("agreement", "part", AGREE, with_(*_D) + _AGREED),
            _rows("contrast", "part", CONTRAST, with_(*_RAYS) + f"SELECT CASE copy WHEN 0 THEN 'fit' ELSE 'model' END AS part, {_SUMS} FROM c WHERE copy <= 0 GROUP BY copy"),
            _rows("null", "'fit'", NULL, with_(*_RAYS) + _NULLS),
            _rows("gaps", "'fit'", GAPS, rq.ORACLE_SQL["same_winding_gaps"]),
            _rows("phase", "'model'", PHASE, rq.ORACLE_SQL["phase_to_fit"]),
            _rows("pitch", "winding", PITCH, mq.ORACLE_SQL["winding_pitch"]),
            _rows("radius", "winding", RADIUS, mq.ORACLE_SQL["radius_by_winding"]),
            _rows("trace", "winding", TRACE, "SELECT winding, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y FROM (" + mq.ORACLE_SQL["plane_polyline"] + ") GROUP BY winding"),
            _rows(
                "drift",
                "winding",
                DRIFT,
                "SELECT winding, count(*) AS rows, median(layers) AS median_layers FROM (" + mq.ORACLE_SQL["drift_unwrap"] + ") WHERE winding IN (SELECT winding FROM (" + mq.ORACLE_SQL["quantile_windings"] + ")) GROUP BY winding",
            ),
        ]
    )
}
