"""Queries over positions on rays (view PT): fitted crossings are the clicks,
model crossings the views, crests the purchases, profile samples all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import share
from ..operators import sequence as seq
from ..operators import statistics as st
from .views import PT, interp_cte, points, with_

GOLDEN = 0.6180339887498949
NULL_COPIES = 20
OFFSETS = [round(-0.5 + 0.05 * k, 2) for k in range(20)]
R6 = 6


def _pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir)


def _kind(pt: DataFrame, kind: str, *extra: str) -> DataFrame:
    return pt.where(F.col("kind") == kind).select("ray_id", "t", *extra)


def _knots(pt: DataFrame) -> DataFrame:
    return pt.where("raw is not null").select("ray_id", "t", F.col("raw").alias("v"))


def _rounded(df: DataFrame, places: int = R6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = _pt(spark, sf_dir)
    return st.contrast(_knots(pt), _kind(pt, "click"))


def contrast_ctes(hits: str = "hits") -> list[str]:
    """SQL of ``operators.statistics.contrast`` over the relation ``hits``."""
    return [
        "knots AS (SELECT ray_id, t, raw AS v FROM pt WHERE raw IS NOT NULL)",
        "spread AS (SELECT ray_id, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS spread FROM knots GROUP BY ray_id HAVING count(*) >= 20 AND quantile_cont(v, 0.95) - quantile_cont(v, 0.05) > 0)",
        f"nb AS (SELECT *, (t + lag(t) OVER o) / 2 AS ml, (t + lead(t) OVER o) / 2 AS mr FROM {hits} WINDOW o AS (PARTITION BY ray_id{', copy' if hits == 'moved' else ''} ORDER BY t))",
        "inner_ AS (SELECT *, row_number() OVER () AS rid FROM nb WHERE ml IS NOT NULL AND mr IS NOT NULL)",
        "q0 AS (SELECT ray_id, t, rid FROM inner_)",
        "q1 AS (SELECT ray_id, ml AS t, rid FROM inner_)",
        "q2 AS (SELECT ray_id, mr AS t, rid FROM inner_)",
        interp_cte("i0", "q0", "knots"),
        interp_cte("i1", "q1", "knots"),
        interp_cte("i2", "q2", "knots"),
        "c AS (SELECT n.*, (i0.v - (i1.v + i2.v) / 2) / s.spread AS c FROM inner_ n JOIN spread s USING (ray_id) JOIN i0 ON n.rid = i0.rid JOIN i1 ON n.rid = i1.rid JOIN i2 ON n.rid = i2.rid)",
    ]


HITS = "hits AS (SELECT ray_id, t FROM pt WHERE kind = 'click')"
SUMMARY = "count(c) AS n, round(median(c), 6) AS median_c, round(avg(c), 6) AS mean_c, round(avg((c > 0)::INT), 6) AS frac_c_pos, round(avg((c > 0.1)::INT), 6) AS frac_c_gt_0_1"


def sheet_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast of every ray's interior fitted crossings."""
    return _rounded(_contrast(spark, sf_dir).groupBy("ray_id").agg(*st.summary()))


def contrast_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast by bands of t, bands with at least 20 crossings."""
    c = _contrast(spark, sf_dir).withColumn("band", st.band(F.col("t"), [0, 150, 300, 450, 600]))
    return _rounded(st.summarise(c, "band").where("n >= 20"))


_BAND = "CASE WHEN t >= 0 AND t < 150 THEN '0-150' WHEN t >= 150 AND t < 300 THEN '150-300' WHEN t >= 300 AND t < 450 THEN '300-450' WHEN t >= 450 AND t < 600 THEN '450-600' WHEN t >= 600 AND t < 99999 THEN '600-99999' END"


def overall_and_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the overall row: a crossing counts for its band and for all."""
    c = _contrast(spark, sf_dir).select("c", F.explode(F.array(st.band(F.col("t"), [0, 150, 300, 450, 600]), F.lit("all"))).alias("band"))
    return _rounded(st.summarise(c, "band"))


def hit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = _pt(spark, sf_dir)
    return _rounded(seq.gaps(_kind(pt, "click")).select("ray_id", "t", "gap"))


def _labelled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with a winding: the event's number modulo 3."""
    return _kind(_pt(spark, sf_dir), "click", (F.col("event_id") % 3).alias("winding"), "event_id")


LABELLED = "lh AS (SELECT ray_id, t, event_id % 3 AS winding, event_id FROM pt WHERE kind = 'click')"
_GAPS = "g AS (SELECT * FROM (SELECT ray_id, t, t - lag(t) OVER o AS gap, winding = lag(winding) OVER o AS same FROM lh WINDOW o AS (PARTITION BY ray_id ORDER BY t)) WHERE gap IS NOT NULL)"


def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each ray against the ray's median."""
    return _rounded(st.gap_statistics(seq.gaps(_labelled_hits(spark, sf_dir)), "ray_id"))


def same_winding_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short gaps of all rays, split by whether one winding makes them."""
    return _rounded(st.gap_statistics(seq.gaps(_labelled_hits(spark, sf_dir)).withColumn("all", F.lit(1)), "all").drop("all"))


_GAP_COLS = """count(*) AS n, round(any_value(med), 6) AS median, round(avg((gap < 0.5 * med)::INT), 6) AS frac_lt_half_median, round(avg((gap < 3)::INT), 6) AS frac_lt_small,
  round(avg((gap > 1.5 * med)::INT), 6) AS frac_gt_1_5_median, round(avg((gap < 3 AND NOT same)::INT), 6) AS frac_small_two_windings, round(avg((gap < 3 AND same)::INT), 6) AS frac_small_one_winding"""


def hit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on a coarse grid of hours, so that repeats occur, without them."""
    hits = _labelled_hits(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 12) * 12.0)
    w = Window.partitionBy("ray_id").orderBy("t", "winding", "event_id")
    kept = hits.withColumn("_rep", F.coalesce((F.col("t") - F.lag("t").over(w) < 1e-6) & (F.col("winding") == F.lag("winding").over(w)), F.lit(False))).where("not _rep")
    return _rounded(kept.groupBy("ray_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("t").alias("sum_t")))


def ray_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays wholly inside a band, with enough crossings, samples inside and
    unmasked samples."""
    pt = _pt(spark, sf_dir)
    c = pt.groupBy("ray_id").agg(
        F.count(F.when(F.col("kind") == "click", 1)).alias("crossings"),
        F.min(F.when(F.col("kind") == "click", F.col("t"))).alias("first_t"),
        F.max(F.when(F.col("kind") == "click", F.col("t"))).alias("last_t"),
        share(F.col("t") < 700).alias("in_volume"),
        share(F.coalesce(F.col("raw"), F.lit(0.0)) > 20).alias("unmasked"),
        F.count(F.lit(1)).alias("samples"),
    )
    return _rounded(c.where("crossings >= 3 and first_t >= 1 and last_t < 743 and in_volume >= 0.8 and unmasked >= 0.5 and samples >= 20"))


def winding_agreement_d1_d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fitted crossings lie between model crossings one and five
    apart: counts, shares and errors of each ray."""
    pt = _pt(spark, sf_dir)
    counted = seq.count_before(_kind(pt, "view", "event_id"), _kind(pt, "click"))
    w = Window.partitionBy("ray_id").orderBy("t", "event_id")
    c = counted.withColumn("d1", F.lead("hits_before").over(w) - F.col("hits_before")).withColumn("d5", F.lead("hits_before", 5).over(w) - F.col("hits_before"))
    d1, d5 = F.col("d1"), F.col("d5")
    return _rounded(
        c.groupBy("ray_id").agg(
            F.count(d1).alias("pairs_d1"),
            share(d1 == 1).alias("frac_exact_d1"),
            *[share(d1 == k).alias(f"count_{k}") for k in range(4)],
            share(d1 >= 4).alias("count_4_up"),
            F.avg(F.abs(d1 - 1).cast("double")).alias("mean_abs_err_d1"),
            F.count(d5).alias("pairs_d5"),
            share(d5 == 5).alias("frac_exact_d5"),
            F.percentile(d5, F.lit(0.5)).alias("median_count_d5"),
        )
    )


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = _pt(spark, sf_dir)
    near = seq.neighbours(_kind(pt, "view", "event_id"), _kind(pt, "click"))
    return near.withColumn("dist", seq.nearest_distance(F.col("left"), F.col("t"), F.col("right")))


def crossing_nearest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from each model crossing to the nearest fitted one."""
    return _rounded(_nearest(spark, sf_dir).groupBy("ray_id").agg(F.count("dist").alias("n"), F.percentile("dist", F.lit(0.5)).alias("median_dist"), F.max("dist").alias("max_dist")))


def _phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ray_id").orderBy("t", "event_id")
    near = _nearest(spark, sf_dir).withColumn("span", (F.lead("t").over(w) - F.lag("t").over(w)) / 2)
    return near.where("span is not null and dist is not null").withColumn("phase", F.least(F.greatest(F.col("dist") / F.greatest("span", F.lit(1e-6)), F.lit(0.0)), F.lit(1.0)))


def phase_to_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase of interior model crossings relative to the fit: 0 on a fitted
    crossing, near one half between two."""
    p = F.col("phase")
    phases = _phase(spark, sf_dir)
    middle = st.exact_percentiles(phases, "phase", {"median": 0.5}).agg(F.first("median").alias("median"))
    rest = phases.agg(F.count(p).alias("n"), share(p < 0.15).alias("frac_lt_0_15"), share((p >= 0.35) & (p <= 0.65)).alias("frac_mid"))
    return _rounded(rest.crossJoin(F.broadcast(middle)).select("n", "median", "frac_lt_0_15", "frac_mid"))


def phase_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.histogram(_phase(spark, sf_dir), "phase", 0.0, 1.0, 10)


_PHASE = [
    "m AS (SELECT ray_id, t, event_id FROM pt WHERE kind = 'view')",
    "nn AS (SELECT m.*, (SELECT min(abs(h.t - m.t)) FROM hits h WHERE h.ray_id = m.ray_id) AS dist FROM m)",
    "ph AS (SELECT least(greatest(dist / greatest(span, 1e-6), 0), 1) AS phase FROM (SELECT *, (lead(t) OVER o - lag(t) OVER o) / 2 AS span FROM nn WINDOW o AS (PARTITION BY ray_id ORDER BY t, event_id)) WHERE span IS NOT NULL AND dist IS NOT NULL)",
]


def random_shift_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of positive contrast against copies of the fit that are
    shifted along each ray by a fraction of its median gap."""
    pt = _pt(spark, sf_dir)
    hits = _kind(pt, "click")
    med = seq.gaps(hits).groupBy("ray_id").agg(F.percentile("gap", F.lit(0.5)).alias("g"), F.count("gap").alias("n")).where("n >= 2").select("ray_id", "g")
    k = F.col("copy") * F.lit(GOLDEN)
    moved = hits.join(med, "ray_id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(NULL_COPIES)))).select(F.concat_ws("|", "ray_id", "copy").alias("rc"), "ray_id", "copy", (F.col("t") + (k - F.floor(k) - 0.5) * F.col("g")).alias("t"))
    knots = _knots(pt)
    # A ray and a copy are one ray to the operator; the profile joins by the ray.
    w = Window.partitionBy("ray_id", "copy").orderBy("t")
    inner = moved.withColumn("ml", (F.col("t") + F.lag("t").over(w)) / 2).withColumn("mr", (F.col("t") + F.lead("t").over(w)) / 2).where("ml is not null and mr is not null")
    asked = inner.select("ray_id", "copy", F.col("t").alias("at"), F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("t").alias("t")), F.struct(F.lit(1).alias("role"), F.col("ml").alias("t")), F.struct(F.lit(2).alias("role"), F.col("mr").alias("t")))).alias("p"))
    found = seq.interpolate_at(knots, asked.select("ray_id", F.col("p.t").alias("t"), "copy", "at", F.col("p.role").alias("role")))
    role = lambda r: F.max(F.when(F.col("role") == r, F.col("v")))
    spread = knots.groupBy("ray_id").agg(F.count("v").alias("n"), (F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))).alias("s")).where("n >= 20 and s > 0").select("ray_id")
    c = found.groupBy("ray_id", "copy", "at").agg((role(0) - (role(1) + role(2)) / 2).alias("c")).join(spread, "ray_id", "left_semi")
    observed = _contrast(spark, sf_dir).agg(share(F.col("c") > 0).alias("frac"))
    return _rounded(st.null_report(c.groupBy("copy").agg(share(F.col("c") > 0).alias("frac")), observed))


def offset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of positive contrast for rigid shifts of the fit by -8 to 8."""
    pt = _pt(spark, sf_dir)
    hits = _kind(pt, "click")
    spread = _knots(pt).groupBy("ray_id").agg(F.count("v").alias("n"), (F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))).alias("s")).where("n >= 20 and s > 0").select("ray_id")
    inner = seq.midpoints(hits).withColumn("shift", F.explode(F.sequence(F.lit(-8), F.lit(8))))
    asked = inner.select("ray_id", "shift", F.col("t").alias("at"), F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("t").alias("t")), F.struct(F.lit(1).alias("role"), F.col("mid_left").alias("t")), F.struct(F.lit(2).alias("role"), F.col("mid_right").alias("t")))).alias("p"))
    found = seq.interpolate_at(_knots(pt), asked.select("ray_id", (F.col("p.t") + F.col("shift")).alias("t"), "shift", "at", F.col("p.role").alias("role")))
    role = lambda r: F.max(F.when(F.col("role") == r, F.col("v")))
    c = found.groupBy("ray_id", "shift", "at").agg((role(0) - (role(1) + role(2)) / 2).alias("c")).join(spread, "ray_id", "left_semi")
    return _rounded(c.groupBy("shift").agg(F.count("c").alias("n"), share(F.col("c") > 0).alias("frac_c_pos")))


def _snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = _pt(spark, sf_dir)
    return seq.snap(_kind(pt, "view", F.col("event_id").alias("k")), _kind(pt, "purchase"))


_SNAP = [
    "m AS (SELECT ray_id, t, event_id AS k FROM pt WHERE kind = 'view')",
    "cr AS (SELECT ray_id, t FROM pt WHERE kind = 'purchase')",
    "g AS (SELECT *, coalesce((lead(t) OVER o - lag(t) OVER o) / 2, lead(t) OVER o - t, t - lag(t) OVER o) AS gap FROM m WINDOW o AS (PARTITION BY ray_id ORDER BY t, k))",
    "lr AS (SELECT g.*, a.t AS lt, b.t AS rt FROM g ASOF LEFT JOIN cr a ON g.ray_id = a.ray_id AND g.t >= a.t ASOF LEFT JOIN cr b ON g.ray_id = b.ray_id AND g.t <= b.t)",
    "near AS (SELECT *, CASE WHEN lt IS NULL THEN rt WHEN rt IS NULL THEN lt WHEN t - lt <= rt - t THEN lt ELSE rt END AS crest FROM lr)",
    "ok AS (SELECT *, coalesce(abs(crest - t) <= 0.5 * gap, false) AS ok FROM near)",
    "sn AS (SELECT *, CASE WHEN NOT ok THEN 'no_crest' WHEN row_number() OVER (PARTITION BY ray_id, ok, crest ORDER BY abs(crest - t), t, k) > 1 THEN 'conflict' ELSE 'snapped' END AS status FROM ok)",
    "sp AS (SELECT *, CASE WHEN status = 'snapped' THEN crest ELSE t END AS t_new FROM sn)",
]


def snap_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes and moves of snapping model crossings to crests, by ray."""
    s, moved = F.col("status"), F.abs(F.col("t_new") - F.col("t"))
    return _rounded(
        _snapped(spark, sf_dir)
        .groupBy("ray_id")
        .agg(
            F.count(F.lit(1)).alias("crossings"),
            F.count(F.when(s == "snapped", 1)).alias("snapped"),
            F.count(F.when(s == "no_crest", 1)).alias("no_crest"),
            F.count(F.when(s == "conflict", 1)).alias("conflict"),
            F.coalesce(F.percentile(F.when(s == "snapped", moved), F.lit(0.5)), F.lit(-1.0)).alias("median_move"),
        )
    )


def snap_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapping with the undo of moves that bring crossings too close."""
    from ..operators.rays import snap_rays

    pt = _pt(spark, sf_dir)
    out = snap_rays(_kind(pt, "view", F.col("event_id").alias("k")), _kind(pt, "purchase"), reach=0.5, least_gap=0.5)
    return _rounded(out.select("ray_id", "k", "t", "t_new", "status"))


def consistent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two snapped crossings with one crest number less
    level; a crossing's level is its number along the ray, halved."""
    pt = _pt(spark, sf_dir)
    w = Window.partitionBy("ray_id").orderBy("t", "k")
    levelled = _snapped(spark, sf_dir).withColumn("level", F.floor(F.row_number().over(w) / 2).cast("long"))
    snapped = levelled.where("status = 'snapped'").select("ray_id", F.col("t_new").alias("t"), F.col("t").alias("t_old"), "k", "level")
    numbered = seq.count_before(snapped, _kind(pt, "purchase"))
    out = seq.runs(numbered.withColumn("diff", F.col("hits_before") - F.col("level")), "ray_id", "t_old", F.col("diff"))
    return _rounded(out.groupBy("ray_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("t_old").alias("first_t"), F.max("t_old").alias("last_t")).where("n >= 2").drop("run"))


def _anchor(crossings: DataFrame, knots: DataFrame) -> DataFrame:
    """Best of the offsets f by the mean intensity at t + f x local gap."""
    from ..operators.rays import best_offsets

    return best_offsets(crossings, knots, OFFSETS)


def phase_anchor_best_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pt = _pt(spark, sf_dir)
    return _rounded(_anchor(_kind(pt, "view", F.col("event_id").alias("k")), _knots(pt)))


def phase_anchor_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset chosen on even crossings, and the mean intensity of the odd
    ones before and after it."""
    pt = _pt(spark, sf_dir)
    w = Window.partitionBy("ray_id").orderBy("t", "k")
    numbered = _kind(pt, "view", F.col("event_id").alias("k")).withColumn("gap", seq.local_gap(F.col("t"), w)).withColumn("odd", (F.row_number().over(w) - 1) % 2).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("ray_id"))).where("total >= 6")
    from ..operators.rays import best_offsets

    knots = _knots(pt)
    best = best_offsets(numbered.where("odd = 0").select("ray_id", "t", "k", "gap"), knots, OFFSETS).select("ray_id", "f")
    odd = numbered.where("odd = 1").join(best, "ray_id")
    before = seq.interpolate_at(knots, odd.select("ray_id", "t")).groupBy("ray_id").agg(F.avg("v").alias("before"))
    after = seq.interpolate_at(knots, odd.select("ray_id", (F.col("t") + F.col("f") * F.col("gap")).alias("t"), "f")).groupBy("ray_id", "f").agg(F.avg("v").alias("after"), F.count("v").alias("n"))
    return _rounded(before.join(after, "ray_id"))


_FS = "fs AS (SELECT unnest([" + ", ".join(f"{f}::DOUBLE" for f in OFFSETS) + "]) AS f)"


def _anchor_ctes(source: str) -> list[str]:
    return [
        "knots AS (SELECT ray_id, t, raw AS v FROM pt WHERE raw IS NOT NULL)",
        _FS,
        f"aq AS (SELECT ray_id, t + f * gap AS t, f FROM {source}, fs)",
        interp_cte("ai", "aq", "knots"),
        "sc AS (SELECT ray_id, f, avg(v) AS score, count(v) AS n FROM ai GROUP BY ray_id, f)",
        "spr AS (SELECT ray_id, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS spread FROM knots GROUP BY ray_id)",
        "best AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY round(score, 9) DESC, f) AS rn, max(score) OVER (PARTITION BY ray_id) - min(score) OVER (PARTITION BY ray_id) AS span FROM sc WHERE n >= 3)",
        "bst AS (SELECT b.ray_id, b.f, b.score, b.span / s.spread AS contrast, b.n FROM best b JOIN spr s USING (ray_id) WHERE rn = 1 AND s.spread > 0)",
    ]


_MG = ["m AS (SELECT ray_id, t, event_id AS k FROM pt WHERE kind = 'view')", "mg AS (SELECT *, coalesce((lead(t) OVER o - lag(t) OVER o) / 2, lead(t) OVER o - t, t - lag(t) OVER o) AS gap, (row_number() OVER o - 1) % 2 AS odd, count(*) OVER (PARTITION BY ray_id) AS total FROM m WINDOW o AS (PARTITION BY ray_id ORDER BY t, k))"]


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays, crossings and gap percentiles of the model store."""
    pt = _pt(spark, sf_dir)
    views = _kind(pt, "view")
    counts = views.groupBy("ray_id").agg(F.count(F.lit(1)).alias("count"))
    per_ray = counts.agg(F.count(F.lit(1)).alias("rays"), F.sum("count").alias("crossings"))
    gaps, qs = seq.gaps(views), {"gap_p10": 0.1, "gap_p50": 0.5, "gap_p90": 0.9}
    # Each is one row.
    one = [
        st.exact_percentiles(counts, "count", {"crossings_per_ray": 0.5}).agg(F.first("crossings_per_ray").alias("crossings_per_ray")),
        st.exact_percentiles(gaps, "gap", qs).agg(*[F.first(q).alias(q) for q in qs]),
        gaps.agg(share(F.col("gap") < 8).alias("frac_lt_8")),
    ]
    for row in one:
        per_ray = per_ray.crossJoin(F.broadcast(row))
    return _rounded(per_ray)


def middle_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle 16 of the sorted rays."""
    ids = _pt(spark, sf_dir).select("ray_id").distinct()
    n = ids.count()
    start = max(0, n // 2 - 8)
    ranked = ids.withColumn("rank", F.row_number().over(Window.orderBy("ray_id")) - 1)
    return ranked.where((F.col("rank") >= start) & (F.col("rank") < start + 16)).select("ray_id", F.col("rank").cast("long").alias("rank"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample without replacement that any engine repeats: the 100 events
    with the least MD5."""
    return _pt(spark, sf_dir).select("event_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("h")).orderBy("h", "event_id").limit(100)


def phase_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of 1 - cos(2 pi w) of the valid rows and the mean fractional
    residual of w, w being hours by spacing 16."""
    pt = _pt(spark, sf_dir)
    w = F.col("t") / 16
    return _rounded(pt.groupBy("kind").agg(F.avg(F.when(F.col("raw").isNotNull(), 1 - F.cos(2 * F.pi() * w))).alias("loss"), F.avg(F.abs(w - F.rint(w))).alias("residual"), F.count("raw").alias("n")))


def block_audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit as given and moved by 6: contrast and gaps of both."""
    pt = _pt(spark, sf_dir)
    hits = _kind(pt, "click")
    out = None
    for state, frame in (("raw", hits), ("shifted", hits.withColumn("t", F.col("t") + 6.0))):
        c = st.summarise(st.contrast(_knots(pt), frame))
        g = st.gap_statistics(seq.gaps(frame)).select(F.col("n").alias("gaps"), "median", "frac_lt_half_median", "frac_gt_1_5_median")
        row = c.crossJoin(F.broadcast(g)).withColumn("state", F.lit(state))
        out = row if out is None else out.unionByName(row)
    return _rounded(out)


def hit_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous runs of days with a crossing, by ray."""
    days = _pt(spark, sf_dir).select("ray_id", F.floor(F.col("t") / 24).cast("long").alias("day")).distinct()
    return seq.integer_runs(days, "ray_id", "day")


QUERIES = {
    f.__name__: f
    for f in (
        sheet_contrast, contrast_by_band, overall_and_by_band, hit_gaps, gap_stats, same_winding_gaps, hit_dedupe, ray_acceptance, winding_agreement_d1_d5,
        crossing_nearest_fit, phase_to_fit, phase_hist, random_shift_null, offset_scan, snap_nearest, snap_full, consistent_runs, phase_anchor_best_offset,
        phase_anchor_cv, store_stats, middle_block, hash_sample, phase_loss, block_audit_report, hit_islands,
    )
}

_C = [PT, HITS, *contrast_ctes()]
_MOVED = [
    PT,
    HITS,
    "g0 AS (SELECT ray_id, t - lag(t) OVER (PARTITION BY ray_id ORDER BY t) AS gap FROM hits)",
    "med AS (SELECT ray_id, median(gap) AS g FROM g0 WHERE gap IS NOT NULL GROUP BY ray_id HAVING count(*) >= 2)",
    f"moved AS (SELECT ray_id, copy, t + (copy * {GOLDEN}::DOUBLE - floor(copy * {GOLDEN}::DOUBLE) - 0.5) * g AS t FROM hits JOIN med USING (ray_id), (SELECT unnest(range(1, {NULL_COPIES + 1})) AS copy))",
]

ORACLE_SQL = {
    "sheet_contrast": with_(*_C) + f"SELECT ray_id, {SUMMARY} FROM c GROUP BY ray_id",
    "contrast_by_band": with_(*_C) + f"SELECT {_BAND} AS band, {SUMMARY} FROM c GROUP BY ALL HAVING count(c) >= 20",
    "overall_and_by_band": with_(*_C) + f"SELECT CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, {SUMMARY} FROM (SELECT {_BAND} AS band, c FROM c) GROUP BY ROLLUP (band)",
    "hit_gaps": with_(PT, HITS) + "SELECT ray_id, round(t, 6) AS t, round(gap, 6) AS gap FROM (SELECT ray_id, t, t - lag(t) OVER (PARTITION BY ray_id ORDER BY t) AS gap FROM hits) WHERE gap IS NOT NULL",
    "gap_stats": with_(PT, LABELLED, _GAPS, "gm AS (SELECT *, median(gap) OVER (PARTITION BY ray_id) AS med FROM g)") + f"SELECT ray_id, {_GAP_COLS} FROM gm GROUP BY ray_id",
    "same_winding_gaps": with_(PT, LABELLED, _GAPS, "gm AS (SELECT *, (SELECT median(gap) FROM g) AS med FROM g)") + f"SELECT {_GAP_COLS} FROM gm",
    "hit_dedupe": with_(PT, LABELLED, "f AS (SELECT ray_id, floor(t / 12) * 12.0::DOUBLE AS t, winding, event_id FROM lh)")
    + "SELECT ray_id, count(*) AS kept, round(sum(t), 6) AS sum_t FROM (SELECT *, coalesce(t - lag(t) OVER o < 1e-6 AND winding = lag(winding) OVER o, false) AS rep FROM f WINDOW o AS (PARTITION BY ray_id ORDER BY t, winding, event_id)) WHERE NOT rep GROUP BY ray_id",
    "ray_acceptance": with_(PT)
    + "SELECT * FROM (SELECT ray_id, count(*) FILTER (kind = 'click') AS crossings, round(min(t) FILTER (kind = 'click'), 6) AS first_t, round(max(t) FILTER (kind = 'click'), 6) AS last_t, round(avg((t < 700)::INT), 6) AS in_volume, round(avg((coalesce(raw, 0) > 20)::INT), 6) AS unmasked, count(*) AS samples FROM pt GROUP BY ray_id) WHERE crossings >= 3 AND first_t >= 1 AND last_t < 743 AND in_volume >= 0.8 AND unmasked >= 0.5 AND samples >= 20",
    "winding_agreement_d1_d5": with_(PT, HITS, "m AS (SELECT ray_id, t, event_id FROM pt WHERE kind = 'view')", "n AS (SELECT m.*, (SELECT count(*) FROM hits h WHERE h.ray_id = m.ray_id AND h.t < m.t) AS b FROM m)", "d AS (SELECT ray_id, lead(b) OVER o - b AS d1, lead(b, 5) OVER o - b AS d5 FROM n WINDOW o AS (PARTITION BY ray_id ORDER BY t, event_id))")
    + "SELECT ray_id, count(d1) AS pairs_d1, round(avg((d1 = 1)::INT), 6) AS frac_exact_d1, "
    + ", ".join(f"round(avg((d1 = {k})::INT), 6) AS count_{k}" for k in range(4))
    + ", round(avg((d1 >= 4)::INT), 6) AS count_4_up, round(avg(abs(d1 - 1)), 6) AS mean_abs_err_d1, count(d5) AS pairs_d5, round(avg((d5 = 5)::INT), 6) AS frac_exact_d5, round(median(d5), 6) AS median_count_d5 FROM d GROUP BY ray_id",
    "crossing_nearest_fit": with_(PT, HITS, *_PHASE[:2]) + "SELECT ray_id, count(dist) AS n, round(median(dist), 6) AS median_dist, round(max(dist), 6) AS max_dist FROM nn GROUP BY ray_id",
    "phase_to_fit": with_(PT, HITS, *_PHASE) + "SELECT count(*) AS n, round(median(phase), 6) AS median, round(avg((phase < 0.15)::INT), 6) AS frac_lt_0_15, round(avg((phase BETWEEN 0.35 AND 0.65)::INT), 6) AS frac_mid FROM ph",
    "phase_hist": with_(PT, HITS, *_PHASE) + "SELECT least(floor(phase / 0.1::DOUBLE), 9)::INT AS bin, count(*) AS n FROM ph GROUP BY 1",
    "random_shift_null": with_(*_MOVED, *contrast_ctes("moved"), "cf AS (SELECT copy, avg((c > 0)::INT) AS frac FROM c GROUP BY copy)", *[x.replace("knots AS", "knots2 AS").replace("spread AS (", "spread2 AS (").replace("nb AS", "nb2 AS").replace("inner_ AS", "inner2 AS").replace("FROM nb ", "FROM nb2 ").replace("FROM inner_", "FROM inner2").replace("JOIN spread ", "JOIN spread2 ").replace("q0", "p0").replace("q1", "p1").replace("q2", "p2").replace("i0", "j0").replace("i1", "j1").replace("i2", "j2").replace("c AS (SELECT n.", "c2 AS (SELECT n.") for x in contrast_ctes()], "ob AS (SELECT avg((c > 0)::INT) AS observed FROM c2)")
    + "SELECT count(*) AS copies, round(avg(frac), 6) AS null_mean, round(quantile_cont(frac, 0.025), 6) AS null_p2_5, round(quantile_cont(frac, 0.975), 6) AS null_p97_5, round(avg((frac >= observed)::INT), 6) AS frac_at_or_above, round(any_value(observed), 6) AS observed FROM cf, ob",
    "offset_scan": with_(PT, HITS, "knots AS (SELECT ray_id, t, raw AS v FROM pt WHERE raw IS NOT NULL)", "good AS (SELECT ray_id FROM knots GROUP BY ray_id HAVING count(*) >= 20 AND quantile_cont(v, 0.95) - quantile_cont(v, 0.05) > 0)", "nb AS (SELECT *, (t + lag(t) OVER o) / 2 AS ml, (t + lead(t) OVER o) / 2 AS mr FROM hits WINDOW o AS (PARTITION BY ray_id ORDER BY t))", "n0 AS (SELECT *, row_number() OVER () AS rid FROM (SELECT nb.*, shift FROM nb JOIN good USING (ray_id), (SELECT unnest(range(-8, 9)) AS shift) WHERE ml IS NOT NULL AND mr IS NOT NULL))", "q0 AS (SELECT ray_id, t + shift AS t, rid FROM n0)", "q1 AS (SELECT ray_id, ml + shift AS t, rid FROM n0)", "q2 AS (SELECT ray_id, mr + shift AS t, rid FROM n0)", interp_cte("i0", "q0", "knots"), interp_cte("i1", "q1", "knots"), interp_cte("i2", "q2", "knots"))
    + "SELECT shift, count(*) AS n, round(avg((i0.v - (i1.v + i2.v) / 2 > 0)::INT), 6) AS frac_c_pos FROM n0 JOIN i0 USING (rid) JOIN i1 USING (rid) JOIN i2 USING (rid) GROUP BY shift",
    "snap_nearest": with_(PT, *_SNAP)
    + "SELECT ray_id, count(*) AS crossings, count(*) FILTER (status = 'snapped') AS snapped, count(*) FILTER (status = 'no_crest') AS no_crest, count(*) FILTER (status = 'conflict') AS conflict, round(coalesce(median(abs(t_new - t)) FILTER (status = 'snapped'), -1), 6) AS median_move FROM sp GROUP BY ray_id",
    "consistent_runs": with_(PT, *_SNAP, "lv AS (SELECT *, floor(row_number() OVER (PARTITION BY ray_id ORDER BY t, k) / 2)::BIGINT AS level FROM sp)", "nu AS (SELECT lv.*, (SELECT count(*) FROM cr WHERE cr.ray_id = lv.ray_id AND cr.t < lv.t_new) - level AS diff FROM lv WHERE status = 'snapped')", "ch AS (SELECT *, CASE WHEN lag(diff) OVER (PARTITION BY ray_id ORDER BY t) = diff THEN 0 ELSE 1 END AS changed FROM nu)", "ru AS (SELECT *, sum(changed) OVER (PARTITION BY ray_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM ch)")
    + "SELECT ray_id, count(*) AS n, round(min(t), 6) AS first_t, round(max(t), 6) AS last_t FROM ru GROUP BY ray_id, run HAVING count(*) >= 2",
    "phase_anchor_best_offset": with_(PT, *_MG, *_anchor_ctes("mg")) + "SELECT ray_id, f, round(score, 6) AS score, round(contrast, 6) AS contrast, n FROM bst",
    "phase_anchor_cv": with_(PT, *_MG, "ev AS (SELECT * FROM mg WHERE odd = 0 AND total >= 6)", *_anchor_ctes("ev"), "od AS (SELECT mg.*, bst.f FROM mg JOIN bst USING (ray_id) WHERE odd = 1 AND total >= 6)", "ob AS (SELECT ray_id, t FROM od)", "oa AS (SELECT ray_id, t + f * gap AS t, f FROM od)", interp_cte("ib", "ob", "knots"), interp_cte("ia", "oa", "knots"))
    + "SELECT ray_id, round(any_value(b.before), 6) AS before, any_value(f) AS f, round(avg(v), 6) AS after, count(v) AS n FROM ia JOIN (SELECT ray_id, avg(v) AS before FROM ib GROUP BY ray_id) b USING (ray_id) GROUP BY ray_id",
    "store_stats": with_(PT, "m AS (SELECT ray_id, t FROM pt WHERE kind = 'view')", "g AS (SELECT t - lag(t) OVER (PARTITION BY ray_id ORDER BY t) AS gap FROM m)", "p AS (SELECT count(*) AS n FROM m GROUP BY ray_id)")
    + "SELECT (SELECT count(*) FROM p) AS rays, (SELECT sum(n)::BIGINT FROM p) AS crossings, (SELECT median(n) FROM p) AS crossings_per_ray, round(quantile_cont(gap, 0.1), 6) AS gap_p10, round(quantile_cont(gap, 0.5), 6) AS gap_p50, round(quantile_cont(gap, 0.9), 6) AS gap_p90, round(avg((gap < 8)::INT), 6) AS frac_lt_8 FROM g WHERE gap IS NOT NULL",
    "middle_block": with_(PT, "i AS (SELECT ray_id, row_number() OVER (ORDER BY ray_id) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT ray_id FROM pt))") + "SELECT ray_id, rank FROM i WHERE rank >= greatest(0, n // 2 - 8) AND rank < greatest(0, n // 2 - 8) + 16",
    "hash_sample": "SELECT event_id, md5(event_id::VARCHAR) AS h FROM events ORDER BY h, event_id LIMIT 100",
    "phase_loss": with_(PT) + "SELECT kind, round(avg(1 - cos(2 * pi() * t / 16)) FILTER (raw IS NOT NULL), 6) AS loss, round(avg(abs(t / 16 - round_even(t / 16, 0))), 6) AS residual, count(raw) AS n FROM pt GROUP BY kind",
    "block_audit_report": " UNION ALL ".join(
        "SELECT * FROM ("
        + with_(PT, f"hits AS (SELECT ray_id, t + {d} AS t FROM pt WHERE kind = 'click')", *contrast_ctes(), "g AS (SELECT t - lag(t) OVER (PARTITION BY ray_id ORDER BY t) AS gap FROM hits)", "gm AS (SELECT gap, (SELECT median(gap) FROM g) AS med FROM g WHERE gap IS NOT NULL)", "gs AS (SELECT count(*) AS gaps, round(any_value(med), 6) AS median, round(avg((gap < 0.5 * med)::INT), 6) AS frac_lt_half_median, round(avg((gap > 1.5 * med)::INT), 6) AS frac_gt_1_5_median FROM gm)", f"cs AS (SELECT {SUMMARY} FROM c)")
        + f"SELECT cs.*, gs.*, '{s}' AS state FROM cs, gs)"
        for s, d in (("raw", "0.0::DOUBLE"), ("shifted", "6.0::DOUBLE"))
    ),
    "hit_islands": with_(PT, "d AS (SELECT DISTINCT ray_id, floor(t / 24)::BIGINT AS day FROM pt)") + "SELECT ray_id, min(day) AS first, max(day) AS last, count(*) AS n FROM (SELECT ray_id, day, day - row_number() OVER (PARTITION BY ray_id ORDER BY day) AS island FROM d) GROUP BY ray_id, island",
}
