"""Queries over profiles (view PROF): smoothing, peaks, periods, phases."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, gaussian_kernel, parabola, share
from ..operators import sequence as seq
from ..operators import statistics as st
from .ray_queries import _rounded, contrast_ctes
from .views import PROF, profiles, table, with_

SIGMA = 2.0
PERIOD = 14.0
PERIODS = [8.0 + 0.25 * k for k in range(89)]
LO, HI = 2.0, 12.0


def profile_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed profiles, ends mirrored: total and the first and last value."""
    s = seq.smooth(profiles(spark, sf_dir), SIGMA)
    return _rounded(s.groupBy("prof_id").agg(F.sum("smooth").alias("total"), F.sum(F.when(F.col("i") == 0, F.col("smooth"))).alias("first"), F.sum(F.when(F.col("i") == 63, F.col("smooth"))).alias("last"), F.max("smooth").alias("top")))


_K = gaussian_kernel(SIGMA)
_R = len(_K) // 2
_KERNEL = "ker AS (SELECT unnest(range(" + f"{-_R}, {_R + 1}" + ")) AS d, unnest([" + ", ".join(f"{w!r}::DOUBLE" for w in _K) + "]) AS w)"
_SMOOTH = "sm AS (SELECT p.prof_id, any_value(p.winding) AS winding, p.i, any_value(p.t) AS t, sum(k.w * q.raw) AS v FROM prof p, ker k JOIN prof q ON q.prof_id = p.prof_id AND q.i = CASE WHEN p.i + k.d < 0 THEN -1 - (p.i + k.d) WHEN p.i + k.d > 63 THEN 127 - (p.i + k.d) ELSE p.i + k.d END GROUP BY p.prof_id, p.i)"


def _smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.smooth(profiles(spark, sf_dir), SIGMA, name="v").withColumn("t", F.col("i") * F.lit(0.5))


def _peaks(spark: SparkSession, sf_dir: str, part: float = 0.25) -> DataFrame:
    w = Window.partitionBy("prof_id")
    s = _smoothed(spark, sf_dir).withColumn("lo", F.min("v").over(w)).withColumn("hi", F.max("v").over(w))
    return seq.local_maxima(s, F.col("lo") + part * (F.col("hi") - F.col("lo")))


def profile_peaks_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima of the smoothed profiles with sub-sample places."""
    p = _peaks(spark, sf_dir)
    return _rounded(p.select("prof_id", "i", (F.col("t") + 0.5 * parabola(F.col("left_v"), F.col("v"), F.col("right_v"))).alias("at"), "v"))


_PEAKS = "pk AS (SELECT * FROM (SELECT *, lag(v) OVER o AS l, lead(v) OVER o AS r, min(v) OVER (PARTITION BY prof_id) AS lo, max(v) OVER (PARTITION BY prof_id) AS hi FROM sm WINDOW o AS (PARTITION BY prof_id ORDER BY i)) WHERE v > l AND v >= r AND v > lo + 0.25 * (hi - lo))"
_AT = "t + 0.5 * CASE WHEN abs(l - 2 * v + r) > 1e-6 THEN least(greatest(0.5 * (l - r) / (l - 2 * v + r), -0.5), 0.5) ELSE 0 END"


def profile_peaks_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crests by prominence and distance, one function per profile."""
    from ..operators.rays import crests

    packed = _smoothed(spark, sf_dir).groupBy("prof_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select("prof_id", F.col("p.v").alias("v"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for rows in batches:
            found = [crests(v, np.ones(len(v), bool), 0.5 * np.arange(len(v))) for v in map(np.asarray, rows["v"])]
            yield pd.DataFrame({"prof_id": np.repeat(rows["prof_id"].to_numpy(), [len(f) for f in found]), "at": np.concatenate([*found, np.zeros(0)])})

    return _rounded(packed.mapInPandas(run, "prof_id long, at double"))


def profile_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each profile without its line."""
    d = seq.detrend(profiles(spark, sf_dir), value="raw")
    return _rounded(d.groupBy("prof_id").agg(F.sqrt(F.avg(F.col("detrended") * F.col("detrended"))).alias("rms"), F.max("detrended").alias("top")))


_DET = "dt AS (SELECT p.*, raw - avg(raw) OVER w - regr_slope(raw, t) OVER w * (t - avg(t) OVER w) AS d FROM prof p WINDOW w AS (PARTITION BY prof_id))"


def profile_phasor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset of the nearest crest by the phase of the profile at a fixed
    period, and the amplitude."""
    d = seq.detrend(profiles(spark, sf_dir), value="raw")
    angle = 2 * F.pi() * F.col("t") / PERIOD
    f = d.groupBy("prof_id").agg(F.sum(F.col("detrended") * F.cos(angle)).alias("re"), F.sum(-F.col("detrended") * F.sin(angle)).alias("im"))
    return _rounded(f.select("prof_id", (-F.atan2("im", "re") * PERIOD / (2 * F.pi())).alias("offset"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amplitude")))


def peak_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median distance of neighbouring crests by winding, where at least ten
    distances lie within the allowed range."""
    w = Window.partitionBy("prof_id").orderBy("i")
    g = _peaks(spark, sf_dir).join(profiles(spark, sf_dir).select("prof_id", "winding").distinct(), "prof_id").withColumn("gap", F.col("t") - F.lag("t").over(w)).where(F.col("gap").between(LO, HI))
    return _rounded(g.groupBy("winding").agg(F.count(F.lit(1)).alias("n"), F.percentile("gap", F.lit(0.5)).alias("period")).where("n >= 10"))


def autocorr_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag of the highest peak of the mean normalised autocorrelation by
    winding. A profile joins itself by lag inside one array expression."""
    d = seq.detrend(profiles(spark, sf_dir), value="raw")
    packed = d.groupBy("winding", "prof_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("detrended").alias("v")))).alias("p"), F.sqrt(F.sum(F.col("detrended") * F.col("detrended"))).alias("len")).select("winding", F.transform("p", lambda x: x["v"] / F.greatest(F.col("len"), F.lit(1e-9))).alias("v"))
    n = 64

    def at(v, k):
        return F.aggregate(F.zip_with(F.slice(v, 1, F.lit(n) - k), F.slice(v, k + 1, F.lit(n) - k), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) * n / (n - k)

    lags = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: F.struct(k.alias("k"), at(F.col("v"), k).alias("ac")))
    ac = packed.select("winding", F.explode(lags).alias("l")).groupBy("winding", F.col("l.k").alias("k")).agg(F.round(F.avg("l.ac"), 9).alias("ac"))
    w = Window.partitionBy("winding").orderBy("k")
    peaks = ac.withColumn("a", F.lag("ac").over(w)).withColumn("b", F.lead("ac").over(w)).where((F.col("k") / 2.0).between(LO, HI) & (F.col("ac") >= F.col("a")) & (F.col("ac") >= F.col("b")))
    best = F.row_number().over(Window.partitionBy("winding").orderBy(F.desc("ac"), "k"))
    out = peaks.withColumn("_r", best).where("_r = 1")
    return _rounded(out.select("winding", (0.5 * (F.col("k") + parabola(F.col("a"), F.col("ac"), F.col("b")))).alias("period"), "ac"), 5)


def vertex_crest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each profile the crest nearest to its middle, the spacing of its
    crests and the crest's height above the mean."""
    middle = 15.75
    w = Window.partitionBy("prof_id").orderBy("i")
    p = _peaks(spark, sf_dir).withColumn("at", F.col("t") + 0.5 * parabola(F.col("left_v"), F.col("v"), F.col("right_v")) - middle).withColumn("gap", F.col("at") - F.lag("at").over(w))
    near = F.row_number().over(Window.partitionBy("prof_id").orderBy(F.round(F.abs("at"), 9), "i"))
    s = p.withColumn("_r", near).groupBy("prof_id").agg(F.max(F.when(F.col("_r") == 1, F.col("at"))).alias("delta"), F.percentile("gap", F.lit(0.5)).alias("spacing"), F.max(F.when(F.col("_r") == 1, F.col("v"))).alias("strength"))
    return _rounded(s.select("prof_id", "delta", F.coalesce("spacing", F.lit(-1.0)).alias("spacing"), "strength"))


def period_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period in 8..30 by quarters whose cosine and sine fit a tile's mean
    profile best, by 2 x 2 normal equations, and the crest's place."""
    tiles = profiles(spark, sf_dir).groupBy("winding", "i", "t").agg(F.avg("raw").alias("v"))
    centred = tiles.withColumn("x", F.col("v") - F.avg("v").over(Window.partitionBy("winding")))
    p = centred.withColumn("P", F.explode(F.array(*[F.lit(x) for x in PERIODS]))).withColumn("a", 2 * F.pi() * F.col("t") / F.col("P"))
    c, s, x = F.cos("a"), F.sin("a"), F.col("x")
    sums = p.groupBy("winding", "P").agg(F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(c * x).alias("cx"), F.sum(s * x).alias("sx"), F.sum(x * x).alias("xx"))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    fit = sums.withColumn("b", (F.col("cx") * F.col("ss") - F.col("sx") * F.col("cs")) / det).withColumn("c", (F.col("sx") * F.col("cc") - F.col("cx") * F.col("cs")) / det)
    fit = fit.withColumn("rest", F.round(F.col("xx") - F.col("b") * F.col("cx") - F.col("c") * F.col("sx"), 6))
    best = F.row_number().over(Window.partitionBy("winding").orderBy("rest", "P"))
    out = fit.withColumn("_r", best).where("_r = 1")
    return _rounded(out.select("winding", F.col("P").alias("period"), (F.col("P") * F.atan2("c", "b") / (2 * F.pi())).alias("place")), 4)


def plane_circular_R(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of the crest phase by winding."""
    d = vertex_crest_offset(spark, sf_dir).where("spacing > 0").join(profiles(spark, sf_dir).select("prof_id", "winding").distinct(), "prof_id")
    return _rounded(d.groupBy("winding").agg(st.circular_concentration(F.col("delta") / F.col("spacing")).alias("R"), F.count(F.lit(1)).alias("n"), share(F.abs("delta") < 0.25 * F.col("spacing")).alias("on_sheet")), 5)


def layer_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of layers i and i + 1 over the profiles of a winding."""
    p = profiles(spark, sf_dir)
    q = p.select("prof_id", (F.col("i") - 1).alias("i"), F.col("raw").alias("next"))
    return _rounded(p.join(q, ["prof_id", "i"]).groupBy("winding", "i").agg(F.corr("raw", "next").alias("corr")))


def best_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift 0..8 at which layer 20 correlates best, by winding."""
    p = profiles(spark, sf_dir).where("i >= 21 and i <= 29").select("prof_id", "winding", (F.col("i") - 21).alias("shift"), "raw")
    base = profiles(spark, sf_dir).where("i = 20").select("prof_id", F.col("raw").alias("base"))
    c = p.join(base, "prof_id").groupBy("winding", "shift").agg(F.round(F.corr("raw", "base"), 9).alias("corr"))
    best = F.row_number().over(Window.partitionBy("winding").orderBy(F.desc("corr"), "shift"))
    return _rounded(c.withColumn("_r", best).where("_r = 1").select("winding", "shift", "corr"))


def layer_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(max - min) / (max + min) of each winding's mean profile."""
    m = profiles(spark, sf_dir).groupBy("winding", "i").agg(F.avg("raw").alias("m"))
    lo, hi = F.min("m"), F.max("m")
    return _rounded(m.groupBy("winding").agg(((hi - lo) / (hi + lo + 1e-6)).alias("contrast")))


def stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values stretched between their 1st and 99th percentile to 0..255."""
    p = profiles(spark, sf_dir)
    cut = st.exact_percentiles(p, "raw", {"lo": 0.01, "hi": 0.99}, "winding").drop("n")
    v = clip((F.col("raw") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)), 0, 1)
    return _rounded(p.join(cut, "winding").groupBy("winding").agg(F.avg(v * 255).alias("mean_byte"), share(v >= 1).alias("white"), share(v <= 0).alias("black")))


def auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length ranks toxic documents, by language."""
    lab = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("n_chars").alias("score"), (F.col("toxic") == 1).alias("label"))
    return _rounded(st.auc(lab, "score", "label", "lang"))


def auc_by_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the mean of 28 layers of a 64-layer stack tells marked places
    from others, for shifts of -8 to 8; places without a mark are left out."""
    stacks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda v: F.floor(128 + 200 * v.cast("double"))).alias("stack"))
    marks = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("label"))
    # Whole numbers, so that the order of summation never decides a tie.
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    return _rounded(st.auc_by_shift(stacks, marks, "doc_id", 28, list(range(-8, 9, 2)), 18, total))


def anchor_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast of crossings six apart, read from a profile's centre, its
    brightest or its darkest sample within 8."""
    p = profiles(spark, sf_dir).select(F.col("prof_id").alias("ray_id"), "t", F.col("raw").alias("v"))
    steps = F.explode(F.sequence(F.lit(-5), F.lit(5)))
    read = lambda a: a.withColumn("s", steps).select("ray_id", "anchor_t", (F.col("anchor_t") + 6.0 * F.col("s")).alias("t")).where("t between 0 and 31.5")
    return _rounded(st.anchor_contrast(p, read, 15.5, 8.0))


QUERIES = {
    f.__name__: f
    for f in (
        profile_smooth, profile_peaks_local, profile_peaks_prominence, profile_detrend, profile_phasor, peak_period, autocorr_period, vertex_crest_offset,
        period_fit, plane_circular_R, layer_corr, best_layer, layer_contrast, stretch, auc_by_group, auc_by_shift, anchor_contrast,
    )
}

_VCO = [
    PROF, _KERNEL, _SMOOTH, _PEAKS,
    f"a1 AS (SELECT prof_id, i, v, {_AT} - 15.75 AS pos FROM pk)",
    "a2 AS (SELECT *, pos - lag(pos) OVER (PARTITION BY prof_id ORDER BY i) AS gap, row_number() OVER (PARTITION BY prof_id ORDER BY round(abs(pos), 9), i) AS rn FROM a1)",
    "vc AS (SELECT prof_id, round(max(pos) FILTER (rn = 1), 6) AS delta, round(coalesce(median(gap), -1), 6) AS spacing, round(max(v) FILTER (rn = 1), 6) AS strength FROM a2 GROUP BY prof_id)",
]
_TAU = repr(2 * math.pi)

ORACLE_SQL = {
    "profile_smooth": with_(PROF, _KERNEL, _SMOOTH) + 'SELECT prof_id, round(sum(v), 6) AS total, round(sum(v) FILTER (i = 0), 6) AS "first", round(sum(v) FILTER (i = 63), 6) AS "last", round(max(v), 6) AS top FROM sm GROUP BY prof_id',
    "profile_peaks_local": with_(PROF, _KERNEL, _SMOOTH, _PEAKS) + f"SELECT prof_id, i, round({_AT}, 6) AS at, round(v, 6) AS v FROM pk",
    "profile_detrend": with_(PROF, _DET) + "SELECT prof_id, round(sqrt(avg(d * d)), 6) AS rms, round(max(d), 6) AS top FROM dt GROUP BY prof_id",
    "profile_phasor": with_(PROF, _DET, f"f AS (SELECT prof_id, sum(d * cos({_TAU} * t / {PERIOD})) AS re, sum(-d * sin({_TAU} * t / {PERIOD})) AS im FROM dt GROUP BY prof_id)") + f'SELECT prof_id, round(-atan2(im, re) * {PERIOD} / {_TAU}, 6) AS "offset", round(sqrt(re * re + im * im), 6) AS amplitude FROM f',
    "peak_period": with_(PROF, _KERNEL, _SMOOTH, _PEAKS, "g AS (SELECT winding, t - lag(t) OVER (PARTITION BY prof_id ORDER BY i) AS gap FROM pk)") + f"SELECT winding, count(*) AS n, round(median(gap), 6) AS period FROM g WHERE gap BETWEEN {LO} AND {HI} GROUP BY winding HAVING count(*) >= 10",
    "autocorr_period": with_(PROF, _DET, "nm AS (SELECT *, d / greatest(sqrt(sum(d * d) OVER (PARTITION BY prof_id)), 1e-9) AS v FROM dt)", "lg AS (SELECT unnest(range(41)) AS k)", "one AS (SELECT a.winding, a.prof_id, k, sum(a.v * b.v) * 64 / (64 - k) AS ac FROM nm a, lg JOIN nm b ON b.prof_id = a.prof_id AND b.i = a.i + k GROUP BY a.winding, a.prof_id, k)", "ac AS (SELECT winding, k, round(avg(ac), 9) AS ac FROM one GROUP BY winding, k)", "nb AS (SELECT *, lag(ac) OVER o AS a, lead(ac) OVER o AS b FROM ac WINDOW o AS (PARTITION BY winding ORDER BY k))", f"bs AS (SELECT *, row_number() OVER (PARTITION BY winding ORDER BY ac DESC, k) AS rn FROM nb WHERE k / 2.0 BETWEEN {LO} AND {HI} AND ac >= a AND ac >= b)")
    + "SELECT winding, round(0.5 * (k + CASE WHEN abs(a - 2 * ac + b) > 1e-6 THEN least(greatest(0.5 * (a - b) / (a - 2 * ac + b), -0.5), 0.5) ELSE 0 END), 5) AS period, round(ac, 5) AS ac FROM bs WHERE rn = 1",
    "vertex_crest_offset": with_(*_VCO) + "SELECT * FROM vc",
    "period_fit": with_(PROF, "tl AS (SELECT winding, i, t, avg(raw) AS v FROM prof GROUP BY ALL)", "ce AS (SELECT *, v - avg(v) OVER (PARTITION BY winding) AS x FROM tl)", "ps AS (SELECT 8.0::DOUBLE + 0.25 * unnest(range(89)) AS P)", f"an AS (SELECT winding, P, x, cos({_TAU} * t / P) AS c, sin({_TAU} * t / P) AS s FROM ce, ps)", "su AS (SELECT winding, P, sum(c*c) AS cc, sum(s*s) AS ss, sum(c*s) AS cs, sum(c*x) AS cx, sum(s*x) AS sx, sum(x*x) AS xx FROM an GROUP BY winding, P)", "ft AS (SELECT *, (cx*ss - sx*cs) / (cc*ss - cs*cs) AS b, (sx*cc - cx*cs) / (cc*ss - cs*cs) AS c FROM su)", "bs AS (SELECT *, row_number() OVER (PARTITION BY winding ORDER BY round(xx - b*cx - c*sx, 6), P) AS rn FROM ft)")
    + f"SELECT winding, P AS period, round(P * atan2(c, b) / {_TAU}, 4) AS place FROM bs WHERE rn = 1",
    "plane_circular_R": with_(*_VCO, "j AS (SELECT vc.*, label AS winding FROM vc JOIN embeddings e ON vc.prof_id = e.vec_id WHERE spacing > 0)") + f"SELECT winding, round(sqrt(avg(cos({_TAU} * (delta / spacing))) ** 2 + avg(sin({_TAU} * (delta / spacing))) ** 2), 5) AS R, count(*) AS n, round(avg((abs(delta) < 0.25 * spacing)::INT), 5) AS on_sheet FROM j GROUP BY winding",
    "layer_corr": with_(PROF) + "SELECT p.winding, p.i, round(corr(p.raw, q.raw), 6) AS corr FROM prof p JOIN prof q ON p.prof_id = q.prof_id AND q.i = p.i + 1 GROUP BY p.winding, p.i",
    "best_layer": with_(PROF, "c AS (SELECT p.winding, p.i - 21 AS shift, round(corr(p.raw, b.raw), 9) AS corr FROM prof p JOIN prof b ON p.prof_id = b.prof_id AND b.i = 20 WHERE p.i BETWEEN 21 AND 29 GROUP BY ALL)") + "SELECT winding, shift, round(corr, 6) AS corr FROM (SELECT *, row_number() OVER (PARTITION BY winding ORDER BY corr DESC, shift) AS rn FROM c) WHERE rn = 1",
    "layer_contrast": with_(PROF, "m AS (SELECT winding, i, avg(raw) AS m FROM prof GROUP BY ALL)") + "SELECT winding, round((max(m) - min(m)) / (max(m) + min(m) + 1e-6), 6) AS contrast FROM m GROUP BY winding",
    "stretch": with_(PROF, "s AS (SELECT winding, least(greatest((raw - quantile_cont(raw, 0.01) OVER w) / greatest(quantile_cont(raw, 0.99) OVER w - quantile_cont(raw, 0.01) OVER w, 1e-6), 0), 1) AS v FROM prof WINDOW w AS (PARTITION BY winding))") + "SELECT winding, round(avg(v * 255), 6) AS mean_byte, round(avg((v >= 1)::INT), 6) AS white, round(avg((v <= 0)::INT), 6) AS black FROM s GROUP BY winding",
    "anchor_contrast": with_(
        PROF,
        "an AS (SELECT prof_id, unnest([0, 1, 2]) AS k, unnest([15.5::DOUBLE, arg_max(t, [raw, -t]), arg_min(t, [raw, t])]) AS a FROM prof WHERE t BETWEEN 7.5 AND 23.5 GROUP BY prof_id)",
        "pt AS (SELECT prof_id * 3 + k AS ray_id, t, raw FROM prof JOIN an USING (prof_id))",
        "hits AS (SELECT prof_id * 3 + k AS ray_id, a + 6.0 * s AS t, a, k FROM an, (SELECT unnest(range(-5, 6)) AS s) WHERE a + 6.0 * s BETWEEN 0 AND 31.5)",
        *contrast_ctes(),
        "su AS (SELECT k, count(*) AS n, avg((c > 0)::INT) AS p FROM c WHERE abs(t - a) > 1 GROUP BY k)",
    )
    + "SELECT (['centre', 'bright', 'dark'])[k + 1] AS anchor, n, round(p, 6) AS frac_c_pos, round(sqrt(p * (1 - p) / greatest(n, 1)), 6) AS se FROM su",
    "auc_by_shift": "WITH l AS (SELECT d AS shift, quality = 1 AS label, list_sum(list_transform(embedding[19 + d : 46 + d], lambda v: floor(128 + 200 * v::DOUBLE)::BIGINT))::BIGINT AS score FROM embeddings JOIN labels ON vec_id = doc_id, (SELECT unnest(range(-8, 9, 2)) AS d) WHERE quality IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY shift ORDER BY score) + (count(*) OVER (PARTITION BY shift, score) - 1) / 2.0::DOUBLE AS rank FROM l), s AS (SELECT shift, count(*) FILTER (label) AS positives, count(*) FILTER (NOT label) AS negatives, sum(rank) FILTER (label) AS ranks, avg(score) AS mean_score FROM r GROUP BY shift) SELECT shift::INT AS shift, round((ranks - positives * (positives + 1) / 2) / nullif((positives * negatives)::DOUBLE, 0), 6) AS auc, positives, negatives, round(mean_score, 6) AS mean_score FROM s",
    "auc_by_group": "WITH l AS (SELECT lang, n_chars AS score, toxic = 1 AS label FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS rank FROM l), s AS (SELECT lang, count(*) FILTER (label) AS positives, count(*) FILTER (NOT label) AS negatives, sum(rank) FILTER (label) AS rs FROM r GROUP BY lang) SELECT lang, positives, negatives, round((rs - positives * (positives + 1) / 2.0::DOUBLE) / nullif(positives * negatives, 0), 6) AS auc FROM s",
}
