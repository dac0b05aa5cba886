"""Per-ray operators: best rigid offset, crest finding, snapping with undo.

What needs a ray as a whole and a loop runs as one Arrow-batched function per
ray; a ray is short. Everything else is windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import interpolate_at, local_gap


def best_offsets(crossings: DataFrame, knots: DataFrame, offsets: list[float], least: int = 3) -> DataFrame:
    """For each ray the fraction f of the local gap that, added to all its
    crossings, gives the largest mean intensity (the first on ties):
    ray_id, f, score, contrast (range of scores over p95 - p5), n."""
    w = Window.partitionBy("ray_id").orderBy("t", "k")
    gapped = crossings if "gap" in crossings.columns else crossings.withColumn("gap", local_gap(F.col("t"), w))
    moved = gapped.withColumn("f", F.explode(F.array(*[F.lit(float(f)) for f in offsets]))).select("ray_id", (F.col("t") + F.col("f") * F.col("gap")).alias("t"), "f")
    scores = interpolate_at(knots, moved).groupBy("ray_id", "f").agg(F.avg("v").alias("score"), F.count("v").alias("n")).where(F.col("n") >= least)
    ray = Window.partitionBy("ray_id")
    spread = knots.groupBy("ray_id").agg((F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))).alias("spread")).where("spread > 0")
    ranked = scores.withColumn("rank", F.row_number().over(ray.orderBy(F.round("score", 9).desc(), "f"))).withColumn("span", F.max("score").over(ray) - F.min("score").over(ray))
    return ranked.where("rank = 1").join(spread, "ray_id").select("ray_id", "f", "score", (F.col("span") / F.col("spread")).alias("contrast"), "n")


def find_peaks(values: np.ndarray, prominence: float = 0.0, distance: int = 1) -> np.ndarray:
    """Indices of peaks: strict maxima (of a plateau its middle, rounded
    down), thinned so that the highest of any within ``distance`` samples
    stay, then those with at least ``prominence``."""
    x = np.asarray(values, float)
    change = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.concatenate([[0], change + 1]), np.concatenate([change, [len(x) - 1]])
    level = x[starts]
    inner = np.arange(1, len(level) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    peaks = (starts[top] + ends[top]) // 2
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(peaks - peaks[k]) < distance
                near[k] = False
                keep &= ~near
        peaks = peaks[keep]
    if prominence > 0 and len(peaks):
        kept = []
        for p in peaks:
            higher_left = np.flatnonzero(x[:p] > x[p])
            higher_right = np.flatnonzero(x[p + 1 :] > x[p])
            lo = higher_left[-1] + 1 if len(higher_left) else 0
            hi = p + 1 + higher_right[0] if len(higher_right) else len(x)
            if x[p] - max(x[lo : p + 1].min(), x[p:hi].min()) >= prominence:
                kept.append(p)
        peaks = np.array(kept, int)
    return peaks


def crests(profile: np.ndarray, inside: np.ndarray, t: np.ndarray, prominence: float = 0.15, distance: int = 8) -> np.ndarray:
    """Sub-sample crest positions of a smoothed profile; masked samples count
    as dark, and a crest is no end of the profile."""
    seen = profile[inside]
    if len(seen) < 20 or (spread := float(np.subtract(*np.percentile(seen, [95, 5])))) <= 0:
        return np.zeros(0)
    dark = np.where(inside, profile, seen.min())
    at = [p for p in find_peaks(dark, prominence * spread, distance).tolist() if 0 < p < len(profile) - 1 and inside[p]]
    out = []
    for p in at:
        rise, fall = profile[p] - profile[p - 1], profile[p] - profile[p + 1]
        # The parabola's turn; a concave one has rise + fall above 0.
        out.append(t[p] + (t[1] - t[0]) * min(0.5, max(-0.5, 0.5 * (rise - fall) / (rise + fall))) if rise + fall > 0 else t[p])
    return np.array(out)


def snap_one(t: np.ndarray, crest: np.ndarray, reach: float, least_gap: float, fixed: np.ndarray | None = None) -> tuple[np.ndarray, list[str]]:
    """One ray's crossings, ascending, moved to crests: to the nearest within
    reach x local gap (ties left), one crossing per crest, and moves undone,
    the larger first, while neighbours are closer than ``least_gap``."""
    n = len(t)
    new, status = t.astype(float).copy(), ["fixed" if fixed is not None and fixed[k] else "no_crest" for k in range(n)]
    if n < 2 or not len(crest):
        return new, status
    # Half the distance between both neighbours, one-sided at the ends.
    gap = np.gradient(t.astype(float))
    at = np.searchsorted(crest, t)
    left, right = crest[np.clip(at - 1, 0, len(crest) - 1)], crest[np.clip(at, 0, len(crest) - 1)]
    target = np.where(np.abs(left - t) <= np.abs(right - t), left, right)
    claims: dict[float, int] = {}
    for k in np.argsort(np.abs(target - t), kind="stable").tolist():
        if status[k] == "fixed" or abs(target[k] - t[k]) > reach * gap[k]:
            continue
        status[k] = "conflict" if target[k] in claims else "snapped"
        claims.setdefault(target[k], k)
    for k in range(n):
        if status[k] == "snapped":
            new[k] = target[k]
    moved = np.array([s == "snapped" for s in status])
    while (tight := (np.diff(new) < least_gap) & (moved[:-1] | moved[1:])).any():
        k = int(tight.argmax())  # the first pair that an undo can part
        far = np.where(moved[k : k + 2], np.abs(new[k : k + 2] - t[k : k + 2]), -1.0)
        k += int(far.argmax())
        new[k], moved[k], status[k] = t[k], False, "undone"
    return new, status


def snap_rays(points: DataFrame, crests_: DataFrame, reach: float = 0.5, least_gap: float = 4.0) -> DataFrame:
    """``snap_one`` for every ray: ray_id, k, t, t_new, status."""
    both = points.select("ray_id", "t", "k", F.lit(0).alias("crest")).unionByName(crests_.select("ray_id", "t", F.lit(None).cast("long").alias("k"), F.lit(1).alias("crest")))

    def run(rows):
        import pandas as pd

        rows = rows.sort_values(["t", "k"], kind="stable")
        p, c = rows[rows["crest"] == 0], rows[rows["crest"] == 1]
        new, status = snap_one(p["t"].to_numpy(), c["t"].to_numpy(), reach, least_gap)
        return pd.DataFrame({"ray_id": p["ray_id"], "k": p["k"].astype("int64"), "t": p["t"], "t_new": new, "status": status})

    return both.groupBy("ray_id").applyInPandas(run, "ray_id long, k long, t double, t_new double, status string")
