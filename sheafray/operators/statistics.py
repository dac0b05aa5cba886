"""Summaries: contrast, gaps, bands, histograms, thresholds, ranks, nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import share
from .lineage import cut
from .sequence import interpolate_at, midpoints


def by_value(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(key, value, n): how often each group (``key``, a struct of ``by``) has
    each value, nulls left out, dealt by ranges of both and checkpointed.

    Equal values are counted before they move, so neither a hot group nor a
    hot value is one task's burden. Groups without values are absent.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("one"))
    counted = rows.where(F.col(value).isNotNull()).groupBy(key.alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return cut(counted.repartitionByRange("key", "value"))


def ranked_percentiles(counted: DataFrame, qs: dict[str, float]) -> DataFrame:
    """(key, one column per percentile) of ``by_value`` rows: exact, with
    linear interpolation, for groups of any size.

    The partitions' sizes tell which of them hold the ranks asked for; only
    those, at most two per percentile and group, are ranked within.
    """
    placed = counted.withColumn("part", F.spark_partition_id())
    group = Window.partitionBy("key")
    earlier = F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.groupBy("key", "part").agg(F.sum("n").alias("size")).select("key", "part", "size", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("size").over(group).alias("total"))
    place = {name: F.lit(q) * (F.col("total") - 1) for name, q in qs.items()}
    within = lambda rank, lo, hi: (rank >= lo) & (rank < hi)
    held = F.lit(False)
    for at in place.values():
        for rank in (F.floor(at), F.ceil(at)):
            held = held | within(rank, F.col("before"), F.col("before") + F.col("size"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("key", "part").orderBy("value"))
    ranked = placed.join(parts.where(held), ["key", "part"]).withColumn("upto", upto).withColumn("since", F.col("upto") - F.col("n"))
    found = []
    for name, at in place.items():
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found.append(F.max(F.when(within(rank, F.col("since"), F.col("upto")), F.col("value"))).alias(f"{side}_{name}"))
    ends = ranked.groupBy("key").agg(F.first("total").alias("total"), *found)
    part = lambda at: at - F.floor(at)
    return ends.select("key", *[(F.col(f"lo_{name}") * (1 - part(at)) + F.col(f"hi_{name}") * part(at)).alias(name) for name, at in place.items()])


def exact_percentiles(rows: DataFrame, value: str, qs: dict[str, float], *by: str) -> DataFrame:
    """(by, n, one column per percentile): see ``ranked_percentiles``."""
    counted = by_value(rows, value, *by)
    out = counted.groupBy("key").agg(F.sum("n").alias("n")).join(ranked_percentiles(counted, qs), "key")
    return out.select(*[F.col(f"key.{c}").alias(c) for c in by], "n", *qs)


def summarise(rows: DataFrame, *by: str, column: str = "c") -> DataFrame:
    """``summary`` of groups of any size; without ``by`` one row, of nulls and
    n = 0 where there is no value."""
    counted = by_value(rows, column, *by)
    value, n = F.col("value"), F.col("n")
    part = lambda hit: F.sum(F.when(hit, n).otherwise(0)) / F.sum(n)
    sums = counted.groupBy("key").agg(F.sum(n).alias("n"), (F.sum(value * n) / F.sum(n)).alias("mean_c"), part(value > 0).alias("frac_c_pos"), part(value > 0.1).alias("frac_c_gt_0_1"))
    out = sums.join(ranked_percentiles(counted, {"median_c": 0.5}), "key").select(*[F.col(f"key.{c}").alias(c) for c in by], "n", "median_c", "mean_c", "frac_c_pos", "frac_c_gt_0_1")
    if by:
        return out
    # At most one row.
    return out.agg(F.coalesce(F.first("n"), F.lit(0)).alias("n"), *[F.first(c).alias(c) for c in ("median_c", "mean_c", "frac_c_pos", "frac_c_gt_0_1")])


def summary(column: str = "c") -> list[Column]:
    """n, median, mean and the shares above 0 and 0.1 of a contrast column, of
    groups of a bounded size, as rays; see ``summarise`` for others."""
    c = F.col(column)
    return [
        F.count(c).alias("n"),
        F.percentile(c, F.lit(0.5)).alias("median_c"),
        F.avg(c).alias("mean_c"),
        share(c > 0).alias("frac_c_pos"),
        share(c > 0.1).alias("frac_c_gt_0_1"),
    ]


def contrast(knots: DataFrame, hits: DataFrame, least_samples: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """c of every interior hit: its intensity less the mean of the mid-points
    to both neighbours, over the ray's p95 - p5.

    ``knots`` (ray_id, t, v) is the profile, ``hits`` (ray_id, t, ...) the
    positions; further columns of hits are kept, and those of ``by`` part sets
    of positions that meet the profile together but not each other. Rays with
    fewer than ``least_samples`` samples or a flat profile give nothing.
    """
    spread = knots.groupBy("ray_id").agg(F.count("v").alias("_n"), (F.percentile("v", F.lit(0.95)) - F.percentile("v", F.lit(0.05))).alias("spread")).where((F.col("_n") >= least_samples) & (F.col("spread") > 0))
    carried = [c for c in hits.columns if c not in ("ray_id", "t")]
    inner = midpoints(hits, by=by)
    points = inner.select(
        "ray_id",
        F.col("t").alias("_at"),
        *carried,
        F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("t").alias("t")), F.struct(F.lit(1).alias("role"), F.col("mid_left").alias("t")), F.struct(F.lit(2).alias("role"), F.col("mid_right").alias("t")))).alias("p"),
    ).select("ray_id", F.col("p.t").alias("t"), "_at", *carried, F.col("p.role").alias("role"))
    found = interpolate_at(knots, points)
    role = lambda k: F.max(F.when(F.col("role") == k, F.col("v")))
    wide = found.groupBy("ray_id", F.col("_at").alias("t"), *carried).agg(role(0).alias("at"), role(1).alias("left_v"), role(2).alias("right_v"))
    return wide.join(spread.select("ray_id", "spread"), "ray_id").select("ray_id", "t", *carried, ((F.col("at") - (F.col("left_v") + F.col("right_v")) / 2) / F.col("spread")).alias("c"))


def anchor_contrast(profiles: DataFrame, crossings, centre: float, reach: float, near: float = 1.0) -> DataFrame:
    """Whether crossings sit on bright sheets by what their reading is anchored
    to: the profile's ``centre``, or the brightest or darkest sample at most
    ``reach`` from it (ties: the first). One row an anchor: n, frac_c_pos, se.

    ``profiles`` has ray_id, t and v; ``crossings`` maps a DataFrame with
    ray_id and anchor_t to the rows (ray_id, anchor_t, t) of the crossings read
    from there. A crossing within ``near`` of its anchor takes part as a
    neighbour but is left out of the sums, as it is where it is by choice.
    """
    window = profiles.where(F.col("v").isNotNull() & F.col("t").between(centre - reach, centre + reach))
    found = window.groupBy("ray_id").agg(F.max_by("t", F.struct(F.col("v"), -F.col("t"))).alias("bright"), F.min_by("t", F.struct("v", "t")).alias("dark"))
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("anchor"), at.alias("anchor_t")) for k, (name, at) in enumerate((("centre", F.lit(float(centre))), ("bright", F.col("bright")), ("dark", F.col("dark"))))])
    anchors = found.select(F.col("ray_id").alias("ray"), F.explode(kinds).alias("a")).select("ray", "a.*").withColumn("ray_id", F.struct("ray", "k"))
    hits = crossings(anchors.select("ray_id", "anchor_t"))
    knots = profiles.withColumnRenamed("ray_id", "ray").join(anchors.select("ray", "ray_id"), "ray").select("ray_id", "t", "v")
    c = contrast(knots, hits.select("ray_id", "t", "anchor_t")).where(F.abs(F.col("t") - F.col("anchor_t")) > near)
    name = F.element_at(F.array(*[F.lit(n) for n in ("centre", "bright", "dark")]), F.col("ray_id.k") + 1)
    p = share(F.col("c") > 0)
    return c.groupBy(name.alias("anchor")).agg(F.count(F.lit(1)).alias("n"), p.alias("frac_c_pos")).withColumn("se", F.sqrt(F.col("frac_c_pos") * (1 - F.col("frac_c_pos")) / F.greatest("n", F.lit(1))))


def gap_statistics(gapped: DataFrame, *by: str, small: float = 3.0) -> DataFrame:
    """n, median and shares of short and long gaps; the median is the group's.
    Two passes: the median joins back to the gaps on the group's columns. Of
    the groups only rays are of a bounded size."""
    if "ray_id" in by:
        med = gapped.groupBy(*by).agg(F.percentile("gap", F.lit(0.5)).alias("median"))
    else:
        found = exact_percentiles(gapped, "gap", {"median": 0.5}, *by).drop("n")
        med = found if by else found.agg(F.first("median").alias("median"))
    rows = gapped.join(med, list(by)) if by else gapped.crossJoin(F.broadcast(med))
    gap, near = F.col("gap"), F.col("gap") < small
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.first("median").alias("median"),
        share(gap < 0.5 * F.col("median")).alias("frac_lt_half_median"),
        share(near).alias("frac_lt_small"),
        share(gap > 1.5 * F.col("median")).alias("frac_gt_1_5_median"),
    ]
    if "same_winding" in gapped.columns:
        aggs += [share(near & ~F.col("same_winding")).alias("frac_small_two_windings"), share(near & F.col("same_winding")).alias("frac_small_one_winding")]
    return rows.groupBy(*by).agg(*aggs)


def band(value: Column, edges: list[float], last: float = 99999.0) -> Column:
    """The label "lo-hi" of the half-open band a value is in, else null."""
    bounds = list(zip(edges, [*edges[1:], last], strict=True))
    out = None
    for lo, hi in bounds:
        hit, label = (value >= lo) & (value < hi), f"{lo:g}-{hi:g}"
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int, *by: str) -> DataFrame:
    """Counts by fixed bins of [lo, hi]; the last bin is closed."""
    width = (hi - lo) / bins
    which = F.least(F.floor((F.col(value) - lo) / width).cast("int"), F.lit(bins - 1))
    return rows.where((F.col(value) >= lo) & (F.col(value) <= hi)).groupBy(*by, which.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(rows: DataFrame, value: str, *by: str, bins: int = 256, lo: float = 0.0, hi: float = 256.0) -> DataFrame:
    """Threshold that maximises the variance between both sides: the centre of
    the first best bin. Sums run over at most ``bins`` rows a group."""
    width = (hi - lo) / bins
    grid = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    counts = histogram(rows, value, lo, hi, bins, *by)
    groups = counts.select(*by).distinct() if by else counts.limit(1).select(F.lit(1).alias("_one")).distinct()
    full = groups.select(*by, grid).join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).cast("double").alias("h"))
    w = Window.partitionBy(*by).orderBy("bin")
    all_ = Window.partitionBy(*by)
    centre = F.lit(lo) + (F.col("bin") + 0.5) * width
    sums = (
        full.withColumn("w0", F.sum("h").over(w))
        .withColumn("s0", F.sum(F.col("h") * centre).over(w))
        .withColumn("w1", F.sum("h").over(all_) - F.col("w0"))
        .withColumn("s1", F.sum(F.col("h") * centre).over(all_) - F.col("s0"))
    )
    apart = F.col("s0") / F.greatest("w0", F.lit(1e-9)) - F.col("s1") / F.greatest("w1", F.lit(1e-9))
    scored = sums.withColumn("between", F.round(F.col("w0") * F.col("w1") * apart * apart, 3)).where(F.col("bin") < bins - 1)
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("between"), "bin"))
    return scored.withColumn("_r", best).where("_r = 1").select(*by, centre.alias("threshold"))


def circular_concentration(phase: Column) -> Column:
    """|mean exp(2 pi i phase)|: 1 for equal phases, about 0 for random ones."""
    angle = 2 * F.pi() * phase
    return F.sqrt(F.avg(F.cos(angle)) * F.avg(F.cos(angle)) + F.avg(F.sin(angle)) * F.avg(F.sin(angle)))


def tile_concentration(rows: DataFrame, tile: int = 5, least: int = 15, phase: str = "phase") -> DataFrame:
    """By winding the concentration of all phases (winding, r, c, phase), the
    median of that of tile x tile cells, and how many tiles count: those
    wholly within the grid with at least ``least`` phases. A surface that
    follows its sheets at a slowly varying offset has a high median alone.

    Null and NaN phases are left out, but their rows count for the grid's size.
    """
    shape = rows.groupBy("winding").agg((F.max("r") + 1).alias("_rows"), (F.max("c") + 1).alias("_cols"))
    held = rows.where(F.col(phase).isNotNull() & ~F.isnan(F.col(phase)))
    whole = held.groupBy("winding").agg(circular_concentration(F.col(phase)).alias("phase_R"))
    tr, tc = F.floor(F.col("r") / tile).alias("_tr"), F.floor(F.col("c") / tile).alias("_tc")
    tiles = held.groupBy("winding", tr, tc).agg(F.count(F.lit(1)).alias("_n"), circular_concentration(F.col(phase)).alias("_R")).where(F.col("_n") >= least)
    inside = tiles.join(shape, "winding").where(((F.col("_tr") + 1) * tile <= F.col("_rows")) & ((F.col("_tc") + 1) * tile <= F.col("_cols")))
    medians = exact_percentiles(inside.select("winding", "_R"), "_R", {"phase_R_tile_median": 0.5}, "winding").withColumnRenamed("n", "tiles")
    return whole.join(medians, "winding", "left").withColumn("tiles", F.coalesce("tiles", F.lit(0)))


def auc(rows: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Area under the ROC curve by average ranks, of groups of any size; null
    with a single class. Rows without a score or a label do not count.

    Equal scores are counted first and dealt by ranges of group and score. A
    partition's ranks begin after what its group has in earlier partitions, so
    neither a group nor a window holds a class.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(1).alias("one"))
    held = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = held.groupBy(key.alias("key"), F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("p"))
    placed = cut(counts.repartitionByRange("key", "score").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("key", "part").agg(F.sum("n").alias("size")).select("key", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    local = Window.partitionBy("key", "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("before") + F.coalesce(F.sum("n").over(local), F.lit(0)) + (F.col("n") + 1) / F.lit(2.0)
    n1, n = F.sum("p").cast("double"), F.sum("n").cast("double")
    n0 = n - n1
    ranked = placed.join(parts, ["key", "part"]).withColumn("rank", rank).groupBy("key")
    out = ranked.agg(((F.sum(F.col("rank") * F.col("p")) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))).alias("auc"), n1.cast("long").alias("positives"), n0.cast("long").alias("negatives"))
    return out.select(*[F.col(f"key.{c}").alias(c) for c in by], "auc", "positives", "negatives")


def auc_by_shift(stacks: DataFrame, labels: DataFrame, key: str, layers: int, shifts: list[int], centre: int, score, *by: str) -> DataFrame:
    """How well ``score`` of a window of ``layers`` values ranks the labels
    when the window moves by each shift (and ``by``): shift, auc, positives,
    negatives and the mean score.

    ``stacks`` (key, stack) is gathered once, wide enough for all shifts;
    ``score`` maps an array column to a value; ``labels`` (key, label) has the
    supervised places alone.
    """
    moved = stacks.join(labels, key).select(*by, "label", "stack", F.explode(F.array(*[F.lit(s) for s in shifts])).alias("shift"))
    scored = cut(moved.select("shift", *by, "label", score(F.slice("stack", F.lit(centre + 1) + F.col("shift"), F.lit(layers))).alias("score")))
    means = scored.groupBy("shift", *by).agg(F.avg("score").alias("mean_score"))
    return auc(scored, "score", "label", "shift", *by).join(means, ["shift", *by])


def null_report(copies: DataFrame, observed: DataFrame) -> DataFrame:
    """``copies`` (copy, frac) against the one row ``observed`` (frac): mean,
    p2.5, p97.5 and the share of copies that reach the observed value."""
    both = copies.crossJoin(F.broadcast(observed.select(F.col("frac").alias("observed"))))
    return both.agg(
        F.count(F.lit(1)).alias("copies"),
        F.avg("frac").alias("null_mean"),
        F.percentile("frac", F.lit(0.025)).alias("null_p2_5"),
        F.percentile("frac", F.lit(0.975)).alias("null_p97_5"),
        share(F.col("frac") >= F.col("observed")).alias("frac_at_or_above"),
        F.first("observed").alias("observed"),
    )


def percentiles(column: str, qs: dict[str, float]) -> list[Column]:
    """Exact percentiles with linear interpolation, by name, of groups of a
    bounded size; see ``exact_percentiles`` for others."""
    return [F.percentile(column, F.lit(q)).alias(name) for name, q in qs.items()]


def majority(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """The most frequent key of a group (ties: the least) and the share of
    rows that have another."""
    counts = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    first = F.row_number().over(w.orderBy(F.desc("n"), key))
    return counts.withColumn("total", F.sum("n").over(w)).withColumn("_r", first).where("_r = 1").select(*by, F.col(key).alias("majority"), (1 - F.col("n") / F.col("total")).alias("off_majority"))
