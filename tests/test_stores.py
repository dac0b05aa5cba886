"""Tolerance joins, ranks, dense numbers and what a snapped store keeps."""

import random

import pytest
from pyspark.sql import functions as F

from sheafray.operators import numbering, sequence, statistics, tolerance


def test_values_within_a_tolerance(spark):
    rng = random.Random(7)
    # Values on cell borders, equal ones, pairs at the tolerance, and negatives.
    value = lambda: rng.choice([rng.uniform(-1, 1), rng.randint(-4, 4) * 0.25, 0.0])
    left = [(k, rng.randint(0, 1), value(), value()) for k in range(200)] + [(900, 0, None, 0.0), (901, 0, float("nan"), 0.0), (902, None, 0.0, 0.0)]
    right = [(k, rng.randint(0, 1), value(), value()) for k in range(150)] + [(900, 0, 0.0, None), (901, 0, 0.0, float("inf"))]
    kind = "k int, g int, a double, b double"
    whole = lambda r: all(v is not None and abs(v) < float("inf") for v in r)
    for tol, relative in (({"a": 0.25, "b": 0.1}, 0.0), ({"a": 0.01, "b": 0.0}, 0.0), ({"a": 0.05, "b": 0.05}, 0.1)):
        got = tolerance.match_within(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), tol, "g", relative=relative).select("k", "other.k").collect()
        want = [(x[0], y[0]) for x in left for y in right if x[1] == y[1] and whole(x) and whole(y) and all(abs(x[i] - y[i]) <= tol[n] + relative * abs(y[i]) for i, n in ((2, "a"), (3, "b")))]
        assert sorted(map(tuple, got)) == sorted(want)


def test_stores_compared(spark):
    kind = "ray_id int, z double, y double, x double, crossings array<struct<t:double,level:int>>"
    stored = [(1, 0.0, 0.0, 0.0, [(1.0, 0), (2.0, 1)]), (2, 5.0, 0.0, 0.0, [(1.0, 0)]), (3, 5.0, 0.0, 0.0, []), (4, 9.0, 9.0, 9.0, [(1.0, 0)])]
    derived = [(10, 0.0009, 0.0, -0.0009, [(1.019, 0), (1.981, 1)]), (11, 0.0011, 0.0, 0.0, []), (12, 5.0, 0.0, 0.0, [(1.021, 0)]), (13, 9.0, 9.0, 9.0, [(1.0, 1)]), (14, 9.0, 9.0, 9.0, [])]
    got = {r.ray_id: (r.stored_id, r.n_derived, r.n_stored, r.status) for r in tolerance.compare_stores(spark.createDataFrame(derived, kind), spark.createDataFrame(stored, kind), relative=0.0).collect()}
    assert got == {10: (1, 2, 2, "match"), 11: (None, 0, 0, "no ray"), 12: (2, 1, 1, "diff"), 13: (4, 1, 1, "diff"), 14: (4, 0, 1, "diff")}


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_and_offsets_over_partitions(many_parts):
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 5)) for k in rng.sample(range(10_000), 500)]
    got = {r.k: (r.id, r.offset) for r in numbering.dense(many_parts.createDataFrame(rows, "k int, n int").repartition(5), "k", total="n").collect()}
    at = 0
    for number, (k, n) in enumerate(sorted(rows)):
        assert got[k] == (number, at)
        at += n
    assert numbering.dense(many_parts.createDataFrame([], "k int, n int"), "k", total="n").collect() == []


def test_auc_of_one_group_over_partitions(many_parts):
    rng = random.Random(2)
    rows = [(g, rng.randint(0, 11) / 3, rng.random() < 0.3) for g in ("a", "b") for _ in range(800)]
    rows += [("one", 1.0, True), ("a", None, True), ("b", 2.0, None), (None, 0.5, True), (None, 0.5, False)]
    df = many_parts.createDataFrame(rows, "g string, s double, y boolean")
    got = {r.g: r.auc for r in statistics.auc(df, "s", "y", "g").collect()}

    def brute(g):
        pos = [s for h, s, y in rows if h == g and y is True and s is not None]
        neg = [s for h, s, y in rows if h == g and y is False and s is not None]
        return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None

    assert got.keys() == {"a", "b", "one", None}
    assert all(got[g] == pytest.approx(brute(g), abs=1e-12) for g in ("a", "b", None)) and got["one"] is None
    whole = statistics.auc(df, "s", "y").first()
    assert whole.positives + whole.negatives == sum(s is not None and y is not None for _, s, y in rows)


def test_auc_of_a_moved_window(spark):
    rng = random.Random(3)
    stacks = [(k, [rng.random() + (3.0 if k % 2 and 6 <= i < 9 else 0.0) for i in range(16)]) for k in range(60)]
    marks = [(k, bool(k % 2)) for k in range(50)]
    score = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    got = {r["shift"]: r for r in statistics.auc_by_shift(spark.createDataFrame(stacks, "k int, stack array<double>"), spark.createDataFrame(marks, "k int, label boolean"), "k", 3, [-6, 0, 6], 6, score).collect()}
    assert got[0].auc == 1.0 and got[0].positives == got[0].negatives == 25
    assert all(0.2 < got[s].auc < 0.8 for s in (-6, 6))
    for s in (-6, 0, 6):
        assert got[s].mean_score == pytest.approx(sum(sum(v[6 + s : 9 + s]) for k, v in stacks if k < 50) / 50)


def test_runs_become_rays(spark):
    """A crest that is missing between two crossings parts a ray in two; a
    run of one crossing, and an unmoved crossing, are left out."""
    crests = [(r, float(t)) for r in (1, 2) for t in (30, 46, 78, 94, 110)]
    t_new = [30.0, 46.0, 64.0, 78.0, 94.0, 110.0]
    rows = [(1, k, t + 0.5, t, "no_crest" if k == 2 else "snapped", k, None if k == 2 else t) for k, t in enumerate(t_new)]
    rows += [(2, k, t - 0.5, t, "snapped" if k not in (0, 2) else "no_crest", k, t) for k, t in enumerate(t_new)] + [(3, 0, 5.0, 5.0, "no_crest", 0, None)]
    df = spark.createDataFrame(rows, "ray_id int, k int, t double, t_new double, status string, level int, crest double")
    c = spark.createDataFrame(crests, "ray_id int, t double")
    rays, crossings = sequence.drop_unsnapped(df, c)
    assert [(r.ray, r.ray_id, r.offset, r.n) for r in rays.orderBy("ray").collect()] == [(0, 1, 0, 2), (1, 1, 2, 3), (2, 2, 5, 3)]
    assert [(r.ray, r.place, r.t, r.level) for r in crossings.orderBy("ray", "place").collect()] == [(0, 0, 30.0, 0), (0, 1, 46.0, 1), (1, 0, 78.0, 3), (1, 1, 94.0, 4), (1, 2, 110.0, 5), (2, 0, 78.0, 3), (2, 1, 94.0, 4), (2, 2, 110.0, 5)]
    s = sequence.snap_summary(df, c).first()
    assert (s.rays, s.crossings, s.rays_out) == (3, 13, 3)
    assert s.snapped_frac == pytest.approx(9 / 13) and s.kept_frac == pytest.approx(8 / 13) and s.inconsistent_frac == pytest.approx(1 / 13)
    assert s.shift_p50 == pytest.approx(0.5) and s.crest_gap_median == pytest.approx(16.0)
    none = sequence.snap_summary(df.where("false"), c.where("false")).first()
    assert none.crossings == 0 and none.snapped_frac is None and none.shift_p50 is None
