"""The nearest site of a group, against brute force on awkward points."""

import math
import random

import pytest

from sheafray.operators import spatial


def _held(spark, points, sites, cell):
    p = spark.createDataFrame(points, "key long, winding int, x double, y double, z double")
    s = spark.createDataFrame(sites, "winding int, x double, y double, z double")
    got = {r.key: r.distance for r in spatial.nearest_vertex(p, s, cell).collect()}
    whole = lambda r: all(v is not None and math.isfinite(v) for v in r)
    sites = [x for x in sites if whole(x[1:])]
    want = {k: min(math.dist(at, x[1:]) for x in sites if x[0] == w) for k, w, *at in points if whole(at) and any(x[0] == w for x in sites)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_null_and_far_points_and_copies(spark):
    rng = random.Random(3)
    at = lambda lo, hi: [rng.uniform(lo, hi) for _ in range(3)]
    points = [(k, k % 3, *at(-500, 500)) for k in range(300)]
    points += [(900, 0, None, 1.0, 2.0), (901, 0, float("nan"), 0.0, 0.0), (902, 0, float("inf"), 0.0, 0.0), (903, 9, 1.0, 1.0, 1.0), (904, None, 1.0, 1.0, 1.0), (905, 0, 1e6, -1e6, 3.0)]
    sites = [(k % 2, *at(-500, 500)) for k in range(400)] + [(0, None, 1.0, 1.0), (1, float("nan"), 1.0, 1.0)] + [(0, 1.0, 1.0, 1.0)] * 50
    _held(spark, points, sites, 20.0)


def test_one_group_far_longer_than_the_next(spark):
    """Points of a long strip whose sites end after a tenth of it."""
    points = [(k, 0, 20.0 * (k % 8), 20.0 * (k // 8), 0.0) for k in range(1200)]
    sites = [(0, 20.0 * (k % 8) + 3.0, 20.0 * (k // 8), 9.0) for k in range(120)]
    _held(spark, points, sites, 20.0)


def test_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWD", 16)
    rng = random.Random(4)
    at = lambda lo, hi: [rng.uniform(lo, hi) for _ in range(3)]
    points = [(k, k % 2, *at(0, 1)) for k in range(200)] + [(1000 + k, 0, *at(-100, 100)) for k in range(30)]
    _held(spark, points, [(k % 2, *at(0, 1)) for k in range(700)] + [(0, 500.0, 0.0, 0.0)], 20.0)


def test_nothing_to_find(spark):
    _held(spark, [], [(0, 1.0, 1.0, 1.0)], 20.0)
    _held(spark, [(1, 0, 5.0, 5.0, 5.0)], [], 20.0)
    _held(spark, [(1, 0, 5.0, 5.0, 5.0)], [(0, 5.0, 5.0, 5.0)], 20.0)


def _plain(a, b):
    """Added one by one: math.dist and sum() of floats round otherwise."""
    x, y, z = ((p - q) * (p - q) for p, q in zip(a, b, strict=True))
    return math.sqrt(x + y + z)


def _within(spark, points, sites, radius, k):
    p = spark.createDataFrame(points, "key long, winding int, x double, y double, z double")
    s = spark.createDataFrame(sites, "winding int, x double, y double, z double, name string")
    got = sorted((r.winding, r.key, r["rank"], r.distance, r.site.name) for r in spatial.nearest_within(p, s, radius, k=k).collect())
    want = []
    for key, w, *at in points:
        near = sorted((_plain(at, x[1:4]), x[1:]) for x in sites if x[0] == w)
        want += [(w, key, i + 1, d, x[3]) for i, (d, x) in enumerate(near[:k]) if d <= radius]
    assert got == sorted(want)
    return len(got)


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_within_against_brute_force(spark, k):
    """Sparse, crowded and tied sites, points at borders of cells and without sites."""
    rng = random.Random(5)
    at = lambda lo, hi: [rng.uniform(lo, hi) for _ in range(3)]
    points = [(i, i % 3, *at(-300, 300)) for i in range(200)] + [(300 + i, 0, *at(-9, 9)) for i in range(40)]
    points += [(400 + i, 1, 20.0 * (i % 12), 20.0 * (i // 12), 0.0) for i in range(144)] + [(600, 9, 0.0, 0.0, 0.0)]
    sites = [(i % 3, *at(-300, 300), f"a{i}") for i in range(300)] + [(0, *at(-9, 9), f"b{i}") for i in range(200)]
    sites += [(1, 20.0 * (i % 12), 20.0 * (i // 12), 5.0, f"c{i}") for i in range(144)]
    assert _within(spark, points, sites, 60.0, k) > 200 * k
    # The same key in two groups, as own_other_none has it.
    _within(spark, [(1, w, 0.0, 0.0, 0.0) for w in range(3)], sites, 60.0, k)


def test_sites_from_small_files_are_not_broadcast(spark, tmp_path):
    """Copies in cells outgrow the file by far: Spark's choice by the file's
    size sent them all through the driver."""
    from sheafray.plans.mesh_queries import own_other_none

    spark.range(512).selectExpr("id AS vec_id", "cast(id % 4 AS int) AS label", "transform(sequence(0, 63), i -> cast(sin(id * 64 + i) / 8 AS float)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = own_other_none(spark, str(tmp_path))
    assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert df.agg({"n": "sum"}).first()[0] == 512 * 64
