import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafray.functions import expr
from sheafray.operators import mesh as ms
from sheafray.operators import rays, sequence, spatial, statistics, volume
from sheafray.sources import arrays, codecs, text


def test_expressions(spark):
    df = spark.createDataFrame([(k, [float(v) for v in np.random.default_rng(k).normal(size=1 + 7 * k)], 0.37 * k - 1) for k in range(12)], "k int, a array<double>, p double")
    for r in df.select("a", "p", expr.interpolate(F.col("a"), F.col("p")).alias("v"), expr.smooth_array(F.col("a"), 2.0).alias("s"), expr.smooth_array(F.col("a"), 1.0, "nearest").alias("e"), expr.wrap(F.col("p"), F.lit(1.0)).alias("w")).collect():
        a = np.array(r.a)
        assert r.v == pytest.approx(np.interp(r.p, np.arange(len(a)), a))
        for got, sigma, mode in ((r.s, 2.0, "symmetric"), (r.e, 1.0, "edge")):
            k = np.array(expr.gaussian_kernel(sigma))
            assert got == pytest.approx(np.convolve(np.pad(a, len(k) // 2, mode=mode), k, "valid").tolist())
        assert -0.5 <= r.w < 0.5 and (r.p - r.w) == pytest.approx(round(r.p - r.w))


def _brute_peaks(x, prominence, distance):
    x, out = list(x), []
    k = 1
    while k < len(x) - 1:
        e = k
        while e + 1 < len(x) and x[e + 1] == x[k]:
            e += 1
        if x[k - 1] < x[k] and e < len(x) - 1 and x[e + 1] < x[k]:
            out.append((k + e) // 2)
        k = e + 1
    keep = set(out)
    for p in sorted(out, key=lambda p: (-x[p], -p)):
        if p in keep:
            keep -= {q for q in keep if q != p and abs(q - p) < distance}
    result = []
    for p in sorted(keep):
        sides = []
        for step in (-1, 1):
            q, low = p, x[p]
            while 0 <= q < len(x) and x[q] <= x[p]:
                low = min(low, x[q])
                q += step
            sides.append(low)
        if x[p] - max(sides) >= prominence:
            result.append(p)
    return result


@pytest.mark.parametrize("seed", range(30))
def test_find_peaks(seed):
    x = np.random.default_rng(seed).integers(0, 6, 60)
    assert rays.find_peaks(x, 2, 4).tolist() == _brute_peaks(x, 2, 4)
    assert rays.find_peaks(x).tolist() == _brute_peaks(x, 0, 1)


def test_snap_one():
    sheets = np.arange(30.0, 111, 16)
    t = sheets + np.array([3.0, -4, 2, 5, -3, 1])
    new, status = rays.snap_one(t, sheets, 0.5, 4.0)
    assert new.tolist() == sheets.tolist() and set(status) == {"snapped"}
    new, status = rays.snap_one(t, np.delete(sheets, 2), 0.5, 4.0)
    assert new[2] == t[2] and status[2] == "no_crest"
    new, status = rays.snap_one(t, sheets, 0.5, 4.0, np.array([True] + [False] * 5))
    assert new[0] == t[0] and status[0] == "fixed"
    new, status = rays.snap_one(np.array([28.0, 33, 47]), np.array([30.0, 46, 62]), 0.5, 4.0)
    assert new.tolist() == [28, 33, 46] and status == ["undone", "conflict", "snapped"]


def test_interpolation_and_counts(spark):
    rng = np.random.default_rng(2)
    knots = [(int(k % 5), float(t), float(v)) for k, (t, v) in enumerate(zip(rng.uniform(0, 100, 200), rng.normal(size=200), strict=True))]
    points = [(int(k % 6), float(t), k) for k, t in enumerate(rng.uniform(-10, 110, 300))] + [(k, t, 1000 + n) for n, (k, t, _) in enumerate(knots[:20])]
    K, P = spark.createDataFrame(knots, "ray_id int, t double, v double"), spark.createDataFrame(points, "ray_id int, t double, id int")
    got = {r.id: r.v for r in sequence.interpolate_at(K, P).collect()}
    near = {r.id: (r.left, r.right) for r in sequence.neighbours(P, K.select("ray_id", "t")).collect()}
    count = {r.id: r.hits_before for r in sequence.count_before(P, K.select("ray_id", "t")).collect()}
    for ray, t, k in points:
        own = sorted((a, b) for r, a, b in knots if r == ray)
        if not own:
            assert got[k] is None and near[k] == (None, None) and count[k] == 0
            continue
        assert got[k] == pytest.approx(np.interp(t, [a for a, _ in own], [b for _, b in own]))
        assert near[k] == (max((a for a, _ in own if a <= t), default=None), min((a for a, _ in own if a >= t), default=None))
        assert count[k] == sum(a < t for a, _ in own)


def test_statistics(spark):
    rng = np.random.default_rng(5)
    s, y = rng.integers(0, 12, 500), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(int(a), bool(b), float(a)) for a, b in zip(s, y, strict=True)], "s int, y boolean, v double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())
    assert statistics.auc(df, "s", "y").first().auc == pytest.approx(want, abs=1e-12)
    assert statistics.auc(df.where("y"), "s", "y").first().auc is None
    counts = {r.bin: r.n for r in statistics.histogram(df, "v", 0.0, 11.0, 11).collect()}
    assert [counts.get(k, 0) for k in range(11)] == np.histogram(s, 11, (0, 11))[0].tolist()
    two = spark.createDataFrame([(float(v),) for v in [*rng.normal(60, 5, 300), *rng.normal(180, 5, 300)]], "v double")
    assert 75 < statistics.otsu(two, "v").first().threshold < 165
    assert statistics.contrast(df.select(F.lit(1).alias("ray_id"), F.col("v").alias("t"), "v").limit(3), df.select(F.lit(1).alias("ray_id"), F.col("v").alias("t")).limit(0)).collect() == []


def test_percentiles_of_any_group(spark):
    """Against NumPy: a hot group, a hot value, a null group, groups of one and
    two values, and one without any."""
    rng = np.random.default_rng(11)
    groups = {"hot": [*rng.normal(0, 9, 3000), *[1.5] * 2000], "even": [7.0] * 50, None: [3.0, -1.0], "one": [2.0], "big": [1e300, *rng.lognormal(0, 5, 900)], "none": []}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in statistics.exact_percentiles(df, "v", qs, "g").collect()}
    assert set(got) == set(groups) - {"none"}
    for g, r in got.items():
        assert r.n == len(groups[g]) and [r[q] for q in qs] == pytest.approx([np.quantile(groups[g], q) for q in qs.values()], rel=1e-12)
    every = np.concatenate([v for v in groups.values() if v])
    assert statistics.exact_percentiles(df, "v", {"m": 0.5}).first().m == pytest.approx(np.median(every))
    few = df.where("g = 'hot'").withColumnRenamed("v", "c")
    want = few.agg(*statistics.summary()).first()
    assert list(statistics.summarise(few).first()) == pytest.approx(list(want))
    nothing = statistics.summarise(few.limit(0)).first()
    assert nothing.n == 0 and nothing.median_c is None and statistics.exact_percentiles(df.limit(0), "v", qs, "g").collect() == []


def test_codecs(spark, tmp_path):
    import struct
    import zlib

    import pyarrow as pa

    rng = np.random.default_rng(12)
    v = np.cumsum(rng.integers(0, 3, 4000)).astype("<u4")
    raw, noise = v.tobytes(), rng.bytes(999)
    for data, width in ((raw, 4), (raw, 1), (noise, 8), (b"", 2), (b"abc", 2), (raw[:-3], 4)):
        assert codecs.blosc_decode(codecs.blosc_encode(data, width)) == data
    # Two blocks of 8192 bytes, split by bytes, the last shorter and so whole; each by another coder.
    for flag, coder in ((1, "lz4_raw"), (2, "snappy"), (4, "zstd"), (3, None)):
        pack = zlib.compress if coder is None else lambda b, coder=coder: pa.Codec(coder).compress(b).to_pybytes()
        blocks = []
        for block in (raw[:8192], raw[8192:]):
            turned = np.frombuffer(block, np.uint8).reshape(-1, 4).T
            parts = [p.tobytes() for p in turned] if len(block) == 8192 else [turned.tobytes()]
            blocks.append(b"".join(struct.pack("<I", len(pack(p))) + pack(p) for p in parts))
        head = bytes([2, 1, 1 | flag << 5, 4]) + struct.pack("<III", len(raw), 8192, 24 + sum(map(len, blocks))) + struct.pack("<II", 24, 24 + len(blocks[0]))
        assert codecs.blosc_decode(head + b"".join(blocks)) == raw
    # Bit planes: plane k holds bit k of each element, the first element lowest.
    planes = b"".join(sum(((int(x) >> k) & 1) << i for i, x in enumerate(v)).to_bytes(500, "little") for k in range(32))
    body = pa.Codec("lz4_raw").compress(planes).to_pybytes()
    frame = bytes([2, 1, 0x14 | 1 << 5, 4]) + struct.pack("<IIIII", len(raw), len(raw), 24 + len(body), 20, len(body)) + body
    assert codecs.blosc_decode(frame) == raw
    with pytest.raises(ValueError):
        codecs.blosc_decode(bytes([2, 1, 0x10, 4]) + frame[4:])
    steps = np.diff(v.astype("<i4"), prepend=0).astype("<i2").tobytes()
    assert codecs.decode_chunk(zlib.compress(steps), "zlib", [{"id": "delta", "dtype": "<i4", "astype": "<i2"}]) == v.astype("<i4").tobytes()
    turned = v.view(np.uint8).reshape(-1, 4).T.tobytes()
    checked = struct.pack("<I", zlib.crc32(turned)) + turned
    assert codecs.decode_chunk(checked, None, [{"id": "shuffle", "elementsize": 4}, {"id": "crc32"}]) == raw
    with pytest.raises(ValueError):
        codecs.decode_chunk(b"0000" + turned, None, [{"id": "crc32"}])
    scaled = codecs.decode_chunk(np.array([15, 20], "u1").tobytes(), None, [{"id": "fixedscaleoffset", "scale": 10, "offset": 3, "dtype": "<f8", "astype": "|u1"}])
    assert np.frombuffer(scaled, "<f8").tolist() == [4.5, 5.0]
    assert codecs.decode_chunk(b"\x05" + np.packbits([1, 0, 1]).tobytes(), None, [{"id": "packbits"}]) == b"\x01\x00\x01"
    # A whole array, written and read.
    vol = rng.integers(0, 9, (10, 8, 8)).astype("<u2")
    (tmp_path / ".zarray").write_text('{"shape": [10, 8, 8], "chunks": [5, 8, 8], "dtype": "<u2", "compressor": {"id": "blosc"}, "filters": [{"id": "quantize"}]}')
    arrays.save_files(arrays.chunk_files(arrays.chunk_rows(spark, vol, (5, 8, 8)), codec="blosc"), f"file://{tmp_path}")
    back = {r.cz: r.data for r in arrays.read_chunks(spark, f"file://{tmp_path}").collect()}
    assert b"".join(bytes(back[k]) for k in (0, 1)) == vol.tobytes()


def test_gather_from_voxels_and_chunks(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 255, (20, 24, 28)).astype(np.uint8)
    chunks = arrays.chunk_rows(spark, v, (8, 8, 8))
    pts = rng.uniform(0, 1, (200, 3)) * (np.array(v.shape) - 1.001)
    P = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "key long, z double, y double, x double")
    a = {r.key: r.value for r in volume.gather_chunks(P, chunks, (8, 8, 8), "key").collect()}
    b = {r.key: r.value for r in volume.gather(P, volume.explode_chunks(chunks, (8, 8, 8)), "key").collect()}
    for k, p in enumerate(pts):
        lo, f = np.floor(p).astype(int), p - np.floor(p)
        want = sum(v[tuple(lo + d)] * np.prod([f[i] if d[i] else 1 - f[i] for i in range(3)]) for d in np.ndindex(2, 2, 2))
        assert a[k] == pytest.approx(want) and b[k] == pytest.approx(want)


def test_spatial_joins(spark):
    rng = np.random.default_rng(3)
    P = rng.uniform(0, 100, (60, 3))
    S = rng.uniform(0, 100, (80, 3))
    mk = lambda a, key: spark.createDataFrame([(k, 1, *map(float, p)) for k, p in enumerate(a)], f"{key} long, winding int, x double, y double, z double")
    got = {r.key: r.distance for r in spatial.nearest_vertex(mk(P, "key"), mk(S, "s").drop("s"), 5.0).collect()}
    want = np.sqrt(((P[:, None] - S[None]) ** 2).sum(-1)).min(1)
    assert [got[k] for k in range(60)] == pytest.approx(want.tolist())
    tri = rng.uniform(0, 60, (40, 3, 3))
    tri[0] *= 6
    d = rng.normal(size=(30, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    o = rng.uniform(0, 60, (30, 3))
    vec = lambda p: dict(zip("zyx", map(float, p), strict=True))
    T = spark.createDataFrame([(1, k, vec(t[0]), vec(t[1]), vec(t[2])) for k, t in enumerate(tri)], "winding int, tri_id long, " + ", ".join(f"{v} struct<z:double,y:double,x:double>" for v in ("v0", "v1", "v2")))
    R = spark.createDataFrame([(k, vec(a), vec(b), 100.0) for k, (a, b) in enumerate(zip(o, d, strict=True))], "ray_id long, origin struct<z:double,y:double,x:double>, direction struct<z:double,y:double,x:double>, length double")
    got = {(r.ray_id, r.tri_id): r.t for r in spatial.ray_triangle_hits(R, T, 16.0).collect()}
    want = {}
    for i in range(30):
        for j in range(40):
            m = np.stack([tri[j, 1] - tri[j, 0], tri[j, 2] - tri[j, 0], -d[i]], axis=1)
            u, v, t = np.linalg.solve(m, o[i] - tri[j, 0])
            if u >= 0 and v >= 0 and u + v <= 1 and 0 <= t <= 100:
                want[i, j] = t
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_mesh_holes(spark):
    rows = [(1, r, c, 20.0 * c, 20.0 * r, 5.0, (r, c) != (2, 2)) for r in range(5) for c in range(5)]
    m = spark.createDataFrame(rows, "winding int, r int, c int, x double, y double, z double, valid boolean")
    assert ms.normals_interior(m).count() == 9 - 5 and ms.normals_onesided(m).count() == 24
    assert ms.triangulate(m).count() == 32 - 6
    assert {(r.r, r.c) for r in ms.full_blocks(m, 2, 1).collect()} == {(r, c) for r in range(4) for c in range(4)} - {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert ms.with_validity(m.withColumn("x", F.when(F.col("r") == 0, float("nan")).otherwise(F.col("x"))), "nonnegative").where("valid").count() == 20


def test_sources_round_trip(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 255, (20, 16, 16)).astype(np.uint8)
    v[:8, :8, :8] = 0
    root = tmp_path / "vol"
    root.mkdir()
    (root / ".zarray").write_text('{"shape": [20, 16, 16], "chunks": [8, 8, 8], "dtype": "|u1", "order": "C", "compressor": {"id": "zlib"}, "fill_value": 0, "filters": null, "zarr_format": 2, "dimension_separator": "/"}')
    assert arrays.save_files(arrays.chunk_files(arrays.chunk_rows(spark, v, (8, 8, 8)), "/"), str(root)) == 11
    back = volume.explode_chunks(arrays.read_chunks(spark, f"file://{root}"), (8, 8, 8)).where("z < 20").toPandas()
    grid = np.zeros_like(v)
    grid[back["z"], back["y"], back["x"]] = back["v"]
    assert (grid == v).all()
    assert arrays.read_chunks(spark, f"file://{root}", (16, 20)).select("cz").distinct().collect()[0].cz == 2
    rows = [(w, r, c, float(c), float(r), 3.0 + w, (r, c) != (0, 0)) for w in (7, 12) for r in range(4) for c in range(3)]
    mesh = spark.createDataFrame(rows, "winding int, r int, c int, x double, y double, z double, valid boolean")
    arrays.save_files(arrays.mesh_files(mesh), str(tmp_path / "mesh"))
    again = arrays.read_meshes(spark, f"file://{tmp_path}/mesh")
    assert again.where("valid").select("winding", "r", "c", "x", "y", "z").exceptAll(mesh.where("valid").select("winding", "r", "c", "x", "y", "z")).count() == 0 and again.count() == 24
    image = rng.normal(size=(5, 7)).astype("f4")
    assert (arrays.decode_tiff(arrays.encode_tiff(image)) == image).all()


def test_store_round_trip(spark, tmp_path):
    point = "struct<z:double,y:double,x:double>"
    rows = [("s0", k, (1.0 * k, 2.0, 3.0), (0.0, 0.5, 0.0), 5, [(float(t), t) for t in range(k)]) for k in range(4)]
    rays_ = spark.createDataFrame(rows, f"shard string, row long, origin {point}, step {point}, seed_winding int, crossings array<struct<t:double,level:int>>")
    files = arrays.store_files(rays_).collect()
    names = {f.path: f for f in files}
    for f in files:
        (tmp_path / f.path).parent.mkdir(exist_ok=True)
        (tmp_path / f.path).write_bytes(bytes(f.content))
    manifest = {"shards": [{"name": "s0", "arrays": {p.split("/")[1][:-4]: {"file": p.split("/")[1], "sha256": f.sha256} for p, f in names.items()}}], "elapsed_seconds": 3}
    import json

    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    back = {r.row: r for r in arrays.read_store(spark, f"file://{tmp_path}").collect()}
    assert len(back) == 4 and [len(back[k].crossings) for k in range(4)] == [0, 1, 2, 3] and back[3].origin.z == 3.0
    assert arrays.fingerprint(manifest) == arrays.fingerprint(manifest | {"elapsed_seconds": 9}) != arrays.fingerprint({"shards": []})


def test_logs(spark, tmp_path):
    assert text.literals("BLOCK a {'n': 1, 's': '}'} {'x': None} {bad") == [{"n": 1, "s": "}"}, {"x": None}]
    (tmp_path / "log.txt").write_text("noise\nBLOCK w001 {'n': 3}\n")
    row = text.read_log(spark, f"file://{tmp_path}/log.txt", r"^BLOCK (\S+)", ("name",)).first()
    assert row.name == "w001" and row.objects == ['{"n": 3}']
    lines = spark.createDataFrame([(1, 1, "x"), (1, 2, '{"a":1}'), (1, 3, '{"a":2}'), (1, 4, "end")], "run int, line_no int, value string")
    assert text.last_object(lines, "run").first().value == '{"a":2}'


def test_offsets_flow(spark):
    gaps = sequence.gaps(spark.createDataFrame([(1, 1.0), (1, 4.0), (1, 9.0), (2, 5.0)], "ray_id int, t double"))
    assert sorted(r.gap for r in gaps.collect()) == [3.0, 5.0]
    runs = sequence.integer_runs(spark.createDataFrame([(1, k) for k in (3, 4, 5, 9, 11, 12)], "g int, k int"), "g", "k")
    assert sorted((r.first, r.last, r.n) for r in runs.collect()) == [(3, 5, 3), (9, 9, 1), (11, 12, 2)]


def test_rows_blocks_and_rays_by_place(spark):
    from pyspark.sql import functions as F

    from sheafray.operators import mesh as ms

    grid = spark.createDataFrame([(w, r, c, 1.0 * c, 1.0 * r, 100.0 * r, (w, r, c) != (1, 4, 2)) for w in (1, 2) for r in range(9) for c in range(5)], "winding int, r int, c int, x double, y double, z double, valid boolean")
    assert {(x.winding, x.r) for x in ms.band_rows(grid, 300.0, 350.0, 40.0).collect()} == {(w, r) for w in (1, 2) for r in (2, 3, 4)}
    assert ms.band_rows(grid, 5000.0, 6000.0).collect() == []
    blocks = ms.full_blocks(grid, 2, 1)
    for w, n in ((1, 28), (2, 32)):
        every = sorted((x.r, x.c) for x in blocks.where(F.col("winding") == w).collect())
        assert len(every) == n
        assert sorted((x.r, x.c) for x in ms.spaced_blocks(blocks, 3).where(F.col("winding") == w).collect()) == [every[0], every[(n - 1) // 2], every[-1]]
    assert [x.winding for x in ms.quantile_windings(grid, (0.2, 0.8)).orderBy("winding").collect()] == [1, 2]
    rays = spark.range(200).select("id", F.struct(*[((F.col("id") * k) % 100).cast("double").alias(a) for a, k in (("z", 7), ("y", 13), ("x", 29))]).alias("origin"))
    dealt = spatial.by_locality(rays, 10.0, 4).withColumn("p", F.spark_partition_id()).collect()
    key = [(x.p, x.origin.z // 10, x.origin.y // 10, x.origin.x // 10) for x in dealt]
    assert len(key) == 200 and key == sorted(key) and len({k[0] for k in key}) == 4
