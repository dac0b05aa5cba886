"""Operators on voxel tables (z, y, x, v) and on chunk rows of a 3-D array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import trilinear_weight


def chunk_of(value: Column, size: int) -> Column:
    return F.floor(value / size).cast("int")


def corners(points: DataFrame, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """The up to eight voxels (iz, iy, ix) around each point with their
    trilinear weight w; corners of weight zero are left out."""
    base = points
    for k, a in enumerate("zyx"):
        low = F.floor(a).cast("int")
        base = base.withColumn(f"_{a}0", F.least(F.greatest(low, F.lit(0)), F.lit(shape[k] - 2)) if shape else low)
        base = base.withColumn(f"_f{a}", F.col(a) - F.col(f"_{a}0"))
    bits = F.explode(F.array(*[F.struct(*[F.lit(n >> k & 1).alias(a) for k, a in enumerate("zyx")]) for n in range(8)]))
    c = base.withColumn("_b", bits)
    w = trilinear_weight(F.col("_fz"), F.col("_b.z")) * trilinear_weight(F.col("_fy"), F.col("_b.y")) * trilinear_weight(F.col("_fx"), F.col("_b.x"))
    c = c.withColumn("w", w).where("w <> 0")
    return c.select(*points.columns, *[(F.col(f"_{a}0") + F.col(f"_b.{a}")).alias(f"i{a}") for a in "zyx"], "w")


def gather(points: DataFrame, voxels: DataFrame, key: str, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Trilinear samples of a voxel table at points (key, z, y, x): an
    equi-join of corners with voxels and a weighted sum; a missing voxel is 0."""
    c = corners(points, shape)
    v = voxels.select(F.col("z").alias("iz"), F.col("y").alias("iy"), F.col("x").alias("ix"), F.col("v").cast("double").alias("v"))
    return c.join(v, ["iz", "iy", "ix"], "left").groupBy(key).agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0.0))).alias("value"))


def sample_coords(points: DataFrame, voxels: DataFrame, key: str, shape: tuple[int, int, int], sampling: str = "trilinear", z_range: tuple[float, float] | None = None) -> DataFrame:
    """``points`` (key, z, y, x, and ``ok`` if there is a mask) with ``value``,
    a whole number from 0 to 255, and ``inside``: whether the point lies in the
    volume (in the slices of ``z_range``, half-open, if given) and is not masked.

    "trilinear" values are rounded half up, "nearest" takes the voxel whose
    place is nearest, halves to the even one. Outside points have the value 0,
    as have missing voxels.
    """
    fit = [F.col(a).between(0, n - 1) for a, n in zip("zyx", shape, strict=True)]
    if z_range:
        fit.append(F.col("z").between(z_range[0], z_range[1] - 1))
    if "ok" in points.columns:
        fit.append(F.col("ok"))
    inside = F.lit(True)
    for f in fit:
        inside = inside & F.coalesce(f, F.lit(False))
    told = points.withColumn("inside", inside)
    if sampling == "nearest":
        v = voxels.select(*[F.col(a).cast("int").alias(f"_i{a}") for a in "zyx"], F.col("v").cast("double").alias("_v"))
        placed = told.withColumns({f"_i{a}": F.when(F.col("inside"), F.rint(a)).cast("int") for a in "zyx"})
        found = placed.join(v, ["_iz", "_iy", "_ix"], "left").drop("_iz", "_iy", "_ix")
    elif sampling == "trilinear":
        values = gather(told.where("inside").select(key, "z", "y", "x"), voxels, key)
        found = told.join(values.withColumnRenamed("value", "_v"), key, "left")
    else:
        raise ValueError(f"sampling {sampling} is not known")
    value = F.floor(F.least(F.greatest(F.coalesce("_v", F.lit(0.0)), F.lit(0.0)), F.lit(255.0)) + 0.5)
    return found.withColumn("value", F.least(value, F.lit(255)).cast("int")).drop("_v")


def gather_chunks(points: DataFrame, chunks: DataFrame, chunk: tuple[int, int, int], key: str, dtype: str = "uint8") -> DataFrame:
    """The same from chunk rows (cz, cy, cx, data): each corner goes to its
    chunk and is looked up there, so a chunk moves once whatever number of
    points it serves. Partial sums meet by the point's key."""
    c = corners(points)
    c = c.withColumns({f"c{a}": chunk_of(F.col(f"i{a}"), n) for a, n in zip("zyx", chunk, strict=True)})
    sent = c.select(F.col(key).alias("key"), "iz", "iy", "ix", "w", "cz", "cy", "cx")

    def look(pts, held):
        import numpy as np
        import pandas as pd

        if not len(pts):
            return pd.DataFrame({"key": pd.Series([], dtype="int64"), "part": pd.Series([], dtype="float64")})
        value = np.zeros(len(pts))
        if len(held):
            block = np.frombuffer(held["data"].iloc[0], dtype).reshape(chunk)
            value = block[tuple(pts[f"i{a}"].to_numpy() % n for a, n in zip("zyx", chunk, strict=True))].astype(float)
        return pd.DataFrame({"key": pts["key"], "part": pts["w"].to_numpy() * value})

    by = ["cz", "cy", "cx"]
    parts = sent.groupBy(*by).cogroup(chunks.groupBy(*by)).applyInPandas(look, "key long, part double")
    return parts.groupBy(F.col("key").alias(key)).agg(F.sum("part").alias("value"))


def box(voxels: DataFrame, z: tuple[int, int], y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Voxels of a half-open box; plain range filters reach the scan."""
    return voxels.where(F.col("z").between(z[0], z[1] - 1) & F.col("y").between(y[0], y[1] - 1) & F.col("x").between(x[0], x[1] - 1))


def chunk_keys(points: DataFrame, chunk: tuple[int, int, int]) -> DataFrame:
    """Distinct chunks that the points' corners touch."""
    c = corners(points)
    return c.select(*[chunk_of(F.col(f"i{a}"), n).alias(f"c{a}") for a, n in zip("zyx", chunk, strict=True)]).distinct()


def missing_chunks(needed: DataFrame, present: DataFrame) -> DataFrame:
    return needed.join(present, ["cz", "cy", "cx"], "left_anti")


def explode_chunks(chunks: DataFrame, chunk: tuple[int, int, int], dtype: str = "uint8") -> DataFrame:
    """Chunk rows to voxel rows, for small boxes and tests."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for rows in batches:
            for cz, cy, cx, data in zip(rows["cz"], rows["cy"], rows["cx"], rows["data"], strict=True):
                block = np.frombuffer(data, dtype).reshape(chunk)
                z, y, x = np.indices(chunk).reshape(3, -1)
                yield pd.DataFrame({"z": z + cz * chunk[0], "y": y + cy * chunk[1], "x": x + cx * chunk[2], "v": block.ravel().astype("int32")})

    return chunks.select("cz", "cy", "cx", "data").mapInPandas(run, "z int, y int, x int, v int")


def density_rewrite(voxels: DataFrame, mode: str, value: float = 0.0, low: float = 0.0, high: float = 255.0, core: Column | None = None) -> DataFrame:
    """Rewrite a density field (0 is invalid): "constant" sets every valid
    voxel, "clamp" bounds it; where ``core`` holds it becomes invalid."""
    v = F.col("v")
    new = F.lit(value) if mode == "constant" else F.least(F.greatest(v.cast("double"), F.lit(low)), F.lit(high))
    out = F.when(v == 0, F.lit(0.0)).otherwise(new.cast("double"))
    return voxels.withColumn("v", F.when(core, F.lit(0.0)).otherwise(out) if core is not None else out)


def plane_points(spark, rows: int, columns: int, origin: tuple, along_row: tuple, along_column: tuple) -> DataFrame:
    """Points of an affine plane: key, i, j, z, y, x."""
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    grid = spark.range(rows * columns).select(F.col("id").alias("key"), F.floor(F.col("id") / columns).cast("int").alias("i"), (F.col("id") % columns).cast("int").alias("j"))
    return grid.select("key", "i", "j", *[(F.lit(float(o)) + i * float(a) + j * float(b)).alias(n) for n, o, a, b in zip("zyx", origin, along_row, along_column, strict=True)])


def along_normals(vertices: DataFrame, reach: float, step: float = 1.0) -> DataFrame:
    """Sample points at offsets -reach..reach along each vertex's normal:
    adds off, and pz, py, px."""
    n = int(round(2 * reach / step))
    moved = vertices.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("off", F.col("_n") * F.lit(step) - F.lit(reach)).drop("_n")
    return moved.withColumns({f"p{a}": F.col(a) + F.col("off") * F.col(f"n{a}") for a in "zyx"})


def void_fraction(samples: DataFrame, threshold: Column) -> DataFrame:
    """Vertices all of whose samples are inside (above 0) and none of which
    reaches the threshold, as a share by winding: (winding, vertex, value)."""
    v = samples.groupBy("winding", "vertex").agg(F.max("value").alias("top"), F.min("value").alias("low"))
    inside = F.col("low") > 0
    void = inside & (F.col("top") < threshold)
    return v.groupBy("winding").agg(F.sum(void.cast("int")).alias("void"), F.sum(inside.cast("int")).alias("inside"))
