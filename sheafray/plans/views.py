"""The domain's tables derived from the bundled test tables, for the queries.

PT: ``events`` as positions on rays. PROF: ``embeddings`` as profiles. MESH:
``embeddings`` as one grid mesh per label. VOX: ``embeddings`` as a voxel
block. LAB: labelled scores. Each has the same definition in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Control points of the axis: z, y, x.
AXIS = ((0.0, 300.0, 500.0), (1000.0, 340.0, 620.0), (2000.0, 280.0, 700.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ray_id, t (hours), raw, kind, event_id."""
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 3.6e9D")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ray_id"), hours.alias("t"), F.col("value").cast("double").alias("raw"), F.col("event_type").alias("kind"), "event_id")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prof_id, winding, i, t, raw."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("prof_id"), F.col("label").alias("winding"), F.posexplode("embedding").alias("i", "e"))
    return e.select("prof_id", "winding", "i", (F.col("i") * F.lit(0.5)).alias("t"), (128 + 200 * F.col("e").cast("double")).alias("raw"))


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """winding, r, c, x, y, z, valid."""
    rows = table(spark, sf_dir, "embeddings").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    e = rows.select(F.col("label").alias("winding"), "r", F.posexplode("embedding").alias("c", "e"))
    v = F.col("e").cast("double")
    return e.select("winding", "r", "c", (20.0 * F.col("c")).alias("x"), (20.0 * F.col("r")).alias("y"), (1000 + 40 * v).alias("z"), (v > -0.2).alias("valid"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, y, x, v (0 to 255)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("z"), F.posexplode("embedding").alias("i", "e"))
    v = F.floor(F.least(F.greatest(128 + 200 * F.col("e").cast("double"), F.lit(0.0)), F.lit(255.0))).cast("int")
    return e.select("z", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("v"))


def axis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AXIS, "z double, y double, x double")


PT = "pt AS (SELECT user_id AS ray_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3.6e9::DOUBLE AS t, value::DOUBLE AS raw, event_type AS kind, event_id FROM events)"
PROF = "prof AS (SELECT vec_id AS prof_id, label AS winding, i, i * 0.5::DOUBLE AS t, 128 + 200 * embedding[i + 1]::DOUBLE AS raw FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding)))::INT AS i FROM embeddings))"
MESH = "mesh AS (SELECT winding, r, c, 20.0::DOUBLE * c AS x, 20.0::DOUBLE * r AS y, 1000 + 40 * e AS z, e > -0.2 AS valid FROM (SELECT label AS winding, r, i AS c, embedding[i + 1]::DOUBLE AS e FROM (SELECT label, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS r, unnest(range(len(embedding)))::INT AS i FROM embeddings)))"
VOX = "vox AS (SELECT z, (i // 8)::INT AS y, (i % 8)::INT AS x, floor(least(greatest(128 + 200 * e, 0.0), 255.0))::INT AS v FROM (SELECT vec_id::INT AS z, i, embedding[i + 1]::DOUBLE AS e FROM (SELECT vec_id, embedding, unnest(range(len(embedding)))::INT AS i FROM embeddings)))"
UMB = "umb AS (SELECT * FROM (VALUES " + ", ".join(f"({z}::DOUBLE, {y}::DOUBLE, {x}::DOUBLE)" for z, y, x in AXIS) + ") AS a(z, y, x))"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def interp_cte(name: str, points_: str, knots: str, keys: str = "ray_id") -> str:
    """SQL of ``operators.sequence.interpolate_at`` by two as-of joins."""
    return f"""{name} AS (SELECT q.*, CASE WHEN a.t IS NULL THEN b.v WHEN b.t IS NULL OR a.t = q.t OR a.t = b.t THEN a.v
      ELSE a.v + (q.t - a.t) * ((b.v - a.v) / (b.t - a.t)) END AS v
    FROM {points_} q ASOF LEFT JOIN {knots} a ON q.{keys} = a.{keys} AND q.t >= a.t
    ASOF LEFT JOIN {knots} b ON q.{keys} = b.{keys} AND q.t <= b.t)"""
