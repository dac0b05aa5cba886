"""Joins of values that are equal but for a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_within(left: DataFrame, right: DataFrame, columns: dict[str, float], *by: str, relative: float = 0.0) -> DataFrame:
    """Rows of ``left`` with each row of ``right`` as the struct ``other`` whose
    ``columns`` differ by at most their tolerance (and ``relative`` times the
    right value) and whose ``by`` are equal; each pair once.

    The right side lies in one cell of a grid twice as wide as the tolerance,
    the left side in the at most two cells an axis that its ball touches, so
    the join is an equality. Rows with a null or non-finite value match none.
    """
    fine = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    for c in columns:
        left, right = left.where(fine(c)), right.where(fine(c))
    reach = dict(columns)
    if relative:
        # One row.
        most = right.agg(*[F.max(F.abs(c)).alias(c) for c in columns]).first()
        reach = {c: t + relative * float(most[c] or 0.0) for c, t in columns.items()}
    cells, asked, placed = [], left, right.select(*by, F.struct(*right.columns).alias("other"))
    for c in columns:
        # A tolerance of zero still needs a cell; neighbours are then one.
        wide = 2 * reach[c] * (1 + 1e-9) or 1.0
        cell = f"_cell_{c}"
        asked = asked.withColumn(cell, F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) + s * reach[c] * (1 + 1e-9)) / wide) for s in (-1, 1)]))))
        placed = placed.withColumn(cell, F.floor(F.col(f"other.{c}") / wide))
        cells.append(cell)
    met = asked.join(placed, [*by, *cells]).drop(*cells)
    for c, t in columns.items():
        met = met.where(F.abs(F.col(c) - F.col(f"other.{c}")) <= t + relative * F.abs(F.col(f"other.{c}")))
    return met


def compare_stores(derived: DataFrame, stored: DataFrame, origin: float = 1e-3, along: float = 0.02, relative: float = 1e-5) -> DataFrame:
    """Whether rays derived again are those of a store: (ray_id, stored_id,
    n_derived, n_stored, status), a row for each derived ray.

    Both have ray_id, z, y, x and crossings (an array of t and level). A ray's
    counterpart is the first stored one with the same origin within the
    tolerance; "match" says that both have the same crossings in order, t
    within its tolerance and levels equal, "diff" that they have not, "no ray"
    that there is no counterpart.
    """
    found = match_within(derived.select("ray_id", "z", "y", "x"), stored.select("ray_id", "z", "y", "x"), dict.fromkeys("zyx", origin), relative=relative)
    pair = found.groupBy("ray_id").agg(F.min("other.ray_id").alias("stored_id"))
    held = stored.select(F.col("ray_id").alias("stored_id"), F.col("crossings").alias("theirs"))
    both = derived.select("ray_id", "crossings").join(pair, "ray_id", "left").join(held, "stored_id", "left")
    near = lambda a, b: (F.abs(a["t"] - b["t"]) <= along + relative * F.abs(a["t"])) & (a["level"] == b["level"])
    same = (F.size("crossings") == F.size("theirs")) & F.forall(F.zip_with("crossings", "theirs", near), lambda x: F.coalesce(x, F.lit(False)))
    status = F.when(F.col("stored_id").isNull(), "no ray").when(F.coalesce(same, F.lit(False)), "match").otherwise("diff")
    return both.select("ray_id", "stored_id", F.size("crossings").alias("n_derived"), F.coalesce(F.when(F.col("theirs").isNotNull(), F.size("theirs")), F.lit(0)).alias("n_stored"), status.alias("status"))


def path_order(rows: DataFrame, ray: str = "ray_id") -> DataFrame:
    """Rows (ray, t, level) gathered by ray as ``crossings`` in order of t;
    a ray has a few thousand at most."""
    return rows.groupBy(ray).agg(F.array_sort(F.collect_list(F.struct("t", "level"))).alias("crossings"))


def levelled(rows: DataFrame, ray: str = "ray_id", t: str = "t") -> DataFrame:
    """``rows`` with ``level``, their number along the ray."""
    return rows.withColumn("level", F.row_number().over(Window.partitionBy(ray).orderBy(t)))
