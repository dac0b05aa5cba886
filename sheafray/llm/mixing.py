"""Mixing sources to target weights (operator 9): hash-threshold histograms.

Each source gets a target of words. A document is taken ``floor(target /
source size)`` times, and once more if its hash lies at or below the source's
threshold. Thresholds are nested budgets: sums of words by source and hash
bucket give, by a running sum, the bucket in which the budget runs out; only
that bucket is split again, until one hash value is left. Nothing is sorted by
document, no document moves to be selected, and a larger budget of the same
source keeps every document a smaller one keeps.

Defined cases: a null text has no words; a null source is a source of its own,
last in order; a document with a null id is placed by its text; repeated rows
share a hash and are taken alike; a source without words has the target 0; an
empty table gives no rows; further columns are not read by ``mix`` and are
carried whole, under their own names, by ``mix_stage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, n_words_of

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5, 2, 1)
#: A source's target is at most so many times its size.
MAX_REPEATS = 3
HASH_BITS = 60
#: Bits that each level of the histogram resolves.
LEVEL_BITS = 12


def place(doc_id: Column, text: Column) -> Column:
    """A document's hash, 60 bits of an MD5 so that any SQL engine agrees."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """Targets from one row (source, source_size) per source.

    ``share`` of all words is dealt by weight; what a source cannot take,
    beyond ``MAX_REPEATS`` times its size, is dealt again by weight among the
    others until none is above. In closed form: with sources in order of cap /
    weight, the first prefix whose remaining budget per remaining weight does
    not exceed the next ratio is capped, and the others get that level times
    their weight. One row per source passes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.lit(MAX_REPEATS) * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    level = ranked.withColumn(
        "level",
        (F.lit(float(share)) * F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    ).withColumn("fits", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    water = F.max("fits").over(everything)
    return level.select("source", "source_size", F.when(F.col("ratio") <= F.coalesce(water, F.col("ratio")), F.col("cap")).otherwise(water * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source the times all is taken (``whole``) and the largest
    hash that is taken once more (``last``), -1 if none.

    ``sized`` has source, size, place. Each level sums words by source and the
    next bits, so what is shuffled is sums; the running sum of a source runs
    over at most 2**LEVEL_BITS buckets. Levels stop once every source's
    boundary bucket holds a single hash value.
    """
    spark = sized.sparkSession
    todo = plan.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("whole"),
    ).withColumn("left", F.col("target") - F.col("whole").cast("double") * F.col("source_size").cast("double"))
    bounds = todo.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    bits, within = 0, sized.select("source", "size", "place")
    while bits < HASH_BITS:
        step = min(LEVEL_BITS, HASH_BITS - bits)
        rest = HASH_BITS - bits - step
        cut = bounds.where("left > 0").select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        inside = within.join(cut, within["source"].eqNullSafe(F.col("s")) & (F.shiftright("place", HASH_BITS - bits) == F.col("p"))).drop("s", "p")
        sums = inside.groupBy("source", F.shiftright("place", rest).alias("bucket")).agg(F.sum("size").alias("words"), F.min("place").alias("lo"), F.max("place").alias("hi"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        run = sums.withColumn("ahead", F.coalesce(F.sum("words").over(run), F.lit(0)))
        b = bounds.alias("b")
        found = (
            b.join(run.alias("r"), F.col("b.source").eqNullSafe(F.col("r.source")), "left")
            .where((F.col("b.left") <= 0) | F.col("r.bucket").isNull() | ((F.col("b.before") + F.col("r.ahead") <= F.col("b.left")) & (F.col("b.before") + F.col("r.ahead") + F.col("r.words") > F.col("b.left"))))
            .select("b.source", "b.source_size", "b.target", "b.whole", "b.left", F.coalesce("r.bucket", F.lit(-1)).cast("long").alias("prefix"), (F.col("b.before") + F.coalesce("r.ahead", F.lit(0))).alias("before"), F.col("r.words").alias("words"), "r.lo", "r.hi")
        )
        bounds = materialize(found, "mix-bounds")
        bits += step
        if not bounds.where("left > 0 and lo < hi").head(1):
            break
    last = F.when(F.col("left") <= 0, F.lit(-1)).when(F.col("lo").isNull(), F.lit(-1)).when(2 * (F.col("left") - F.col("before")) > F.col("words"), F.col("hi")).otherwise(F.col("lo") - 1)
    return bounds.select("source", "source_size", "target", "whole", last.cast("long").alias("last"))


def _plan(docs: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    sized = materialize(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("place")), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, thresholds(sized, targets(sizes, share))


def _copies(place_column: Column) -> Column:
    return (F.col("whole") + F.when(place_column <= F.col("last"), F.lit(1)).otherwise(F.lit(0))).cast("long")


def mix(docs: DataFrame, share: float = 1.0) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized, cuts = _plan(docs, share)
    d, c = sized.alias("d"), cuts.alias("c")
    return d.join(c, F.col("d.source").eqNullSafe(F.col("c.source"))).select("d.doc_id", "d.size", "c.source_size", "c.target", (F.col("d.size") * _copies(F.col("d.place"))).alias("taken"))


def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the mix of all documents."""
    return mix(documents(spark, sf_dir))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it."""
    _, cuts = _plan(docs, 1.0)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").alias("_source"), place(F.col("doc_id"), F.col("text")).alias("_place"))
    taken = rows.join(cuts.select(F.col("source").alias("_s"), "whole", "last"), F.col("_source").eqNullSafe(F.col("_s"))).withColumn("_copies", _copies(F.col("_place"))).where("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size::DOUBLE AS cap, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
v AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN ratio <= coalesce(water, ratio) THEN cap ELSE water * weight END AS target FROM v),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
x AS (SELECT d.doc_id, d.size, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS remaining,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.place) AS own
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * (remaining - (upto - own)) > own THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
