"""Queries over voxels (view VOX) and over the other test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import binomial_se, share
from ..operators import statistics as st
from ..operators import volume as vo
from .ray_queries import _rounded
from .views import PT, VOX, points, table, voxels, with_

CHUNK = (16, 4, 4)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample points, one an event: key, z, y, x."""
    e = points(spark, sf_dir)
    part = lambda k, m: F.col("event_id") * k % 1000 / 1000.0 * m
    return e.select(F.col("event_id").alias("key"), part(7, 497.93171).alias("z"), part(13, 6.48713).alias("y"), part(29, 6.47917).alias("x"))


_PLACES = "pl AS (SELECT event_id AS key, event_id * 7 % 1000 / 1000.0::DOUBLE * 497.93171::DOUBLE AS z, event_id * 13 % 1000 / 1000.0::DOUBLE * 6.48713::DOUBLE AS y, event_id * 29 % 1000 / 1000.0::DOUBLE * 6.47917::DOUBLE AS x FROM pt)"
_CORNERS = "co AS (SELECT * FROM (SELECT key, floor(z)::INT + a AS iz, floor(y)::INT + b AS iy, floor(x)::INT + c AS ix, (CASE a WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) * (CASE b WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE c WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM pl, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)) WHERE w <> 0)"


def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vo.chunk_keys(_places(spark, sf_dir), CHUNK)


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the volume but for every fifth layer of them."""
    v = voxels(spark, sf_dir)
    return v.select(*[vo.chunk_of(F.col(a), n).alias(f"c{a}") for a, n in zip("zyx", CHUNK, strict=True)]).distinct().where("cz % 5 <> 2")


def chunk_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the points need and the volume lacks."""
    return vo.missing_chunks(chunk_keys(spark, sf_dir), _present(spark, sf_dir))


def trilinear_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(vo.gather(_places(spark, sf_dir), voxels(spark, sf_dir), "key"))


def box_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = vo.box(voxels(spark, sf_dir), (10, 60), (2, 6), (1, 7))
    return _rounded(b.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("sum_v"), F.max("v").alias("max_v")))


def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.otsu(voxels(spark, sf_dir).where("v > 0"), "v"))


def void_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of voxels that no sample of reaches the threshold, by layer
    block, and over all by a rollup of the counts, not of the shares."""
    v = voxels(spark, sf_dir).select((F.col("z") % 10).alias("winding"), (F.col("z") * 8 + F.col("y")).alias("vertex"), F.col("v").cast("double").alias("value"))
    by = vo.void_fraction(v, F.lit(150.0))
    out = by.rollup("winding").agg(F.sum("void").alias("void"), F.sum("inside").alias("inside"))
    return _rounded(out.select(F.coalesce("winding", F.lit(-1)).alias("winding"), "void", "inside", (F.col("void") / F.greatest("inside", F.lit(1))).alias("void_frac")))


def density_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels(spark, sf_dir).withColumn("v", F.when(F.col("v") % 7 == 0, 0).otherwise(F.col("v")))
    core = (F.col("y") - 3.5) * (F.col("y") - 3.5) + (F.col("x") - 3.5) * (F.col("x") - 3.5) < 2.0
    c = vo.density_rewrite(v, "clamp", low=60.0, high=200.0, core=core)
    k = vo.density_rewrite(v, "constant", value=62.5).select("z", "y", "x", F.col("v").alias("k"))
    return _rounded(c.join(k, ["z", "y", "x"]).groupBy("y", "x").agg(F.sum("v").alias("clamped"), F.sum("k").alias("constant"), F.sum(F.when(F.col("v") == 0, 1).otherwise(0)).alias("invalid")))


def zero_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a voxel that is not dark: what a sparse store keeps."""
    v = voxels(spark, sf_dir)
    by = [vo.chunk_of(F.col(a), n).alias(f"c{a}") for a, n in zip("zyx", (1, 4, 4), strict=True)]
    return v.groupBy(*by).agg(F.max("v").alias("top"), F.count(F.lit(1)).alias("n")).where("top >= 200")


def percentile_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {"p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("v"))
    rows = line.withColumn("of", F.lit("line")).unionByName(orders.withColumn("of", F.lit("orders")))
    return _rounded(st.exact_percentiles(rows, "v", q, "of", "grp").drop("of"), 4)


def histogram_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 50.0, 10, "l_returnflag")


def label_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results table: counts by nation with the region's label where there
    is one, thousands separated. A dimension joins by Spark's own choice."""
    region = table(spark, sf_dir, "region").where("r_regionkey < 3")
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean"))
    j = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    row = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.coalesce("r_name", F.lit("-")), F.lit(" | "), F.format_number(F.col("n") * 1000, 0), F.lit(" |"))
    return _rounded(j.select("n_name", F.coalesce("r_name", F.lit("-")).alias("label"), "n", F.col("mean").alias("mean_balance"), row.alias("line")), 4)


def jobs_cross_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of runs times windings, each with the first variant there is:
    spliced, then plain."""
    runs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run"))
    windings = spark.range(10, 20).select(F.col("id").alias("winding"))
    parts = table(spark, sf_dir, "part")
    files = parts.select((F.col("p_partkey") % 5 + 1).alias("run"), (F.col("p_size") % 12 + 8).cast("long").alias("winding"), F.when(F.col("p_size") % 3 == 0, "spliced").otherwise("plain").alias("variant")).distinct()
    order = F.array_position(F.array(F.lit("spliced"), F.lit("plain")), F.col("variant"))
    jobs = runs.crossJoin(F.broadcast(windings)).join(files, ["run", "winding"], "left")
    first = F.row_number().over(Window.partitionBy("run", "winding").orderBy(order))
    return jobs.withColumn("_r", first).where("_r = 1").select("run", "winding", F.coalesce("variant", F.lit("missing")).alias("variant"))


def shard_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and SHA-256 of every document as a shard file."""
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of JSON lines, by kind."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return _rounded(e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("sum_k"), F.avg("k").alias("mean_k")))


def log_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern out of log-like text: its first match in each turn, and how
    many there are."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract(F.coalesce("text", F.lit("")), r"([a-z]+ing)", 1).alias("first_match"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([a-z]+ing)"), 1)).cast("long").alias("matches"))
    return t.where("matches > 0")


def last_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each role in a conversation: last match by order."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.max_by(F.octet_length("text"), "turn").cast("long").alias("bytes"), F.max("turn").alias("turn"))
    return c


def majority_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(st.majority(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_returnflag"))


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windings dealt round-robin to four workers: numbered within ranges of
    keys, after the count of the ranges before."""
    ids = table(spark, sf_dir, "part").select("p_partkey").withColumn("range", F.floor(F.col("p_partkey") / 10_000))
    # One row a range.
    before = ids.groupBy("range").agg(F.count(F.lit(1)).alias("own")).select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    k = ((F.row_number().over(Window.partitionBy("range").orderBy("p_partkey")) - 1 + F.col("before")) % 4).cast("int")
    return ids.join(before, "range").withColumn("worker", k).groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("sum_key"))


def first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of candidate spacings the first whose cost fits a budget, else the
    last, for several budgets."""
    cost = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 6).alias("spacing")).agg(F.sum("o_totalprice").alias("cost"))
    budgets = cost.agg(F.array(*[F.max("cost") * f for f in (0.5, 0.97, 1.0)]).alias("b")).select(F.posexplode("b").alias("which", "budget"))
    c = cost.crossJoin(F.broadcast(budgets))
    best = F.row_number().over(Window.partitionBy("which").orderBy(F.when(F.col("cost") <= F.col("budget"), F.col("spacing")).otherwise(F.lit(1000) - F.col("spacing"))))
    return c.withColumn("_r", best).where("_r = 1").select("which", "spacing")


def binomial_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = points(spark, sf_dir).groupBy("kind").agg(share(F.col("raw") > 60).alias("p"), F.count("raw").alias("n"))
    return _rounded(e.select("kind", "p", "n", binomial_se(F.col("p"), F.col("n")).alias("se"), (1.96 * binomial_se(F.col("p"), F.col("n"))).alias("half_width")))


def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two result sets of the same rows compared: differences and equal
    counts, one of them in single precision."""
    e = points(spark, sf_dir).where("raw is not null").select("event_id", "ray_id", F.col("raw").alias("a"), (F.floor(F.col("raw") * 8) / 8).alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return _rounded(e.groupBy("ray_id").agg(F.percentile(d, F.lit(0.5)).alias("median_diff"), F.percentile(d, F.lit(0.99)).alias("p99_diff"), F.max(d).alias("max_diff"), share(F.floor("a") == F.floor("b")).alias("same_count")))


def variant_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset with one component replaced: nations, those of one region
    from another list, the rest as they are."""
    n = table(spark, sf_dir, "nation")
    other = n.where("n_regionkey = 1").select("n_nationkey", F.upper(F.concat("n_name", F.lit("_snapped"))).alias("replaced"))
    return n.join(other, "n_nationkey", "left").select("n_nationkey", F.coalesce("replaced", "n_name").alias("component"))


def roll_up_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and quartiles of ratios by group, nulls left out."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 1000).alias("ratio"))
    return _rounded(st.exact_percentiles(o, "ratio", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "o_orderstatus"), 5)


def coords_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oblique planes of 8 x 8 points, one a supplier, sampled both ways within
    all but the last slices of the volume."""
    voxels_ = voxels(spark, sf_dir)
    last = voxels_.agg(F.max("z").alias("z")).first()["z"] or 0
    k, i, j = F.col("s_suppkey"), F.col("i"), F.col("j")
    grid = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("n")).withColumn("i", F.floor(F.col("n") / 8)).withColumn("j", F.col("n") % 8)
    points = grid.select("s_suppkey", (k * 64 + F.col("n")).alias("key"), (k * 13 % (last + 20) - 10 + i * 0.7531).alias("z"), (j * 0.9137 - 0.4).alias("y"), (k % 5 * 1.1313 + i * 0.2571).alias("x"), ((k + j) % 7 != 0).alias("ok"))
    out = None
    for sampling in ("nearest", "trilinear"):
        one = vo.sample_coords(points, voxels_, "key", (last + 1, 8, 8), sampling, (0, last - 2))
        one = one.groupBy("s_suppkey").agg(F.count_if("inside").alias("inside"), F.sum("value").alias(sampling))
        out = one if out is None else out.join(one.drop("inside"), "s_suppkey")
    return out


QUERIES = {
    f.__name__: f
    for f in (
        chunk_keys, chunk_missing, trilinear_gather, box_read, otsu_threshold, void_fraction, density_rewrite, zero_tiles, percentile_panel, histogram_fixed,
        label_dim_join, jobs_cross_fallback, shard_digests, json_props, log_extract, last_line, majority_class, round_robin, first_fit, binomial_error,
        paired_runs, variant_view, roll_up_result, coords_sample,
    )
}

_CHUNKS = "ch AS (SELECT DISTINCT iz // 16 AS cz, iy // 4 AS cy, ix // 4 AS cx FROM co)"
_P = "quantile_cont({c}, {q})"

ORACLE_SQL = {
    "chunk_keys": with_(PT, _PLACES, _CORNERS, _CHUNKS) + "SELECT * FROM ch",
    "chunk_missing": with_(PT, VOX, _PLACES, _CORNERS, _CHUNKS) + "SELECT * FROM ch EXCEPT SELECT DISTINCT z // 16, y // 4, x // 4 FROM vox WHERE z // 16 % 5 <> 2",
    "coords_sample": with_(
        VOX,
        "l AS (SELECT max(z) AS last FROM vox)",
        "p AS (SELECT s_suppkey, s_suppkey * 13 % (last + 20) - 10 + i * 0.7531::DOUBLE AS z, j * 0.9137::DOUBLE - 0.4 AS y, s_suppkey % 5 * 1.1313::DOUBLE + i * 0.2571::DOUBLE AS x, (s_suppkey + j) % 7 <> 0 AS ok, last FROM (SELECT s_suppkey, n // 8 AS i, n % 8 AS j FROM (SELECT s_suppkey, unnest(range(64)) AS n FROM supplier)), l)",
        "q AS (SELECT *, row_number() OVER () AS k, ok AND z BETWEEN 0 AND least(last, last - 3) AND y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 AS inside FROM p)",
        "n AS (SELECT k, v FROM q JOIN vox w ON w.z = round_even(q.z, 0)::INT AND w.y = round_even(q.y, 0)::INT AND w.x = round_even(q.x, 0)::INT WHERE inside)",
        "c AS (SELECT k, floor(z)::INT + a AS iz, floor(y)::INT + b AS iy, floor(x)::INT + c AS ix, (CASE WHEN a = 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN c = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM q, (VALUES (0), (1)) AS d(a), (VALUES (0), (1)) AS e(b), (VALUES (0), (1)) AS f(c) WHERE inside)",
        "t AS (SELECT k, floor(sum(w * v) + 0.5) AS v FROM c JOIN vox ON vox.z = iz AND vox.y = iy AND vox.x = ix GROUP BY k)",
    )
    + "SELECT s_suppkey, count(*) FILTER (inside) AS inside, sum(coalesce(n.v, 0))::BIGINT AS nearest, sum(coalesce(t.v, 0))::BIGINT AS trilinear FROM q LEFT JOIN n USING (k) LEFT JOIN t USING (k) GROUP BY s_suppkey",
    "trilinear_gather": with_(PT, VOX, _PLACES, _CORNERS) + "SELECT key, round(sum(w * coalesce(v, 0)), 6) AS value FROM co LEFT JOIN vox ON z = iz AND y = iy AND x = ix GROUP BY key",
    "box_read": with_(VOX) + "SELECT z, count(*) AS n, sum(v)::BIGINT AS sum_v, max(v) AS max_v FROM vox WHERE z >= 10 AND z < 60 AND y >= 2 AND y < 6 AND x >= 1 AND x < 7 GROUP BY z",
    "otsu_threshold": with_(VOX, "h AS (SELECT b, count(v)::DOUBLE AS h FROM (SELECT unnest(range(256)) AS b) LEFT JOIN vox ON v = b AND v > 0 GROUP BY b)", "s AS (SELECT b, sum(h) OVER o AS w0, sum(h * (b + 0.5)) OVER o AS s0, sum(h) OVER () - sum(h) OVER o AS w1, sum(h * (b + 0.5)) OVER () - sum(h * (b + 0.5)) OVER o AS s1 FROM h WINDOW o AS (ORDER BY b))") + "SELECT (b + 0.5)::DOUBLE AS threshold FROM s WHERE b < 255 ORDER BY round(w0 * w1 * (s0 / greatest(w0, 1e-9) - s1 / greatest(w1, 1e-9)) ** 2, 3) DESC, b LIMIT 1",
    "void_fraction": with_(VOX, "p AS (SELECT z % 10 AS winding, max(v) < 150 AND min(v) > 0 AS void, min(v) > 0 AS inside FROM vox GROUP BY z, y)") + "SELECT coalesce(winding, -1) AS winding, sum(void::INT)::BIGINT AS void, sum(inside::INT)::BIGINT AS inside, round(sum(void::INT) / greatest(sum(inside::INT), 1), 6) AS void_frac FROM p GROUP BY ROLLUP (winding)",
    "density_rewrite": with_(VOX, "d AS (SELECT y, x, CASE WHEN v % 7 = 0 THEN 0 ELSE v END AS v, (y - 3.5) ** 2 + (x - 3.5) ** 2 < 2 AS core FROM vox)", "e AS (SELECT y, x, CASE WHEN core OR v = 0 THEN 0 ELSE least(greatest(v, 60), 200) END::DOUBLE AS c, CASE WHEN v = 0 THEN 0 ELSE 62.5 END::DOUBLE AS k FROM d)") + "SELECT y, x, sum(c) AS clamped, sum(k) AS constant, sum((c = 0)::INT)::BIGINT AS invalid FROM e GROUP BY y, x",
    "zero_tiles": with_(VOX) + "SELECT z AS cz, y // 4 AS cy, x // 4 AS cx, max(v) AS top, count(*) AS n FROM vox GROUP BY ALL HAVING max(v) >= 200",
    "percentile_panel": " UNION ALL ".join(f"SELECT {g} AS grp, count(*) AS n, " + ", ".join(f"round(quantile_cont({c}, {q}), 4) AS {n}" for n, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + f" FROM {t} GROUP BY 1" for g, c, t in (("l_returnflag", "l_extendedprice", "lineitem"), ("o_orderpriority", "o_totalprice", "orders"))),
    "histogram_fixed": "SELECT l_returnflag, least(floor(l_quantity / 5), 9)::INT AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY ALL",
    "label_dim_join": "WITH c AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS mean FROM customer GROUP BY 1) SELECT n_name, coalesce(r_name, '-') AS label, n, round(mean, 4) AS mean_balance, '| ' || n_name || ' | ' || coalesce(r_name, '-') || ' | ' || format('{:,}', n * 1000) || ' |' AS line FROM c JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey",
    "jobs_cross_fallback": "WITH f AS (SELECT DISTINCT p_partkey % 5 + 1 AS run, p_size % 12 + 8 AS winding, CASE WHEN p_size % 3 = 0 THEN 'spliced' ELSE 'plain' END AS variant FROM part), j AS (SELECT s_suppkey AS run, w AS winding FROM supplier, (SELECT unnest(range(10, 20)) AS w)) SELECT run, winding, coalesce(max(variant), 'missing') AS variant FROM j LEFT JOIN f USING (run, winding) GROUP BY run, winding",
    "shard_digests": "SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256 FROM documents",
    "json_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS sum_k, round(avg(k), 6) AS mean_k FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY event_type",
    "log_extract": "SELECT conv_id, turn, regexp_extract(text, '([a-z]+ing)', 1) AS first_match, len(regexp_extract_all(text, '[a-z]+ing'))::BIGINT AS matches FROM conversations WHERE regexp_matches(text, '[a-z]+ing')",
    "last_line": "SELECT conv_id, role, arg_max(octet_length(encode(text)), turn)::BIGINT AS bytes, max(turn) AS turn FROM conversations GROUP BY conv_id, role",
    "majority_class": "WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus AS majority, round(1 - n / total, 6) AS off_majority FROM (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) AS total, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linestatus) AS rn FROM c) WHERE rn = 1",
    "round_robin": "SELECT worker, count(*) AS n, sum(p_partkey)::BIGINT AS sum_key FROM (SELECT p_partkey, ((row_number() OVER (ORDER BY p_partkey) - 1) % 4)::INT AS worker FROM part) GROUP BY worker",
    "first_fit": "WITH c AS (SELECT o_orderkey % 6 AS spacing, sum(o_totalprice) AS cost FROM orders GROUP BY 1), b AS (SELECT i::INT AS which, (SELECT max(cost) FROM c) * f AS budget FROM (SELECT unnest([0, 1, 2]) AS i, unnest([0.5::DOUBLE, 0.97::DOUBLE, 1.0::DOUBLE]) AS f)) SELECT which, spacing FROM (SELECT which, spacing, row_number() OVER (PARTITION BY which ORDER BY CASE WHEN cost <= budget THEN spacing ELSE 1000 - spacing END) AS rn FROM c, b) WHERE rn = 1",
    "binomial_error": with_(PT) + "SELECT kind, round(p, 6) AS p, n, round(sqrt(p * (1 - p) / n), 6) AS se, round(1.96 * sqrt(p * (1 - p) / n), 6) AS half_width FROM (SELECT kind, avg((raw > 60)::INT) AS p, count(raw) AS n FROM pt GROUP BY kind)",
    "paired_runs": with_(PT) + "SELECT ray_id, round(median(d), 6) AS median_diff, round(quantile_cont(d, 0.99), 6) AS p99_diff, round(max(d), 6) AS max_diff, round(avg((floor(a) = floor(b))::INT), 6) AS same_count FROM (SELECT ray_id, raw AS a, floor(raw * 8) / 8 AS b, abs(raw - floor(raw * 8) / 8) AS d FROM pt WHERE raw IS NOT NULL) GROUP BY ray_id",
    "variant_view": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name || '_snapped') ELSE n_name END AS component FROM nation",
    "roll_up_result": "SELECT o_orderstatus, count(r) AS n, round(quantile_cont(r, 0.25), 5) AS q25, round(quantile_cont(r, 0.5), 5) AS q50, round(quantile_cont(r, 0.75), 5) AS q75 FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000 END AS r FROM orders) GROUP BY 1",
}
