"""What the operators of this sub-package share: session settings, scratch
tables in the cluster's shared folder, and the word definition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, x20 and x09 to x0D: what separates words.
WS_CHARS = " \t\n\x0b\x0c\r"
#: One run of it, as a Java regular expression.
WS_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    ``spark.checkpoint.dir`` of the session where the cluster names one. Where
    it is unset, a local master gets a temporary folder and any other master
    a folder in the SQL warehouse; the choice is stored back in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = f"file://{tempfile.mkdtemp(prefix='scratch_')}"
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: What this driver has written to the shared folder.
_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables that this driver's operators left in the shared
    folder, once their results have been written or counted: results read
    them until then. Returns how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_WRITTEN)
    while _WRITTEN:
        where = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        where.getFileSystem(conf).delete(where, True)
    return n


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the
    lineage that survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), value)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """``df``, written first where it is itself the outcome of a shuffle.

    Operators that deal rows by their place in the input read it several
    times; rows of files come in the same order each time, those of a shuffle
    need not.
    """
    return materialize(df, "settled") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    A plain reference inside a lambda would be evaluated again for each
    element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The array of words of a text; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RUN))


def n_words_of(text: Column) -> Column:
    """How many words a text has, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def groups_for(docs: DataFrame, bytes_each: int, column: str = "text") -> tuple[int, int]:
    """How many groups of about ``bytes_each`` bytes the column's values make,
    and their total bytes: one pass over that column, no row leaves it."""
    total = docs.agg(F.sum(F.octet_length(column)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    size = int(total["b"] or 0) + 16 * int(total["n"] or 0)
    return max(1, -(-size // bytes_each)), size
