"""Cuts in the lineage of iterative plans that outlive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed and checkpointed in the folder that the cluster names in
    ``spark.checkpoint.dir``; where it names none, a local master gets a
    temporary folder and any other one in the SQL warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            local = context.master == "local" or context.master.startswith("local[")
            found = f"file://{tempfile.mkdtemp(prefix='checkpoint_')}" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoint"
            spark.conf.set("spark.checkpoint.dir", found)
        context.setCheckpointDir(found)
    return df.checkpoint()
