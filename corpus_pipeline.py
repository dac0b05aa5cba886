"""The training-corpus pipeline: documents to packed windows, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafray.llm import mixing, neardup, packing, quality, substring
from sheafray.llm.common import documents, materialize

STAGES = [
    ("quality rules", quality.quality_stage),
    ("near dedup", neardup.near_stage),
    ("substring dedup", substring.substring_stage),
    ("mix sources", mixing.mix_stage),
    ("pack", packing.pack_stage),
]

#: Signatures, a learned list and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
