import corpus_pipeline

from sheafray.llm import mixing, neardup, quality, substring
from sheafray.llm.common import materialize


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "substring dedup", "mix sources", "pack"]
    kept = materialize(quality.quality_stage(spark, docs, d), "t")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = materialize(neardup.near_stage(spark, kept, d), "t")
    assert one.columns == docs.columns and 0 < one.count() < kept.count()
    assert neardup.classes(one).where("doc_id <> class_id").count() == 0
    cut = materialize(substring.substring_stage(spark, one, d), "t")
    assert cut.columns == docs.columns and cut.count() == one.count()
    assert substring.repeat_digests(one).agg({"n_removed": "sum"}).first()[0] == sum(len(a.split()) for (a,) in one.select("text").collect()) - sum(len(a.split()) for (a,) in cut.select("text").collect())
    mixed = materialize(mixing.mix_stage(spark, cut, d), "t")
    assert mixed.columns == docs.columns
    whole = corpus_pipeline.run(spark, d)
    assert whole.count() > 0 and whole.select("doc_id").distinct().join(mixed, "doc_id", "left_anti").count() == 0
