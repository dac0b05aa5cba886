from sheafray.llm import common


def test_scratch_tables_are_cleared(spark):
    df = common.materialize(spark.range(5), "t")
    assert df.count() == 5
    assert common.clear_scratch(spark) >= 1 and common.clear_scratch(spark) == 0


def test_shared_dir_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
