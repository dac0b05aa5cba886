from pyspark.sql import functions as F

from sheafray.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_partials_and_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = incremental.append_partials(incremental.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("ray_id", "kind").agg(F.sum("n").alias("n"))
    want = events.groupBy(F.col("user_id").alias("ray_id"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    s = incremental.windowed_summary(incremental.event_stream(spark, str(tmp_path / "in"), 10), late="400 days")
    q = s.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
