from pyspark.sql import functions as F

from cuewright.streaming import segments as st


def test_stream_renders_and_drops_repeats(spark, tmp_path):
    rows = [(0, 0.0, 1.5, " hi "), (0, 0.0, 1.5, " hi "), (1, 2.3, 3.0, " ")]
    spark.createDataFrame(rows, "media_id long, start double, end double, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("media_id long, start double, end double, text string").parquet(str(tmp_path / "in")).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    q = st.rendered_stream(st.first_arrivals(src, "at")).writeStream.format("memory").queryName("rendered").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("rendered").collect()] == [(0, "00:00:00,000 --> 00:00:01,500", "hi")]
    n = st.arrivals_per_window(spark.createDataFrame(rows, "media_id long, start double, end double, text string").withColumn("at", F.lit("2024-01-01").cast("timestamp")), "at")
    assert sorted({(r.media_id, r.n) for r in n.collect()}) == [(0, 2), (1, 1)]
