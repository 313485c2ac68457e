from orbweave.operators.bins import time_bins
from orbweave.streaming.incremental import streaming_time_bins


def test_stream_gives_the_batch_bins(spark, tmp_path):
    rows = [("a", 60.0 * i + 0.5, float(i), 9, i) for i in range(6)] + [("a", 61.0, 5.0, 7, 9)]
    df = spark.createDataFrame(rows, "relative_path string, epoch double, latency_ms double, ttl int, icmp_seq long")
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming_time_bins(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    columns = ["relative_path", "bin_epoch", "observed_replies", "latency_mean_ms", "latency_max_ms", "ttl_min", "bin_start_utc"]
    expected = time_bins(df, 60, ("relative_path",)).select(*columns).collect()
    assert sorted(map(tuple, spark.table("bins").select(*columns).collect())) == sorted(map(tuple, expected))
