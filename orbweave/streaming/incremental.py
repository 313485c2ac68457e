"""Time bins kept up to date while logs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.scalars import utc_iso


def streaming_time_bins(observations: DataFrame, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """The bins of a stream of (relative_path, epoch, latency_ms, ttl, icmp_seq); a bin is final once it is ``lateness`` old.

    The same columns as the batch bins, without a session's metadata, which is a function of its path.
    """
    timed = observations.withColumn("at", F.timestamp_micros((F.col("epoch") * 1_000_000).cast("long"))).withWatermark("at", lateness)
    grouped = timed.groupBy("relative_path", F.window("at", f"{seconds} seconds").alias("w")).agg(
        F.count("*").alias("observed_replies"), F.avg("latency_ms").alias("latency_mean_ms"), F.stddev_pop("latency_ms").alias("latency_std_ms"), F.min("latency_ms").alias("latency_min_ms"), F.max("latency_ms").alias("latency_max_ms"),
        F.avg("ttl").alias("ttl_mean"), F.min("ttl").alias("ttl_min"), F.max("ttl").alias("ttl_max"), F.min("icmp_seq").alias("icmp_seq_min"), F.max("icmp_seq").alias("icmp_seq_max"),
    )
    start = F.unix_seconds("w.start")
    return grouped.withColumns({"bin_epoch": start, "bin_start_utc": utc_iso(start), "bin_seconds": F.lit(seconds)}).drop("w")
