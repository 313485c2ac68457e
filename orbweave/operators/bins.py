"""Observations to session summaries, strided samples and fixed-width time bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.scalars import bucket, utc_iso
from orbweave.sources.bindings import META


def time_bins(observations: DataFrame, seconds: int = 60, meta: tuple[str, ...] = META) -> DataFrame:
    """One row per session and bin. Partial sums are made before the only shuffle, so lines never travel."""
    kept = observations.withColumn("bin_epoch", bucket("epoch", seconds)).withColumn("bin_seconds", F.lit(seconds))
    stats = kept.groupBy("relative_path", "bin_seconds", "bin_epoch").agg(
        *[F.first(c).alias(c) for c in meta if c != "relative_path"],
        F.count("*").alias("observed_replies"), F.avg("latency_ms").alias("latency_mean_ms"), F.stddev_pop("latency_ms").alias("latency_std_ms"), F.min("latency_ms").alias("latency_min_ms"), F.max("latency_ms").alias("latency_max_ms"),
        F.avg("ttl").alias("ttl_mean"), F.min("ttl").alias("ttl_min"), F.max("ttl").alias("ttl_max"), F.min("icmp_seq").alias("icmp_seq_min"), F.max("icmp_seq").alias("icmp_seq_max"),
    )
    return stats.withColumn("bin_start_utc", utc_iso("bin_epoch"))


def session_summary(files: DataFrame, observations: DataFrame, order: str = "line_no", sample_rows: int = 1000) -> DataFrame:
    """One row per file of ``files`` (relative_path, file_size_bytes, ...), also for files without observations.

    First and last epoch are those of the first and last line, not the extremes.
    """
    stats = observations.groupBy("relative_path").agg(
        F.count("*").alias("observation_count"), F.min_by("epoch", order).alias("epoch_start"), F.max_by("epoch", order).alias("epoch_end"),
        F.avg("latency_ms").alias("latency_mean_ms"), F.stddev_pop("latency_ms").alias("latency_std_ms"), F.min("latency_ms").alias("latency_min_ms"), F.max("latency_ms").alias("latency_max_ms"),
        F.avg("ttl").alias("ttl_mean"), F.min("ttl").alias("ttl_min"), F.max("ttl").alias("ttl_max"),
    )
    joined = files.join(stats, "relative_path", "left")
    n = F.coalesce("observation_count", F.lit(0))
    stride = sample_stride(n, sample_rows)
    return joined.withColumns({
        "observation_count": n, "latency_std_ms": F.coalesce("latency_std_ms", F.lit(0.0)),
        "timestamp_start_utc": F.coalesce(utc_iso(F.floor("epoch_start")), F.lit("")), "timestamp_end_utc": F.coalesce(utc_iso(F.floor("epoch_end")), F.lit("")),
        "sample_stride": stride, "sampled_observation_count": F.least(F.ceil(n / stride), F.lit(sample_rows)).cast("long"),
    })


def sample_stride(n, sample_rows: int):
    return F.when((n > sample_rows) & F.lit(sample_rows > 0), F.greatest(F.lit(1), F.floor(n / F.lit(max(sample_rows, 1))))).otherwise(1).cast("long")


def observation_sample(observations: DataFrame, sample_rows: int = 1000, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Every stride-th observation of each session, ``sample_rows`` at most.

    Observations that know their ``place`` in the session and its size ``n`` (``logs.placed_replies``) are only filtered;
    others are numbered by ``order`` first, a session being the unit of order.
    """
    session = Window.partitionBy("relative_path")
    known = {"place", "n"} <= set(observations.columns)
    placed = observations if known else observations.withColumn("place", F.row_number().over(session.orderBy(*order)) - 1).withColumn("n", F.count("*").over(session))
    stride = sample_stride(F.col("n"), sample_rows)
    kept = placed.where((F.col("place") % stride == 0) & (F.floor(F.col("place") / stride) < sample_rows))
    return kept.drop("place", "n").withColumn("timestamp_utc", utc_iso(F.floor("epoch")))
