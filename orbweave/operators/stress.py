"""Synthetic stress on bins or on the forecast table. Every draw is a hash of a key, so partitions and order don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.scalars import draw_between, uniform
from orbweave.operators.ranks import placed


def _degraded(frame: DataFrame, hit: Column, severity: Column, std_share: float, over: float, drop: float, name: str) -> DataFrame:
    """Raise latency and its spread where ``hit``, lower replies, and mark the rows."""
    work = frame.withColumns({"_hit": hit, "_s": severity})
    on = lambda new, old: F.when(F.col("_hit"), new).otherwise(F.col(old))
    mean = F.col("latency_mean_ms") + F.col("_s")
    return work.withColumns({
        "latency_max_ms": on(F.greatest("latency_max_ms", mean + over * F.col("_s")), "latency_max_ms"),
        "latency_mean_ms": on(mean, "latency_mean_ms"),
        "latency_std_ms": on(F.col("latency_std_ms") + std_share * F.col("_s"), "latency_std_ms"),
        "observed_replies": on(F.greatest(F.lit(1), F.floor(F.col("observed_replies") * F.lit(1.0 - drop))).cast("long"), "observed_replies"),
        "stress_applied": F.col("_hit").cast("int"), "stress_scenario": F.lit(name),
    }).drop("_hit", "_s")


def _std() -> Column:
    return F.coalesce("latency_std_ms", F.lit(0.0))


def base_scenario(bins: DataFrame) -> DataFrame:
    return bins.withColumns({"stress_applied": F.lit(0), "stress_scenario": F.lit("base")})


def burst_stress(bins: DataFrame, seed: int = 42, fraction: float = 0.12, spike: float = 18.0, drop: float = 0.12) -> DataFrame:
    """Short spikes on single bins, likelier where latency already varies. The extremes of the deviation are one row."""
    ends = F.broadcast(bins.agg(F.min(_std()).alias("_lo"), F.max(_std()).alias("_hi")))
    key = F.concat_ws("|", "relative_path", F.col("bin_epoch").cast("string"))
    scale = (_std() - F.col("_lo")) / F.greatest(F.lit(1e-9), F.col("_hi") - F.col("_lo"))
    chance = F.least(F.lit(0.85), F.greatest(F.lit(0.0), fraction * (1.0 + 0.9 * scale) * F.when(F.col("path_state") == "active", 1.0).otherwise(0.75)))
    severity = (spike + 0.45 * _std()) * (0.8 + 0.4 * uniform(seed, key, "severity"))
    return _degraded(bins.join(ends), uniform(seed, key, "hit") < chance, severity, 0.55, 0.5, drop, "burst").drop("_lo", "_hi")


def outage_stress(bins: DataFrame, seed: int = 43, fraction: float = 0.25, lengths: tuple[int, int] = (2, 5), spike: float = 35.0, drop: float = 0.35) -> DataFrame:
    """One run of bad bins in the later part of some sessions; needs session_bin_index."""
    path, n = F.col("relative_path"), F.col("_n")
    sessions = bins.groupBy("relative_path").agg(F.count("*").alias("_n"), F.first("path_state").alias("_state"))
    inactive = F.col("_state") == "inactive"
    length = F.least(draw_between(uniform(seed, path, "length"), F.lit(lengths[0]), F.lit(lengths[1])), n)
    selected = (uniform(seed, path, "select") < F.least(F.lit(0.95), F.lit(fraction) + F.when(inactive, 0.18).otherwise(0.0))) & (n >= lengths[0])
    runs = sessions.where(selected).withColumn("_len", length)
    first = F.greatest(F.lit(0), F.floor(n * F.lit(0.65)) - F.col("_len"))
    runs = runs.select("relative_path", "_len", draw_between(uniform(seed, path, "start"), first, n - F.col("_len")).alias("_from"))
    place = F.col("session_bin_index")
    severity = spike + 0.35 * _std() + F.when(F.col("path_state") == "inactive", 10.0).otherwise(0.0)
    hit = F.coalesce((place >= F.col("_from")) & (place < F.col("_from") + F.col("_len")), F.lit(False))
    return _degraded(bins.join(runs, "relative_path", "left"), hit, severity, 0.7, 0.75, drop, "outage").drop("_len", "_from")


def _some_locations(frame: DataFrame, seed: int, fraction: float) -> DataFrame:
    """A share of the locations (two at least, if there are), those of least hash."""
    places = frame.select("location").where("location is not null").distinct()
    ranked = placed(places.withColumn("_u", uniform(seed, F.col("location"), "location")), ["_u", "location"], name="_r")
    size = F.broadcast(ranked.agg(F.count("*").alias("_n")))  # one row
    return ranked.join(size).where(F.col("_r") < F.greatest(F.lit(2), F.ceil(F.col("_n") * F.lit(fraction)))).select("location", F.lit(True).alias("_chosen"))


def _runs_of_windows(size: DataFrame, seed: int, count: int, lengths: tuple[int, int], tail: Column, size_column: str) -> DataFrame:
    """The places covered by ``count`` runs that start in the tail of 0 .. size-1; ``size`` has one row."""
    n = F.col(size_column)
    runs = size.select(n.alias(size_column), F.explode(F.sequence(F.lit(0), F.lit(max(1, count) - 1))).alias("k"))
    length = F.greatest(F.lit(1), F.least(draw_between(uniform(seed, F.col("k"), "length"), F.lit(lengths[0]), F.lit(lengths[1])), n))
    runs = runs.withColumn("len", length).withColumn("first", tail)
    until = F.greatest(F.col("first") + 1, n - F.col("len") + 1)
    start = F.col("first") + F.floor(uniform(seed, F.col("k"), "start") * (until - F.col("first")))
    return runs.select(F.explode(F.sequence(start.cast("long"), (start + F.col("len") - 1).cast("long"))).alias("session_bin_index")).distinct().withColumn("_in", F.lit(True))


def structural_stress(bins: DataFrame, seed: int = 44, fraction: float = 0.35, windows: int = 2, lengths: tuple[int, int] = (2, 4), spike: float = 28.0, drop: float = 0.20) -> DataFrame:
    """The same late windows are bad in a share of the locations; needs session_bin_index."""
    size = bins.agg((F.max("session_bin_index") + 1).alias("size"))
    tail = F.greatest(F.lit(0), F.floor(F.col("size") * F.lit(0.65)) - F.col("len"))
    marked = bins.join(F.broadcast(_runs_of_windows(size, seed, windows, lengths, tail, "size")), "session_bin_index", "left").join(_some_locations(bins, seed, fraction), "location", "left")
    return _structural(marked, seed, spike, drop, 0.30).select(*bins.columns, "stress_applied", "stress_scenario")


def structural_forecast_stress(table: DataFrame, seed: int = 44, fraction: float = 0.35, windows: int = 2, lengths: tuple[int, int] = (2, 4), spike: float = 28.0, drop: float = 0.20) -> DataFrame:
    """As above on a forecast table: windows by their place among those that occur, locations among those affected, and
    the target rises too; lags and rolling columns stay as they are."""
    places = placed(table.select("session_bin_index").distinct(), ["session_bin_index"])
    size = places.agg(F.count("*").alias("size"))
    tail = F.greatest(F.lit(0), F.floor(F.col("size") * F.lit(0.85)))
    hit = _runs_of_windows(size, seed, windows, lengths, tail, "size").withColumnRenamed("session_bin_index", "place").join(places, "place").select("session_bin_index", "_in")
    near = table.join(F.broadcast(hit), "session_bin_index", "left")
    marked = near.join(_some_locations(near.where("_in"), seed, fraction), "location", "left")
    before = F.col("target_next")
    out = _structural(marked.withColumn("_old", F.col("latency_mean_ms")), seed, spike, drop, 0.25)
    out = out.withColumn("target_next", F.when(F.col("stress_applied") == 1, before + 0.85 * (F.col("latency_mean_ms") - F.col("_old"))).otherwise(before))
    return out.select(*table.columns, "stress_applied", "stress_scenario")


def _structural(marked: DataFrame, seed: int, spike: float, drop: float, share: float) -> DataFrame:
    key = F.concat_ws("|", "relative_path", F.col("bin_epoch").cast("string"))
    severity = (spike + share * _std()) * (0.90 + 0.25 * uniform(seed, key, "severity"))
    return _degraded(marked, F.coalesce(F.col("_in") & F.col("_chosen"), F.lit(False)), severity, 0.60, 0.65, drop, "structural")


def stress_scenarios(bins: DataFrame) -> DataFrame:
    """Base, burst, outage and structural bins in one table, told apart by ``stress_scenario``; needs session_bin_index."""
    out = base_scenario(bins)
    for one in (burst_stress(bins), outage_stress(bins), structural_stress(bins)):
        out = out.unionByName(one)
    return out
