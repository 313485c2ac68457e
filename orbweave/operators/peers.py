"""Peer context per decision window, in closed form from sums: no pair of rows is ever made.

A window (session_bin_index) holds a row per session, so few windows hold all rows: context comes from aggregates with
partial sums, which are small and joined back, never from a sort of a whole window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.storage import materialise

WINDOW = ("session_bin_index",)
GROUPS_AT_MOST = 500_000  # whose sums are broadcast, at about a hundred bytes each


def _beside(groups: DataFrame) -> DataFrame:
    """Sums per group, written once and broadcast while they are few: then the rows that they are joined to stay where they are."""
    kept = materialise(groups, "groups")
    return F.broadcast(kept) if kept.limit(GROUPS_AT_MOST + 1).count() <= GROUPS_AT_MOST else kept


def _sums(frame: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], tag: str) -> DataFrame:
    stats = [F.count("*").alias(f"{tag}_n")]
    for c in columns:
        stats += [F.avg(c).alias(f"{tag}_m_{c}"), F.var_pop(c).alias(f"{tag}_v_{c}")]
    return frame.groupBy(*[F.col(k).alias(f"{tag}_{k}") for k in keys]).agg(*stats)


def _joined(frame: DataFrame, sums: DataFrame, keys: tuple[str, ...], tag: str) -> DataFrame:
    on = [F.col(k) == F.col(f"{tag}_{k}") for k in keys]
    return frame.join(_beside(sums), on, "left").drop(*[f"{tag}_{k}" for k in keys])


def _others(column: str, tag: str) -> tuple[Column, Column]:
    """Mean and population deviation of the others in the group: own value without others, 0 with fewer than two."""
    x, n, m, v = F.col(column), F.col(f"{tag}_n"), F.col(f"{tag}_m_{column}"), F.col(f"{tag}_v_{column}")
    d, k = x - m, F.col(f"{tag}_n") - 1
    mean = F.when(k > 0, m - d / k).otherwise(x)
    var = F.greatest(F.lit(0.0), (v * n - d * d) / k - (d / k) * (d / k))
    return mean, F.when(k > 1, F.sqrt(var)).otherwise(0.0)


def peer_features(frame: DataFrame, window: tuple[str, ...] = WINDOW) -> DataFrame:
    """Means and deviations of latency, replies and burst of the window's other rows, the gap to them, and the window's size."""
    columns = ("latency_mean_ms", "observed_replies", "burst_indicator")
    out = _joined(frame, _sums(frame, window, columns, "w"), window, "w")
    new = {}
    for c, name in zip(columns, ("peer_latency", "peer_reply", "peer_burst_indicator"), strict=True):
        new[f"{name}_mean"], new[f"{name}_std"] = _others(c, "w")
    new["snapshot_candidate_count"] = F.col("w_n")
    out = out.withColumns(new).withColumn("peer_latency_gap", F.col("latency_mean_ms") - F.col("peer_latency_mean"))
    return out.select([c for c in out.columns if not c.startswith("w_")])


def _latency_peers(frame: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Rows whose last key is null have no such peers: they match no group."""
    out = _joined(frame, _sums(frame, keys, ("latency_mean_ms",), "g"), keys, "g")
    mean, std = _others("latency_mean_ms", "g")
    out = out.withColumns({f"{name}_latency_mean": F.coalesce(mean, "latency_mean_ms"), f"{name}_latency_std": F.coalesce(std, F.lit(0.0))})
    return out.select([c for c in out.columns if not c.startswith("g_")])


def state_peer_features(frame: DataFrame, window: tuple[str, ...] = WINDOW) -> DataFrame:
    return _latency_peers(frame, (*window, "path_state"), "state_peer")


def target_peer_features(frame: DataFrame, window: tuple[str, ...] = WINDOW) -> DataFrame:
    return _latency_peers(frame, (*window, "target_hint"), "target_peer")


def graph_edges(frame: DataFrame, window: tuple[str, ...] = WINDOW) -> DataFrame:
    """The distinct location-target edges of each window; all missing targets are one node."""
    node = lambda c, kind: F.concat(F.lit(f"{kind}::"), F.coalesce(c, F.lit("nan")))
    return frame.select(*window, node("location", "loc").alias("location_node"), node("target_hint", "tgt").alias("target_node")).distinct()


def graph_degrees(edges: DataFrame, window: tuple[str, ...] = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(window, location_node, location_degree) and (window, target_node, target_degree)."""
    return tuple(edges.groupBy(*window, f"{k}_node").agg(F.count("*").alias(f"{k}_degree")) for k in ("location", "target"))


def snapshot_features(frame: DataFrame, window: tuple[str, ...] = WINDOW) -> DataFrame:
    """All fourteen peer and graph columns."""
    out = target_peer_features(state_peer_features(peer_features(frame, window), window), window)
    for kind, c, degrees in zip(("location", "target"), ("location", "target_hint"), graph_degrees(graph_edges(frame, window), window), strict=True):
        tag = "loc" if kind == "location" else "tgt"
        out = out.withColumn(f"{kind}_node", F.concat(F.lit(f"{tag}::"), F.coalesce(c, F.lit("nan")))).join(_beside(degrees), [*window, f"{kind}_node"], "left").drop(f"{kind}_node")
    return out
