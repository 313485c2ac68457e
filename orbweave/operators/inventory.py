"""File inventories: statistics, candidate scores, ranking and the diverse selection of a manifest."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.ranks import placed
from orbweave.sources.logs import file_name_parts, path_parts

# fixed values
TABULAR = (".csv", ".tsv")
TIME_NAMES = ("time", "timestamp", "date", "datetime", "epoch")
NETWORK_NAMES = ("latency", "delay", "throughput", "bandwidth", "node", "sat", "link", "gateway")
POINTS = {"tabular": 40, "sampled_log": 35, "size_most": 30, "time": 20, "network": 20, "sampled": 10, "family": 5, "active": 5, "two_hours": 3}
SIZE_STEP = 50 * 1024 * 1024
GROUP = ("g_location", "g_state", "g_duration")


def inventory_stats(files: DataFrame) -> DataFrame:
    """File count and bytes per suffix, and of all files under the suffix ``*``."""
    counts = files.groupBy("suffix").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"))
    return counts.union(counts.agg(F.lit("*"), F.coalesce(F.sum("file_count"), F.lit(0)), F.coalesce(F.sum("total_bytes"), F.lit(0))))


def _names(columns: str, tokens: tuple[str, ...]) -> Column:
    return F.exists(columns, lambda c: F.lower(c).rlike("|".join(tokens)))


def candidate_scores(files: DataFrame) -> DataFrame:
    """The files that may be modelled (none below a hidden part; tabular or sampled), with path metadata and score."""
    visible = ~F.exists(F.split("relative_path", "/"), lambda p: p.startswith("."))
    tabular = F.col("suffix").isin(*TABULAR)
    kept = files.where(visible & (tabular | F.col("sampled"))).select("*", *path_parts(), *file_name_parts())
    worth = lambda condition, name: F.when(condition, POINTS[name]).otherwise(0)
    kind = F.when(tabular, POINTS["tabular"]).when((F.col("suffix") == ".txt") & F.col("sampled"), POINTS["sampled_log"]).otherwise(0)
    by_size = F.when(F.col("size_bytes") > 0, F.least(F.lit(POINTS["size_most"]), F.floor(F.col("size_bytes") / SIZE_STEP))).otherwise(0)
    parts = [by_size, worth(_names("columns", TIME_NAMES), "time"), worth(_names("columns", NETWORK_NAMES), "network"), worth(F.col("sampled"), "sampled"),
             worth(F.col("measurement_family") != "", "family"), worth(F.col("path_state") == "active", "active"), worth(F.col("window_duration") == "2h", "two_hours")]
    return kept.withColumn("candidate_score", sum(parts, kind).cast("long"))


def _grouped(scored: DataFrame) -> DataFrame:
    known = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "<unknown>").otherwise(F.col(c))
    return scored.withColumns({"g_location": known("location"), "g_state": known("path_state"), "g_duration": known("window_duration"), "g_day": known("session_date")})


def candidate_ranking(scored: DataFrame) -> DataFrame:
    """Each candidate's place in its group of location, state and duration: by score, then size, then path."""
    ranked = placed(_grouped(scored), [F.desc("candidate_score"), F.desc("size_bytes"), F.asc("relative_path")], GROUP)
    return ranked.withColumn("place", F.col("place") + 1)


def _with_top(ranked: DataFrame) -> DataFrame:
    """``ranked`` with the best score of each row's group, pre-aggregated."""
    return ranked.join(ranked.groupBy(*GROUP).agg(F.max("candidate_score").alias("top")), list(GROUP))


def diverse_selection(scored: DataFrame, top_k: int = 25, max_per_location: int = 4, max_per_day: int = 2) -> DataFrame:
    """Round-robin over groups with caps per location and per location and day; ``rank`` is the order of selection.

    The caps concern one location each, so each location's rounds are played apart. Before that two ``row_number``s keep
    what can be picked at all: the best ``max_per_day`` of a group's day, of those the first ``2 * max_per_location``.
    """
    order = [F.desc("candidate_score"), F.desc("size_bytes"), F.asc("relative_path")]
    ranked = _with_top(_grouped(scored))
    ranked = ranked.withColumn("d", F.row_number().over(Window.partitionBy(*GROUP, "g_day").orderBy(*order))).where(F.col("d") <= max_per_day)
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*GROUP).orderBy(*order))).where(F.col("place") <= 2 * max_per_location)

    def play(rows: pd.DataFrame) -> pd.DataFrame:
        queues: dict[tuple, list] = defaultdict(list)
        for r in rows.sort_values("place").itertuples(index=False):
            queues[(-r.top, r.g_location, r.g_state, r.g_duration)].append(r)
        days: dict[str, int] = defaultdict(int)
        picks, taken, turn = [], 0, 0
        while any(queues.values()) and taken < max_per_location:
            turn += 1
            for key in sorted(queues):
                while queues[key] and taken < max_per_location:
                    r = queues[key].pop(0)
                    if days[r.g_day] < max_per_day:
                        days[r.g_day] += 1
                        taken += 1
                        picks.append((r.relative_path, turn))
                        break
        return pd.DataFrame(picks, columns=["relative_path", "round"])

    slim = ranked.select("relative_path", "top", "g_location", "g_state", "g_duration", "g_day", "place")
    picks = slim.groupBy("g_location").applyInPandas(play, "relative_path string, round int")
    first = [F.asc("round"), F.desc("top"), *GROUP]
    chosen = ranked.join(picks, "relative_path").orderBy(*first).limit(top_k)
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(*first)).cast("long")).drop("d", "place", "top", *GROUP, "g_day")


def round_robin(scored: DataFrame, top_k: int = 25) -> DataFrame:
    """The selection where no cap binds: place in the group is the round."""
    ranked = _with_top(candidate_ranking(scored))
    return ranked.orderBy("place", F.desc("top"), *GROUP).limit(top_k).select("relative_path", F.col("place").cast("long").alias("round"))


def manifest_rows(selected: DataFrame) -> DataFrame:
    """A manifest flattened for CSV: the list of columns is one string."""
    return selected.select("relative_path", "suffix", "size_bytes", "candidate_score", "sampled", "row_sample_count", "measurement_family", "path_state", "location", "session_date", "window_duration", F.concat_ws("|", "columns").alias("columns"), "notes")


def manifest_restriction(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    return rows.join(manifest.select("relative_path"), "relative_path", "left_semi")
