"""Row-local functions: sizes, times, metadata as numbers, scores, and hash draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALLEST = 1e-6  # of a denominator


def human_bytes(size: str | Column) -> Column:
    """A size with one decimal in the largest unit that leaves it below 1024, TB at most."""
    value = (F.col(size) if isinstance(size, str) else size).cast("double")
    out = None
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        scaled = value / float(1024**power)
        text = F.format_string(f"%.1f {unit}", scaled)
        out = F.when(scaled < 1024, text) if out is None else out.when(scaled < 1024, text) if unit != "TB" else out.otherwise(text)
    return out


def bucket(epoch: str, seconds: int) -> Column:
    """The start of the fixed-width bin of an epoch."""
    return (F.floor(F.col(epoch) / seconds) * seconds).cast("long")


def utc_iso(epoch: str | Column) -> Column:
    """Whole seconds since 1970 as ISO text in UTC, whatever the session's time zone."""
    begin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))  # a time without zone
    seconds = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.replace((begin + F.make_dt_interval(secs=F.floor(seconds))).cast("string"), F.lit(" "), F.lit("T"))


def forecast_horizon(seconds: float, bin_seconds: float, rounding: str = "ceil") -> int:
    """A horizon in bins, at least 1, rounded up or down."""
    return max(1, math.ceil(seconds / bin_seconds) if rounding == "ceil" else int(seconds // bin_seconds))


def static_features(bins: DataFrame) -> DataFrame:
    """Path state, duration, interval and day of month as numbers; what can't be read counts 0."""
    read = lambda c, unit: F.coalesce(F.replace(F.col(c), F.lit(unit), F.lit("")).try_cast("double"), F.lit(0.0))
    return bins.withColumns({
        "path_state_flag": F.coalesce((F.col("path_state") == "active").cast("int"), F.lit(0)),
        "window_duration_hours": read("window_duration", "h"),
        "probe_interval_ms": read("probe_interval", "ms"),
        "session_day_of_month": F.coalesce(F.dayofmonth(F.col("session_date").try_cast("date")), F.lit(0)),
    })


def at_least(column: Column, least: float) -> Column:
    """``column``, not below ``least``; null stays null."""
    return F.when(column.isNotNull(), F.greatest(column, F.lit(least)))


def feature_columns(frame: DataFrame, also_exclude: tuple[str, ...] = ()) -> list[str]:
    """The numeric columns that may be features: all but targets, and nothing that is a label or a flag of stress."""
    excluded = {"target_next", "target_next_bin_epoch", "target_available", "stress_applied", *also_exclude}
    return [f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in excluded]


def fusion(temporal: str = "pred_forecast", graph: str = "pred_graph", weight: float | Column = 0.65, other: float | Column = 0.35) -> Column:
    return weight * F.col(temporal) + other * F.col(graph)


def disagreement(temporal: str = "pred_forecast", graph: str = "pred_graph") -> Column:
    return F.abs(F.col(graph) - F.col(temporal))


def consensus(temporal: str = "pred_forecast", graph: str = "pred_graph", weight: float | Column = 0.65, other: float | Column = 0.35, penalty: float | Column = 0.30) -> Column:
    """The weighted mean of two experts, raised by how far they disagree."""
    return fusion(temporal, graph, weight, other) + penalty * disagreement(temporal, graph)


def uniform(seed: int, key: Column, tag: str) -> Column:
    """A draw from [0, 1) that depends on nothing but its arguments: the first 32 bits of an MD5, over 2 to the 32nd."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(tag)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def draw_between(u: Column, low: Column, high: Column) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    return low + F.floor(u * (high - low + 1))
