"""Bins to a supervised table: lags, rolling statistics, ratios, the next bin as target, and a split in time order.

All windows share one partitioning, so a whole forecast table costs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.functions.scalars import SMALLEST, at_least, static_features

LAGS = (1, 2, 3, 6, 12)
TARGET = "latency_mean_ms"


def session(keys: tuple[str, ...] = ("relative_path",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("bin_epoch")


def session_bin_index(bins: DataFrame, keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    return bins.withColumn("session_bin_index", (F.row_number().over(session(keys)) - 1).cast("long"))


def lag_features(frame: DataFrame, column: str = TARGET, lags: tuple[int, ...] = LAGS, keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    return frame.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(session(keys)) for k in lags})


def _rolling(column: str, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """Mean and sample deviation (0 for one row) of the last ``n`` rows."""
    last = w.rowsBetween(-(n - 1), 0)
    return F.avg(column).over(last), F.coalesce(F.stddev_samp(column).over(last), F.lit(0.0))


def rolling_features(frame: DataFrame, column: str = TARGET, windows: tuple[int, ...] = (3, 5), keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    new = {}
    for n in windows:
        new[f"{column}_roll_mean_{n}"], new[f"{column}_roll_std_{n}"] = _rolling(column, n, session(keys))
    return frame.withColumns(new)


def reply_features(frame: DataFrame, keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    mean, std = _rolling("observed_replies", 3, session(keys))
    return frame.withColumns({"observed_replies_roll_mean_3": mean, "observed_replies_roll_std_3": std, "observed_replies_lag_1": F.lag("observed_replies", 1).over(session(keys))})


def ratio_features(frame: DataFrame, column: str = TARGET) -> DataFrame:
    """Changes, ratios to the recent mean, and the burst indicator: the mean of the non-negative parts of three signals."""
    x, replies = F.col(column), F.col("observed_replies")
    mean, reply_mean = F.col(f"{column}_roll_mean_3"), F.col("observed_replies_roll_mean_3")
    frame = frame.withColumns({
        "latency_delta_1": x - F.col(f"{column}_lag_1"), "latency_delta_roll3": x - mean,
        "latency_jump_ratio": x / at_least(mean, SMALLEST), "latency_volatility_ratio": F.col(f"{column}_roll_std_3") / at_least(mean, SMALLEST),
        "reply_delta_1": replies - F.col("observed_replies_lag_1"), "reply_gap_roll3": replies - reply_mean, "reply_pressure_score": 1.0 - replies / at_least(reply_mean, SMALLEST),
    })
    signals = [at_least(F.col(c), 0.0) for c in ("latency_jump_ratio", "latency_volatility_ratio", "reply_pressure_score")]
    return frame.withColumn("burst_indicator", sum(signals[1:], signals[0]) / 3.0)


def next_bin_target(frame: DataFrame, column: str = TARGET, horizon: int = 1, keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    w = session(keys)
    ahead = frame.withColumns({"target_next": F.lead(column, horizon).over(w), "target_next_bin_epoch": F.lead("bin_epoch", horizon).over(w)})
    return ahead.withColumn("target_available", F.col("target_next").isNotNull().cast("int"))


def forecast_table(bins: DataFrame, column: str = TARGET, lags: tuple[int, ...] = LAGS, horizon: int = 1, keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    """The supervised table of bins with their session_bin_index; every numeric null becomes 0, rows without target go."""
    frame = static_features(bins)
    for step in (lambda f: lag_features(f, column, lags, keys), lambda f: rolling_features(f, column, (3, 5), keys), lambda f: reply_features(f, keys), lambda f: ratio_features(f, column), lambda f: next_bin_target(f, column, horizon, keys)):
        frame = step(frame)
    numeric = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)}
    filled = frame.where("target_available = 1")
    return filled.withColumns({c: F.coalesce(c, F.lit(0).cast(filled.schema[c].dataType)) for c in filled.columns if c in numeric})


def chronological_split(frame: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, keys: tuple[str, ...] = ("relative_path",)) -> DataFrame:
    """``frame`` with ``split``: the first rows of each session are train, the next val, the rest test."""
    if round(train + val + test, 6) != 1.0:
        raise ValueError("the three shares must add up to 1")
    n = F.count("*").over(Window.partitionBy(*keys)).cast("double")
    place = F.row_number().over(session(keys)) - 1
    first = F.greatest(F.lit(1), F.floor(n * F.lit(float(train))))
    second = F.least(n, F.greatest(first + 1, F.floor(n * F.lit(float(train) + float(val)))))
    return frame.withColumn("split", F.when(place < first, "train").when(place < second, "val").otherwise("test"))
