"""Persistence, least squares and boosted trees, and least squares with each session left out in turn."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import trees

TARGET = "target_next"
KEYS = ("relative_path", "bin_epoch")
ROUNDS, DEPTH = 300, 6  # of boosted trees
FOLDS = 4
AT_ONCE = 4  # fits that run side by side
KEYS_HELD = 2000  # whose sums of products a task holds
AT_A_TIME = 500  # sessions whose coefficients are solved together


def persistence_forecast(frame: DataFrame) -> DataFrame:
    return frame.select(*KEYS, F.lit("persistence").alias("model_name"), F.col(TARGET).alias("y_true"), F.col("latency_mean_ms").alias("y_pred"))


def _cleaned(frame: DataFrame, features: list[str], *more: str) -> DataFrame:
    return frame.select(*more, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(TARGET).cast("double").alias(TARGET))


def gram_sums(frame: DataFrame, features: list[str], centre: np.ndarray, key: str | None = None) -> DataFrame:
    """Sums of products of (1, features - centre, target), upper half by rows, per ``key``: one distributed pass.

    Each task adds up the products of its batches in numpy; what is shuffled is one row per task and key, and what a task
    then holds is one key's sums. Without ``key`` one row is left.
    """
    work = _cleaned(frame, features, *([key] if key else []))
    if not key:
        work = work.withColumn("_all", F.lit("all"))
        key = "_all"
    width = len(features) + 2
    upper = np.triu_indices(width)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[b.column(c).to_numpy(zero_copy_only=False) for c in features], b.column(TARGET).to_numpy(zero_copy_only=False)])
            x[:, 1:-1] -= centre
            names = b.column(key).to_numpy(zero_copy_only=False)
            order = np.argsort(names, kind="stable")
            cuts = np.flatnonzero(np.r_[True, names[order][1:] != names[order][:-1]])
            for at, stop in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
                own = x[order[at:stop]]
                k = names[order[at]]
                sums[k] = sums.get(k, 0) + (own.T @ own)[upper]
            if len(sums) > KEYS_HELD:
                yield told(sums)
                sums.clear()
        if sums:
            yield told(sums)

    def told(sums):
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["k", "g"])

    def added(batches):
        last, sums = None, None
        for b in batches:
            done = {}
            for k, g in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g = np.frombuffer(g.as_buffer())
                if sums is not None and k == last:
                    sums = sums + g
                    continue
                if sums is not None:
                    done[last] = sums
                last, sums = k, g
            if done:
                yield told(done)
        if sums is not None:
            yield told({last: sums})

    return work.mapInArrow(run, "k string, g binary").repartition("k").sortWithinPartitions("k").mapInArrow(added, "k string, g binary")


def _square(g: bytes, width: int) -> np.ndarray:
    """Sums of products as a matrix."""
    made = np.zeros((width, width))
    made[np.triu_indices(width)] = np.frombuffer(g)
    return made + np.triu(made, 1).T


def solve(gram: np.ndarray) -> np.ndarray:
    """Intercept and coefficients from the sums, by a pseudo-inverse of the standardised matrix (collinear columns share);
    of one matrix or of each of several."""
    a, b = gram[..., :-1, :-1], gram[..., :-1, -1]
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=-2, axis2=-1), 1e-300))
    scale = np.where(scale < 1e-12, 1.0, scale)
    inverse = np.linalg.pinv(a / (scale[..., :, None] * scale[..., None, :]), rcond=1e-10, hermitian=True)
    return (inverse @ (b / scale)[..., None])[..., 0] / scale


def _centre(frame: DataFrame, features: list[str]) -> np.ndarray:
    row = _cleaned(frame, features).agg(*[F.avg(c).alias(c) for c in features]).first()
    return np.array([row[c] or 0.0 for c in features])


def ols_fit(frame: DataFrame, features: list[str]) -> dict[str, float]:
    """Least squares with intercept; the features' sums (a p x p matrix) are all that reaches the driver."""
    centre = _centre(frame, features)
    rows = gram_sums(frame, features, centre).collect()
    w = solve(_square(rows[0].g, len(features) + 2)) if rows else np.zeros(len(features) + 1)
    return {"": float(w[0] - w[1:] @ centre)} | dict(zip(features, w[1:].tolist(), strict=True))


def ols_value(model: dict[str, float]) -> Column:
    """What a least squares model says of a row."""
    return sum([F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in model.items() if c], F.lit(model[""]))


def ols_predict(frame: DataFrame, model: dict[str, float], name: str = "linear_regression") -> DataFrame:
    return frame.select(*KEYS, F.lit(name).alias("model_name"), F.col(TARGET).alias("y_true"), ols_value(model).alias("y_pred"))


def single_feature_ols(frame: DataFrame, feature: str = "latency_mean_ms") -> DataFrame:
    return frame.agg(F.regr_slope(TARGET, feature).alias("slope"), F.regr_intercept(TARGET, feature).alias("intercept"))


def boosted_fit(frame: DataFrame, features: list[str], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = 0.05, seed: int = 42) -> trees.BoostedTrees:
    """Boosted trees on squared errors; every tree sees a share of the rows and features, and leaf values have an L2 term."""
    return boosted_fits({"": (frame, features)}, rounds, depth, rate, seed)[""]


def boosted_fits(fits: dict[Hashable, tuple[DataFrame, list[str]]], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = 0.05, seed: int = 42, where: dict[Hashable, Column] | None = None) -> dict[Hashable, trees.BoostedTrees]:
    """Several models, each of its own rows and features, grown in step by the tasks of one stage; ``where`` says which rows each fit learns from."""
    if not fits:
        return {}
    return dict(zip(fits, trees.boosted_fits(list(fits.values()), TARGET, KEYS, rounds, depth, rate, seed, where and [where[k] for k in fits]), strict=True))


def side_by_side(spark: SparkSession, calls: dict[str, Callable], most: int = AT_ONCE) -> dict:
    """The results of independent fits, at most ``most`` at a time, each in a driver thread and a scheduler pool of its own.

    The jobs of a fit leave most of a cluster idle between their small stages; with ``spark.scheduler.mode`` FAIR the pools
    share it evenly, and with FIFO later fits take what earlier ones leave.
    """

    def run(name):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{name}")
        try:
            return calls[name]()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    if not calls:
        return {}
    with ThreadPoolExecutor(min(most, len(calls))) as threads:
        return dict(zip(calls, threads.map(run, calls), strict=True))


def with_boosted(frame: DataFrame, model: trees.BoostedTrees, features: list[str], name: str) -> DataFrame:
    """``frame`` with the trees' prediction as column ``name``."""

    @F.pandas_udf("double")
    def said(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.predict([c.to_numpy() for c in columns]))

    return frame.withColumn(name, said(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))


def boosted_predict(frame: DataFrame, model: trees.BoostedTrees, features: list[str], name: str = "boosted_trees") -> DataFrame:
    return with_boosted(frame, model, features, "_said").select(*KEYS, F.lit(name).alias("model_name"), F.col(TARGET).alias("y_true"), F.col("_said").alias("y_pred"))


def boosted_holdout(frame: DataFrame, features: list[str], folds: int = FOLDS, rounds: int = ROUNDS) -> DataFrame:
    """relative_path, ``target_next`` and y_pred of boosted trees that have not seen the row's session.

    Sessions are dealt into ``folds`` groups by hash, and each group is predicted by trees learnt from all the others: with
    thousands of sessions, leaving out one at a time would take as many fits. ``frame`` is best a written table.
    """
    group = F.pmod(F.xxhash64("relative_path"), F.lit(folds))
    fitted = boosted_fits({k: (frame, features) for k in range(folds)}, rounds, where={k: group != k for k in range(folds)})
    out = None
    for k, model in fitted.items():
        if not len(model.values) and rounds:  # no other session to learn from
            continue
        one = with_boosted(frame.where(group == k), model, features, "y_pred").select("relative_path", TARGET, "y_pred")
        out = one if out is None else out.union(one)
    return frame.select("relative_path", TARGET, F.lit(0.0).alias("y_pred")).limit(0) if out is None else out


def session_holdout(frame: DataFrame, features: dict[str, list[str]], boosted: tuple[str, ...] = (), folds: int = FOLDS, rounds: int = ROUNDS) -> DataFrame:
    """held_out_relative_path, row_count and MAE and RMSE of each named feature list, with that session left out.

    Those named in ``boosted`` are fitted by boosted trees (see ``boosted_holdout``), the others by least squares: a fold's
    sums are all sums less the session's own, so all folds come from one pass; each session's coefficients are solved in
    the tasks and joined to its rows.
    """
    out = None
    for name, columns in features.items():
        if name in boosted:
            rows, error = boosted_holdout(frame, columns, folds, rounds), F.col(TARGET) - F.col("y_pred")
            out = _fold_errors(rows, error, name, out)
            continue
        centre = _centre(frame, columns)
        own = gram_sums(frame, columns, centre, "relative_path")
        width = len(columns) + 2
        every = gram_sums(frame, columns, centre).collect()
        total = _square(every[0].g, width) if every else np.zeros((width, width))

        def left_out(batches, total=total, width=width):
            for b in batches:
                for at in range(0, b.num_rows, AT_A_TIME):
                    own = b.slice(at, AT_A_TIME)
                    w = solve(total - np.stack([_square(g.as_py(), width) for g in own.column(1)]))
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(w.tolist(), pa.list_(pa.float64()))], ["relative_path", "w"])

        solved = own.select(F.col("k").alias("relative_path"), "g").mapInArrow(left_out, "relative_path string, w array<double>")
        rows = _cleaned(frame, columns, "relative_path").join(solved, "relative_path")
        terms = [F.element_at("w", i + 2) * (F.col(c) - F.lit(float(centre[i]))) for i, c in enumerate(columns)]
        error = F.col(TARGET) - sum(terms, F.element_at("w", 1))
        out = _fold_errors(rows, error, name, out)
    return out


def _fold_errors(rows: DataFrame, error, name: str, out: DataFrame | None) -> DataFrame:
    """``out`` with the errors of one more model."""
    one = rows.groupBy(F.col("relative_path").alias("held_out_relative_path")).agg(F.count("*").alias("row_count"), F.avg(F.abs(error)).alias(f"{name}_mae"), F.sqrt(F.avg(error * error)).alias(f"{name}_rmse"))
    return one if out is None else out.join(one.drop("row_count"), "held_out_relative_path")


def fold_deltas(folds: DataFrame, left: str = "temporal", right: str = "graph_context") -> DataFrame:
    """``folds`` with the differences of MAE and RMSE (right minus left), and which of the two is better by MAE."""
    a, b = F.col(f"{left}_mae"), F.col(f"{right}_mae")
    return folds.withColumns({
        "mae_delta_graph_minus_temporal": b - a, "rmse_delta_graph_minus_temporal": F.col(f"{right}_rmse") - F.col(f"{left}_rmse"),
        f"{left}_better_mae": (a < b).cast("int"), f"{right}_better_mae": (b < a).cast("int"),
    })


def holdout_summary(folds: DataFrame, left: str = "temporal", right: str = "graph_context") -> DataFrame:
    a, b = F.col(f"{left}_mae"), F.col(f"{right}_mae")
    return folds.agg(
        F.count("*").alias("fold_count"), F.avg(a).alias(f"{left}_mae_mean"), F.avg(b).alias(f"{right}_mae_mean"), F.stddev_pop(a).alias(f"{left}_mae_std"), F.stddev_pop(b).alias(f"{right}_mae_std"),
        F.avg(f"{left}_rmse").alias(f"{left}_rmse_mean"), F.avg(f"{right}_rmse").alias(f"{right}_rmse_mean"), F.avg(b - a).alias("mean_mae_delta"), F.count_if(a < b).alias(f"{left}_better_fold_count"), F.count_if(b < a).alias(f"{right}_better_fold_count"),
    )


