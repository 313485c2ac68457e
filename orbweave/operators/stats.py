"""Forecast errors, paired comparisons, signed-rank tests and bootstrap intervals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from orbweave.operators.ranks import summed_before
from orbweave.storage import materialise

METRICS = ("realized_next_latency_ms", "regret_ms", "best_path_match", "success_under_budget")
COMPARED = ("comparison_name", "metric_name")
EXACT_UP_TO = 50
PRIME = (1 << 31) - 1


def forecast_metrics(predictions: DataFrame, keys: tuple[str, ...] = ("model_name",)) -> DataFrame:
    """MAE, RMSE, MAPE (over truths that aren't about 0) and rows per model, of (y_true, y_pred)."""
    error, truth = F.abs(F.col("y_true") - F.col("y_pred")), F.abs("y_true")
    return predictions.groupBy(*keys).agg(F.avg(error).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.when(truth > 1e-9, error / truth)).alias("mape"), F.count("*").alias("row_count"))


def best_model(metrics: DataFrame, keys: tuple[str, ...] = ("family",)) -> DataFrame:
    """The model of least MAE for each of ``keys``, of equal ones the first by name."""
    return metrics.groupBy(*keys).agg(F.min_by("model_name", F.struct("mae", "model_name")).alias("model_name"), F.min("mae").alias("mae"))


def paired_policies(decisions: DataFrame, comparisons: list[tuple[str, str, str]], metrics: tuple[str, ...] = METRICS[:2], window: tuple[str, ...] = ("session_bin_index",)) -> DataFrame:
    """(comparison_name, metric_name, window, delta): left minus right policy on each window that both decided."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("left"), F.lit(b).alias("right")) for n, a, b in comparisons])
    values = F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("double") for m in metrics]))
    side = lambda which: decisions.select(*window, "policy_name", values.alias(which), F.explode(pairs).alias("c")).where(F.col("policy_name") == F.col(f"c.{which}")).select(*window, F.col("c.name").alias("comparison_name"), which)
    both = side("left").join(side("right"), ["comparison_name", *window])
    long = both.select("comparison_name", *window, F.explode(F.array(*map(F.lit, metrics))).alias("metric_name"), "left", "right")
    return long.select("comparison_name", "metric_name", *window, (F.element_at("left", F.col("metric_name")) - F.element_at("right", F.col("metric_name"))).alias("delta"))


def paired_deltas(deltas: DataFrame, keys: tuple[str, ...] = COMPARED) -> DataFrame:
    return deltas.groupBy(*keys).agg(F.count("*").alias("sample_count"), F.avg("delta").alias("mean_delta"), F.median("delta").alias("median_delta"))


def signed_ranks(deltas: DataFrame, keys: tuple[str, ...] = COMPARED, places: int = 9) -> DataFrame:
    """Per comparison and metric: the signed-rank statistic, its normal score, and what decides how p is found.

    Deltas are counted per size first, so ties are one row whatever their number; the rank of a size is its count's middle
    after all lesser ones, by prefix sums over range partitions.
    """
    d = deltas.withColumn("delta", F.round("delta", places))
    sizes = d.where("delta <> 0").groupBy(*keys, F.abs("delta").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("delta") > 0).alias("up"))
    ranked = summed_before(sizes, ["size"], "t", keys)
    rank, t = F.col("before") + (F.col("t") + 1) / 2.0, F.col("t").cast("double")
    sums = ranked.groupBy(*keys).agg(F.sum("t").alias("nonzero_count"), F.least(F.sum(F.col("up") * rank), F.sum((F.col("t") - F.col("up")) * rank)).alias("statistic"), F.sum(t * (t * t - 1)).alias("tie_sum"))
    every = d.groupBy(*keys).agg(F.count("*").alias("sample_count"))
    n = F.coalesce("nonzero_count", F.lit(0)).cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.coalesce("tie_sum", F.lit(0.0)) / 48.0
    z = F.when(var > 0, (F.coalesce("statistic", F.lit(0.0)) - n * (n + 1) / 4.0) / F.sqrt(var)).otherwise(0.0)
    return every.join(sums, list(keys), "left").select(*keys, "sample_count", F.coalesce("nonzero_count", F.lit(0)).cast("long").alias("nonzero_count"), F.coalesce("statistic", F.lit(0.0)).alias("statistic"), z.alias("z_score"), F.coalesce("tie_sum", F.lit(0.0)).alias("tie_sum"))


def signed_rank_p(n_all: int, n: int, statistic: float, z: float, tied: bool) -> float:
    """Two-sided p: exact for up to 50 deltas without zeros or ties, else the normal form without continuity correction."""
    if n == 0:
        return 1.0
    if n <= EXACT_UP_TO and n == n_all and not tied:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(min(1.0, 2 * ways[: int(math.floor(statistic + 1e-9)) + 1].sum() / 2.0**n))
    return math.erfc(abs(z) / math.sqrt(2))


def signed_rank_test(deltas: DataFrame, keys: tuple[str, ...] = COMPARED) -> DataFrame:
    """``signed_ranks`` with ``p_value``, found by a small function on one row per comparison."""

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            p = [signed_rank_p(r["sample_count"], r["nonzero_count"], r["statistic"], r["z_score"], r["tie_sum"] > 0) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, "p_value"])

    ranks = signed_ranks(deltas, keys)
    return ranks.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in [*ranks.dtypes, ("p_value", "double")]))


def significance(decisions: DataFrame, comparisons: list[tuple[str, str, str]], by: tuple[str, ...] = (), unit: str = "session_bin_index") -> DataFrame:
    """Mean and median delta and the signed-rank test of every comparison and metric, in each of ``by`` (a scenario, say)."""
    keys = (*by, *COMPARED)
    deltas = materialise(paired_policies(decisions, comparisons, window=(*by, unit)), "deltas")
    return paired_deltas(deltas, keys).join(signed_rank_test(deltas, keys).drop("sample_count"), list(keys))


def poisson_cuts() -> list[float]:
    """The cumulative probabilities of a Poisson variable of mean 1: a draw counts how many of them it reaches."""
    total, term, out = 0.0, math.exp(-1), []
    for k in range(1, 13):
        total += term
        out.append(total)
        term /= k
    return out


def poisson_weights(a: np.ndarray, c: np.ndarray, rounds: int) -> np.ndarray:
    """How often each unit (rows, with hashes ``a`` and ``c``) counts in each round: Poisson(1) draws from a * round + c mod a prime."""
    u = (a[:, None] * np.arange(1, rounds + 1)[None, :] + c[:, None]) % PRIME / PRIME
    return np.searchsorted(poisson_cuts(), u, side="right")


def bootstrap_intervals(decisions: DataFrame, metrics: tuple[str, ...] = METRICS, keys: tuple[str, ...] = ("policy_name",), unit: str = "session_bin_index", rounds: int = 2000, share: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile bootstrap of the mean over units (windows), by weights: a unit counts Poisson(1) times in every round.

    The weight is a hash of unit and round, the same for all groups and metrics, so nothing is drawn or joined. Each task
    folds its rows into one array of sums per group, and these are what is shuffled and folded again, one after another:
    neither rows nor rounds multiply. A round in which nothing counts is left out; one unit gives (mean, mean).
    """
    names, m = [*keys, "a", "c", *metrics], len(metrics)
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(unit).cast("string")).cast("binary"))
    number = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("long") % PRIME
    rows = decisions.select(*keys, number(1).alias("a"), number(9).alias("c"), *[F.col(x).cast("double").alias(x) for x in metrics])
    types = [f"{k} {decisions.schema[k].dataType.simpleString()}" for k in keys]

    def add(sums, key, part):
        if key in sums:
            sums[key] += part
        else:
            sums[key] = part

    def fold(batches):  # per group: weighted sums by round and metric, weights by round, and at the end plain sums and the count
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            of: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(b.column(k).to_pylist() for k in keys), strict=True)):
                of.setdefault(key, []).append(i)
            a, c, *x = (b.column(n).to_numpy(zero_copy_only=False) for n in names[len(keys) :])
            x = np.column_stack([*x, np.ones(b.num_rows)])
            for key, own in of.items():
                for at in range(0, len(own), 1024):
                    i = np.array(own[at : at + 1024])
                    add(sums, key, np.concatenate([(poisson_weights(a[i], c[i], rounds).T @ x[i]).ravel(), x[i].sum(axis=0)]))
        yield from batch(sums)

    def batch(sums):
        for key, s in sums.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v], f.type) for v, f in zip(key, arrow, strict=True)], pa.array([s.tolist()], pa.list_(pa.float64()))], [*keys, "sums"])

    def finish(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                add(sums, tuple(key), np.array(s))
        for key, s in sums.items():
            table, plain = s[: -(m + 1)].reshape(rounds, m + 1), s[-(m + 1) :]
            means = table[table[:, m] > 0]
            low, high = (np.percentile(means[:, :m] / means[:, m:], q, axis=0) if len(means) else plain[:m] / plain[m] for q in ((1 - share) * 50, 100 - (1 - share) * 50))
            columns = [[metrics[j], float(plain[j] / plain[m]), float(low[j]), float(high[j]), int(plain[m])] for j in range(m)]
            if plain[m] == 1:
                columns = [[n, v, v, v, k] for n, v, _, _, k in columns]
            made = zip(*[[*key, *c] for c in columns], strict=True)
            kinds = [*[f.type for f in arrow], pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], [*keys, "metric_name", "mean_value", "ci_lower", "ci_upper", "sample_count"])

    arrow = list(to_arrow_schema(rows.select(*keys).schema))
    folded = rows.mapInArrow(fold, ", ".join([*types, "sums array<double>"])).repartition(*keys)
    return folded.mapInArrow(finish, ", ".join([*types, "metric_name string, mean_value double, ci_lower double, ci_upper double, sample_count long"]))


def resampled_intervals(decisions: DataFrame, metrics: tuple[str, ...] = METRICS, keys: tuple[str, ...] = ("policy_name",), unit: str = "session_bin_index", rounds: int = 2000, share: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile bootstrap of the mean by drawing exactly n of n windows in every round; for few windows.

    Draw i of round b is the window of place hash(seed, b, i) mod n. Draws join the values by (group, place): rows times
    rounds are joined, where ``bootstrap_intervals`` joins nothing. The same draws serve all metrics of a group.
    """
    order = Window.partitionBy(*keys).orderBy(unit)
    n = F.count("*").over(Window.partitionBy(*keys))
    placed = decisions.select(*keys, (F.row_number().over(order) - 1).alias("place"), n.alias("n"), *[F.col(m).cast("double").alias(m) for m in metrics])
    draws = placed.select(*keys, F.col("place").alias("i"), "n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("b"))
    draws = draws.select(*keys, "b", F.pmod(hash_long(seed, F.col("b"), F.col("i")), F.col("n")).alias("place"))
    means = draws.join(placed, [*keys, "place"]).groupBy(*keys, "b").agg(*[F.avg(m).alias(m) for m in metrics])
    long = lambda df, name: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric_name"), F.col(m).alias(name)) for m in metrics])).alias("x")).select(*keys, "x.metric_name", f"x.{name}")
    low = (1 - share) / 2
    ends = long(means, "v").groupBy(*keys, "metric_name").agg(F.percentile("v", F.array(F.lit(low), F.lit(1 - low))).alias("p"))
    own = long(placed, "v").groupBy(*keys, "metric_name").agg(F.avg("v").alias("mean_value"), F.count("*").alias("sample_count"))
    return own.join(ends, [*keys, "metric_name"]).select(*keys, "metric_name", "mean_value", F.col("p")[0].alias("ci_lower"), F.col("p")[1].alias("ci_upper"), "sample_count")


def hash_long(seed: int, *parts):
    """The first 32 bits of an MD5 as a number; the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def scenario_pivot(rows: DataFrame, index: str, column: str, values: list[str], measure: str) -> DataFrame:
    return rows.groupBy(index).pivot(column, values).agg(F.first(measure))


def interval_pivot(intervals: DataFrame, summary: DataFrame, metrics: tuple[str, ...] = METRICS, keys: tuple[str, ...] = ("policy_name",)) -> DataFrame:
    """Intervals with a column per metric and end, joined to the policy summary."""
    wide = intervals.groupBy(*keys).pivot("metric_name", list(metrics)).agg(F.first("ci_lower").alias("ci_lower"), F.first("ci_upper").alias("ci_upper"))
    return summary.join(wide, list(keys), "left")
