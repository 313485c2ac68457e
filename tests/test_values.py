"""The queries that SQL cannot express, against numpy and plain Python on the smallest tables."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions.scalars import feature_columns
from orbweave.operators import models, peers, policies, stress
from orbweave.plans import jobs, registry

ROUNDS = 3


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return jobs.materialise(registry.graph(spark, sf_dir), "values-table")


@pytest.fixture(scope="module")
def plain(table):
    return table.toPandas().sort_values(["relative_path", "bin_epoch"]).reset_index(drop=True)


def _design(rows, columns, like=None):
    """Columns of the design matrix, centred and scaled as those of ``like``."""
    like = rows if like is None else like
    x, y = (r[columns].fillna(0.0).to_numpy(float) for r in (rows, like))
    centre, scale = y.mean(0), np.maximum(y.std(0), 1e-12)
    scale[y.std(0) < 1e-9 * np.maximum(1, np.abs(centre))] = 1.0
    return np.column_stack([np.ones(len(x)), (x - centre) / scale])


def _fitted(train, test, columns):
    w = np.linalg.pinv(_design(train, columns), rcond=1e-9) @ train.target_next.to_numpy(float)
    return _design(test, columns, train) @ w


def test_file_listing(spark, sf_dir):
    got = {os.path.basename(r.path): r.length for r in registry.queries()["file_listing"](spark, sf_dir).collect()}
    assert got == {f: os.path.getsize(f"{sf_dir}/{f}") for f in os.listdir(sf_dir) if f.endswith(".parquet")}


def test_least_squares_queries(spark, sf_dir, table, plain):
    columns = jobs.temporal_columns(table)
    train, test = plain[plain.split != "test"], plain[plain.split == "test"]
    expected = _fitted(train, test, columns)
    got = registry.queries()["ols_predict"](spark, sf_dir).toPandas().sort_values(["relative_path", "bin_epoch"])
    assert np.abs(got.y_pred.to_numpy() - expected).max() < 1e-3
    assert np.allclose(got.y_true, test.target_next, atol=1e-5)
    errors = {r.model_name: r for r in registry.queries()["run_forecast_baselines"](spark, sf_dir).collect()}
    miss = np.abs(test.target_next - expected)
    assert abs(errors["linear_regression"].mae - miss.mean()) < 1e-3 and abs(errors["linear_regression"].rmse - math.sqrt((miss**2).mean())) < 1e-3
    assert abs(errors["persistence"].mae - np.abs(test.target_next - test.latency_mean_ms).mean()) < 1e-5
    said = {r.feature: r.coefficient for r in registry.queries()["ols_fit"](spark, sf_dir).collect()}
    exact = models.ols_fit(table.where("split <> 'test'"), columns)
    by_hand = exact[""] + test[columns].fillna(0.0).to_numpy(float) @ np.array([exact[c] for c in columns])
    assert np.abs(by_hand - expected).max() < 1e-3
    assert set(said) == {"", *columns} and all(abs(said[c] - exact[c]) < 2e-6 for c in columns)  # the query's are rounded


def test_leave_one_session_out(table, plain):
    columns = jobs.temporal_columns(table)
    folds = models.session_holdout(table, {"temporal": columns, "graph_context": feature_columns(table)}, boosted=("graph_context",), folds=2, rounds=ROUNDS)
    folds = jobs.materialise(folds, "values-folds")
    rows = {r.held_out_relative_path: r for r in folds.collect()}
    assert set(rows) == set(plain.relative_path)
    for path in sorted(rows)[:12]:
        own = plain[plain.relative_path == path]
        miss = np.abs(own.target_next - _fitted(plain[plain.relative_path != path], own, columns))
        assert rows[path].row_count == len(own)
        assert abs(rows[path].temporal_mae - miss.mean()) < 1e-2 * (1 + miss.mean()), path
    summary = models.holdout_summary(folds).first()
    mae = np.array([[r.temporal_mae, r.graph_context_mae] for r in rows.values()])
    assert summary.fold_count == len(rows) and np.allclose([summary.temporal_mae_mean, summary.graph_context_mae_mean], mae.mean(0))
    for r in models.fold_deltas(folds).collect():
        assert math.isclose(r.mae_delta_graph_minus_temporal, r.graph_context_mae - r.temporal_mae) and (r.temporal_better_mae, r.graph_context_better_mae) == (int(r.temporal_mae < r.graph_context_mae), int(r.temporal_mae > r.graph_context_mae))
    assert np.allclose([summary.temporal_mae_std, summary.graph_context_mae_std], mae.std(0)) and math.isclose(summary.mean_mae_delta, (mae[:, 1] - mae[:, 0]).mean(), abs_tol=1e-9)
    assert (summary.temporal_better_fold_count, summary.graph_context_better_fold_count) == ((mae[:, 0] < mae[:, 1]).sum(), (mae[:, 1] < mae[:, 0]).sum())


def _summary(rows, column, window):
    """Mean latency, mean regret and share of best paths when the candidate of least ``column`` is taken in every window."""
    order = rows.sort_values([column, "relative_path", "bin_epoch"]).groupby(window).first()
    best = rows.sort_values(["target_next", "relative_path", "bin_epoch"]).groupby(window).first()
    return order.target_next.mean(), (order.target_next - best.target_next).mean(), (order.relative_path == best.relative_path).mean()


def _planted(spark):
    """Windows of four candidates whose truth leans on one expert in validation rows and on the other in test rows."""
    rng, rows = random.Random(1), []
    for scenario, window, path in itertools.product(("base", "burst"), range(120), range(4)):
        split = ("train", "val", "test")[window % 3]
        t, g = rng.uniform(20, 90), rng.uniform(20, 90)
        truth = {"train": 50.0, "val": 0.5 * t + 0.5 * g, "test": 0.8 * t + 0.2 * g}[split]
        rows.append((scenario, f"p{path}", "l", "active", split, window, window, t, t, g, 50.0, truth, 0))
    columns = "stress_scenario string, relative_path string, location string, path_state string, split string, session_bin_index long, bin_epoch long, latency_mean_ms double, t double, g double, still double, target_next double, stress_applied int"
    return spark.createDataFrame(rows, columns)


def test_weights_are_tuned_on_validation_rows_and_used_on_test_rows(spark):
    table = _planted(spark)
    experts = {"temporal": {"t": jobs.one_column("t"), "still": jobs.one_column("still")}, "graph": {"g": jobs.one_column("g")}}
    both = policies.add_scores(table.withColumns({"pred_forecast": F.col("t"), "pred_graph": F.col("g")}))
    of = {split: policies.consensus_tuning(both.where(F.col("split") == split)).first() for split in ("val", "test")}
    assert (of["val"].temporal_weight, of["val"].disagreement_penalty) == (0.5, 0.0) != (of["test"].temporal_weight, of["test"].disagreement_penalty)
    made = jobs.robustness_tables(table.limit(0), experts=experts, table=table)
    assert made["tuning"].first() == of["val"]
    for r in made["decisions"].collect():
        assert math.isclose(r.pred_simple_fusion, 0.5 * r.pred_forecast + 0.5 * r.pred_graph) and math.isclose(r.pred_consensus, r.pred_simple_fusion)
    test = both.where("split = 'test'")
    assert sorted(made["penalty_sweep"].collect()) == sorted(policies.penalty_sweep(test, weight=0.5, other=0.5).collect())
    assert {(r.best_temporal_model, r.best_graph_model) for r in made["policy_summary"].collect()} == {("t", "g")}


def test_the_better_expert_speaks_in_each_scenario(spark):
    table = _planted(spark).withColumn("still", F.when(F.col("stress_scenario") == "burst", F.col("target_next") + 1).otherwise(F.col("still") + 500))
    experts = {"temporal": {"t": jobs.one_column("t"), "still": jobs.one_column("still")}, "graph": {"g": jobs.one_column("g")}}
    made = jobs.robustness_tables(table.limit(0), experts=experts, table=table)
    assert {(r.stress_scenario, r.best_temporal_model) for r in made["policy_summary"].collect()} == {("base", "t"), ("burst", "still")}
    assert {r.model_name for r in made["metrics"].collect()} == {"persistence", "t", "still", "g"}


def test_structural_rows_are_the_shifted_forecast_table_with_its_peers(spark, sf_dir):
    bins = registry.indexed(spark, sf_dir)
    shifted = peers.snapshot_features(stress.structural_forecast_stress(registry.forecast(spark, sf_dir)))
    made = jobs.scenario_table(bins).where("stress_scenario = 'structural'")
    names = sorted(c for c in shifted.columns if c not in ("measurement_family", "window_start"))
    rows = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).na.fill("").collect())
    assert rows(made) == rows(shifted) and made.where("stress_applied = 1").count() > 0


def test_policies_under_stress(spark, sf_dir):
    made = jobs.robustness_tables(registry.indexed(spark, sf_dir), rounds=ROUNDS)
    rows = made["decisions"].toPandas()
    assert {r.stress_scenario for r in made["policy_summary"].collect()} == {"base", "burst", "outage", "structural"}
    assert rows.pred_graph.nunique() > 10 and not np.allclose(rows.pred_graph, rows.pred_forecast)
    for r in made["policy_summary"].collect():
        own = rows[(rows.stress_scenario == r.stress_scenario) & (rows.policy_name == r.policy_name)]
        assert np.allclose((r.mean_realized_latency_ms, r.mean_regret_ms), (own.realized_next_latency_ms.mean(), own.regret_ms.mean()))
        assert (r.best_temporal_model, r.best_graph_model) == ("linear_regression", "boosted_trees")


def test_ablation_is_by_scenario_and_features(spark, sf_dir):
    made = jobs.ablation_tables(registry.indexed(spark, sf_dir), ROUNDS)
    rows = {(r.stress_scenario, r.policy_name): r for r in made["summary"].collect()}
    assert set(rows) == set(itertools.product(("base", "burst", "outage"), jobs.ABLATION_POLICIES))
    assert all(r.mean_regret_ms >= 0 and 0 <= r.best_path_match_rate <= 1 and r.regret_ms_ci_lower <= r.mean_regret_ms + 1e-9 and r.mean_regret_ms <= r.regret_ms_ci_upper + 1e-9 for r in rows.values())
    tests = made["significance"].collect()
    assert len(tests) == 3 * 2 * 2 and {r.comparison_name for r in tests} == {"full_vs_temporal", "full_vs_graph_only"}
    # the temporal policy is least squares of base rows
    table = jobs.scenario_table(registry.indexed(spark, sf_dir), ("base", "burst", "outage")).toPandas()
    temporal = jobs.temporal_columns(jobs.scenario_table(registry.indexed(spark, sf_dir), ("base",)))
    train, test = table[(table.stress_scenario == "base") & (table.split != "test")], table[table.split == "test"].copy()
    test["said"] = _fitted(train, test, temporal)
    for scenario, own in test.groupby("stress_scenario"):
        got = rows[scenario, "predictive_temporal_only"]
        assert np.allclose((got.mean_realized_latency_ms, got.mean_regret_ms, got.best_path_match_rate), _summary(own, "said", ["session_bin_index"]))


def test_three_hundred_rounds_and_no_files_left(spark):
    rng = random.Random(7)
    rows = [(x := rng.random(), y := rng.random(), 10 * x + (5 if y > 0.5 else 0)) for _ in range(300)]
    table = jobs.materialise(spark.createDataFrame(rows, "x double, y double, target_next double"), "rounds")
    model = models.boosted_fit(table, ["x", "y"], models.ROUNDS, 2)
    assert model.getNumTrees == 300
    said = models.with_boosted(table, model, ["x", "y"], "p").toPandas()
    assert np.abs(said.p - said.target_next).mean() < 0.3
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not [f for _, _, files in os.walk(folder) for f in files if f.startswith("part-")]


def test_side_by_side_keeps_names_and_errors(spark):
    made = models.side_by_side(spark, {str(k): lambda k=k: spark.range(k).count() for k in range(6)})
    assert made == {str(k): k for k in range(6)} and models.side_by_side(spark, {}) == {}
    with pytest.raises(ZeroDivisionError):
        models.side_by_side(spark, {"a": lambda: 1, "b": lambda: 1 // 0})


def test_trees_learn(table, plain):
    every = feature_columns(table)
    train, test = table.where("split <> 'test'"), table.where("split = 'test'")
    said = models.boosted_predict(test, models.boosted_fit(train, every, 20, 3), every).toPandas()
    assert np.isfinite(said.y_pred).all() and said.y_pred.nunique() > 10
    assert np.abs(said.y_true - said.y_pred).mean() < np.abs(plain[plain.split == "test"].target_next - plain[plain.split == "test"].latency_mean_ms).mean()


def test_signed_rank_query(spark, sf_dir):
    deltas = registry.deltas(spark, sf_dir).toPandas()
    made = registry.queries()["signed_rank_test"](spark, sf_dir).collect()
    assert len(made) == 14
    for r in made:
        d = deltas[(deltas.comparison_name == r.comparison_name) & (deltas.metric_name == r.metric_name)].delta.round(9)
        x = d[d != 0].to_numpy()
        size = np.abs(x)
        rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
        w = min(rank[x > 0].sum(), rank[x < 0].sum()) if len(x) else 0.0
        assert (r.sample_count, r.nonzero_count) == (len(d), len(x)) and math.isclose(r.statistic, w)
        n, ties = len(x), [(size == s).sum() for s in np.unique(size)]
        if n == 0:
            assert r.p_value == 1.0
        elif n == len(d) <= 15 and max(ties) == 1:  # all ways of giving signs
            low = sum(sum(c) <= w for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k))
            assert math.isclose(r.p_value, min(1.0, 2 * low / 2**n), abs_tol=1e-6)
        elif n < len(d) or max(ties) > 1 or n > 50:
            var = n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties) / 48
            assert math.isclose(r.p_value, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * var)), abs_tol=1e-6)


def test_selection_query(spark, sf_dir):
    rows = registry.queries()["diverse_selection"](spark, sf_dir).orderBy("rank").collect()
    ranked = registry.queries()["candidate_ranking"](spark, sf_dir).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    best = {r.relative_path for r in ranked if r.place == 1}
    assert rows[0].relative_path in best and rows[0].candidate_score == max(r.candidate_score for r in ranked)
