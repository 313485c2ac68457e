"""Every query with SQL against DuckDB, on the smallest tables; the others are held against plain code in test_values."""

import pytest
from oracle import same

from orbweave.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    assert same(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)



def test_the_others_are_known():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {
        "file_listing", "diverse_selection", "signed_rank_test", "run_forecast_baselines", "ols_fit", "ols_predict", "boosted_predict", "run_graph_baseline",
        "session_holdout", "session_holdout_summary", "feature_ablation", "robustness_evaluation",
    }
