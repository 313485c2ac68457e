"""The robustness job makes the tables that are asked for, by the steps that they need, of the columns that they need."""

from orbweave.plans import jobs, registry
from orbweave.storage import recording

SOME = ("latency_mean_ms_roll_mean_3", "latency_mean_ms_roll_mean_5", "peer_latency_mean", "state_peer_latency_mean")


def test_only_wanted_phases_are_learnt(spark, sf_dir):
    seen = []

    def expert(column):
        def learn(train):
            seen.append({r.split for r in train.select("split").distinct().collect()})
            return lambda rows, name: rows.withColumn(name, jobs.F.col(column))

        return learn

    bins = registry.indexed(spark, sf_dir)
    table = jobs.scenario_table(bins, columns=SOME)
    experts = {"temporal": {"mean": expert(SOME[0])}, "graph": {"peers": expert(SOME[2])}}
    made = jobs.robustness_tables(bins, experts=experts, table=table, wanted=("metrics",))
    assert set(made) == {"metrics"} and seen == [{"train", "val"}] * 2
    seen.clear()
    assert set(jobs.robustness_tables(bins, experts=experts, table=table, wanted=("tuning",))) == {"tuning"} and seen == [{"train"}] * 2


def test_bins_are_read_once_and_no_wide_table_is_written(spark, sf_dir):
    with recording() as paths:
        table = jobs.scenario_table(registry.indexed(spark, sf_dir), columns=SOME)
    names = [p.rsplit("/", 1)[1] for p in paths]
    assert any(n.startswith("indexed-bins") for n in names) and not any(n.startswith(("shifted-features", "scenarios")) for n in names)
    wide = next(p for p in paths if "scenario-features" in p)
    assert not {"ttl_mean", "latency_mean_ms_lag_12", "measurement_family"} & set(spark.read.parquet(wide).columns)
    assert {*SOME} <= set(table.columns)
