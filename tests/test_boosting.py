"""Boosted trees: against plain code, whatever the partitions, and a job a level for several fits."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.operators import models, trees
from orbweave.plans import jobs
from orbweave.storage import materialise


@pytest.fixture(scope="module")
def few(spark):
    """Columns of few values, so that all of them are bounds of bins."""
    rows = spark.range(0, 4000, 1, 5).select(F.col("id").alias("bin_epoch"), *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20)).alias(f"c{i}") for i in range(6)])
    return materialise(rows.withColumn("target_next", F.expr("2.0D * c0 + if(c1 > 7, 30, 0) + c2 * c3 / 10 + bin_epoch % 5")), "few-values")


COLUMNS = [f"c{i}" for i in range(6)]


def _same(a, b):
    return all(np.array_equal(x, y) for x, y in zip((a.features, a.cuts, a.values, *a.bounds), (b.features, b.cuts, b.values, *b.bounds), strict=True)) and a.start == b.start


def test_trees_do_not_depend_on_partitions(few):
    one, many = (models.boosted_fit(few.repartition(n), COLUMNS, 5, 4) for n in (1, 7))
    assert one.getNumTrees == 5 and _same(one, many)


def test_fits_in_step_are_those_made_alone_and_share_their_jobs(spark, few):
    rounds, depth = 6, 4
    fits = {"all": (few, COLUMNS), "some": (few.where("c5 < 9"), COLUMNS[:4])}
    context = spark.sparkContext
    context.setJobGroup("boosting", "")
    try:
        both = models.boosted_fits(fits, rounds, depth)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("boosting")) <= rounds * depth + 12
    assert all(_same(both[name], models.boosted_fit(rows, columns, rounds, depth)) for name, (rows, columns) in fits.items())


def test_a_trees_splits_and_leaves_are_those_of_plain_code():
    rng, depth = np.random.default_rng(3), 3
    x, keys = rng.integers(0, 32, (4, 3000)).astype(np.uint8), rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    error = np.round(5.0 * (x[0] > 11) * (x[1] > 20) + x[2] / 8 + rng.normal(size=3000), 3)
    grown = trees._Growing(depth, float(np.abs(error).max()))
    grown.begin(4, 42)
    for level in range(depth):
        tasks, parts = {0: grown.task(level)}, [slice(0, 1000), slice(1000, 3000)]
        told = [next(trees._histograms(tasks, iter([(0, np.ascontiguousarray(x[:, p]), keys[p], error[p])]))) for p in parts]
        grown.take(level, trees._added(*told).get(0))
    feature, cut, value = grown.end(0.05)
    drawn = trees._drawn(keys, 42)
    assert 0.8 < drawn.mean() < 0.9 and len(grown.columns) == 3

    def grow(node, rows, level):
        score = lambda r: error[r].sum() ** 2 / (r.sum() + trees.PENALTY)
        if level == depth:
            assert math.isclose(value[node - (1 << depth) + 1], 0.05 * error[rows].sum() / (rows.sum() + trees.PENALTY), abs_tol=1e-5)
            return
        ways = {(f, c): score(rows & (x[f] <= c)) + score(rows & (x[f] > c)) for f in grown.columns for c in range(31) if 0 < (rows & (x[f] <= c)).sum() < rows.sum()}
        assert math.isclose(ways[feature[node], cut[node]], max(ways.values()), rel_tol=1e-6)
        right = x[feature[node]] > cut[node]
        grow(2 * node + 1, rows & ~right, level + 1)
        grow(2 * node + 2, rows & right, level + 1)

    grow(0, drawn, 0)


def test_odd_rows(spark):
    rows = [(float(i % 7), None if i % 3 else float("nan"), 5.0) for i in range(50)]
    table = spark.createDataFrame(rows, "x double, y double, target_next double")
    said = models.with_boosted(table, models.boosted_fit(table, ["x", "y"], 3, 2), ["x", "y"], "p")
    assert {r.p for r in said.collect()} == {5.0}
    nothing = models.boosted_fit(table.limit(0), ["x", "y"], 3, 2)
    assert {r.p for r in models.with_boosted(table, nothing, ["x", "y"], "p").collect()} == {0.0}
    with pytest.raises(Exception, match="no finite number"):
        models.boosted_fit(table.withColumn("target_next", F.lit(None).cast("double")), ["x", "y"], 3, 2)


def test_experts_of_a_job_learn_in_step(spark, few, monkeypatch):
    """The trees of both phases (or feature lists) are one call, and each still learns from its own rows and columns."""
    seen, fits = [], models.boosted_fits
    monkeypatch.setattr(models, "boosted_fits", lambda of, *a: seen.append(set(of)) or fits(of, *a))
    calls = {"val graph": (jobs.boosted_trees(COLUMNS, 3), few.where("c5 < 9")), "test graph": (jobs.boosted_trees(COLUMNS[:4], 3), few), "plain": (jobs.one_column("c0"), few)}
    learnt = jobs._learnt(spark, calls)
    assert seen == [{"val graph", "test graph"}] and set(learnt) == set(calls)
    for name in seen[0]:
        expert, rows = calls[name]
        alone = models.with_boosted(few, fits({0: (rows, expert.columns)}, 3)[0], expert.columns, "p")
        assert sorted(r.p for r in learnt[name](few, "p").select("p").collect()) == sorted(r.p for r in alone.select("p").collect())


def test_all_rounds_are_one_stage_of_tasks_that_agree(spark, few, monkeypatch):
    """However many rounds, the jobs are the same few; and four tasks grow the trees of one."""
    fits = {"all": (few, COLUMNS), "some": (few.where("c5 < 9"), COLUMNS[:4])}
    alone = models.boosted_fits(fits, 8, 4)
    monkeypatch.setattr(trees, "ROWS_A_TASK", 1000)
    context, jobs_of = spark.sparkContext, {}
    for rounds in (2, 8):
        context.setJobGroup(f"growing-{rounds}", "")
        try:
            together = models.boosted_fits(fits, rounds, 4)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        jobs_of[rounds] = len(context.statusTracker().getJobIdsForGroup(f"growing-{rounds}"))
    assert jobs_of[2] == jobs_of[8] and all(_same(together[k], alone[k]) for k in fits)


def test_quantiles_of_many_values_are_near_the_exact_ones(monkeypatch):
    monkeypatch.setattr(trees, "CHUNK", 4096)
    rng = np.random.default_rng(5)
    values = np.sort(rng.exponential(size=400_000))
    batch = pa.RecordBatch.from_arrays([pa.array(rng.permutation(values)), pa.array([None, float("nan")] * 200_000), pa.array(values), pa.array(range(400_000)), pa.array([1] * 400_000)], ["f0", "f1", "y", "h", "of"])
    rows = pa.Table.from_batches(list(trees._summaries([0], (batch.slice(i, 10_000) for i in range(0, 400_000, 10_000))))).to_pandas()
    told = trees._quantiles(rows[rows.column == 0].reset_index()).told[0]
    assert np.abs(values.searchsorted(told) / 400_000 - np.arange(1, 256) / 256).max() < 1 / 1024
    assert set(trees._quantiles(rows[rows.column == 1].reset_index()).told[0]) == {0.0}
    assert trees._quantiles(rows[rows.column == -1].reset_index()).told[0] == pytest.approx([400_000, values.mean(), values[0], values[-1]])


def test_fits_of_rows_named_by_a_condition_are_those_of_these_rows(few):
    named = {k: (few, COLUMNS) for k in (0, 1)}
    conditions = {0: F.col("c5") < 9, 1: F.col("c5") > 4}
    shared = models.boosted_fits(named, 4, 3, where=conditions)
    assert all(_same(shared[k], models.boosted_fit(few.where(conditions[k]), COLUMNS, 4, 3)) for k in named)


def test_sums_of_products_travel_as_one_row_a_key(few, monkeypatch):
    """Not as a row per key and product, of which a session of 26 rows has some fifteen hundred."""
    monkeypatch.setattr(models, "KEYS_HELD", 3)
    rows = few.withColumn("relative_path", F.concat(F.lit("s"), (F.col("bin_epoch") % 40).cast("string")))
    made = models.gram_sums(rows, COLUMNS, np.arange(6.0), "relative_path")
    assert "Generate" not in made._jdf.queryExecution().toString()
    got, table = {r.k: models._square(r.g, 8) for r in made.collect()}, rows.toPandas()
    assert len(got) == 40
    for k, own in table.groupby("relative_path"):
        x = np.column_stack([np.ones(len(own)), own[COLUMNS].to_numpy(float) - np.arange(6.0), own.target_next])
        assert np.allclose(got[k], x.T @ x)


def test_another_attempt_goes_on_from_the_trees_kept(few, monkeypatch, tmp_path):
    fits = {"all": (few, COLUMNS)}
    alone, grown, mark = models.boosted_fits(fits, 8, 3), trees._grown, str(tmp_path / "lost")

    def lost_once(*args):  # in the tasks
        import os

        kept = trees._Exchange.__dict__["keep"]

        def keep(self, what):
            kept(self, what)
            if len(what[0]) == 6 and not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("lost")

        trees._Exchange.keep = keep
        try:
            yield from grown(*args)
        finally:
            trees._Exchange.keep = kept

    monkeypatch.setattr(trees, "ROWS_A_TASK", 1000)
    monkeypatch.setattr(trees, "CHECKPOINT_EVERY", 3)
    monkeypatch.setattr(trees, "_grown", lost_once)
    assert _same(models.boosted_fits(fits, 8, 3)["all"], alone["all"]) and (tmp_path / "lost").exists()
