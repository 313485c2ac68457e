"""Written trees: files of more than one size step, many logs, wide folders, and manifests that are joined."""

import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
from oracle import arrow, canonical, connection, same

from orbweave.plans import registry
from orbweave.plans.jobs import logs as job_logs
from orbweave.sources import bindings, logs


def test_sizes_count_in_scanned_candidates(spark, sf_dir, tmp_path):
    """1.2 million orders of one priority make a file of more than one step of 50 MB, as do those of the tables at 1 GB."""
    shutil.copytree(sf_dir, tmp_path / "t")
    n = 1_200_000
    few = pq.read_table(f"{sf_dir}/orders.parquet")
    many = pa.table({c: few.column(c).take(pa.array([0] * n)) for c in few.column_names}).set_column(few.column_names.index("o_orderkey"), "o_orderkey", pa.array(range(n), pa.int64()))
    os.chmod(tmp_path / "t", 0o755)
    os.remove(tmp_path / "t" / "orders.parquet")
    pq.write_table(many, tmp_path / "t" / "orders.parquet")
    folder, name = str(tmp_path / "t"), "scanned_candidates"
    got = registry.queries()[name](spark, folder).toArrow()
    assert canonical(got) == canonical(arrow(connection(folder).sql(registry.oracle_sql()[name])))
    assert [r["candidate_score"] for r in got.to_pylist() if r["folder"].startswith("orders/")] == [96]


def test_sizes_are_those_of_the_files(spark, sf_dir):
    listed = {r.relative_path: r.size_bytes for r in registry._summarised(spark, sf_dir).collect()}
    expected = arrow(connection(sf_dir).sql(registry.Q.query(registry.SIZES, "obs"))).to_pylist()
    assert len(expected) > 10 and all(listed[r["folder"]] == r["size_bytes"] for r in expected)


def test_a_log_is_a_file_and_not_a_folder(spark, sf_dir, tmp_path):
    bindings.write_logs(spark, sf_dir, str(tmp_path / "logs"))
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "logs") for f in names]
    sessions = bindings.observations(spark, sf_dir).select("relative_path").distinct().count()
    assert len(files) == sessions and not any(os.path.basename(f).startswith(".") for f in files)
    assert not any(d.startswith("name=") for _, folders, _ in os.walk(tmp_path / "logs") for d in folders)


def test_wide_trees_are_listed_in_few_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "ping-a.txt").write_text("x\n")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(key), spark.sparkContext
    context.setJobGroup("listing", "")
    try:
        assert logs.read_log_lines(spark, str(tmp_path)) is not None
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup("listing")]
    tasks = [context.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) <= 4 * context.defaultParallelism and spark.conf.get(key) == before
    assert logs.file_listing(spark, str(tmp_path)).count() == 60


def test_a_manifest_of_very_many_logs_is_joined(spark, sf_dir, monkeypatch):
    """Beyond PATHS_AT_MOST the manifest is joined by the paths below the root, which are not the relative paths."""
    monkeypatch.setattr(job_logs, "target_files", lambda *a, **k: None)
    made = registry.queries()["manifest_restriction"](spark, sf_dir)
    assert not made.isEmpty() and same(made, registry.oracle_sql()["manifest_restriction"], sf_dir)
