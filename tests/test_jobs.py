"""The jobs end to end, on logs on disk and on the smallest tables."""

from orbweave.operators import bins
from orbweave.plans import jobs, registry
from orbweave.sources import logs


def test_tables_from_logs(spark, tmp_path):
    root = tmp_path / "data"
    day = root / "inside-out/active/loc/2025-03-29"
    day.mkdir(parents=True)
    name = "ping-t-10ms-1h-2025-03-29-13-00-00.txt"
    (day / name).write_text("PING t(1.2.3.4) from 5.6.7.8 eth0: 56\n" + "".join(f"[{60 * i}.5] 64 bytes from x: icmp_seq={i} ttl=9 time={i}.0 ms\n" for i in range(5)))
    (day / "ping-broken.txt").write_text("no reply\n")
    made = jobs.build_tables(spark, str(root), sample_rows=2)
    rows = {r.relative_path: r for r in made["session_summary"].collect()}
    good, empty = rows[f"inside-out/active/loc/2025-03-29/{name}"], rows["inside-out/active/loc/2025-03-29/ping-broken.txt"]
    assert (good.observation_count, good.epoch_start, good.epoch_end, good.interface, good.sample_stride, good.sampled_observation_count) == (5, 0.5, 240.5, "eth0", 2, 2)
    assert (empty.observation_count, empty.latency_mean_ms, empty.latency_std_ms, empty.header_target, empty.timestamp_start_utc) == (0, None, 0.0, "", "")
    assert [r.icmp_seq for r in made["observation_sample"].orderBy("line_no").collect()] == [0, 2]
    assert made["time_bins"].count() == 5 and made["time_bins"].first().target_hint == "t"


def _logs(root, names):
    paths = []
    for i, name in enumerate(names):
        day = root / "inside-out/active" / f"loc{i}" / "2025-03-29"
        day.mkdir(parents=True)
        (day / name).write_text("".join(f"[{60 * k}.5] 64 bytes from x: icmp_seq={k} ttl=9 time={k}.0 ms\n" for k in range(5)))
        paths.append(f"inside-out/active/loc{i}/2025-03-29/{name}")
    return paths


def _scanned(df):
    return {f.split("/")[-1] for f in df.inputFiles()}


def test_only_the_manifests_files_are_scanned(spark, tmp_path):
    names = [f"ping-t{i}-10ms-1h-2025-03-29-13-00-00.txt" for i in range(5)] + ["other name +1.txt"]
    paths = _logs(tmp_path / "data", names)
    root = str(tmp_path / "data")
    manifest = spark.createDataFrame([(paths[5], 1), (paths[3], 2), (paths[1], 3)], "relative_path string, rank int")
    wanted = logs.target_files(spark, root, manifest)
    assert [p.split("/")[-1] for p in wanted] == [names[5], names[3], names[1]]
    assert _scanned(logs.read_log_lines(spark, wanted, "*")) == {n.replace(" ", "%20") for n in (names[5], names[3], names[1])}
    of = lambda **options: {r.relative_path for r in jobs.build_tables(spark, root, **options)["session_summary"].collect()}
    assert of(manifest=manifest) == {paths[5], paths[3], paths[1]}
    assert of(manifest=manifest, max_files=2) == {paths[5], paths[3]}
    assert of(max_files=2) == {paths[0], paths[1]} and of(max_files=0) == set() and len(of()) == 5
    assert {r.relative_path: r.observation_count for r in jobs.build_tables(spark, root, manifest=manifest.where("rank = 2"))["session_summary"].collect()} == {paths[3]: 5}
    assert logs.target_files(spark, root, manifest, most=2) is None


def test_long_manifests_are_joined(spark, tmp_path, monkeypatch):
    names = [f"ping-t{i}-10ms-1h-2025-03-29-13-00-00.txt" for i in range(4)]
    paths = _logs(tmp_path / "data", names)
    monkeypatch.setattr(logs, "target_files", lambda *a, **k: None)
    made = jobs.build_tables(spark, str(tmp_path / "data"), manifest=spark.createDataFrame([(paths[2],)], "relative_path string"))
    assert {r.relative_path for r in made["time_bins"].collect()} == {paths[2]}


def test_samples_of_split_files_without_shuffling_lines(spark, tmp_path):
    (tmp_path / "ping-a.txt").write_text("".join("nothing\n" * (k % 3) + f"[{k}.5] 64 bytes from x: icmp_seq={k} ttl=9 time=1.0 ms\n" for k in range(9_000)))
    (tmp_path / "ping-b.txt").write_text("[1.0] 64 bytes from x: icmp_seq=7 ttl=9 time=1.0 ms\n" * 3)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
        lines = logs.read_log_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 4
        placed = logs.placed_replies(lines.withColumnRenamed("path", "relative_path"), "relative_path")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    sample = bins.observation_sample(placed, 100)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    rows = [(r.relative_path[-5:], r.icmp_seq) for r in sample.collect()]
    assert sorted(i for f, i in rows if f == "a.txt") == list(range(0, 9_000, 90)) and sum(f == "b.txt" for f, _ in rows) == 3


def test_forecasts(spark, sf_dir):
    table = jobs.materialise(jobs.graph_table(registry.day_bins(spark, sf_dir)), "graph-table")
    made = jobs.evaluate_forecasts(table, boosting_rounds=2)
    assert {r.model_name for r in made["metrics"].collect()} == {"persistence", "linear_regression", "boosted_trees"}


def test_robustness(spark, sf_dir):
    made = {name: t.collect() for name, t in jobs.robustness_tables(registry.indexed(spark, sf_dir), rounds=3).items() }
    assert {r.stress_scenario for r in made["policy_summary"]} == {"base", "burst", "outage", "structural"}
    assert len(made["penalty_sweep"]) == 20 and len(made["tuning"]) == 1
    assert len(made["significance"]) == 4 * 7 * 2 and len(made["intervals"]) == 4 * 6 * 4
    assert {r.disagreement_bin for r in made["disagreement_summary"]} == {"Low", "Medium", "High"}
    assert all(0 <= r.p_value <= 1 for r in made["significance"])
