"""Golden cells and properties of the operators."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave import storage
from orbweave.functions.scalars import forecast_horizon, human_bytes, utc_iso
from orbweave.operators import features, inventory, models, peers, policies, ranks, stats, stress
from orbweave.plans import registry
from orbweave.sources import heads, logs


def test_candidate_scores_and_sizes(spark):
    columns = ["epoch", "icmp_seq", "ttl", "latency_ms", "reply_ip"]
    name = "ping-t-10ms-{}-2025-03-29-13-00-00.txt"
    rows = [("inside-out/active/loc/2025-03-29/" + name.format("2h"), 98), ("inside-out/active/loc/2025-03-29/" + name.format("1h"), 95), ("inside-out/inactive/loc/2025-03-29/" + name.format("1h"), 90)]
    files = spark.createDataFrame([(p, ".txt", 45_742_081 + 25 * 0, True, columns, 25, "") for p, _ in rows], "relative_path string, suffix string, size_bytes long, sampled boolean, columns array<string>, row_sample_count int, notes string")
    got = {r.relative_path: r.candidate_score for r in inventory.candidate_scores(files).collect()}
    assert got == dict(rows)
    sizes = spark.createDataFrame([(45_742_081,), (1023,), (1024,), (3 * 1024**5,)], "n long").select(human_bytes("n").alias("s")).collect()
    assert [r.s for r in sizes] == ["43.6 MB", "1023.0 B", "1.0 KB", "3072.0 TB"]


def test_file_names_are_greedy_and_blank_when_odd(spark):
    df = spark.createDataFrame([("a/b/ping--100.64.0.1-10ms-1h-2025-03-29-13-00-00.txt",), ("note.txt",)], "relative_path string")
    got = df.select(*logs.path_parts(), *logs.file_name_parts()).collect()
    assert (got[0].target_hint, got[0].probe_interval, got[0].window_duration) == ("-100.64.0.1", "10ms", "1h")
    assert (got[1].target_hint, got[1].measurement_family, got[1].path_state) == ("", "note.txt", "")


def test_reply_lines_are_trimmed_and_others_skipped(spark):
    lines = ["\t[1741521600.5] 64 bytes from 2605:59c8::1: icmp_seq=12 ttl=63 time=41.3 ms \r", "no answer yet for icmp_seq=13", "", None]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)], "path string, line_no int, line string")
    got = logs.parse_replies(df).collect()
    assert [(r.epoch, r.icmp_seq, r.ttl, r.latency_ms, r.reply_ip) for r in got] == [(1741521600.5, 12, 63, 41.3, "2605:59c8::1")]


def test_logs_on_disk(spark, tmp_path):
    day = tmp_path / "inside-out/active/loc/2025-03-29"
    day.mkdir(parents=True)
    (day / "ping-t-10ms-1h-2025-03-29-13-00-00.txt").write_bytes(b"PING t(1.2.3.4) from 5.6.7.8 eth0: 56\n[1.5] 64 bytes from x: icmp_seq=1 ttl=9 time=2.0 ms\n\xff\n[0.5] 64 bytes from x: icmp_seq=2 ttl=9 time=4.0 ms\n")
    (day / "ping-empty.txt").write_text("nothing\n")
    (day / "table.csv").write_text("a,b\n1,2\n")
    assert logs.file_listing(spark, str(tmp_path)).count() == 3
    assert logs.file_listing(spark, str(tmp_path / "missing")).count() == 0
    lines = logs.read_log_lines(spark, str(tmp_path))
    assert logs.parse_headers(lines).collect()[0].interface == "eth0"
    replies = logs.parse_replies(lines).orderBy("line_no").collect()
    assert [r.epoch for r in replies] == [1.5, 0.5]


@pytest.mark.parametrize("n, sizes", [(60, (42, 9, 9)), (59, (41, 9, 9)), (119, (83, 18, 18)), (1, (1, 0, 0)), (2, (1, 1, 0))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).select(F.lit("s").alias("relative_path"), F.col("id").alias("bin_epoch"))
    got = Counter(r.split for r in features.chronological_split(df).collect())
    assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == sizes


def test_split_rejects_bad_shares(spark):
    with pytest.raises(ValueError):
        features.chronological_split(spark.range(3), 0.5, 0.2, 0.2)


def test_horizon():
    assert [forecast_horizon(10, 60), forecast_horizon(90, 60), forecast_horizon(90, 60, "floor"), forecast_horizon(10, 60, "floor")] == [1, 2, 1, 1]


def test_peers_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"p{i}", w, rng.choice("ab"), rng.choice(["x", "y", None]), f"l{i % 3}", 1e6 + rng.random() * 50, rng.randint(1, 9), rng.random()) for w in range(5) for i in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "relative_path string, session_bin_index long, path_state string, target_hint string, location string, latency_mean_ms double, observed_replies long, burst_indicator double")
    got = {(r.relative_path, r.session_bin_index): r for r in peers.snapshot_features(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r[:2]]
        others = [o for o in rows if o[1] == r[1] and o is not r]
        for name, group in (("peer", others), ("state_peer", [o for o in others if o[2] == r[2]]), ("target_peer", [o for o in others if r[3] and o[3] == r[3]])):
            x = [o[5] for o in group]
            assert math.isclose(g[f"{name}_latency_mean"], np.mean(x) if x else r[5], abs_tol=1e-6)
            assert math.isclose(g[f"{name}_latency_std"], np.std(x) if len(x) > 1 else 0.0, abs_tol=1e-4)
        assert g.snapshot_candidate_count == len(others) + 1
        here = [*others, r]
        assert g.location_degree == len({o[3] for o in here if o[4] == r[4]}) and g.target_degree == len({o[4] for o in here if o[3] == r[3]})


FILES = "relative_path string, size_bytes long, candidate_score long, location string, path_state string, window_duration string, session_date string"


def test_selection_by_hand(spark):
    rows = [
        ("a1", 5, 95, "l1", "a", "1h", "d1"), ("a2", 5, 94, "l1", "a", "1h", "d1"), ("a3", 5, 93, "l1", "a", "1h", "d2"), ("a4", 5, 92, "l1", "a", "1h", "d1"),
        ("b1", 5, 94, "l1", "b", "1h", "d1"), ("b2", 5, 90, "l1", "b", "1h", "d2"),
        ("c2", 4, 93, "l2", "a", "1h", "d1"), ("c1", 5, 93, "l2", "a", "1h", "d1"), ("c3", 5, 91, "l2", "a", "1h", "d1"),
    ]
    df = spark.createDataFrame(rows, FILES)
    picks = lambda **caps: [r.relative_path for r in inventory.diverse_selection(df, **caps).orderBy("rank").collect()]
    # first each group's best; then a2 is passed over, as l1 has two of d1; then l1 has its four, and l2 two of d1
    assert picks(top_k=10) == ["a1", "b1", "c1", "a3", "b2", "c2"]
    assert picks(top_k=4) == ["a1", "b1", "c1", "a3"]
    assert picks(max_per_location=1) == ["a1", "c1"]
    assert picks(max_per_day=1) == ["a1", "b2", "c1"]  # b1 is passed over within the turn
    assert picks(max_per_day=9, max_per_location=9) == ["a1", "b1", "c1", "a2", "b2", "c2", "a3", "c3", "a4"]


def test_selection_keeps_its_caps_and_leaves_nothing_that_fits(spark):
    rng = random.Random(9)
    files = [(f"f{i:03d}", rng.randint(1, 5), rng.randint(90, 95), f"l{rng.randint(0, 3)}", rng.choice("ab"), rng.choice(["1h", "2h", ""]), f"d{rng.randint(0, 3)}") for i in range(60)]
    got = inventory.diverse_selection(spark.createDataFrame(files, FILES), 100, 3, 2).collect()
    by_location, by_day = Counter(r.location for r in got), Counter((r.location, r.session_date) for r in got)
    assert max(by_location.values()) <= 3 and max(by_day.values()) <= 2
    chosen = {r.relative_path for r in got}
    assert all(f[0] in chosen or by_location[f[3]] == 3 or by_day[(f[3], f[6])] == 2 for f in files)


def test_places_of_a_group_that_spans_partitions(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randint(0, 50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x long, i long")
    got = {r.i: r.place for r in ranks.placed(df, [F.desc("x"), F.asc("i")], ("g",), parts=5).collect()}
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(len(own)))
    whole = {r.i: r.place for r in ranks.placed(df, ["x", "i"]).collect()}
    assert [whole[r[2]] for r in sorted(rows, key=lambda r: r[1:])] == list(range(400))
    assert ranks.placed(df.limit(0), ["x"], ("g",)).isEmpty()


def test_utc_times_in_any_time_zone(spark):
    df = spark.createDataFrame([(0,), (1741521600,), (1710054000,), (-1,)], "e long")
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r.t for r in df.select(utc_iso("e").alias("t")).collect()] == ["1970-01-01T00:00:00", "2025-03-09T12:00:00", "2024-03-10T07:00:00", "1969-12-31T23:59:59"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_large_logs_are_split_and_keep_their_order(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(20_000)]
    (tmp_path / "ping-a.txt").write_text("\n".join(lines))
    (tmp_path / "ping-b.txt").write_text("one\r\n\r\nthree\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
        read = logs.read_log_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 5
        rows = read.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    of = lambda name: [r.line for r in sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.line_no)]
    assert of("ping-a.txt") == lines and of("ping-b.txt") == ["one", "", "three"]


def test_no_local_folder_on_a_cluster():
    class Cluster:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        storage.shared_path(Cluster(), "x")


def test_boosted_holdout_has_not_seen_the_session(spark, sf_dir):
    table = storage.materialise(registry.forecast(spark, sf_dir), "holdout")
    columns = ["latency_mean_ms", "latency_mean_ms_lag_1", "latency_mean_ms_roll_mean_3"]
    folds = {r.relative_path: r.k for r in table.selectExpr("relative_path", "pmod(xxhash64(relative_path), 2) k").distinct().collect()}
    got = models.boosted_holdout(table, columns, 2, 3).toPandas()
    assert len(got) == table.count()
    for k in (0, 1):
        model = models.boosted_fit(table.where(f"pmod(xxhash64(relative_path), 2) <> {k}"), columns, 3)
        expected = models.with_boosted(table.where(f"pmod(xxhash64(relative_path), 2) = {k}"), model, columns, "p").select("relative_path", "target_next", "p").toPandas()
        own = got[got.relative_path.map(folds) == k]
        assert np.allclose(sorted(own.y_pred), sorted(expected.p))
    assert models.boosted_holdout(table.limit(0), columns, 2, 3).isEmpty()


def test_terciles(spark):
    for n in (1, 2, 28, 29):
        df = spark.range(n).select(F.col("id").alias("session_bin_index"), F.lit(1.0).alias("max_candidate_disagreement"))
        got = Counter(r.disagreement_bin for r in policies.disagreement_bins(df).collect())
        expected = Counter("Low" if 3 * r <= n - 1 else "Medium" if 3 * r <= 2 * (n - 1) else "High" for r in range(n))
        assert got == expected
    assert [got[k] for k in ("Low", "Medium", "High")] == [10, 9, 10]


def test_signed_rank_p():
    assert round(stats.signed_rank_p(12, 12, 29.0, 0.0, False), 4) == round(sum(1 for m in range(2**12) if sum(i + 1 for i in range(12) if m >> i & 1) <= 29) * 2 / 2**12, 4)
    z = lambda n, w: (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    for n, w, p in ((4, 0, 0.067889), (11, 1, 0.004439), (12, 29, 0.432768), (1, 0, 0.317311)):
        assert round(stats.signed_rank_p(28, n, w, z(n, w), False), 6) == p
    assert stats.signed_rank_p(5, 0, 0.0, 0.0, False) == 1.0


def test_decisions_have_no_negative_regret(spark, sf_dir):
    rows = registry.decisions(spark, sf_dir).collect()
    windows = {r.session_bin_index for r in rows}
    assert len(rows) == len(windows) * len(policies.POLICIES)
    assert all(r.regret_ms >= 0 for r in rows)


def test_stress_does_not_depend_on_partitions(spark, sf_dir):
    bins = registry.indexed(spark, sf_dir)
    key = ["relative_path", "bin_epoch", "stress_scenario", "stress_applied", "observed_replies"]
    one = sorted(map(tuple, stress.stress_scenarios(bins).select(*key).collect()))
    two = sorted(map(tuple, stress.stress_scenarios(bins.repartition(7, "bin_epoch")).select(*key).collect()))
    assert one == two and any(r[3] for r in one)


def test_ols_against_numpy(spark, sf_dir):
    table = registry.forecast(spark, sf_dir)
    columns = ["latency_mean_ms", "latency_mean_ms_lag_1", "latency_delta_1", "observed_replies", "bin_epoch"]
    rows = table.select(*columns, "target_next").toPandas()
    x = np.column_stack([np.ones(len(rows)), rows[columns].to_numpy(float)])
    w = np.linalg.lstsq(x / np.abs(x).max(0), rows.target_next, rcond=1e-12)[0] / np.abs(x).max(0)
    got = models.ols_predict(table, models.ols_fit(table, columns)).toPandas()
    expected = dict(zip(map(tuple, table.select("relative_path", "bin_epoch").collect()), x @ w))
    assert max(abs(expected[(r.relative_path, r.bin_epoch)] - r.y_pred) for r in got.itertuples()) < 1e-4


def test_metrics_skip_zero_truths(spark):
    df = spark.createDataFrame([("m", 0.0, 1.0), ("m", 2.0, 1.0)], "model_name string, y_true double, y_pred double")
    r = stats.forecast_metrics(df).first()
    assert (r.mae, r.rmse, r.mape, r.row_count) == (1.0, 1.0, 0.5, 2)


def test_bootstrap_of_one_window_is_the_mean(spark):
    df = spark.createDataFrame([("p", 1, 3.5)], "policy_name string, session_bin_index long, regret_ms double")
    r = stats.bootstrap_intervals(df, ("regret_ms",), rounds=5).first()
    assert (r.mean_value, r.ci_lower, r.ci_upper, r.sample_count) == (3.5, 3.5, 3.5, 1)


def test_poisson_weights_are_poisson():
    rng = np.random.default_rng(0)
    w = stats.poisson_weights(*rng.integers(0, stats.PRIME, (2, 2000)), 500)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.2


def test_bootstrap_by_weights_comes_near_resampling(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("p", None if k % 9 == 0 else "s", k, rng.gauss(40, 10)) for k in range(300)], "policy_name string, scenario string, session_bin_index long, regret_ms double")
    keys = ("policy_name", "scenario")
    a = {r.scenario: r for r in stats.bootstrap_intervals(df.repartition(3), ("regret_ms",), keys).collect()}
    b = {r.scenario: r for r in stats.resampled_intervals(df.where("scenario is not null"), ("regret_ms",), keys).collect()}
    assert set(a) == {None, "s"} and a["s"].sample_count == b["s"].sample_count and math.isclose(a["s"].mean_value, b["s"].mean_value)
    assert abs(a["s"].ci_lower - b["s"].ci_lower) < 0.3 and abs(a["s"].ci_upper - b["s"].ci_upper) < 0.3
    one = {r.scenario: r for r in stats.bootstrap_intervals(df.coalesce(1), ("regret_ms",), keys).collect()}
    assert all(math.isclose(one[k].ci_lower, a[k].ci_lower) for k in one)
    assert stats.bootstrap_intervals(df.limit(0), ("regret_ms",), keys).collect() == []


def test_bootstrap_shuffles_a_row_per_task_and_group(spark):
    df = spark.range(5000).selectExpr("'p' policy_name", "id session_bin_index", "double(id % 7) regret_ms").repartition(3)
    plan = stats.bootstrap_intervals(df, ("regret_ms",), rounds=50)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_ranks_of_ties_that_span_partitions(spark):
    rng = random.Random(12)
    rows = [(c, "m", rng.choice([-2.0, -1.0, 0.0, 1.0, 1.0, 2.0, 3.0]) if c == "hot" else rng.gauss(0, 1)) for c in ["hot"] * 400 + ["b"] * 40]
    df = spark.createDataFrame(rows, "comparison_name string, metric_name string, delta double").repartition(7)
    for r in stats.signed_ranks(df).collect():
        x = np.array([d for c, _, d in rows if c == r.comparison_name and d])
        size = np.abs(x.round(9))
        rank = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
        ties = [(size == s).sum() for s in np.unique(size)]
        assert math.isclose(r.statistic, min(rank[x > 0].sum(), rank[x < 0].sum())) and r.nonzero_count == len(x)
        assert r.tie_sum == sum(t**3 - t for t in ties)


FILES_ON_DISK = {
    "logs/ping-a.txt": b"PING t(1.2.3.4) from 5.6.7.8 eth0: 56\n\xff\n" + b"[1.5] 64 bytes from x: icmp_seq=1 ttl=9 time=2.0 ms\n" * 40,
    "logs/note.TXT": b"nothing here\n", "logs/empty.txt": b"", "t/good.csv": b'\xef\xbb\xbf"a, b","c""d","line\nbreak",a,a,\r\n1,2,3,4,5,6\r\n\r\n"x\ny",2,3\n', "t/tabs.TSV": b"p\tq\n" + b"1\t2\n" * 30,
    "t/wide row.csv": b"a,b\n1,2\n1,2,3\n", "t/open.csv": b'a,b\n1,"never\nclosed\n', "t/bytes.csv": b"a,b\n\xff\xfe,1\n", "t/none.csv": b"", "t/blank.csv": b"\n\n", "t/head.csv": b"only,names\n", "x/data.json": b"{}", "x/run.log": b"x", "x/noext": b"x", "x/y.parquet": b"x",
}


def test_heads_of_mixed_files(spark, tmp_path):
    root = tmp_path / "tree"
    for name, data in FILES_ON_DISK.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    rows = {r.relative_path: r for r in heads.file_summary(spark, str(root)).collect()}
    assert set(rows) == set(FILES_ON_DISK) and all(rows[n].size_bytes == len(d) for n, d in FILES_ON_DISK.items())
    told = {n: (r.suffix, r.sampled, r.columns, r.row_sample_count, r.notes) for n, r in rows.items()}
    assert told["logs/ping-a.txt"] == (".txt", True, ["epoch", "icmp_seq", "ttl", "latency_ms", "reply_ip"], 25, "ping log parsed")
    assert told["logs/note.TXT"] == told["logs/empty.txt"] == (".txt", False, [], 0, "text file did not match ping log pattern")
    assert told["t/good.csv"] == (".csv", True, ["a, b", 'c"d', "line\nbreak", "a", "a.1", "Unnamed: 5"], 2, "")
    assert told["t/tabs.TSV"] == (".tsv", True, ["p", "q"], 25, "") and told["t/head.csv"] == (".csv", True, ["only", "names"], 0, "")
    for name in ("wide row", "open", "bytes", "none", "blank"):
        suffix, sampled, columns, n, note = told[f"t/{name}.csv"]
        assert (suffix, sampled, columns, n) == (".csv", False, [], 0) and note.startswith("tabular sample failed: "), name
    assert "row 2 has 3 fields" in told["t/wide row.csv"][4]
    assert [told[f"x/{n}"][0] for n in ("data.json", "run.log", "noext", "y.parquet")] == [".json", ".log", "<no_ext>", ".parquet"]
    assert told["x/run.log"][4].startswith("text-like") and told["x/noext"][4].startswith("non-tabular")
    assert {r.relative_path for r in heads.csv_schema_sample(spark, str(root)).collect()} == {"t/good.csv", "t/tabs.TSV", "t/head.csv"}
    scores = {r.relative_path: r.candidate_score for r in inventory.candidate_scores(heads.file_summary(spark, str(root))).collect()}
    assert scores["logs/ping-a.txt"] == 35 + 20 + 20 + 10 + 5 and scores["t/none.csv"] == 40 + 5


def test_large_files_are_read_at_their_heads_only(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a,b\n" + "1,2\n" * 400_000)
    (tmp_path / "small.csv").write_text("c\n1\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
        rows = {r.relative_path: (r.columns, r.row_sample_count) for r in heads.file_summary(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert rows == {"big.csv": (["a", "b"], 25), "small.csv": (["c"], 1)}
