"""The queries of the library, each on the tables of a data folder, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.functions.scalars import bucket, consensus, disagreement, feature_columns, forecast_horizon, fusion, human_bytes, static_features, utc_iso
from orbweave.operators import bins as B
from orbweave.operators import features as X
from orbweave.operators import inventory as I
from orbweave.operators import models as M
from orbweave.operators import peers as P
from orbweave.operators import policies as D
from orbweave.operators import stats as S
from orbweave.operators import stress as Z
from orbweave.plans import jobs
from orbweave.plans import sql as Q
from orbweave.sources import bindings, heads, logs
from orbweave.storage import materialise, read_table, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COMPARISONS = jobs.COMPARISONS
KEY = "relative_path bin_epoch"
# means of short decimals that may end in an exact 5 at the place of rounding: a tiny nudge sends them the same way in both engines
TIED = frozenset("prediction_disagreement peer_features snapshot_features candidate_frame scenario_features".split())
NUDGE = 3e-10


def rounded(df: DataFrame, nudge: float, places: int = 6) -> DataFrame:
    """All doubles rounded (and minus zero made zero), so that the order of summation does not show in the comparison."""
    kept = lambda c: F.round(F.col(c) + F.lit(nudge) if nudge else F.col(c), places) + F.lit(0.0)
    return df.select(*[kept(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name; its doubles are rounded as the SQL rounds them."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        nudge = NUDGE if key in TIED else 0.0
        QUERIES[key] = lambda spark, sf_dir: rounded(f(spark, sf_dir), nudge)
        if sql:
            SQL[key] = Q.nudged(sql, nudge) if nudge else sql
        return f

    return add


def _rounded(columns: str, doubles: str, source: str, last: str) -> str:
    return Q.query(f"SELECT {', '.join([*columns.split(), *[f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in doubles.split()]])} FROM ({source})", last)


def day_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.time_bins(bindings.observations(spark, sf_dir), bindings.DAY)


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.session_bin_index(day_bins(spark, sf_dir))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chronological_split(X.forecast_table(indexed(spark, sf_dir)))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecast table, written once as peers are aggregated from it in several ways, with its peer columns."""
    return P.snapshot_features(materialise(forecast(spark, sf_dir), "forecast-table"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with the rolling mean and the peers' mean as the two experts, and two scenarios by day."""
    test = graph(spark, sf_dir).where("split = 'test'")
    marked = test.withColumns({
        "pred_forecast": F.col("latency_mean_ms_roll_mean_3"), "pred_graph": F.col("peer_latency_mean"), "stress_applied": (F.col("latency_jump_ratio") > 1.2).cast("int"),
        "stress_scenario": F.when(F.col("bin_epoch") % 172800 == 0, "even").otherwise("odd"),
    })
    return materialise(D.add_scores(marked), "candidates")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.policy_decisions(candidates(spark, sf_dir))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.disagreement_bins(D.window_context(candidates(spark, sf_dir)))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paired_policies(materialise(decisions(spark, sf_dir), "decisions"), COMPARISONS)


def _decided_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    return D.decision_context(D.policy_decisions(rows), D.disagreement_bins(D.window_context(rows)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = graph(spark, sf_dir).where("split = 'test'")
    kinds = [("persistence", "temporal", "latency_mean_ms"), ("rolling_mean", "temporal", "latency_mean_ms_roll_mean_3"), ("peer_mean", "graph", "peer_latency_mean")]
    models = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(f).alias("family"), F.col(c).alias("y_pred")) for n, f, c in kinds])
    return test.select("relative_path", "bin_epoch", F.col("target_next").alias("y_true"), F.explode(models).alias("m")).select("relative_path", "bin_epoch", "m.model_name", "m.family", "y_true", "m.y_pred")


# --- sources and sinks


@query()
def file_listing(spark, sf_dir):
    return logs.file_listing(spark, sf_dir, "*.parquet")


def _tables(spark: SparkSession, sf_dir: str, **options) -> dict[str, DataFrame]:
    """The job's tables of the events, written as a tree of logs."""
    root = bindings.write_logs(spark, sf_dir, shared_path(spark, "logs"))
    return jobs.build_tables(spark, root, bindings.DAY, 20, glob=bindings.LOGS, inside=bindings.inside(), **options)


@query(Q.query("SELECT relative_path, row_number() OVER (PARTITION BY relative_path ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY relative_path) AS n, event_id AS icmp_seq, ttl, round(epoch, 6) + 0.0::DOUBLE AS epoch, round(latency_ms, 6) + 0.0::DOUBLE AS latency_ms FROM obs", "obs"))
def read_ping_logs(spark, sf_dir):
    """Events written as a tree of logs, one file per session, and read back: every reply with its place in its file."""
    root = bindings.write_logs(spark, sf_dir, shared_path(spark, "logs"))
    lines = logs.read_log_lines(spark, root, bindings.LOGS).withColumn("relative_path", bindings.inside()).drop("path")
    return logs.placed_replies(lines, "relative_path").select("relative_path", "place", "n", "icmp_seq", "ttl", "epoch", "latency_ms")


BIN_DOUBLES = "latency_mean_ms latency_std_ms latency_min_ms latency_max_ms ttl_mean"
BIN_OTHERS = "relative_path path_state location session_date target_hint bin_seconds bin_epoch bin_start_utc observed_replies ttl_min ttl_max icmp_seq_min icmp_seq_max"


@query(Q.columns("idx", BIN_DOUBLES, "relative_path bin_epoch session_bin_index observed_replies").replace("SELECT relative_path, bin_epoch, session_bin_index", "SELECT relative_path, bin_epoch, session_bin_index, day(session_date::DATE)::INT AS session_day, epoch(bin_start_utc::TIMESTAMP)::BIGINT AS bin_start", 1))
def load_time_bins(spark, sf_dir):
    """Bins written as CSV and loaded with a schema."""
    made = day_bins(spark, sf_dir)
    path = shared_path(spark, "bins-csv")
    made.write.csv(path, header=True)
    loaded = logs.load_time_bins(spark.read.schema(made.schema).csv(path, header=True))
    return loaded.select("relative_path", "bin_epoch", "session_bin_index", F.dayofmonth("session_date").alias("session_day"), F.unix_timestamp("bin_start_utc").alias("bin_start"), "observed_replies", *BIN_DOUBLES.split())


SAMPLED = "SELECT * FROM (SELECT *, CASE WHEN n > 20 THEN greatest(1, n // 20) ELSE 1 END AS stride FROM (SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY relative_path) AS n FROM obs)) WHERE place % stride = 0 AND place // stride < 20"


@query(Q.query(f"""SELECT 'time_bins' AS table_name, session_date, count(*) AS row_count, sum(observed_replies)::BIGINT AS total FROM bins GROUP BY session_date
  UNION ALL SELECT 'session_summary', session_date, count(DISTINCT relative_path), count(*) FROM obs GROUP BY session_date UNION ALL SELECT 'observation_sample', session_date, count(*), sum(event_id)::BIGINT FROM ({SAMPLED}) GROUP BY session_date""", "bins"))
def write_tables(spark, sf_dir):
    """Bins, written as Parquet with a folder per day, and summaries and samples, written as CSV, all read back."""
    out, tables = None, _tables(spark, sf_dir)
    for name, total in (("time_bins", "observed_replies"), ("session_summary", "observation_count"), ("observation_sample", "icmp_seq")):
        table, path = tables[name], shared_path(spark, name)
        if name == "time_bins":
            table.repartition("session_date").write.partitionBy("session_date").parquet(path)
            back = spark.read.parquet(path)
        else:
            table.write.csv(path, header=True)
            back = spark.read.schema(table.schema).csv(path, header=True)
        one = back.groupBy(F.lit(name).alias("table_name"), F.col("session_date").cast("string").alias("session_date")).agg(F.count("*").alias("row_count"), F.sum(total).alias("total"))
        out = one if out is None else out.union(one)
    return out


MANIFEST = "relative_path, suffix, size_bytes, candidate_score, sampled, row_sample_count, measurement_family, path_state, location, session_date, window_duration"


@query(Q.query(f"SELECT {MANIFEST}, array_to_string(columns, '|') AS columns, notes FROM scored ORDER BY candidate_score DESC, size_bytes DESC, relative_path LIMIT 25", "scored"))
def write_manifest(spark, sf_dir):
    """The best 25 candidates written as JSON, read back and flattened."""
    best = I.candidate_scores(bindings.inventory(spark, sf_dir)).orderBy(F.desc("candidate_score"), F.desc("size_bytes"), "relative_path").limit(25)
    path = shared_path(spark, "manifest")
    best.write.json(path)
    return I.manifest_rows(spark.read.schema(best.schema).json(path))


@query(Q.query("SELECT count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'val') AS val_rows, count(*) FILTER (WHERE split = 'test') AS test_rows, count(DISTINCT relative_path) AS session_count FROM fc", "fc"))
def write_run_metadata(spark, sf_dir):
    counts = [F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "val", "test")]
    return forecast(spark, sf_dir).agg(*counts, F.count_distinct("relative_path").alias("session_count"))


# --- scalar functions


@query(Q.query("SELECT relative_path AS path, round(epoch, 6) + 0.0::DOUBLE AS epoch, icmp_seq, ttl, latency_ms, '2605:59c8::' || (event_id % 97) AS reply_ip FROM obs", "obs"))
def parse_log_lines(spark, sf_dir):
    return logs.parse_replies(bindings.log_lines(spark, sf_dir)).drop("line_no")


@query(Q.query("SELECT relative_path AS path, min(target_hint) AS header_target, '100.64.0.1' AS header_target_ip, '192.168.1.7' AS header_source_ip, min(location) AS interface FROM obs WHERE target_hint IS NOT NULL GROUP BY relative_path", "obs"))
def parse_headers(spark, sf_dir):
    return logs.parse_headers(bindings.log_lines(spark, sf_dir))


@query(Q.query("SELECT relative_path, target_hint, probe_interval, window_duration, window_start FROM named", "named"))
def parse_file_names(spark, sf_dir):
    return bindings.inventory(spark, sf_dir).select("relative_path", *logs.file_name_parts())


@query(Q.query("SELECT relative_path, measurement_family, path_state, location, session_date FROM named", "named"))
def parse_path_parts(spark, sf_dir):
    return bindings.inventory(spark, sf_dir).select("relative_path", *logs.path_parts())


@query(Q.query("SELECT event_id, (floor(epoch / 60) * 60)::BIGINT AS bin_epoch, strftime(make_timestamp((floor(epoch / 60) * 60)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S') AS bin_start_utc FROM obs", "obs"))
def epoch_to_utc(spark, sf_dir):
    return bindings.observations(spark, sf_dir).select("event_id", bucket("epoch", 60).alias("bin_epoch")).withColumn("bin_start_utc", utc_iso("bin_epoch"))


@query(Q.query("SELECT relative_path, CASE WHEN size_bytes < 1024 THEN printf('%.1f B', size_bytes::DOUBLE) WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0::DOUBLE) WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes / 1048576.0::DOUBLE) ELSE printf('%.1f GB', size_bytes / 1073741824.0::DOUBLE) END AS size FROM (SELECT relative_path, size_bytes + 1 AS size_bytes FROM files)", "files"), "human_bytes")
def human_sizes(spark, sf_dir):
    return bindings.inventory(spark, sf_dir).select("relative_path", human_bytes(F.col("size_bytes") + 1).alias("size"))


@query(Q.query("SELECT relative_path, bin_epoch, (path_state = 'active')::INT AS path_state_flag, replace(window_duration, 'h', '')::DOUBLE AS window_duration_hours, replace(probe_interval, 'ms', '')::DOUBLE AS probe_interval_ms, day(session_date::DATE)::INT AS session_day_of_month FROM bins", "bins"), "static_features")
def static_numbers(spark, sf_dir):
    return static_features(day_bins(spark, sf_dir)).select(*KEY.split(), "path_state_flag", "window_duration_hours", "probe_interval_ms", "session_day_of_month")


RATIOS = "latency_delta_1 latency_delta_roll3 latency_jump_ratio latency_volatility_ratio reply_gap_roll3 reply_pressure_score burst_indicator"


@query(Q.columns("fc", RATIOS, f"{KEY} reply_delta_1"))
def ratio_features(spark, sf_dir):
    return forecast(spark, sf_dir).select(*KEY.split(), "reply_delta_1", *RATIOS.split())


for _name, _column in (("fusion_scores", "pred_simple_fusion"), ("consensus_scores", "pred_consensus"), ("prediction_disagreement", "pred_disagreement")):

    def _scores(spark, sf_dir, column=_column):
        made = {"pred_simple_fusion": fusion(), "pred_consensus": consensus(), "pred_disagreement": disagreement()}[column]
        return candidates(spark, sf_dir).select(*KEY.split(), made.alias(column))

    query(Q.columns("cand", _column, KEY), _name)(_scores)


# the features by hand: metadata as numbers, what a bin holds, what is derived from its session, and the peers' columns
OWN_FEATURES = (
    "bin_seconds bin_epoch observed_replies latency_mean_ms latency_std_ms latency_min_ms latency_max_ms ttl_mean ttl_min ttl_max icmp_seq_min icmp_seq_max session_bin_index "
    "latency_mean_ms_lag_1 latency_mean_ms_lag_2 latency_mean_ms_lag_3 latency_mean_ms_lag_6 latency_mean_ms_lag_12 latency_mean_ms_roll_mean_3 latency_mean_ms_roll_std_3 latency_mean_ms_roll_mean_5 latency_mean_ms_roll_std_5 "
    "observed_replies_lag_1 observed_replies_roll_mean_3 observed_replies_roll_std_3 latency_delta_1 latency_delta_roll3 latency_jump_ratio latency_volatility_ratio reply_delta_1 reply_gap_roll3 reply_pressure_score burst_indicator "
    "path_state_flag window_duration_hours probe_interval_ms session_day_of_month"
)
PEER_FEATURES = (
    "peer_latency_mean peer_latency_std peer_reply_mean peer_reply_std peer_burst_indicator_mean peer_burst_indicator_std snapshot_candidate_count peer_latency_gap "
    "state_peer_latency_mean state_peer_latency_std target_peer_latency_mean target_peer_latency_std location_degree target_degree"
)
COUNTED = " UNION ALL ".join(f"SELECT '{c}' AS feature, {str(own).lower()} AS temporal, count({c}) AS row_count FROM graph" for names, own in ((OWN_FEATURES, True), (PEER_FEATURES, False)) for c in names.split())


@query(Q.query(COUNTED, "graph"), "feature_columns")
def feature_list(spark, sf_dir):
    """Each feature of the graph models: in how many rows it is there, and whether the temporal models have it too."""
    frame = graph(spark, sf_dir)
    names, temporal = feature_columns(frame), feature_columns(forecast(spark, sf_dir))
    counts = frame.agg(*[F.count(c).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(c in temporal).alias("temporal"), F.col(c).alias("row_count")) for c in names])).alias("x")).select("x.*")


# --- inventory and selection


LINE = "'  [' || printf('%.6f', epoch) || '] 64 bytes from 2605:59c8::' || (event_id % 97) || ': icmp_seq=' || event_id || ' ttl=' || ttl || ' time=' || printf('%.3f', latency_ms) || ' ms '"
TREE = r"""
  SELECT 'logs/family=inside-out/state=' || any_value(path_state) || '/location=' || any_value(location) || '/date=' || any_value(session_date) || '/name=' || list_last(string_split(relative_path, '/')) AS folder, '.txt' AS suffix, true AS sampled,
    'epoch|icmp_seq|ttl|latency_ms|reply_ip' AS columns, least(count(*), 25)::INT AS row_sample_count, 'ping log parsed' AS notes FROM obs GROUP BY relative_path
  UNION ALL SELECT 'orders/name=' || o_orderpriority, '.csv', true, 'key, time|the "delay"|two' || chr(10) || 'lines', least(count(*), 25)::INT, '' FROM orders GROUP BY o_orderpriority
  UNION ALL SELECT 'customers/name=' || c_mktsegment, '.tsv', true, 'node|a, b', least(count(*), 25)::INT, '' FROM customer GROUP BY c_mktsegment
  UNION ALL SELECT DISTINCT 'notes/name=' || coalesce(source, 'none'), '.txt', false, '', 0, 'text file did not match ping log pattern' FROM documents
  UNION ALL SELECT 'nations', '.json', false, '', 0, 'text-like file; schema sampling skipped' UNION ALL SELECT 'regions', '.parquet', false, '', 0, 'non-tabular or unsupported extension'"""


def _summarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = bindings.write_tree(spark, sf_dir, shared_path(spark, "tree"))
    return heads.file_summary(spark, root).withColumn("relative_path", F.regexp_replace("relative_path", "/part-[^/]*$", ""))


@query(Q.query(TREE, "obs"))
def file_summary(spark, sf_dir):
    """A written tree of logs, delimited files, notes and others, summarised by the heads of its files."""
    return _summarised(spark, sf_dir).select(F.col("relative_path").alias("folder"), "suffix", "sampled", F.array_join("columns", "|").alias("columns"), "row_sample_count", "notes")


@query(Q.query(f"SELECT folder, columns, row_sample_count FROM ({TREE}) WHERE suffix IN ('.csv', '.tsv')", "obs"))
def csv_schema_sample(spark, sf_dir):
    """Delimited files with separators, quotes and line ends in names and fields, written and read by their heads."""
    root = bindings.write_tree(spark, sf_dir, shared_path(spark, "tree"))
    found = heads.csv_schema_sample(spark, root)
    return found.select(F.regexp_replace("relative_path", "/part-[^/]*$", "").alias("folder"), F.array_join("columns", "|").alias("columns"), "row_sample_count")


# bytes of the files that are looked at: of logs as in ``session_summary``; quoted fields and names of the orders; tabs and line ends of the customers
SIZES = rf"""
  SELECT 'logs/family=inside-out/state=' || path_state || '/location=' || location || '/date=' || session_date || '/name=' || list_last(string_split(relative_path, '/')) AS folder,
    sum(strlen({LINE}) + 1) + CASE WHEN target_hint IS NULL THEN 0 ELSE 2 * strlen('PING ' || target_hint || '(100.64.0.1) from 192.168.1.7 ' || location || ': 56 data bytes.') END AS size_bytes FROM obs GROUP BY relative_path, path_state, location, session_date, target_hint
  UNION ALL SELECT 'orders/name=' || o_orderpriority, 40 + sum(9 + coalesce(strlen(o_orderkey::VARCHAR), 0) + coalesce(strlen(o_totalprice::DECIMAL(18, 2)::VARCHAR), 0) + coalesce(strlen('first,' || chr(10) || 'second ' || o_orderkey), 0)) FROM orders GROUP BY o_orderpriority
  UNION ALL SELECT 'customers/name=' || c_mktsegment, 10 + sum(2 + coalesce(strlen(c_custkey::VARCHAR), 0) + CASE WHEN c_name = '' THEN 2 ELSE coalesce(strlen(c_name), 0) END) FROM customer GROUP BY c_mktsegment"""


@query(Q.query(f"""SELECT folder, (CASE WHEN suffix IN ('.csv', '.tsv') THEN 40 WHEN suffix = '.txt' THEN 35 ELSE 0 END + least(30, size_bytes // {I.SIZE_STEP}) + CASE WHEN regexp_matches(lower(columns), 'time|date|epoch') THEN 20 ELSE 0 END
  + CASE WHEN regexp_matches(lower(columns), 'latency|delay|throughput|bandwidth|node|sat|link|gateway') THEN 20 ELSE 0 END + 10 + 5)::BIGINT AS candidate_score FROM ({TREE}) LEFT JOIN ({SIZES}) USING (folder) WHERE sampled""", "obs"))
def scanned_candidates(spark, sf_dir):
    """Candidate scores of files that were really looked at."""
    return I.candidate_scores(_summarised(spark, sf_dir)).select(F.col("relative_path").alias("folder"), "candidate_score")


@query(Q.query("SELECT suffix, count(*) AS file_count, sum(size_bytes)::BIGINT AS total_bytes FROM files GROUP BY suffix UNION ALL SELECT '*', count(*), coalesce(sum(size_bytes), 0)::BIGINT FROM files", "files"))
def inventory_stats(spark, sf_dir):
    return I.inventory_stats(bindings.inventory(spark, sf_dir))


@query(Q.query("SELECT relative_path, candidate_score FROM scored", "scored"))
def candidate_score(spark, sf_dir):
    return I.candidate_scores(bindings.inventory(spark, sf_dir)).select("relative_path", "candidate_score")


@query(Q.query("SELECT relative_path, candidate_score, place::INT AS place FROM ranked", "ranked"))
def candidate_ranking(spark, sf_dir):
    return I.candidate_ranking(I.candidate_scores(bindings.inventory(spark, sf_dir))).select("relative_path", "candidate_score", "place")


@query()
def diverse_selection(spark, sf_dir):
    return I.diverse_selection(I.candidate_scores(bindings.inventory(spark, sf_dir))).select("rank", "relative_path", "candidate_score", "location", "session_date")


@query(Q.query("SELECT relative_path, place::BIGINT AS round FROM ranked ORDER BY place, top DESC, location, path_state, CASE WHEN window_duration = '' THEN '<unknown>' ELSE window_duration END LIMIT 25", "ranked"))
def round_robin_selection(spark, sf_dir):
    return I.round_robin(I.candidate_scores(bindings.inventory(spark, sf_dir)))


# --- aggregation


ISO = "strftime(make_timestamp(floor({})::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S')"
SESSION_DOUBLES = "epoch_start epoch_end latency_mean_ms latency_std_ms latency_min_ms latency_max_ms ttl_mean"
SESSION_OTHERS = "relative_path file_size_bytes observation_count ttl_min ttl_max sample_stride sampled_observation_count timestamp_start_utc timestamp_end_utc header_target header_target_ip header_source_ip interface measurement_family path_state location session_date"


@query(_rounded(SESSION_OTHERS, SESSION_DOUBLES, f"""
  SELECT *, least(ceil(observation_count / sample_stride), 20)::BIGINT AS sampled_observation_count, {ISO.format('epoch_start')} AS timestamp_start_utc, {ISO.format('epoch_end')} AS timestamp_end_utc,
    coalesce(t, '') AS header_target, CASE WHEN t IS NULL THEN '' ELSE '100.64.0.1' END AS header_target_ip, CASE WHEN t IS NULL THEN '' ELSE '192.168.1.7' END AS header_source_ip, CASE WHEN t IS NULL THEN '' ELSE location END AS interface,
    (bytes + CASE WHEN t IS NULL THEN 0 ELSE 2 * length('PING ' || t || '(100.64.0.1) from 192.168.1.7 ' || location || ': 56 data bytes.') END)::BIGINT AS file_size_bytes
  FROM (SELECT relative_path, measurement_family, path_state, location, session_date, target_hint AS t, count(*) AS observation_count, sum(length({LINE}) + 1) AS bytes, arg_min(epoch, event_id) AS epoch_start, arg_max(epoch, event_id) AS epoch_end,
      avg(latency_ms) AS latency_mean_ms, stddev_pop(latency_ms) AS latency_std_ms, min(latency_ms) AS latency_min_ms, max(latency_ms) AS latency_max_ms, avg(ttl) AS ttl_mean, min(ttl) AS ttl_min, max(ttl) AS ttl_max,
      CASE WHEN count(*) > 20 THEN greatest(1, count(*) // 20) ELSE 1 END::BIGINT AS sample_stride FROM obs GROUP BY ALL)""", "obs"))
def session_summary(spark, sf_dir):
    """Written logs to a row per file: metadata, first header, size and statistics."""
    return _tables(spark, sf_dir)["session_summary"].select(*SESSION_OTHERS.split(), *SESSION_DOUBLES.split())


@query(Q.query(f"SELECT relative_path, event_id FROM ({SAMPLED})", "obs"))
def observation_sample(spark, sf_dir):
    """Written logs, sampled by each reply's place in its file; no line is shuffled."""
    return _tables(spark, sf_dir)["observation_sample"].select("relative_path", F.col("icmp_seq").alias("event_id"))


@query(Q.columns("bins", BIN_DOUBLES, BIN_OTHERS))
def time_bins(spark, sf_dir):
    return day_bins(spark, sf_dir).select(*BIN_OTHERS.split(), *BIN_DOUBLES.split())


@query(Q.columns("ctx", "mean_candidate_disagreement max_candidate_disagreement stressed_candidate_fraction", "session_bin_index candidate_count"))
def window_context(spark, sf_dir):
    return D.window_context(candidates(spark, sf_dir))


SUMMARY = "avg(realized_next_latency_ms) AS mean_realized_latency_ms, avg(regret_ms) AS mean_regret_ms, avg(best_path_match) AS best_path_match_rate, avg(success_under_budget) AS success_rate_under_60ms"
SUMMARY_DOUBLES = "mean_realized_latency_ms mean_regret_ms best_path_match_rate success_rate_under_60ms"


@query(_rounded("disagreement_bin policy_name decision_count", f"{SUMMARY_DOUBLES} mean_chosen_disagreement", f"SELECT disagreement_bin, policy_name, count(*) AS decision_count, {SUMMARY}, avg(chosen_disagreement) AS mean_chosen_disagreement FROM decx GROUP BY ALL", "decx"))
def disagreement_summary(spark, sf_dir):
    return D.disagreement_summary(_decided_in_context(spark, sf_dir))


@query(Q.columns("metrics", "mae rmse mape", "family model_name row_count"))
def forecast_metrics(spark, sf_dir):
    return S.forecast_metrics(predictions(spark, sf_dir), ("family", "model_name"))


@query(_rounded("policy_name decision_count", SUMMARY_DOUBLES, f"SELECT policy_name, count(*) AS decision_count, {SUMMARY} FROM dec GROUP BY ALL", "dec"))
def policy_summary(spark, sf_dir):
    return D.policy_summary(decisions(spark, sf_dir))


@query(Q.query("SELECT family, arg_min(model_name, mae) AS model_name, round(min(mae), 6) + 0.0::DOUBLE AS mae FROM metrics GROUP BY family", "metrics"))
def best_model(spark, sf_dir):
    return S.best_model(S.forecast_metrics(predictions(spark, sf_dir), ("family", "model_name")))  # by family


@query(Q.query("SELECT family, " + ", ".join(f"round(max(mae) FILTER (WHERE model_name = '{m}'), 6) + 0.0::DOUBLE AS {m}" for m in ("persistence", "rolling_mean", "peer_mean")) + " FROM metrics GROUP BY family", "metrics"))
def scenario_pivot(spark, sf_dir):
    return S.scenario_pivot(S.forecast_metrics(predictions(spark, sf_dir), ("family", "model_name")), "family", "model_name", ["persistence", "rolling_mean", "peer_mean"], "mae")


PLACED = f"SELECT policy_name, {', '.join(S.METRICS)}, row_number() OVER (PARTITION BY policy_name ORDER BY session_bin_index) - 1 AS place, count(*) OVER (PARTITION BY policy_name) AS n FROM dec"
DRAWN = f"""
  SELECT d.policy_name, b, {', '.join(f'avg({m}) AS {m}' for m in S.METRICS)}
  FROM (SELECT policy_name, b, ('0x' || substr(md5('42|' || b || '|' || place), 1, 8))::BIGINT % n AS pick FROM placed, range(1, 2001) r(b)) d JOIN placed p ON p.policy_name = d.policy_name AND p.place = d.pick GROUP BY ALL"""


def _ends(keys: str) -> str:
    """The percentiles of ``drawn`` and the means of ``placed``, a row per ``keys`` and metric."""
    ends = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric_name, quantile_cont({m}, 0.025) AS ci_lower, quantile_cont({m}, 0.975) AS ci_upper FROM drawn GROUP BY ALL" for m in S.METRICS)
    own = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric_name, avg({m}) AS mean_value, count(*) AS sample_count FROM placed GROUP BY ALL" for m in S.METRICS)
    return f"SELECT * FROM ({own}) JOIN ({ends}) USING ({keys}, metric_name)"


RESAMPLED = f"WITH placed AS ({PLACED}), drawn AS ({DRAWN}) {_ends('policy_name')}"


def _weighted(keys: str, source: str, rounds: int = 2000) -> str:
    """Intervals by Poisson weights: a unit's count in a round is how many cumulative probabilities its hash reaches."""
    count = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in S.poisson_cuts())
    hashed = ", ".join(f"('0x' || substr(md5('42|' || session_bin_index), {at}, 8))::BIGINT % {S.PRIME} AS {n}" for n, at in (("a", 1), ("c", 9)))
    drawn = f"SELECT {keys}, b, {', '.join(f'sum(w * {m}) / sum(w) AS {m}' for m in S.METRICS)} FROM (SELECT *, {count} AS w FROM (SELECT *, ((a * b + c) % {S.PRIME}) / {S.PRIME}::DOUBLE AS u FROM (SELECT *, {hashed} FROM placed), range(1, {rounds + 1}) r(b))) GROUP BY ALL HAVING sum(w) > 0"
    return f"WITH placed AS (SELECT * FROM {source}), drawn AS ({drawn}) {_ends(keys)}"


INTERVALS = _weighted("policy_name", "dec")


@query(_rounded("policy_name metric_name sample_count", "mean_value ci_lower ci_upper", INTERVALS, "dec"))
def bootstrap_intervals(spark, sf_dir):
    return S.bootstrap_intervals(materialise(decisions(spark, sf_dir), "decisions"))


@query(_rounded("policy_name metric_name sample_count", "mean_value ci_lower ci_upper", RESAMPLED, "dec"))
def resampled_intervals(spark, sf_dir):
    return S.resampled_intervals(materialise(decisions(spark, sf_dir), "decisions"))


WIDE = ", ".join(f"max(ci_{e}) FILTER (WHERE metric_name = '{m}') AS {m}_ci_{e}" for m in S.METRICS for e in ("lower", "upper"))
WIDE_DOUBLES = " ".join(f"{m}_ci_{e}" for m in S.METRICS for e in ("lower", "upper"))


@query(_rounded("policy_name decision_count", f"{SUMMARY_DOUBLES} {WIDE_DOUBLES}", f"SELECT * FROM (SELECT policy_name, count(*) AS decision_count, {SUMMARY} FROM dec GROUP BY ALL) JOIN (SELECT policy_name, {WIDE} FROM ({INTERVALS}) GROUP BY 1) USING (policy_name)", "dec"))
def interval_pivot(spark, sf_dir):
    made = materialise(decisions(spark, sf_dir), "decisions")
    return S.interval_pivot(S.bootstrap_intervals(made), D.policy_summary(made))


# --- windows


@query(Q.query("SELECT relative_path, bin_epoch, session_bin_index FROM idx", "idx"))
def session_bin_index(spark, sf_dir):
    return indexed(spark, sf_dir).select(*KEY.split(), "session_bin_index")


LAGGED = " ".join(f"latency_mean_ms_lag_{k}" for k in X.LAGS)
ROLLED = "latency_mean_ms_roll_mean_3 latency_mean_ms_roll_std_3 latency_mean_ms_roll_mean_5 latency_mean_ms_roll_std_5"


@query(Q.columns("lags", LAGGED, KEY))
def lag_features(spark, sf_dir):
    return X.lag_features(indexed(spark, sf_dir)).select(*KEY.split(), *LAGGED.split())


@query(Q.columns("lags", ROLLED, KEY))
def rolling_features(spark, sf_dir):
    return X.rolling_features(indexed(spark, sf_dir)).select(*KEY.split(), *ROLLED.split())


@query(Q.columns("lags", "observed_replies_roll_mean_3 observed_replies_roll_std_3", f"{KEY} observed_replies_lag_1"))
def reply_features(spark, sf_dir):
    return X.reply_features(indexed(spark, sf_dir)).select(*KEY.split(), "observed_replies_lag_1", "observed_replies_roll_mean_3", "observed_replies_roll_std_3")


@query(Q.query("SELECT relative_path, bin_epoch, round(target_next, 6) + 0.0::DOUBLE AS target_next, target_next_bin_epoch FROM lags WHERE target_next IS NOT NULL", "lags"))
def next_bin_target(spark, sf_dir):
    return X.next_bin_target(indexed(spark, sf_dir)).where("target_available = 1").select(*KEY.split(), "target_next", "target_next_bin_epoch")


FORECAST = f"{BIN_DOUBLES} {LAGGED} {ROLLED} observed_replies_roll_mean_3 observed_replies_roll_std_3 {RATIOS} target_next window_duration_hours probe_interval_ms"
FORECAST_OTHERS = f"{BIN_OTHERS} session_bin_index path_state_flag session_day_of_month observed_replies_lag_1 reply_delta_1 target_next_bin_epoch target_available"


@query(Q.columns("fc0", FORECAST, FORECAST_OTHERS))
def forecast_table(spark, sf_dir):
    return X.forecast_table(indexed(spark, sf_dir)).select(*FORECAST_OTHERS.split(), *FORECAST.split())


@query(_rounded(f"{KEY} target_next_bin_epoch", "target_next", "SELECT relative_path, bin_epoch, lead(latency_mean_ms, 2) OVER w AS target_next, lead(bin_epoch, 2) OVER w AS target_next_bin_epoch FROM idx WINDOW w AS (PARTITION BY relative_path ORDER BY bin_epoch) QUALIFY target_next IS NOT NULL", "idx"), "forecast_horizon")
def two_days_ahead(spark, sf_dir):
    """A horizon of a day and a half in bins of a day, rounded up: targets two bins ahead."""
    ahead = X.forecast_table(indexed(spark, sf_dir), horizon=forecast_horizon(1.5 * bindings.DAY, bindings.DAY))
    return ahead.select(*KEY.split(), "target_next_bin_epoch", "target_next")


@query(Q.query("SELECT relative_path, bin_epoch, split FROM fc", "fc"))
def chronological_split(spark, sf_dir):
    return forecast(spark, sf_dir).select(*KEY.split(), "split")


PEERS = "peer_latency_mean peer_latency_std peer_reply_mean peer_reply_std peer_burst_indicator_mean peer_burst_indicator_std peer_latency_gap"


@query(Q.columns("graph", PEERS, f"{KEY} snapshot_candidate_count"))
def peer_features(spark, sf_dir):
    return P.peer_features(forecast(spark, sf_dir)).select(*KEY.split(), "snapshot_candidate_count", *PEERS.split())


@query(Q.columns("graph", "state_peer_latency_mean state_peer_latency_std", KEY))
def state_peer_features(spark, sf_dir):
    return P.state_peer_features(forecast(spark, sf_dir)).select(*KEY.split(), "state_peer_latency_mean", "state_peer_latency_std")


@query(Q.columns("graph", "target_peer_latency_mean target_peer_latency_std", KEY))
def target_peer_features(spark, sf_dir):
    return P.target_peer_features(forecast(spark, sf_dir)).select(*KEY.split(), "target_peer_latency_mean", "target_peer_latency_std")


@query(Q.query("SELECT session_bin_index, location_node, target_node FROM edges", "edges"))
def graph_edges(spark, sf_dir):
    return P.graph_edges(forecast(spark, sf_dir))


@query(Q.query("SELECT session_bin_index, location_node AS node, location_degree AS degree FROM ldeg UNION ALL SELECT session_bin_index, target_node, target_degree FROM tdeg", "tdeg"))
def graph_degrees(spark, sf_dir):
    a, b = P.graph_degrees(P.graph_edges(forecast(spark, sf_dir)))
    return a.toDF("session_bin_index", "node", "degree").union(b.toDF("session_bin_index", "node", "degree"))


@query(Q.columns("graph", f"{PEERS} state_peer_latency_mean state_peer_latency_std target_peer_latency_mean target_peer_latency_std", f"{KEY} snapshot_candidate_count location_degree target_degree"))
def snapshot_features(spark, sf_dir):
    return graph(spark, sf_dir).select(*KEY.split(), "snapshot_candidate_count", "location_degree", "target_degree", *PEERS.split(), "state_peer_latency_mean", "state_peer_latency_std", "target_peer_latency_mean", "target_peer_latency_std")


@query(Q.query("SELECT relative_path, bin_epoch, random_score FROM rand", "rand"))
def pseudo_random_score(spark, sf_dir):
    return D.pseudo_random_score(candidates(spark, sf_dir)).select(*KEY.split(), "random_score")


@query(Q.columns("terciles", "max_candidate_disagreement", "session_bin_index disagreement_bin"))
def disagreement_bins(spark, sf_dir):
    return context(spark, sf_dir).select("session_bin_index", "disagreement_bin", "max_candidate_disagreement")


# --- decisions and joins


DECIDED = "reactive_latency_ms realized_next_latency_ms hindsight_best_latency_ms regret_ms pred_consensus pred_disagreement pred_forecast pred_graph pred_simple_fusion"
DECIDED_OTHERS = "policy_name session_bin_index chosen_relative_path chosen_location chosen_path_state best_path_match success_under_budget"


@query(Q.columns("dec", DECIDED, DECIDED_OTHERS))
def policy_decisions(spark, sf_dir):
    return decisions(spark, sf_dir).select(*DECIDED_OTHERS.split(), *DECIDED.split())


@query(Q.columns("best", "hindsight_best_latency_ms", "session_bin_index hindsight_path"))
def hindsight_best(spark, sf_dir):
    return D.hindsight_best(candidates(spark, sf_dir))


@query(Q.columns("cand", "pred_forecast pred_graph target_next", KEY))
def candidate_frame(spark, sf_dir):
    temporal = forecast(spark, sf_dir).where("split = 'test'").select(*KEY.split(), "target_next", F.col("latency_mean_ms_roll_mean_3").alias("pred_forecast"))
    other = graph(spark, sf_dir).where("split = 'test'").select(*KEY.split(), F.col("peer_latency_mean").alias("pred_graph"))
    return D.candidate_frame(temporal, other)


@query(Q.columns("decx", "chosen_disagreement mean_candidate_disagreement max_candidate_disagreement stressed_candidate_fraction", "policy_name session_bin_index candidate_count disagreement_bin"))
def decision_context(spark, sf_dir):
    made = _decided_in_context(spark, sf_dir)
    return made.select("policy_name", "session_bin_index", "candidate_count", "disagreement_bin", "chosen_disagreement", "mean_candidate_disagreement", "max_candidate_disagreement", "stressed_candidate_fraction")


@query(Q.columns("deltas", "delta", "comparison_name metric_name session_bin_index"))
def paired_policies(spark, sf_dir):
    return deltas(spark, sf_dir)


@query(Q.query("SELECT relative_path, bin_epoch, observed_replies FROM bins SEMI JOIN (SELECT DISTINCT relative_path FROM bins WHERE path_state = 'inactive' AND window_duration = '2h') USING (relative_path)", "bins"))
def manifest_restriction(spark, sf_dir):
    """Bins of the logs that a manifest names: its paths are all that is scanned."""
    made = day_bins(spark, sf_dir).where("path_state = 'inactive' and window_duration = '2h'")
    manifest = made.select(bindings.stored().alias("relative_path")).distinct()
    return _tables(spark, sf_dir, manifest=manifest)["time_bins"].select("relative_path", "bin_epoch", "observed_replies")


@query(Q.query("SELECT relative_path, bin_epoch, split, target_available FROM fc WHERE split IN ('train', 'val')", "fc"))
def train_plus_val(spark, sf_dir):
    return forecast(spark, sf_dir).where("split in ('train', 'val')").select(*KEY.split(), "split", "target_available")


# --- tuning and statistics


GRADED = """
  SELECT i, w, p, stress_scenario, session_bin_index, relative_path, target_next FROM (SELECT *, row_number() OVER (PARTITION BY i, stress_scenario, session_bin_index ORDER BY w * pred_forecast + g * pred_graph + p * abs(pred_graph - pred_forecast), relative_path, bin_epoch) AS r FROM cand, grid) WHERE r = 1"""
GRID = "SELECT row_number() OVER () - 1 AS i, w, 1.0::DOUBLE - w AS g, p FROM (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8])::DOUBLE AS w), (SELECT unnest([0.0, 0.1, 0.2, 0.25, 0.3])::DOUBLE AS p) ORDER BY w, p"
BESTS = "SELECT stress_scenario, session_bin_index, relative_path AS hp, target_next AS ht FROM (SELECT *, row_number() OVER (PARTITION BY stress_scenario, session_bin_index ORDER BY target_next, relative_path, bin_epoch) AS r FROM cand) WHERE r = 1"


@query(Q.query(f"""SELECT w AS temporal_weight, 1.0::DOUBLE - w AS graph_weight, p AS disagreement_penalty, round(gap, 6) + 0.0::DOUBLE AS validation_gap_ms FROM (
  WITH grid AS ({GRID}), h AS (SELECT w, p, stress_scenario, avg(target_next) AS hybrid FROM ({GRADED}) GROUP BY ALL),
  one AS (SELECT stress_scenario, k, avg(target_next) AS one FROM (SELECT stress_scenario, 't' AS k, target_next, row_number() OVER (PARTITION BY stress_scenario, session_bin_index ORDER BY pred_forecast, relative_path, bin_epoch) AS r FROM cand
    UNION ALL SELECT stress_scenario, 'g', target_next, row_number() OVER (PARTITION BY stress_scenario, session_bin_index ORDER BY pred_graph, relative_path, bin_epoch) FROM cand) WHERE r = 1 GROUP BY ALL)
  SELECT w, p, avg(hybrid - single) AS gap FROM h JOIN (SELECT stress_scenario, min(one) AS single FROM one GROUP BY ALL) USING (stress_scenario) GROUP BY ALL) ORDER BY round(gap, 9), w, p LIMIT 1""", "cand"))
def consensus_tuning(spark, sf_dir):
    return D.consensus_tuning(candidates(spark, sf_dir))


@query(_rounded("stress_scenario decision_count", f"disagreement_penalty {SUMMARY_DOUBLES}", f"WITH grid AS (SELECT row_number() OVER () AS i, 0.65::DOUBLE AS w, 0.35::DOUBLE AS g, p FROM (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS p)), bests AS ({BESTS}) SELECT stress_scenario, p AS disagreement_penalty, count(*) AS decision_count, avg(target_next) AS mean_realized_latency_ms, avg(target_next - ht) AS mean_regret_ms, avg((relative_path = hp)::INT) AS best_path_match_rate, avg((target_next <= 60.0)::INT) AS success_rate_under_60ms FROM ({GRADED}) JOIN bests USING (stress_scenario, session_bin_index) GROUP BY ALL", "cand"))
def penalty_sweep(spark, sf_dir):
    return D.penalty_sweep(candidates(spark, sf_dir))


@query(_rounded("comparison_name metric_name sample_count", "mean_delta median_delta", "SELECT comparison_name, metric_name, count(*) AS sample_count, avg(delta) AS mean_delta, median(delta) AS median_delta FROM deltas GROUP BY ALL", "deltas"))
def paired_deltas(spark, sf_dir):
    return S.paired_deltas(deltas(spark, sf_dir))


RANKS = """
  SELECT comparison_name, metric_name, count(*) AS nz, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w, sum(t * t - 1)::DOUBLE AS tie_sum FROM (
    SELECT *, rank() OVER (PARTITION BY comparison_name, metric_name ORDER BY abs(d)) + (t - 1) / 2.0::DOUBLE AS r FROM (
      SELECT comparison_name, metric_name, round(delta, 9) AS d, count(*) OVER (PARTITION BY comparison_name, metric_name, abs(round(delta, 9))) AS t FROM deltas WHERE round(delta, 9) <> 0)) GROUP BY ALL"""


@query(_rounded("comparison_name metric_name sample_count nonzero_count", "statistic z_score tie_sum", f"""
  SELECT comparison_name, metric_name, sample_count, coalesce(nz, 0) AS nonzero_count, coalesce(w, 0)::DOUBLE AS statistic, coalesce(tie_sum, 0) AS tie_sum,
    CASE WHEN coalesce(nz, 0) > 0 AND nz * (nz + 1) * (2 * nz + 1) / 24.0::DOUBLE - tie_sum / 48.0 > 0 THEN (w - nz * (nz + 1) / 4.0::DOUBLE) / sqrt(nz * (nz + 1) * (2 * nz + 1) / 24.0::DOUBLE - tie_sum / 48.0) ELSE 0 END AS z_score
  FROM (SELECT comparison_name, metric_name, count(*) AS sample_count FROM deltas GROUP BY ALL) LEFT JOIN ({RANKS}) USING (comparison_name, metric_name)""", "deltas"))
def signed_ranks(spark, sf_dir):
    return S.signed_ranks(deltas(spark, sf_dir))


@query()
def signed_rank_test(spark, sf_dir):
    return S.signed_rank_test(deltas(spark, sf_dir))


# --- stress


STRESSED = "latency_mean_ms latency_std_ms latency_max_ms"
STRESSED_OTHERS = f"{KEY} observed_replies stress_applied stress_scenario"


@query(Q.columns("burst", STRESSED, STRESSED_OTHERS))
def burst_stress(spark, sf_dir):
    return Z.burst_stress(indexed(spark, sf_dir)).select(*STRESSED_OTHERS.split(), *STRESSED.split())


@query(Q.columns("outage", STRESSED, STRESSED_OTHERS))
def outage_stress(spark, sf_dir):
    return Z.outage_stress(indexed(spark, sf_dir)).select(*STRESSED_OTHERS.split(), *STRESSED.split())


@query(Q.columns("structural", STRESSED, STRESSED_OTHERS))
def structural_stress(spark, sf_dir):
    return Z.structural_stress(indexed(spark, sf_dir)).select(*STRESSED_OTHERS.split(), *STRESSED.split())


@query(_rounded("relative_path bin_epoch observed_replies stress_applied stress_scenario", "latency_mean_ms target_next", """
  SELECT relative_path, bin_epoch, hit::INT AS stress_applied, 'structural' AS stress_scenario, CASE WHEN hit THEN latency_mean_ms + s ELSE latency_mean_ms END AS latency_mean_ms, CASE WHEN hit THEN target_next + 0.85 * s ELSE target_next END AS target_next,
    CASE WHEN hit THEN greatest(1, floor(observed_replies * 0.8::DOUBLE))::BIGINT ELSE observed_replies END AS observed_replies
  FROM (SELECT *, location IN (FROM floc) AND session_bin_index IN (FROM fwin) AS hit, (28.0 + 0.25 * latency_std_ms) * (0.90 + 0.25 * U(44, relative_path || '|' || bin_epoch, 'severity')) AS s FROM fc)""", "floc"))
def structural_forecast_stress(spark, sf_dir):
    return Z.structural_forecast_stress(forecast(spark, sf_dir)).select("relative_path", "bin_epoch", "observed_replies", "stress_applied", "stress_scenario", "latency_mean_ms", "target_next")


UNION = " UNION ALL ".join([f"SELECT {STRESSED_OTHERS.replace(' ', ', ')}, latency_mean_ms FROM {s}" for s in ("burst", "outage", "structural")] + ["SELECT relative_path, bin_epoch, observed_replies, 0::INT, 'base', latency_mean_ms FROM idx"])


@query(_rounded(STRESSED_OTHERS, "latency_mean_ms", UNION, "structural"))
def stress_scenarios(spark, sf_dir):
    return Z.stress_scenarios(indexed(spark, sf_dir)).select(*STRESSED_OTHERS.split(), "latency_mean_ms")


@query(Q.query(f"SELECT stress_scenario AS scenario_name, count(*) AS row_count, sum(stress_applied)::BIGINT AS stressed FROM ({UNION}) GROUP BY ALL", "structural"))
def scenario_union(spark, sf_dir):
    return Z.stress_scenarios(indexed(spark, sf_dir)).groupBy(F.col("stress_scenario").alias("scenario_name")).agg(F.count("*").alias("row_count"), F.sum("stress_applied").alias("stressed"))


# --- models


@query(Q.query("SELECT relative_path, bin_epoch, model_name, round(y_true, 6) + 0.0::DOUBLE AS y_true, round(y_pred, 6) + 0.0::DOUBLE AS y_pred FROM preds WHERE model_name = 'persistence'", "preds"))
def persistence_forecast(spark, sf_dir):
    return M.persistence_forecast(forecast(spark, sf_dir).where("split = 'test'"))


@query(Q.query("SELECT round(regr_slope(target_next, latency_mean_ms), 6) + 0.0::DOUBLE AS slope, round(regr_intercept(target_next, latency_mean_ms), 6) + 0.0::DOUBLE AS intercept FROM fc WHERE split <> 'test'", "fc"))
def single_feature_ols(spark, sf_dir):
    return M.single_feature_ols(forecast(spark, sf_dir).where("split <> 'test'"))


@query(name="run_forecast_baselines")
def ols_baseline(spark, sf_dir):
    """Persistence and least squares on test rows: errors of both."""
    table = forecast(spark, sf_dir)
    model = M.ols_fit(table.where("split <> 'test'"), feature_columns(table))
    test = table.where("split = 'test'")
    return S.forecast_metrics(M.persistence_forecast(test).union(M.ols_predict(test, model)))


@query()
def ols_fit(spark, sf_dir):
    """Coefficients of least squares on the temporal features, a row each ("" is the intercept)."""
    table = forecast(spark, sf_dir)
    model = M.ols_fit(table.where("split <> 'test'"), feature_columns(table))
    return spark.createDataFrame(sorted(model.items()), "feature string, coefficient double")


@query()
def ols_predict(spark, sf_dir):
    table = forecast(spark, sf_dir)
    return M.ols_predict(table.where("split = 'test'"), M.ols_fit(table.where("split <> 'test'"), feature_columns(table)))


@query()
def boosted_predict(spark, sf_dir):
    """Boosted trees with peer context on test rows."""
    table = materialise(graph(spark, sf_dir), "graph-table")
    features = feature_columns(table)
    return M.boosted_predict(table.where("split = 'test'"), M.boosted_fit(table.where("split <> 'test'"), features), features)


@query(name="run_graph_baseline")
def boosted_baseline(spark, sf_dir):
    return S.forecast_metrics(boosted_predict(spark, sf_dir))


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = materialise(graph(spark, sf_dir), "graph-table")
    return M.session_holdout(table, {"temporal": jobs.temporal_columns(table), "graph_context": feature_columns(table)}, boosted=("graph_context",))


@query()
def session_holdout(spark, sf_dir):
    return M.fold_deltas(_folds(spark, sf_dir))


@query()
def session_holdout_summary(spark, sf_dir):
    return M.holdout_summary(_folds(spark, sf_dir))


@query()
def feature_ablation(spark, sf_dir):
    return jobs.feature_ablation(indexed(spark, sf_dir))


@query(name="robustness_evaluation")
def robustness(spark, sf_dir):
    return jobs.robustness_evaluation(indexed(spark, sf_dir))


# --- the robustness job's tables, by experts that have nothing to learn, so that SQL can follow it whole


FIXED = {family: {name: jobs.one_column(column) for name, column in of.items()} for family, of in Q.EXPERTS.items()}
SCENARIO = "stress_scenario"


def _job(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bins = indexed(spark, sf_dir)
    table = jobs.scenario_table(bins, columns=tuple(c for of in Q.EXPERTS.values() for c in of.values()))
    return jobs.robustness_tables(bins, experts=FIXED, table=table, wanted=(name,))[name]


SCENARIO_DOUBLES = f"latency_mean_ms latency_std_ms latency_max_ms {LAGGED} {ROLLED} burst_indicator target_next {PEERS} state_peer_latency_mean target_peer_latency_std"
SCENARIO_OTHERS = f"{SCENARIO} {KEY} session_bin_index split stress_applied observed_replies observed_replies_lag_1 snapshot_candidate_count location_degree target_degree"


@query(Q.columns("s_graph", SCENARIO_DOUBLES, SCENARIO_OTHERS))
def scenario_features(spark, sf_dir):
    """The graph tables of all scenarios; the structural shift enters behind lags and targets and before peers."""
    return jobs.scenario_table(indexed(spark, sf_dir), columns=tuple(f"{SCENARIO_OTHERS} {SCENARIO_DOUBLES}".split())).select(*SCENARIO_OTHERS.split(), *SCENARIO_DOUBLES.split())


@query(_rounded(f"{SCENARIO} family model_name row_count", "mae rmse mape", "SELECT * FROM s_metrics WHERE split = 'test'", "s_metrics"))
def robustness_metrics(spark, sf_dir):
    return _job(spark, sf_dir, "metrics")


@query(Q.query("SELECT w AS temporal_weight, g AS graph_weight, p AS disagreement_penalty, round(gap, 6) + 0.0::DOUBLE AS validation_gap_ms FROM s_tuning", "s_tuning"))
def robustness_tuning(spark, sf_dir):
    return _job(spark, sf_dir, "tuning")


CHOSEN = "best_temporal_model best_graph_model"


@query(Q.columns("s_decx", f"{DECIDED} chosen_disagreement mean_candidate_disagreement max_candidate_disagreement stressed_candidate_fraction stress_applied_rate", f"{SCENARIO} {DECIDED_OTHERS} candidate_count disagreement_bin {CHOSEN}"))
def robustness_decisions(spark, sf_dir):
    made = _job(spark, sf_dir, "decisions")
    return made.select(SCENARIO, *DECIDED_OTHERS.split(), "candidate_count", "disagreement_bin", *CHOSEN.split(), *DECIDED.split(), "chosen_disagreement", "mean_candidate_disagreement", "max_candidate_disagreement", "stressed_candidate_fraction", "stress_applied_rate")


@query(Q.columns("s_terciles", "mean_candidate_disagreement max_candidate_disagreement stressed_candidate_fraction", f"{SCENARIO} session_bin_index candidate_count disagreement_bin"))
def robustness_context(spark, sf_dir):
    return _job(spark, sf_dir, "window_context")


@query(_rounded(f"{SCENARIO} policy_name decision_count {CHOSEN}", SUMMARY_DOUBLES, f"SELECT stress_scenario, policy_name, count(*) AS decision_count, {SUMMARY}, any_value(best_temporal_model) AS best_temporal_model, any_value(best_graph_model) AS best_graph_model FROM s_decx GROUP BY ALL", "s_decx"))
def robustness_summary(spark, sf_dir):
    return _job(spark, sf_dir, "policy_summary")


@query(_rounded(f"{SCENARIO} disagreement_bin policy_name decision_count", f"{SUMMARY_DOUBLES} mean_chosen_disagreement", f"SELECT stress_scenario, disagreement_bin, policy_name, count(*) AS decision_count, {SUMMARY}, avg(chosen_disagreement) AS mean_chosen_disagreement FROM s_decx GROUP BY ALL", "s_decx"))
def robustness_disagreement(spark, sf_dir):
    return _job(spark, sf_dir, "disagreement_summary")


@query(_rounded(f"{SCENARIO} decision_count", f"disagreement_penalty {SUMMARY_DOUBLES}", """
  SELECT stress_scenario, disagreement_penalty, count(*) AS decision_count, avg(target_next) AS mean_realized_latency_ms, avg(target_next - hindsight_best_latency_ms) AS mean_regret_ms, avg((relative_path = hindsight_path)::INT) AS best_path_match_rate, avg((target_next <= 60.0)::INT) AS success_rate_under_60ms
  FROM (SELECT c.*, d AS disagreement_penalty, row_number() OVER (PARTITION BY d, stress_scenario, session_bin_index ORDER BY w * pred_forecast + g * pred_graph + d * abs(pred_graph - pred_forecast), relative_path, bin_epoch) AS r FROM s_cand c, s_tuning, (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5])::DOUBLE AS d))
  JOIN s_best USING (stress_scenario, session_bin_index) WHERE r = 1 GROUP BY ALL""", "s_best"))
def robustness_sweep(spark, sf_dir):
    return _job(spark, sf_dir, "penalty_sweep")


S_RANKS = RANKS.replace("comparison_name, metric_name", "stress_scenario, comparison_name, metric_name").replace("FROM deltas", "FROM s_deltas")


@query(_rounded(f"{SCENARIO} comparison_name metric_name sample_count nonzero_count", "mean_delta median_delta statistic", f"""
  SELECT stress_scenario, comparison_name, metric_name, sample_count, coalesce(nz, 0) AS nonzero_count, mean_delta, median_delta, coalesce(w, 0)::DOUBLE AS statistic
  FROM (SELECT stress_scenario, comparison_name, metric_name, count(*) AS sample_count, avg(delta) AS mean_delta, median(delta) AS median_delta FROM s_deltas GROUP BY ALL) LEFT JOIN ({S_RANKS}) USING (stress_scenario, comparison_name, metric_name)""", "s_deltas"))
def robustness_significance(spark, sf_dir):
    """Without p, which SQL cannot give."""
    return _job(spark, sf_dir, "significance").select(SCENARIO, "comparison_name", "metric_name", "sample_count", "nonzero_count", "mean_delta", "median_delta", "statistic")


@query(_rounded(f"{SCENARIO} policy_name metric_name sample_count", "mean_value ci_lower ci_upper", _weighted("stress_scenario, policy_name", "s_dec"), "s_dec"))
def robustness_intervals(spark, sf_dir):
    return _job(spark, sf_dir, "intervals")


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
