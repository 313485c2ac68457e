"""The library's steps as named common table expressions, for holding queries against another SQL engine."""

from __future__ import annotations

import re

# each step may use those above it
STEPS = {
    "o": """
  SELECT event_id, user_id AS u, epoch_us(ts) / 1e6 AS epoch, (event_id % 65536)::BIGINT AS icmp_seq, (40 + (props->>'$.k')::INT % 24)::INT AS ttl, value::DOUBLE AS latency_ms,
    CASE WHEN user_id % 5 = 0 THEN 'inactive' ELSE 'active' END AS path_state, 'loc' || (user_id % 12) AS location, '2024-01-' || lpad((1 + user_id % 28)::VARCHAR, 2, '0') AS session_date,
    CASE WHEN user_id % 11 <> 0 THEN 'tgt' || (user_id % 7) END AS target_hint, '10ms' AS probe_interval, CASE WHEN user_id % 3 = 0 THEN '2h' ELSE '1h' END AS window_duration, 'inside-out' AS measurement_family
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL""",
    "obs": """
  SELECT *, session_date || '-00-00-00' AS window_start,
    'inside-out/' || path_state || '/' || location || '/' || session_date || '/ping-' || coalesce(target_hint, '') || '-10ms-' || window_duration || '-' || session_date || '-00-00-00-u' || lpad(u::VARCHAR, 6, '0') || '.txt' AS relative_path
  FROM o""",
    "bins": """
  SELECT relative_path, measurement_family, path_state, location, session_date, target_hint, probe_interval, window_duration, window_start, 86400::INT AS bin_seconds, (floor(epoch / 86400) * 86400)::BIGINT AS bin_epoch,
    strftime(make_timestamp((floor(epoch / 86400) * 86400)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%S') AS bin_start_utc, count(*) AS observed_replies, avg(latency_ms) AS latency_mean_ms, stddev_pop(latency_ms) AS latency_std_ms,
    min(latency_ms) AS latency_min_ms, max(latency_ms) AS latency_max_ms, avg(ttl) AS ttl_mean, min(ttl) AS ttl_min, max(ttl) AS ttl_max, min(icmp_seq) AS icmp_seq_min, max(icmp_seq) AS icmp_seq_max
  FROM obs GROUP BY ALL""",
    "idx": "SELECT *, row_number() OVER (PARTITION BY relative_path ORDER BY bin_epoch) - 1 AS session_bin_index FROM bins",
    "lags": """
  SELECT *, lag(latency_mean_ms, 1) OVER w AS latency_mean_ms_lag_1, lag(latency_mean_ms, 2) OVER w AS latency_mean_ms_lag_2, lag(latency_mean_ms, 3) OVER w AS latency_mean_ms_lag_3,
    lag(latency_mean_ms, 6) OVER w AS latency_mean_ms_lag_6, lag(latency_mean_ms, 12) OVER w AS latency_mean_ms_lag_12, lag(observed_replies, 1) OVER w AS observed_replies_lag_1,
    avg(latency_mean_ms) OVER w3 AS latency_mean_ms_roll_mean_3, coalesce(stddev_samp(latency_mean_ms) OVER w3, 0) AS latency_mean_ms_roll_std_3,
    avg(latency_mean_ms) OVER w5 AS latency_mean_ms_roll_mean_5, coalesce(stddev_samp(latency_mean_ms) OVER w5, 0) AS latency_mean_ms_roll_std_5,
    avg(observed_replies) OVER w3 AS observed_replies_roll_mean_3, coalesce(stddev_samp(observed_replies) OVER w3, 0) AS observed_replies_roll_std_3,
    lead(latency_mean_ms, 1) OVER w AS target_next, lead(bin_epoch, 1) OVER w AS target_next_bin_epoch
  FROM idx WINDOW w AS (PARTITION BY relative_path ORDER BY bin_epoch), w3 AS (PARTITION BY relative_path ORDER BY bin_epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
    w5 AS (PARTITION BY relative_path ORDER BY bin_epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "ratios": """
  SELECT *, latency_mean_ms - latency_mean_ms_lag_1 AS latency_delta_1, latency_mean_ms - latency_mean_ms_roll_mean_3 AS latency_delta_roll3,
    latency_mean_ms / greatest(latency_mean_ms_roll_mean_3, 1e-6) AS latency_jump_ratio, latency_mean_ms_roll_std_3 / greatest(latency_mean_ms_roll_mean_3, 1e-6) AS latency_volatility_ratio,
    observed_replies - observed_replies_lag_1 AS reply_delta_1, observed_replies - observed_replies_roll_mean_3 AS reply_gap_roll3, 1.0::DOUBLE - observed_replies / greatest(observed_replies_roll_mean_3, 1e-6) AS reply_pressure_score
  FROM lags""",
    "fc0": """
  SELECT * REPLACE (coalesce(latency_mean_ms_lag_1, 0) AS latency_mean_ms_lag_1, coalesce(latency_mean_ms_lag_2, 0) AS latency_mean_ms_lag_2, coalesce(latency_mean_ms_lag_3, 0) AS latency_mean_ms_lag_3,
      coalesce(latency_mean_ms_lag_6, 0) AS latency_mean_ms_lag_6, coalesce(latency_mean_ms_lag_12, 0) AS latency_mean_ms_lag_12, coalesce(observed_replies_lag_1, 0) AS observed_replies_lag_1,
      coalesce(latency_delta_1, 0) AS latency_delta_1, coalesce(reply_delta_1, 0) AS reply_delta_1),
    (path_state = 'active')::INT AS path_state_flag, replace(window_duration, 'h', '')::DOUBLE AS window_duration_hours, replace(probe_interval, 'ms', '')::DOUBLE AS probe_interval_ms, day(session_date::DATE)::INT AS session_day_of_month,
    (greatest(latency_jump_ratio, 0) + greatest(latency_volatility_ratio, 0) + greatest(reply_pressure_score, 0)) / 3.0 AS burst_indicator, 1::INT AS target_available
  FROM ratios WHERE target_next IS NOT NULL""",
    "fc": """
  SELECT * EXCLUDE (n, place), CASE WHEN place < greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train'
    WHEN place < least(n, greatest(greatest(1, floor(n * 0.7::DOUBLE)) + 1, floor(n * (0.7::DOUBLE + 0.15::DOUBLE)))) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, count(*) OVER (PARTITION BY relative_path) AS n, row_number() OVER (PARTITION BY relative_path ORDER BY bin_epoch) - 1 AS place FROM fc0)""",
    "wsum": "SELECT session_bin_index, count(*) AS n, avg(latency_mean_ms) AS ml, var_pop(latency_mean_ms) AS vl, avg(observed_replies) AS mr, var_pop(observed_replies) AS vr, avg(burst_indicator) AS mb, var_pop(burst_indicator) AS vb FROM fc GROUP BY ALL",
    "ssum": "SELECT session_bin_index, path_state, count(*) AS n, avg(latency_mean_ms) AS m, var_pop(latency_mean_ms) AS v FROM fc GROUP BY ALL",
    "tsum": "SELECT session_bin_index, target_hint, count(*) AS n, avg(latency_mean_ms) AS m, var_pop(latency_mean_ms) AS v FROM fc WHERE target_hint IS NOT NULL GROUP BY ALL",
    "edges": "SELECT DISTINCT session_bin_index, 'loc::' || coalesce(location, 'nan') AS location_node, 'tgt::' || coalesce(target_hint, 'nan') AS target_node FROM fc",
    "ldeg": "SELECT session_bin_index, location_node, count(*) AS location_degree FROM edges GROUP BY ALL",
    "tdeg": "SELECT session_bin_index, target_node, count(*) AS target_degree FROM edges GROUP BY ALL",
    "graph": """
  SELECT fc.*,
    CASE WHEN w.n > 1 THEN ml - (latency_mean_ms - ml) / (w.n - 1) ELSE latency_mean_ms END AS peer_latency_mean,
    CASE WHEN w.n > 2 THEN sqrt(greatest(0, (vl * w.n - (latency_mean_ms - ml) ** 2) / (w.n - 1) - ((latency_mean_ms - ml) / (w.n - 1)) ** 2)) ELSE 0 END AS peer_latency_std,
    CASE WHEN w.n > 1 THEN mr - (observed_replies - mr) / (w.n - 1) ELSE observed_replies END AS peer_reply_mean,
    CASE WHEN w.n > 2 THEN sqrt(greatest(0, (vr * w.n - (observed_replies - mr) ** 2) / (w.n - 1) - ((observed_replies - mr) / (w.n - 1)) ** 2)) ELSE 0 END AS peer_reply_std,
    CASE WHEN w.n > 1 THEN mb - (burst_indicator - mb) / (w.n - 1) ELSE burst_indicator END AS peer_burst_indicator_mean,
    CASE WHEN w.n > 2 THEN sqrt(greatest(0, (vb * w.n - (burst_indicator - mb) ** 2) / (w.n - 1) - ((burst_indicator - mb) / (w.n - 1)) ** 2)) ELSE 0 END AS peer_burst_indicator_std,
    w.n AS snapshot_candidate_count, latency_mean_ms - CASE WHEN w.n > 1 THEN ml - (latency_mean_ms - ml) / (w.n - 1) ELSE latency_mean_ms END AS peer_latency_gap,
    CASE WHEN s.n > 1 THEN s.m - (latency_mean_ms - s.m) / (s.n - 1) ELSE latency_mean_ms END AS state_peer_latency_mean,
    CASE WHEN s.n > 2 THEN sqrt(greatest(0, (s.v * s.n - (latency_mean_ms - s.m) ** 2) / (s.n - 1) - ((latency_mean_ms - s.m) / (s.n - 1)) ** 2)) ELSE 0 END AS state_peer_latency_std,
    CASE WHEN t.n > 1 THEN t.m - (latency_mean_ms - t.m) / (t.n - 1) ELSE latency_mean_ms END AS target_peer_latency_mean,
    CASE WHEN t.n > 2 THEN sqrt(greatest(0, (t.v * t.n - (latency_mean_ms - t.m) ** 2) / (t.n - 1) - ((latency_mean_ms - t.m) / (t.n - 1)) ** 2)) ELSE 0 END AS target_peer_latency_std,
    location_degree, target_degree
  FROM fc JOIN wsum w USING (session_bin_index) JOIN ssum s ON s.session_bin_index = fc.session_bin_index AND s.path_state = fc.path_state
    LEFT JOIN tsum t ON t.session_bin_index = fc.session_bin_index AND t.target_hint = fc.target_hint
    JOIN ldeg l ON l.session_bin_index = fc.session_bin_index AND l.location_node = 'loc::' || coalesce(location, 'nan')
    JOIN tdeg d ON d.session_bin_index = fc.session_bin_index AND d.target_node = 'tgt::' || coalesce(fc.target_hint, 'nan')""",
    "cand0": """
  SELECT relative_path, location, path_state, session_bin_index, bin_epoch, bin_start_utc, latency_mean_ms, target_next, burst_indicator, reply_pressure_score, latency_mean_ms_roll_mean_3 AS pred_forecast, peer_latency_mean AS pred_graph,
    peer_burst_indicator_mean, latency_std_ms, (latency_jump_ratio > 1.2)::INT AS stress_applied, CASE WHEN bin_epoch % 172800 = 0 THEN 'even' ELSE 'odd' END AS stress_scenario FROM graph WHERE split = 'test'""",
    "cand": """
  SELECT *, 0.65::DOUBLE * pred_forecast + 0.35::DOUBLE * pred_graph AS pred_simple_fusion, 0.65::DOUBLE * pred_forecast + 0.35::DOUBLE * pred_graph + 0.3::DOUBLE * abs(pred_graph - pred_forecast) AS pred_consensus,
    abs(pred_graph - pred_forecast) AS pred_disagreement FROM cand0""",
    "rand": "SELECT *, (session_bin_index * 100000 + (row_number() OVER (PARTITION BY session_bin_index ORDER BY relative_path, bin_epoch) - 1) * 7919) % 104729 AS random_score FROM cand",
    "best": "SELECT session_bin_index, relative_path AS hindsight_path, target_next AS hindsight_best_latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_bin_index ORDER BY target_next, relative_path, bin_epoch) AS r FROM cand) WHERE r = 1",
    "long": """
  SELECT *, 'random' AS policy_name, -random_score::DOUBLE AS score FROM rand UNION ALL SELECT *, 'reactive_greedy', latency_mean_ms FROM rand UNION ALL SELECT *, 'predictive_greedy', pred_forecast FROM rand
  UNION ALL SELECT *, 'predictive_graph_greedy', pred_graph FROM rand UNION ALL SELECT *, 'predictive_simple_fusion_greedy', pred_simple_fusion FROM rand UNION ALL SELECT *, 'predictive_consensus_greedy', pred_consensus FROM rand""",
    "dec": """
  SELECT policy_name, session_bin_index, relative_path AS chosen_relative_path, location AS chosen_location, path_state AS chosen_path_state, latency_mean_ms AS reactive_latency_ms, target_next AS realized_next_latency_ms,
    hindsight_best_latency_ms, target_next - hindsight_best_latency_ms AS regret_ms, (relative_path = hindsight_path)::INT AS best_path_match, (target_next <= 60.0)::INT AS success_under_budget,
    pred_consensus, pred_disagreement, pred_forecast, pred_graph, pred_simple_fusion
  FROM (SELECT *, row_number() OVER (PARTITION BY policy_name, session_bin_index ORDER BY score, relative_path, bin_epoch) AS r FROM long) JOIN best USING (session_bin_index) WHERE r = 1""",
    "ctx": "SELECT session_bin_index, count(*) AS candidate_count, avg(pred_disagreement) AS mean_candidate_disagreement, max(pred_disagreement) AS max_candidate_disagreement, avg(stress_applied) AS stressed_candidate_fraction FROM cand GROUP BY ALL",
    "terciles": """
  SELECT * EXCLUDE (r, n), CASE WHEN 3 * r <= n - 1 THEN 'Low' WHEN 3 * r <= 2 * (n - 1) THEN 'Medium' ELSE 'High' END AS disagreement_bin
  FROM (SELECT *, row_number() OVER (ORDER BY max_candidate_disagreement, session_bin_index) - 1 AS r, count(*) OVER () AS n FROM ctx)""",
    "decx": "SELECT dec.*, abs(pred_graph - pred_forecast) AS chosen_disagreement, candidate_count, mean_candidate_disagreement, max_candidate_disagreement, stressed_candidate_fraction, disagreement_bin FROM dec JOIN terciles USING (session_bin_index)",
    "deltas": """
  SELECT comparison_name, metric_name, l.session_bin_index, CASE metric_name WHEN 'regret_ms' THEN l.regret_ms - r.regret_ms ELSE l.realized_next_latency_ms - r.realized_next_latency_ms END AS delta
  FROM (VALUES ('graph_vs_reactive', 'predictive_graph_greedy', 'reactive_greedy'), ('graph_vs_predictive_only', 'predictive_graph_greedy', 'predictive_greedy'), ('fusion_vs_temporal', 'predictive_simple_fusion_greedy', 'predictive_greedy'),
    ('fusion_vs_graph', 'predictive_simple_fusion_greedy', 'predictive_graph_greedy'), ('consensus_vs_fusion', 'predictive_consensus_greedy', 'predictive_simple_fusion_greedy'), ('consensus_vs_temporal', 'predictive_consensus_greedy', 'predictive_greedy'),
    ('consensus_vs_graph', 'predictive_consensus_greedy', 'predictive_graph_greedy')) c(comparison_name, a, b)
  JOIN dec l ON l.policy_name = a JOIN dec r ON r.policy_name = b AND r.session_bin_index = l.session_bin_index, (VALUES ('realized_next_latency_ms'), ('regret_ms')) m(metric_name)""",
    "preds": """
  SELECT relative_path, bin_epoch, 'persistence' AS model_name, 'temporal' AS family, target_next AS y_true, latency_mean_ms AS y_pred FROM graph WHERE split = 'test'
  UNION ALL SELECT relative_path, bin_epoch, 'rolling_mean', 'temporal', target_next, latency_mean_ms_roll_mean_3 FROM graph WHERE split = 'test'
  UNION ALL SELECT relative_path, bin_epoch, 'peer_mean', 'graph', target_next, peer_latency_mean FROM graph WHERE split = 'test'""",
    "metrics": """
  SELECT family, model_name, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(CASE WHEN abs(y_true) > 1e-9 THEN abs(y_true - y_pred) / abs(y_true) END) AS mape, count(*) AS row_count FROM preds GROUP BY ALL""",
    "files": """
  SELECT 'inside-out/' || CASE WHEN doc_id % 5 = 0 THEN 'inactive' ELSE 'active' END || '/' || source || '/2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '/' || CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END || doc_id || '/' ||
      CASE WHEN doc_id % 13 = 0 THEN 'table-' || doc_id || '.csv' ELSE 'ping-' || lang || '-10ms-' || CASE WHEN doc_id % 3 = 0 THEN '2h' ELSE '1h' END || '-2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '-00-00-00.txt' END AS relative_path,
    CASE WHEN doc_id % 13 = 0 THEN '.csv' ELSE '.txt' END AS suffix, n_chars * 65536 AS size_bytes, doc_id % 13 = 0 OR doc_id % 40 > 0 AS sampled,
    CASE WHEN doc_id % 13 = 0 THEN ['Timestamp', 'delay_ms'] WHEN doc_id % 40 > 0 THEN ['epoch', 'icmp_seq', 'ttl', 'latency_ms', 'reply_ip'] ELSE []::VARCHAR[] END AS columns,
    least(CASE WHEN doc_id % 13 = 0 THEN 25 ELSE doc_id % 40 END, 25)::INT AS row_sample_count,
    CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 40 > 0 THEN 'ping log parsed' ELSE 'text file did not match ping log pattern' END AS notes FROM documents""",
    "named": r"""
  SELECT *, split_part(relative_path, '/', 1) AS measurement_family, split_part(relative_path, '/', 2) AS path_state, split_part(relative_path, '/', 3) AS location, split_part(relative_path, '/', 4) AS session_date,
    regexp_extract(name, p, 1) AS target_hint, regexp_extract(name, p, 2) AS probe_interval, regexp_extract(name, p, 3) AS window_duration, regexp_extract(name, p, 4) AS window_start
  FROM (SELECT *, list_last(string_split(relative_path, '/')) AS name, '^ping-(.+)-(\d+ms)-(\d+h)-(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})\.txt$' AS p FROM files)""",
    "scored": """
  SELECT * EXCLUDE (name, p), (CASE WHEN suffix IN ('.csv', '.tsv') THEN 40 WHEN suffix = '.txt' AND sampled THEN 35 ELSE 0 END + CASE WHEN size_bytes > 0 THEN least(30, floor(size_bytes / 52428800)) ELSE 0 END
    + CASE WHEN len(list_filter(columns, lambda c: regexp_matches(lower(c), 'time|timestamp|date|datetime|epoch'))) > 0 THEN 20 ELSE 0 END
    + CASE WHEN len(list_filter(columns, lambda c: regexp_matches(lower(c), 'latency|delay|throughput|bandwidth|node|sat|link|gateway'))) > 0 THEN 20 ELSE 0 END
    + CASE WHEN sampled THEN 10 ELSE 0 END + CASE WHEN measurement_family <> '' THEN 5 ELSE 0 END + CASE WHEN path_state = 'active' THEN 5 ELSE 0 END + CASE WHEN window_duration = '2h' THEN 3 ELSE 0 END)::BIGINT AS candidate_score
  FROM named WHERE NOT regexp_matches(relative_path, '(^|/)[.]') AND (suffix IN ('.csv', '.tsv') OR sampled)""",
    "ranked": """
  SELECT *, row_number() OVER (PARTITION BY location, path_state, CASE WHEN window_duration = '' THEN '<unknown>' ELSE window_duration END ORDER BY candidate_score DESC, size_bytes DESC, relative_path) AS place,
    max(candidate_score) OVER (PARTITION BY location, path_state, CASE WHEN window_duration = '' THEN '<unknown>' ELSE window_duration END) AS top FROM scored""",
    "burst": """
  SELECT * REPLACE (CASE WHEN hit THEN greatest(latency_max_ms, latency_mean_ms + s + 0.5 * s) ELSE latency_max_ms END AS latency_max_ms, CASE WHEN hit THEN latency_mean_ms + s ELSE latency_mean_ms END AS latency_mean_ms,
      CASE WHEN hit THEN latency_std_ms + 0.55 * s ELSE latency_std_ms END AS latency_std_ms, CASE WHEN hit THEN greatest(1, floor(observed_replies * 0.88::DOUBLE))::BIGINT ELSE observed_replies END AS observed_replies), hit::INT AS stress_applied, 'burst' AS stress_scenario
  FROM (SELECT *, U(42, relative_path || '|' || bin_epoch, 'hit') < least(0.85, greatest(0, 0.12 * (1.0 + 0.9 * (latency_std_ms - lo) / greatest(1e-9, hi - lo)) * CASE WHEN path_state = 'active' THEN 1.0 ELSE 0.75 END)) AS hit,
    (18.0 + 0.45 * latency_std_ms) * (0.8 + 0.4 * U(42, relative_path || '|' || bin_epoch, 'severity')) AS s FROM idx, (SELECT min(latency_std_ms) AS lo, max(latency_std_ms) AS hi FROM idx))""",
    "runs": """
  SELECT relative_path, len, greatest(0, floor(n * 0.65::DOUBLE) - len) + floor(U(43, relative_path, 'start') * ((n - len) - greatest(0, floor(n * 0.65::DOUBLE) - len) + 1)) AS since
  FROM (SELECT relative_path, count(*) AS n, any_value(path_state) AS st, least(2 + floor(U(43, relative_path, 'length') * 4), count(*)) AS len FROM idx GROUP BY relative_path)
  WHERE n >= 2 AND U(43, relative_path, 'select') < least(0.95, 0.25 + CASE WHEN st = 'inactive' THEN 0.18 ELSE 0 END)""",
    "outage": """
  SELECT * REPLACE (CASE WHEN hit THEN greatest(latency_max_ms, latency_mean_ms + s + 0.75 * s) ELSE latency_max_ms END AS latency_max_ms, CASE WHEN hit THEN latency_mean_ms + s ELSE latency_mean_ms END AS latency_mean_ms,
      CASE WHEN hit THEN latency_std_ms + 0.7 * s ELSE latency_std_ms END AS latency_std_ms, CASE WHEN hit THEN greatest(1, floor(observed_replies * 0.65::DOUBLE))::BIGINT ELSE observed_replies END AS observed_replies), hit::INT AS stress_applied, 'outage' AS stress_scenario
  FROM (SELECT idx.*, coalesce(session_bin_index >= since AND session_bin_index < since + len, false) AS hit, 35.0 + 0.35 * latency_std_ms + CASE WHEN path_state = 'inactive' THEN 10 ELSE 0 END AS s FROM idx LEFT JOIN runs USING (relative_path))""",
    "bad_loc": "SELECT location FROM (SELECT location, row_number() OVER (ORDER BY U(44, location, 'location'), location) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT location FROM idx)) WHERE r <= least(n, greatest(2, ceil(n * 0.35::DOUBLE)))",
    "bad_win": """
  SELECT DISTINCT unnest(range(st, st + len)) AS session_bin_index FROM (SELECT len::BIGINT AS len, (tail + floor(U(44, k, 'start') * (greatest(tail + 1, n - len + 1) - tail)))::BIGINT AS st
  FROM (SELECT *, greatest(0, floor(n * 0.65::DOUBLE) - len) AS tail FROM (SELECT n, k, greatest(1, least(2 + floor(U(44, k, 'length') * 3), n)) AS len FROM (SELECT max(session_bin_index) + 1 AS n FROM idx), (VALUES (0), (1)) v(k))))""",
    "structural": """
  SELECT * REPLACE (CASE WHEN hit THEN greatest(latency_max_ms, latency_mean_ms + s + 0.65 * s) ELSE latency_max_ms END AS latency_max_ms, CASE WHEN hit THEN latency_mean_ms + s ELSE latency_mean_ms END AS latency_mean_ms,
      CASE WHEN hit THEN latency_std_ms + 0.6 * s ELSE latency_std_ms END AS latency_std_ms, CASE WHEN hit THEN greatest(1, floor(observed_replies * 0.8::DOUBLE))::BIGINT ELSE observed_replies END AS observed_replies), hit::INT AS stress_applied, 'structural' AS stress_scenario
  FROM (SELECT *, location IN (FROM bad_loc) AND session_bin_index IN (FROM bad_win) AS hit, (28.0 + 0.30 * latency_std_ms) * (0.90 + 0.25 * U(44, relative_path || '|' || bin_epoch, 'severity')) AS s FROM idx)""",
    "fwin": """
  SELECT session_bin_index FROM (SELECT session_bin_index, row_number() OVER (ORDER BY session_bin_index) - 1 AS place FROM (SELECT DISTINCT session_bin_index FROM fc)) WHERE place IN (
    SELECT unnest(range(st, st + len)) FROM (SELECT len::BIGINT AS len, (tail + floor(U(44, k, 'start') * (greatest(tail + 1, n - len + 1) - tail)))::BIGINT AS st
    FROM (SELECT *, greatest(0, floor(n * 0.85::DOUBLE)) AS tail FROM (SELECT n, k, greatest(1, least(2 + floor(U(44, k, 'length') * 3), n)) AS len FROM (SELECT count(DISTINCT session_bin_index) AS n FROM fc), (VALUES (0), (1)) v(k)))))""",
    "floc": "SELECT location FROM (SELECT location, row_number() OVER (ORDER BY U(44, location, 'location'), location) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT location FROM fc WHERE session_bin_index IN (FROM fwin))) WHERE r <= least(n, greatest(2, ceil(n * 0.35::DOUBLE)))",
}

# the steps from bins to peers again, with a scenario as a further key
KEYED = ("idx", "lags", "ratios", "fc0", "fc", "wsum", "ssum", "tsum", "edges", "ldeg", "tdeg", "graph")


def _keyed(text: str) -> str:
    """A step with ``stress_scenario`` as a further key of its windows, groups and joins, on the keyed steps."""
    text = text.replace("PARTITION BY relative_path", "PARTITION BY stress_scenario, relative_path").replace("SELECT session_bin_index", "SELECT stress_scenario, session_bin_index")
    text = text.replace("DISTINCT session_bin_index", "DISTINCT stress_scenario, session_bin_index").replace("USING (session_bin_index)", "USING (stress_scenario, session_bin_index)")
    text = re.sub(r"(\w)\.session_bin_index = fc\.session_bin_index", r"\1.stress_scenario = fc.stress_scenario AND \1.session_bin_index = fc.session_bin_index", text)
    for name in KEYED:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 s_{name}" + (" fc" if name == "fc" else ""), text)
    return text


STEPS["s_idx"] = "SELECT *, 0::INT AS stress_applied, 'base' AS stress_scenario FROM idx UNION ALL BY NAME SELECT * FROM burst UNION ALL BY NAME SELECT * FROM outage"
for _name in ("lags", "ratios", "fc0"):
    STEPS[f"s_{_name}"] = _keyed(STEPS[_name])
STEPS["s_split"] = _keyed(STEPS["fc"])
STEPS["s_fc"] = """
  SELECT * EXCLUDE (hit, s) FROM s_split UNION ALL BY NAME
  SELECT * EXCLUDE (hit, s) REPLACE (CASE WHEN hit THEN greatest(latency_max_ms, latency_mean_ms + s + 0.65 * s) ELSE latency_max_ms END AS latency_max_ms, CASE WHEN hit THEN latency_mean_ms + s ELSE latency_mean_ms END AS latency_mean_ms,
    CASE WHEN hit THEN latency_std_ms + 0.6 * s ELSE latency_std_ms END AS latency_std_ms, CASE WHEN hit THEN greatest(1, floor(observed_replies * 0.8::DOUBLE))::BIGINT ELSE observed_replies END AS observed_replies,
    CASE WHEN hit THEN target_next + 0.85 * s ELSE target_next END AS target_next, hit::INT AS stress_applied, 'structural' AS stress_scenario)
  FROM (SELECT * EXCLUDE (hit, s), location IN (FROM floc) AND session_bin_index IN (FROM fwin) AS hit, (28.0 + 0.25 * latency_std_ms) * (0.90 + 0.25 * U(44, relative_path || '|' || bin_epoch, 'severity')) AS s FROM s_split WHERE stress_scenario = 'base')"""
for _name in ("wsum", "ssum", "tsum", "edges", "ldeg", "tdeg", "graph"):
    STEPS[f"s_{_name}"] = _keyed(STEPS[_name])
# two experts of each family that have nothing to learn, the better of which speaks in its scenario
EXPERTS = {"temporal": {"rolling_mean_3": "latency_mean_ms_roll_mean_3", "rolling_mean_5": "latency_mean_ms_roll_mean_5"}, "graph": {"peer_mean": "peer_latency_mean", "state_mean": "state_peer_latency_mean"}}
_SAID = [("temporal", "persistence", "latency_mean_ms"), *[(f, n, c) for f, of in EXPERTS.items() for n, c in of.items()]]
_BEST = {f: " ".join(f"WHEN '{n}' THEN {c}" for n, c in of.items()) for f, of in EXPERTS.items()}
STEPS |= {
    "s_said": " UNION ALL ".join(f"SELECT split, stress_scenario, '{f}' AS family, '{n}' AS model_name, target_next AS y_true, {c} AS y_pred FROM s_graph WHERE split <> 'train'" for f, n, c in _SAID),
    "s_metrics": """
  SELECT split, stress_scenario, family, model_name, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(CASE WHEN abs(y_true) > 1e-9 THEN abs(y_true - y_pred) / abs(y_true) END) AS mape, count(*) AS row_count FROM s_said GROUP BY ALL""",
    "s_chosen": """
  SELECT split, stress_scenario, max(model_name) FILTER (WHERE family = 'temporal') AS best_temporal_model, max(model_name) FILTER (WHERE family = 'graph') AS best_graph_model
  FROM (SELECT *, row_number() OVER (PARTITION BY split, stress_scenario, family ORDER BY mae, model_name) AS r FROM s_metrics WHERE model_name <> 'persistence') WHERE r = 1 GROUP BY ALL""",
    "s_told": f"SELECT s_graph.*, CASE best_temporal_model {_BEST['temporal']} END AS pred_forecast, CASE best_graph_model {_BEST['graph']} END AS pred_graph FROM s_graph JOIN s_chosen USING (split, stress_scenario)",
    "s_tuning": """
  SELECT w, 1.0::DOUBLE - w AS g, p, gap FROM (
    WITH points AS (SELECT w, p FROM (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8])::DOUBLE AS w), (SELECT unnest([0.0, 0.1, 0.2, 0.25, 0.3])::DOUBLE AS p)),
    v AS (SELECT * FROM s_told WHERE split = 'val'),
    h AS (SELECT w, p, stress_scenario, avg(target_next) AS hybrid FROM (SELECT *, row_number() OVER (PARTITION BY w, p, stress_scenario, session_bin_index ORDER BY w * pred_forecast + (1.0::DOUBLE - w) * pred_graph + p * abs(pred_graph - pred_forecast), relative_path, bin_epoch) AS r FROM v, points) WHERE r = 1 GROUP BY ALL),
    one AS (SELECT stress_scenario, k, avg(target_next) AS one FROM (SELECT stress_scenario, 't' AS k, target_next, row_number() OVER (PARTITION BY stress_scenario, session_bin_index ORDER BY pred_forecast, relative_path, bin_epoch) AS r FROM v
      UNION ALL SELECT stress_scenario, 'g', target_next, row_number() OVER (PARTITION BY stress_scenario, session_bin_index ORDER BY pred_graph, relative_path, bin_epoch) FROM v) WHERE r = 1 GROUP BY ALL)
    SELECT w, p, avg(hybrid - single) AS gap FROM h JOIN (SELECT stress_scenario, min(one) AS single FROM one GROUP BY ALL) USING (stress_scenario) GROUP BY ALL) ORDER BY round(gap, 9), w, p LIMIT 1""",
    "s_cand": """
  SELECT c.*, w * pred_forecast + g * pred_graph AS pred_simple_fusion, w * pred_forecast + g * pred_graph + p * abs(pred_graph - pred_forecast) AS pred_consensus, abs(pred_graph - pred_forecast) AS pred_disagreement,
    (session_bin_index * 100000 + (row_number() OVER (PARTITION BY stress_scenario, session_bin_index ORDER BY relative_path, bin_epoch) - 1) * 7919) % 104729 AS random_score
  FROM s_told c, s_tuning WHERE split = 'test'""",
    "s_best": "SELECT stress_scenario, session_bin_index, relative_path AS hindsight_path, target_next AS hindsight_best_latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY stress_scenario, session_bin_index ORDER BY target_next, relative_path, bin_epoch) AS r FROM s_cand) WHERE r = 1",
    "s_long": re.sub(r"\brand\b", "s_cand", STEPS["long"]),
    "s_dec": re.sub(r"\b(best|long)\b", r"s_\1", STEPS["dec"].replace("policy_name, session_bin_index,", "policy_name, stress_scenario, session_bin_index,", 1).replace("PARTITION BY policy_name, session_bin_index", "PARTITION BY policy_name, stress_scenario, session_bin_index").replace("USING (session_bin_index)", "USING (stress_scenario, session_bin_index)")),
    "s_terciles": """
  SELECT * EXCLUDE (r, n), CASE WHEN 3 * r <= n - 1 THEN 'Low' WHEN 3 * r <= 2 * (n - 1) THEN 'Medium' ELSE 'High' END AS disagreement_bin
  FROM (SELECT *, row_number() OVER (PARTITION BY stress_scenario ORDER BY max_candidate_disagreement, session_bin_index) - 1 AS r, count(*) OVER (PARTITION BY stress_scenario) AS n FROM (
    SELECT stress_scenario, session_bin_index, count(*) AS candidate_count, avg(pred_disagreement) AS mean_candidate_disagreement, max(pred_disagreement) AS max_candidate_disagreement, avg(stress_applied) AS stressed_candidate_fraction FROM s_cand GROUP BY ALL))""",
    "s_decx": """
  SELECT s_dec.*, abs(pred_graph - pred_forecast) AS chosen_disagreement, candidate_count, mean_candidate_disagreement, max_candidate_disagreement, stressed_candidate_fraction, disagreement_bin, best_temporal_model, best_graph_model, stress_applied_rate
  FROM s_dec JOIN s_terciles USING (stress_scenario, session_bin_index) JOIN (SELECT * FROM s_chosen WHERE split = 'test') USING (stress_scenario) JOIN (SELECT stress_scenario, avg(stress_applied) AS stress_applied_rate FROM s_cand GROUP BY ALL) USING (stress_scenario)""",
    "s_deltas": STEPS["deltas"].replace("SELECT comparison_name, metric_name, l.session_bin_index", "SELECT l.stress_scenario, comparison_name, metric_name, l.session_bin_index").replace("JOIN dec l", "JOIN s_dec l").replace("JOIN dec r ON r.policy_name = b AND", "JOIN s_dec r ON r.policy_name = b AND r.stress_scenario = l.stress_scenario AND"),
}


def _draws(text: str) -> str:
    """U(seed, key, tag) written out: the first 32 bits of an MD5, over 2 to the 32nd."""
    out, at = [], 0
    while (i := text.find("U(", at)) >= 0:
        if i and (text[i - 1].isalnum() or text[i - 1] == "_"):
            out.append(text[at : i + 2])
            at = i + 2
            continue
        seed, rest = text[i + 2 :].split(", ", 1)
        key, tag = rest[: rest.index(")")].rsplit(", ", 1)
        out += [text[at:i], f"((('0x' || substr(md5('{seed}|' || ({key}) || '|' || {tag}), 1, 8))::BIGINT) / 4294967296.0::DOUBLE)"]
        at = i + 2 + len(seed) + 2 + rest.index(")") + 1
    return "".join([*out, text[at:]])


def nudged(text: str, nudge: float) -> str:
    """The final roundings of a query with a nudge before them."""
    return re.sub(r"round\(((?:(?!round\().)+?), 6\) \+ 0\.0::DOUBLE", rf"round(({chr(92)}1) + {nudge}, 6) + 0.0::DOUBLE", text)


def query(final: str, last: str) -> str:
    """``final`` after the steps up to ``last``."""
    names = list(STEPS)
    used = names[: names.index(last) + 1]
    return _draws("WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in used) + f"\n{final}")


def columns(step: str, doubles: str, others: str = "") -> str:
    """The named columns of a step, doubles rounded as the queries round them."""
    parts = [*others.split(), *[f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in doubles.split()]]
    return query(f"SELECT {', '.join(parts)} FROM {step}", step)
