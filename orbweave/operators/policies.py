"""Path choice per decision window under several policies, its regret against hindsight, tuning and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.scalars import consensus, disagreement, fusion
from orbweave.operators.ranks import placed

# fixed values: the budget, the policies' names and columns, the grids, and the scramble of the random policy
BUDGET_MS = 60.0
POLICIES = {
    "random": "random_score",
    "reactive_greedy": "latency_mean_ms",
    "predictive_greedy": "pred_forecast",
    "predictive_graph_greedy": "pred_graph",
    "predictive_simple_fusion_greedy": "pred_simple_fusion",
    "predictive_consensus_greedy": "pred_consensus",
}
WEIGHT_GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80)
PENALTY_GRID = (0.00, 0.10, 0.20, 0.25, 0.30)
SWEEP = (0.0, 0.1, 0.2, 0.3, 0.5)
WEIGHT, OTHER, PENALTY = 0.65, 0.35, 0.30
SCRAMBLE = {"window": 100_000, "place": 7_919, "modulus": 104_729}
WINDOW = ("session_bin_index",)


def candidate_frame(temporal: DataFrame, graph: DataFrame) -> DataFrame:
    """The two experts' predictions of the same rows, joined on (relative_path, bin_epoch)."""
    return temporal.join(graph.select("relative_path", "bin_epoch", "pred_graph"), ["relative_path", "bin_epoch"])


def add_scores(candidates: DataFrame, weight: float = WEIGHT, other: float = OTHER, penalty: float = PENALTY) -> DataFrame:
    return candidates.withColumns({"pred_simple_fusion": fusion(weight=weight, other=other), "pred_consensus": consensus(weight=weight, other=other, penalty=penalty), "pred_disagreement": disagreement()})


def pseudo_random_score(candidates: DataFrame, window: tuple[str, ...] = WINDOW) -> DataFrame:
    """A fixed scramble of a row's place in its window; the larger is chosen."""
    score = (F.col("session_bin_index") * SCRAMBLE["window"] + F.col("_place") * SCRAMBLE["place"]) % SCRAMBLE["modulus"]
    return placed(candidates, ["relative_path", "bin_epoch"], window, "_place").withColumn("random_score", score).drop("_place")


def hindsight_best(candidates: DataFrame, window: tuple[str, ...] = WINDOW) -> DataFrame:
    best = candidates.groupBy(*window).agg(F.min(F.struct("target_next", "relative_path", "bin_epoch")).alias("b"))
    return best.select(*window, F.col("b.relative_path").alias("hindsight_path"), F.col("b.target_next").alias("hindsight_best_latency_ms"))


def policy_decisions(candidates: DataFrame, policies: dict[str, str] = POLICIES, budget: float = BUDGET_MS, window: tuple[str, ...] = WINDOW) -> DataFrame:
    """One row per policy and window: the candidate of least score (ties by path and time), and how it turned out.

    Every candidate is unpivoted to a row per policy and the least is taken by an aggregate, before any shuffle.
    """
    preds = sorted(c for c in candidates.columns if c.startswith("pred_"))
    keep = ["relative_path", "location", "path_state", "latency_mean_ms", "target_next", *preds]
    candidates = candidates.select(*dict.fromkeys([*window, "session_bin_index", "bin_epoch", *keep, *(c for c in policies.values() if c != "random_score")]))
    work = pseudo_random_score(candidates, window) if "random_score" in policies.values() else candidates
    scores = F.array(*[F.struct(F.lit(name).alias("policy_name"), (-F.col(c) if name == "random" else F.col(c)).cast("double").alias("score")) for name, c in policies.items()])
    long = work.select(*window, "bin_epoch", *keep, F.explode(scores).alias("s")).select("*", "s.policy_name", "s.score")
    chosen = long.groupBy("policy_name", *window).agg(F.min_by(F.struct(*keep), F.struct("score", "relative_path", "bin_epoch")).alias("c"))
    best = hindsight_best(candidates, window)
    done = chosen.join(best, list(window))
    return done.select(
        "policy_name", *window, F.col("c.relative_path").alias("chosen_relative_path"), F.col("c.location").alias("chosen_location"), F.col("c.path_state").alias("chosen_path_state"),
        F.col("c.latency_mean_ms").alias("reactive_latency_ms"), F.col("c.target_next").alias("realized_next_latency_ms"), "hindsight_best_latency_ms",
        (F.col("c.target_next") - F.col("hindsight_best_latency_ms")).alias("regret_ms"), (F.col("c.relative_path") == F.col("hindsight_path")).cast("int").alias("best_path_match"),
        (F.col("c.target_next") <= budget).cast("int").alias("success_under_budget"), *[F.col(f"c.{p}").alias(p) for p in preds],
    )


def policy_summary(decisions: DataFrame, keys: tuple[str, ...] = ("policy_name",)) -> DataFrame:
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("decision_count"), F.avg("realized_next_latency_ms").alias("mean_realized_latency_ms"), F.avg("regret_ms").alias("mean_regret_ms"),
        F.avg("best_path_match").alias("best_path_match_rate"), F.avg("success_under_budget").alias("success_rate_under_60ms"),
    )


def window_context(candidates: DataFrame, window: tuple[str, ...] = WINDOW) -> DataFrame:
    return candidates.groupBy(*window).agg(
        F.count("*").alias("candidate_count"), F.avg("pred_disagreement").alias("mean_candidate_disagreement"), F.max("pred_disagreement").alias("max_candidate_disagreement"),
        F.avg("stress_applied").alias("stressed_candidate_fraction"),
    )


def decision_context(decisions: DataFrame, context: DataFrame, window: tuple[str, ...] = WINDOW) -> DataFrame:
    return decisions.join(context, list(window), "left").withColumn("chosen_disagreement", disagreement())


def disagreement_bins(context: DataFrame, scenario: tuple[str, ...] = ()) -> DataFrame:
    """Windows labelled Low, Medium or High by rank of their largest disagreement: rank r of n is Low if 3(r-1) <= n-1."""
    ranked = placed(context, ["max_candidate_disagreement", "session_bin_index"], scenario, "_rank")
    sizes = ranked.groupBy(*scenario).agg((F.max("_rank") + 1).alias("_n"))  # a row per scenario
    ranked = ranked.join(sizes, list(scenario)) if scenario else ranked.join(F.broadcast(sizes))
    rank, n = F.col("_rank"), F.col("_n")
    return ranked.withColumn("disagreement_bin", F.when(3 * rank <= n - 1, "Low").when(3 * rank <= 2 * (n - 1), "Medium").otherwise("High")).drop("_rank", "_n")


def disagreement_summary(decisions: DataFrame, keys: tuple[str, ...] = ("disagreement_bin", "policy_name")) -> DataFrame:
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("decision_count"), F.avg("realized_next_latency_ms").alias("mean_realized_latency_ms"), F.avg("regret_ms").alias("mean_regret_ms"),
        F.avg("best_path_match").alias("best_path_match_rate"), F.avg("success_under_budget").alias("success_rate_under_60ms"), F.avg("chosen_disagreement").alias("mean_chosen_disagreement"),
    )


def _graded(candidates: DataFrame, grid: list[tuple[float, float, float]], window: tuple[str, ...]) -> DataFrame:
    """For each grid point and window, the candidate of least consensus score; rows multiply only before partial aggregation."""
    points = F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(w).alias("w"), F.lit(g).alias("g"), F.lit(p).alias("p")) for i, (w, g, p) in enumerate(grid)])
    long = candidates.select(*window, "relative_path", "bin_epoch", "target_next", "pred_forecast", "pred_graph", F.explode(points).alias("x"))
    score = consensus(weight=F.col("x.w"), other=F.col("x.g"), penalty=F.col("x.p"))
    least = long.groupBy(F.col("x.grid").alias("grid"), *window).agg(F.min(F.struct(score.alias("score"), "relative_path", "bin_epoch", "target_next")).alias("b"))
    return least.select("grid", *window, F.col("b.relative_path").alias("chosen_relative_path"), F.col("b.target_next").alias("realized_next_latency_ms"))


def consensus_tuning(candidates: DataFrame, weights: tuple[float, ...] = WEIGHT_GRID, penalties: tuple[float, ...] = PENALTY_GRID, scenario: str = "stress_scenario") -> DataFrame:
    """The grid point of least mean gap to the better single expert, over scenarios; of equal ones the first."""
    grid = [(w, 1.0 - w, p) for w in weights if w <= 1.0 for p in penalties]
    window = (scenario, "session_bin_index")
    hybrid = _graded(candidates, grid, window).groupBy("grid", scenario).agg(F.avg("realized_next_latency_ms").alias("hybrid"))
    single = policy_decisions(candidates, {"temporal_only": "pred_forecast", "graph_only": "pred_graph"}, window=window)
    single = single.groupBy(scenario, "policy_name").agg(F.avg("realized_next_latency_ms").alias("one")).groupBy(scenario).agg(F.min("one").alias("single"))
    gaps = hybrid.join(single, scenario).groupBy("grid").agg(F.avg(F.col("hybrid") - F.col("single")).alias("gap"))
    best = gaps.agg(F.min(F.struct(F.round("gap", 9).alias("gap"), "grid")).alias("b"))
    value = lambda k: F.element_at(F.array(*[F.lit(g[k]) for g in grid]), F.col("b.grid") + 1)
    return best.select(value(0).alias("temporal_weight"), value(1).alias("graph_weight"), value(2).alias("disagreement_penalty"), F.col("b.gap").alias("validation_gap_ms"))


def penalty_sweep(candidates: DataFrame, penalties: tuple[float, ...] = SWEEP, weight: float = WEIGHT, other: float = OTHER, budget: float = BUDGET_MS, scenario: str = "stress_scenario") -> DataFrame:
    window = (scenario, "session_bin_index")
    chosen = _graded(candidates, [(weight, other, p) for p in penalties], window).join(hindsight_best(candidates, window), list(window))
    rows = chosen.select(
        scenario, F.element_at(F.array(*map(F.lit, penalties)), F.col("grid") + 1).alias("disagreement_penalty"), "realized_next_latency_ms", (F.col("realized_next_latency_ms") - F.col("hindsight_best_latency_ms")).alias("regret_ms"),
        (F.col("chosen_relative_path") == F.col("hindsight_path")).cast("int").alias("best_path_match"), (F.col("realized_next_latency_ms") <= budget).cast("int").alias("success_under_budget"),
    )
    return policy_summary(rows, (scenario, "disagreement_penalty"))
