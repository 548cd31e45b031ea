"""Experiment drivers: a detector tournament, stress replays and the choice of an outage policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.operators import detectors, monitoring, replay
from vigilo.session import materialize


def tournament(daily: DataFrame, episodes: DataFrame, scores: dict[str, Column], cutoff: Column, quantile: float = 0.99, budget: int = 2, cooldown: int = 3) -> DataFrame:
    """(name, threshold, metrics): each detector's threshold frozen before the cutoff, alerts replayed after it."""
    frame = daily
    for name, score in scores.items():
        frame = detectors.frozen_score(frame, score, name)
    frame = materialize(frame, "tournament-scores")
    cuts = frame.where(F.col("available_at") <= cutoff).agg(*(F.percentile(n, F.lit(quantile)).alias(n) for n in scores)).first()
    later = frame.where(F.col("available_at") > cutoff)
    eps = episodes.where(F.col("fault_ts") > cutoff)
    n = later.count()
    out = None
    for name in scores:  # a handful of detectors
        if cuts[name] is None:
            continue
        fired = later.join(replay.replay_alerts(later, name, cuts[name], budget, cooldown), ["asset_id", "day", "available_at"], "left_semi")
        one = replay.alert_metrics(fired, eps, n).select(F.lit(name).alias("name"), F.lit(cuts[name]).alias("threshold"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def stress(cycles: DataFrame, scenarios: list[str], after: str, assets: list[str], column: str, context: str, to_scores: Callable[[DataFrame], DataFrame], grid: DataFrame, score: str) -> DataFrame:
    """(scenario, expected_rows, scored_rows, availability) of frozen scores on perturbed cycles, against one expected grid."""
    out = None
    for s in scenarios:
        scored = to_scores(monitoring.perturb(cycles, s, after, assets, column, context))
        one = monitoring.availability(monitoring.align(scored, grid, [score]), score).select(F.lit(s).alias("scenario"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def pick_policy(results: DataFrame, baseline: str, least_gain: float = 0.0) -> DataFrame:
    """One row of (policy, availability, ...): the most available policy no worse than the baseline on unmatched alerts.

    ``results`` has (policy, min_observations, max_age_days, max_gap_days, availability, unmatched); ties go to more
    observations, then shorter age, then shorter gap.
    """
    base = results.where(F.col("policy") == baseline).agg(F.avg("availability").alias("a0"), F.avg("unmatched").alias("u0"))
    keys = ["policy", "min_observations", "max_age_days", "max_gap_days"]
    mean = results.where(F.col("policy") != baseline).groupBy(*keys).agg(F.avg("availability").alias("availability"), F.avg("unmatched").alias("unmatched"))
    ok = mean.crossJoin(base).where((F.col("availability") >= F.col("a0") + least_gain) & (F.col("unmatched") <= F.col("u0")))  # one-row baseline
    return ok.orderBy(F.desc("availability"), F.desc("min_observations"), "max_age_days", "max_gap_days").limit(1).drop("a0", "u0")


def matched_error(left: DataFrame, right: DataFrame, keys: list[str] = ("asset_id", "day", "available_at")) -> DataFrame:
    """One row: rows predicted by both, and the mean difference of their lower bounds there."""
    both = left.select(*keys, F.col("rul_lower").alias("a")).join(right.select(*keys, F.col("rul_lower").alias("b")), list(keys))
    return both.where("a is not null and b is not null").agg(F.count("*").alias("matched_rows"), F.avg(F.col("b") - F.col("a")).alias("mean_shift"))
