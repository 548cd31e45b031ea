"""Labels, remaining-life projection with empirical bounds, and their evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_SECONDS = 86400.0


def days_between(start: Column, end: Column) -> Column:
    """Elapsed days, fractions kept."""
    return F.timestamp_diff("MICROSECOND", start, end) / (DAY_SECONDS * 1e6)


def in_episode(daily: DataFrame, episodes: DataFrame, closed: bool = False, how: str = "inner") -> DataFrame:
    """Rows whose availability lies in [onset, fault), or [onset, fault] if ``closed``; episodes are few and broadcast by the optimizer's size check."""
    e = episodes.select(F.col("asset_id").alias("__a"), "onset_ts", "fault_ts", *(c for c in ("episode_id",) if c in episodes.columns))
    end = F.col("available_at") <= F.col("fault_ts") if closed else F.col("available_at") < F.col("fault_ts")
    return daily.join(e, (F.col("asset_id") == F.col("__a")) & (F.col("available_at") >= F.col("onset_ts")) & end, how).drop("__a")


def true_rul(daily: DataFrame, episodes: DataFrame) -> DataFrame:
    """Adds true_rul: days left to the fault inside an episode, else null; the last episode in table order wins, here the one with the latest fault."""
    hit = in_episode(daily.select("asset_id", "available_at"), episodes)
    left = hit.groupBy("asset_id", "available_at").agg(F.max(days_between(F.col("available_at"), F.col("fault_ts"))).alias("true_rul"))
    return daily.join(left, ["asset_id", "available_at"], "left")


def horizon_outcomes(daily: DataFrame, episodes: DataFrame, horizon_days: int, observation_end: Column) -> DataFrame:
    """Adds outcome: 1 if a fault falls within the horizon, 0 if follow-up covers it without one, else null."""
    if horizon_days < 0:
        raise ValueError("horizon must not be negative")
    deadline = F.col("available_at") + F.expr(f"INTERVAL {horizon_days} DAY")
    e = episodes.select(F.col("asset_id").alias("__a"), F.col("fault_ts").alias("__f"))
    hit = daily.join(e, (F.col("asset_id") == F.col("__a")) & (F.col("available_at") < F.col("__f")) & (F.col("__f") <= deadline), "left_semi")
    marked = hit.select("asset_id", "available_at").distinct().withColumn("__hit", F.lit(1.0))
    out = daily.join(marked, ["asset_id", "available_at"], "left")
    return out.withColumn("outcome", F.coalesce("__hit", F.when(deadline <= observation_end, 0.0))).drop("__hit")


def last_before_fault(daily: DataFrame, episodes: DataFrame, value: str) -> DataFrame:
    """As-of: for each episode the latest known value available by the fault."""
    e = episodes.select("episode_id", F.col("asset_id").alias("__a"), "fault_ts", "train_id")
    near = daily.select("asset_id", "available_at", value).join(e, (F.col("asset_id") == F.col("__a")) & (F.col("available_at") <= F.col("fault_ts")))
    return near.where(F.col(value).isNotNull()).groupBy("episode_id", F.col("asset_id"), "train_id").agg(F.max_by(value, "available_at").alias("last_value"))


def leave_one_group_thresholds(last: DataFrame, group: str = "train_id") -> DataFrame:
    """(group, threshold): the median of the last values of all other groups' episodes."""
    groups = last.select(F.col(group).alias("fold")).distinct()
    others = groups.join(last.select(group, "last_value"), F.col("fold") != F.col(group))  # a few episodes by a few groups
    return others.groupBy("fold").agg(F.percentile("last_value", F.lit(0.5)).alias("threshold"))


def project(index: Column, slope: Column, threshold: Column, min_slope: float = 0.25, horizon: float = 90.0, form: str = "loglinear") -> Column:
    """Days until the index meets the threshold at this slope, from 0 to ``horizon``; null without a worsening trend."""
    gap = threshold - index
    straight = F.try_divide(gap, slope)
    curved = F.when(index >= 1, F.try_divide(F.ln(F.try_divide(threshold, index)), F.try_divide(slope, index))).otherwise(straight)
    days = curved if form == "loglinear" else straight
    capped = F.least(F.greatest(days, F.lit(0.0)), F.lit(horizon))
    return F.when(index >= threshold, F.lit(0.0)).when(slope > min_slope, capped)


def rank_bounds(scores: DataFrame, score: str, alpha: float = 0.1, by: list[str] = ()) -> DataFrame:
    """(by, n, lo, hi): the floor((n+1)*alpha)-th and ceil((n+1)*(1-alpha))-th smallest; null where that rank is out of range."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    ranked = scores.where(F.col(score).isNotNull()).select(*by, score, F.row_number().over(w.orderBy(score)).alias("r"), F.count(score).over(w).alias("n"))
    low, high = F.floor((F.col("n") + 1) * alpha), F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-12)
    return ranked.groupBy(*by, "n").agg(F.max(F.when(F.col("r") == low, F.col(score))).alias("lo"), F.max(F.when(F.col("r") == high, F.col(score))).alias("hi"))


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float, by: list[str] = ()) -> DataFrame:
    """(by, quantile): the smallest value at which the cumulative share of weight reaches ``q``."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    run = df.select(*by, value, (F.sum(weight).over(w.orderBy(value)) / F.sum(weight).over(w)).alias("share"))
    return run.where(F.col("share") >= q - 1e-12).groupBy(*by).agg(F.min(value).alias("quantile"))


@dataclass(frozen=True)
class LifePolicy:
    min_slope: float = 0.25
    elevated: float = 3.0
    horizon: float = 90.0
    form: str = "loglinear"


def predict(daily: DataFrame, index: str, slope: str, threshold: float | Column | None, lo: float | Column | None, hi: float | Column | None, policy: LifePolicy = LifePolicy(), as_of: Column | None = None, stale_hours: float = 24.0) -> DataFrame:
    """rul_point, rul_lower, rul_upper and prediction_state; later rules override earlier ones, so the last is tested first.

    Threshold and shifts are numbers, or columns where they differ by row; without a threshold, or either shift, a row is uncalibrated.
    """
    i, s = F.col(index), F.col(slope)
    t, low, high = (F.lit(x).cast("double") for x in (threshold, lo, hi))
    known = i.isNotNull() & s.isNotNull()
    quiet = known & (s <= policy.min_slope)
    point = project(i, s, t, policy.min_slope, policy.horizon, policy.form)
    falsy = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rules: list[tuple[Column, str]] = []
    if as_of is not None:
        rules.append((F.col("available_at") > as_of, "not_yet_available"))
        late = F.timestamp_diff("SECOND", F.col("last_observed_at"), as_of) / 3600.0
        rules.append((F.col("last_observed_at").isNull() | (late > stale_hours), "stale_data"))
    rules += [(falsy("context_supported"), "outside_training_conditions"), (falsy("data_quality_ok"), "insufficient_data")]
    rules.append((i.isNotNull() & t.isNotNull() & (i >= t), "threshold_exceeded"))
    rules.append((known & (t.isNull() | low.isNull() & high.isNull()), "uncalibrated"))
    rules += [
        (quiet & (i >= policy.elevated), "elevated_no_trend"),
        (quiet & (i < policy.elevated), "no_worsening_trend"),
        (known & (point >= policy.horizon), "outside_horizon"),
        (known, "valid"),
    ]
    state = F.lit("insufficient_history")
    for test, name in reversed(rules):
        state = F.when(test, name).otherwise(state)
    shifted = lambda d: F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.col("__p") + d))
    st = F.col("prediction_state")
    return (
        daily.withColumn("prediction_state", state)
        .withColumn("__p", point)
        .withColumn("rul_point", F.when(st.isin("valid", "threshold_exceeded", "outside_horizon"), F.col("__p")))
        .withColumn("rul_lower", F.when(st == "valid", shifted(low)).when(st == "threshold_exceeded", 0.0))
        .withColumn("rul_upper", F.when(st == "valid", shifted(high)))
        .drop("__p")
    )


def coverage_summary(pred: DataFrame, group: str = "train_id", by: list[str] = ()) -> DataFrame:
    """One row, or one for each ``by``: group-macro coverage of rul_lower, near-fault coverage, abstention, error; expects true_rul."""
    eligible = pred.where("true_rul is not null")
    covered = (F.col("rul_lower") <= F.col("true_rul")).cast("double")
    scored = F.col("rul_lower").isNotNull()
    by_group = eligible.groupBy(*by, group).agg(
        F.count("*").alias("rows"),
        F.count("rul_lower").alias("scored"),
        F.avg(F.when(scored, covered)).alias("cov"),
        F.sum(F.when(scored & (F.col("true_rul") <= 7), covered)).alias("near_hit"),
        F.count(F.when(scored & (F.col("true_rul") <= 7), 1)).alias("near_n"),
        F.sum(F.when(scored, F.abs(F.col("rul_point") - F.col("true_rul")))).alias("err"),
        F.count(F.when(scored, F.col("rul_point"))).alias("err_n"),
        F.count(F.when(F.col("rul_lower") > 0, 1)).alias("positive"),
    )
    return by_group.groupBy(*by).agg(
        F.sum("rows").alias("episode_rows"),
        F.sum("scored").alias("scored_rows"),
        (1 - F.try_divide(F.sum("scored"), F.sum("rows"))).alias("abstention_rate"),
        F.count("cov").alias("evaluated_groups"),
        F.avg("cov").alias("macro_lower_coverage"),
        F.try_divide(F.sum("near_hit"), F.sum("near_n")).alias("near_fault_lower_coverage"),
        F.try_divide(F.sum("err"), F.sum("err_n")).alias("point_mae_days"),
        F.try_divide(F.sum("positive"), F.sum("scored")).alias("positive_margin_fraction"),
    )
