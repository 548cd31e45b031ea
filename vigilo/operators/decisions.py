"""From margins to reviewable actions: aspects with hysteresis, window comparisons, duty and evidence states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aspects are 0 (clear) to 3 (withdraw); unknown stands apart.
ASPECT_UNKNOWN = -1


@dataclass(frozen=True)
class AspectPolicy:
    withdraw_days: float = 1.0
    tonight_days: float = 3.0
    plan_days: float = 21.0
    dwell_days: int = 3

    def __post_init__(self):
        if not 0 < self.withdraw_days < self.tonight_days < self.plan_days or self.dwell_days < 1:
            raise ValueError("thresholds must ascend and the dwell be positive")


def raw_aspect(margin: Column, policy: AspectPolicy = AspectPolicy()) -> Column:
    """Severity 3 below the first threshold to 0 from the last on; equality goes to the milder side; -1 if unknown."""
    known = margin.isNotNull() & ~F.isnan(margin) & (F.abs(margin) < float("inf"))
    return (
        F.when(~known, ASPECT_UNKNOWN)
        .when(margin < policy.withdraw_days, 3)
        .when(margin < policy.tonight_days, 2)
        .when(margin < policy.plan_days, 1)
        .otherwise(0)
    )


def state_aspect(margin: Column, state: Column, policy: AspectPolicy = AspectPolicy()) -> Column:
    """The raw aspect where the estimate stands; no worsening trend is clear; other states are unknown."""
    return F.when(state == "no_worsening_trend", 0).when(state.isin("valid", "threshold_exceeded"), raw_aspect(margin, policy)).otherwise(ASPECT_UNKNOWN)


def damp(df: DataFrame, raw: str = "raw_aspect", policy: AspectPolicy = AspectPolicy(), by: str = "asset_id", day: str = "day") -> DataFrame:
    """Adds ``aspect``: escalates at once, eases only after ``dwell_days`` consecutive milder days, to that day's value.

    Unknown days hold an elevated aspect and restart the count, as do gaps of more than a day.  One ordered fold per
    asset; an asset's days are bounded by its years in service.
    """
    item = F.struct(F.col(day).alias("d"), F.col(raw).cast("int").alias("r"))
    held = df.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    start = F.struct(F.lit(ASPECT_UNKNOWN).alias("s"), F.lit(0).alias("b"), F.lit(None).cast("date").alias("p"), F.array().cast("array<struct<d:date,a:int>>").alias("o"))

    def step(acc: Column, x: Column) -> Column:
        below = F.when(acc.p.isNotNull() & (F.datediff(x.d, acc.p) > 1), 0).otherwise(acc.b)
        unknown = x.r == ASPECT_UNKNOWN
        rise = (acc.s == ASPECT_UNKNOWN) | (x.r >= acc.s)
        ease = below + 1 >= policy.dwell_days
        state = F.when(unknown, acc.s).when(rise | ease, x.r).otherwise(acc.s)
        count = F.when(unknown | rise | ease, 0).otherwise(below + 1)
        shown = F.when(unknown, F.when(acc.s > 0, acc.s).otherwise(ASPECT_UNKNOWN)).otherwise(state)
        return F.struct(state.alias("s"), count.alias("b"), x.d.alias("p"), F.concat(acc.o, F.array(F.struct(x.d.alias("d"), shown.alias("a")))).alias("o"))

    out = held.select(by, F.explode(F.aggregate("xs", start, step, lambda acc: acc.o)).alias("o")).select(by, F.col("o.d").alias(day), F.col("o.a").alias("aspect"))
    return df.join(out, [by, day])


def stability(point: Column, lower: Column, policy: AspectPolicy = AspectPolicy()) -> Column:
    """How many aspects lie between the point estimate and the lower bound."""
    gap = F.abs(raw_aspect(point, policy) - raw_aspect(lower, policy))
    return F.when(point.isNull() | lower.isNull(), "n/a").when(gap == 0, "HIGH").when(gap == 1, "MEDIUM").otherwise("LOW")


def compare_window(margin: Column, state: Column, horizon: Column) -> Column:
    """Whether a wait of ``horizon`` days stays inside the margin; only strictly inside counts."""
    return (
        F.when(horizon.isNull() | (horizon < 0), "unknown")
        .when(state == "threshold_exceeded", "threshold_exceeded")
        .when((state != "valid") | state.isNull() | margin.isNull(), "unknown")
        .when(margin <= 0, "no_positive_margin")
        .when(horizon < margin, "within_margin")
        .otherwise("exceeds_margin")
    )


def ledger(pred: DataFrame, horizons: tuple[float, ...] = (0, 3, 7, 14, 28), window_at: Column | None = None) -> DataFrame:
    """Adds window_{h}d for each horizon, and with ``window_at`` the hours to it and its label."""
    out = pred.withColumns({f"window_{h:g}d": compare_window(F.col("rul_lower"), F.col("prediction_state"), F.lit(float(h))) for h in horizons})
    if window_at is None:
        return out
    if not out.where(window_at < F.col("available_at")).isEmpty():
        raise ValueError("a maintenance window precedes the prediction it is compared with")
    hours = F.timestamp_diff("SECOND", F.col("available_at"), window_at) / 3600.0
    return out.withColumn("hours_to_window", hours).withColumn("scheduled_window", compare_window(F.col("rul_lower"), F.col("prediction_state"), hours / 24))


def failure_probability(*_args, **_kwargs):
    raise NotImplementedError("bounds are empirical; no failure probability is calibrated")


def evidence_status(df: DataFrame, as_of: Column, completeness: list[str], index: str = "health_index_smooth", max_age_days: int = 1) -> DataFrame:
    """Adds status, missing_channels and last_supported_at: what may be said on the replay clock, unknown kept explicit."""
    short = [F.when(F.coalesce(F.col(c), F.lit(0.0)) < 0.9, F.lit(c.removesuffix("_completeness"))) for c in completeness]
    missing = F.array_compact(F.array(*short))
    falsy = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(F.col("available_at").isNull(), "missing")
        .when(F.col("available_at") > as_of, "not_available")
        .when(F.timestamp_diff("SECOND", F.col("available_at"), as_of) > max_age_days * 86400, "stale")
        .when(falsy("context_supported"), "outside_conditions")
        .when(falsy("data_quality_ok") | (F.size(missing) > 0), "incomplete")
        .when(F.col(index).isNull(), "warming_up")
        .otherwise("supported")
    )
    none = F.array().cast("array<string>")
    return df.withColumn("status", status).withColumn("missing_channels", F.when(F.col("status") == "not_available", none).otherwise(missing))


def carry_supported(df: DataFrame, supported: Column, by: str = "asset_id", day: str = "day") -> DataFrame:
    """Adds last_supported_at: when the latest supported row so far became available."""
    w = Window.partitionBy(by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("last_supported_at", F.last(F.when(supported, F.col("available_at")), ignorenulls=True).over(w))


def islands(df: DataFrame, flag: Column, by: str = "asset_id", day: str = "day") -> DataFrame:
    """(by, start, end, days): runs of consecutive calendar days on which ``flag`` holds."""
    on = df.where(flag).select(by, day)
    w = Window.partitionBy(by).orderBy(day)
    return on.withColumn("g", F.date_sub(day, F.row_number().over(w))).groupBy(by, "g").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("days")).drop("g")
