"""Load sensitivity: does the index rise with load, and would peak load exceed the failure level?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.operators.features import day_index, trailing

STATS = ("duty_n", "duty_sum_l", "duty_sum_ll", "duty_sum_y", "duty_sum_ly", "duty_sum_yy")


def load_stats(cycles: DataFrame, index: str, load: str = "load_proxy") -> DataFrame:
    """Sufficient statistics of (load, index) per asset and day, over supported cycles with both values."""
    ok = F.col(load).isNotNull() & F.col(index).isNotNull() & F.coalesce("context_supported", F.lit(False))
    x, y = F.col("l"), F.col("y")
    rows = cycles.where(ok).select("asset_id", F.col("ts").cast("date").alias("day"), F.col(load).alias("l"), F.col(index).alias("y"))
    return rows.groupBy("asset_id", "day").agg(
        F.count("*").cast("double").alias("duty_n"),
        F.sum(x).alias("duty_sum_l"),
        F.sum(x * x).alias("duty_sum_ll"),
        F.sum(y).alias("duty_sum_y"),
        F.sum(x * y).alias("duty_sum_ly"),
        F.sum(y * y).alias("duty_sum_yy"),
    )


def load_sensitivity(daily: DataFrame, window_days: int = 3, min_cycles: int = 30, min_load_sd: float = 0.08, min_t: float = 2.5, exit_t: float = 1.5) -> DataFrame:
    """Adds load_sensitivity, its t value, the window's mean load, and load_sensitive.

    Each day is centred on its own means before days are pooled, so differences between days do not count.  The flag
    enters at ``min_t`` and stays at ``exit_t`` on consecutive days: since entering implies staying, a run of staying
    days is sensitive from its first entering day on.
    """
    n, sl, sll, sy, sly, syy = (F.coalesce(F.col(c), F.lit(0.0)) for c in STATS)
    has = n > 0
    w = trailing(window_days)
    zero = F.lit(0.0)
    parts = daily.withColumns(
        {
            "__xx": F.when(has, F.greatest(sll - F.try_divide(sl * sl, n), zero)).otherwise(zero),
            "__xy": F.when(has, sly - F.try_divide(sl * sy, n)).otherwise(zero),
            "__yy": F.when(has, F.greatest(syy - F.try_divide(sy * sy, n), zero)).otherwise(zero),
            "__d": has.cast("double"),
            "__n": n,
            "__l": sl,
        }
    )
    pooled = parts.withColumns({f"__s{c}": F.sum(f"__{c}").over(w) for c in ("xx", "xy", "yy", "d", "n", "l")})
    b = F.try_divide(F.col("__sxy"), F.col("__sxx"))
    dof = F.col("__sn") - F.col("__sd") - 1
    left = F.greatest(F.col("__syy") - F.col("__b") * F.col("__sxy"), zero) / F.greatest(dof, F.lit(1.0))
    t = F.try_divide(F.col("__b"), F.sqrt(F.try_divide(left, F.col("__sxx"))))
    sd = F.sqrt(F.try_divide(F.col("__sxx"), F.col("__sn")))
    usable = F.coalesce(F.col("__b").isNotNull() & (dof > 0) & (F.col("__sn") >= min_cycles) & (sd >= min_load_sd), F.lit(False))
    out = pooled.withColumn("__b", b).withColumn("__t", t).withColumn("__u", usable)
    rising = F.col("__u") & (F.col("__b") > 0)
    out = out.withColumn("__enter", F.coalesce(rising & (F.col("__t") >= min_t), F.lit(False))).withColumn("__stay", F.coalesce(rising & (F.col("__t") >= exit_t), F.lit(False)))
    out = schmitt(out, "__enter", "__stay", "load_sensitive")
    out = out.withColumns(
        {
            "load_sensitivity": F.when(F.col("__u"), F.col("__b")),
            "load_sensitivity_t": F.when(F.col("__u"), F.col("__t")),
            "window_mean_load": F.try_divide(F.col("__sl"), F.col("__sn")),
        }
    )
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def schmitt(df: DataFrame, enter: str, stay: str, out: str, by: str = "asset_id", day: str = "day") -> DataFrame:
    """Two-threshold trigger over consecutive days; ``enter`` must imply ``stay``."""
    w = Window.partitionBy(by).orderBy(day)
    gap = day_index(F.col(day)) - F.lag(day_index(F.col(day))).over(w) > 1
    broken = (~F.col(stay) | F.coalesce(gap, F.lit(False))).cast("int")
    runs = df.withColumn("__g", F.sum(broken).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entered = F.max(F.col(enter).cast("int")).over(Window.partitionBy(by, "__g").orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn(out, F.col(stay) & (entered == 1)).drop("__g")


def hourly_profile(cycles: DataFrame, hour: str = "hour_of_day", load: str = "load_proxy") -> DataFrame:
    """(hour, load): the median load of each hour of the day that has cycles; at most 24 rows."""
    seen = cycles.where(F.col(hour).isNotNull() & F.col(load).isNotNull())
    return seen.groupBy(F.least(F.greatest(F.floor(hour), F.lit(0)), F.lit(23)).cast("int").alias("hour")).agg(F.percentile(load, F.lit(0.5)).alias("load"))


def peak_bands(cycles: DataFrame, hour: str = "hour_of_day", load: str = "load_proxy") -> DataFrame:
    """(start_hour, end_hour): runs of hours whose median load is in the upper half of the day's range.

    A flat profile has none, nor do fewer than 24 cycles.
    """
    prof = hourly_profile(cycles, hour, load)
    total = cycles.where(F.col(hour).isNotNull() & F.col(load).isNotNull()).agg(F.count("*").alias("n"))
    ends = prof.agg(F.min("load").alias("lo"), F.max("load").alias("hi"))
    peak = prof.crossJoin(ends).crossJoin(total).where("n >= 24 and hi - lo >= 1e-6 and load >= lo + 0.5 * (hi - lo)")  # one-row tables
    runs = peak.withColumn("g", F.col("hour") - F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("hour")))  # at most 24 rows
    return runs.groupBy("g").agg(F.min("hour").alias("start_hour"), (F.max("hour") + 1).alias("end_hour")).drop("g")


def band_loads(cycles: DataFrame, bands: DataFrame, hour: str = "hour_of_day", load: str = "load_proxy", q: float = 0.9) -> DataFrame:
    """One row: the q-quantile of load inside the bands and the median outside; the mean where a side is empty."""
    seen = cycles.where(F.col(hour).isNotNull() & F.col(load).isNotNull()).select(F.floor(hour).alias("h"), F.col(load).alias("l"))
    hours = bands.select(F.explode(F.sequence("start_hour", F.col("end_hour") - 1)).alias("ph"))
    marked = seen.join(F.broadcast(hours), F.col("h") == F.col("ph"), "left")  # at most 24 rows
    inside = F.when(F.col("ph").isNotNull(), F.col("l"))
    outside = F.when(F.col("ph").isNull(), F.col("l"))
    return marked.agg(
        F.coalesce(F.percentile(inside, F.lit(q)), F.avg("l")).alias("load_peak"),
        F.coalesce(F.percentile(outside, F.lit(0.5)), F.avg("l")).alias("load_offpeak"),
    )


def duty_label(state: Column, aspect: Column, sensitivity: Column, sensitive: Column, peak_state: Column) -> Column:
    """What service the evidence allows; a held escalation is no fresh evidence, so the state is asked first."""
    return (
        F.when(~F.coalesce(state.isin("valid", "threshold_exceeded", "no_worsening_trend"), F.lit(False)), "not_assessed")
        .when(state == "threshold_exceeded", "withdraw")
        .when((aspect == -1) | sensitivity.isNull(), "not_assessed")
        .when(~sensitive, "full_service")
        .when(peak_state == "threshold_exceeded", "off_peak_only")
        .otherwise("full_service")
    )


def assess_duty(card: DataFrame, sensitivity: DataFrame, loads: DataFrame, index: str, predict: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``card`` with what service its evidence allows: base, peak and off-peak states, indices at those loads, duty, duty_reason.

    ``card`` has asset_id, day, prediction_state, aspect and ``index``; ``sensitivity`` is of ``load_sensitivity``,
    ``loads`` one row of load_peak and load_offpeak.  ``predict(rows, index)`` adds prediction_state by the card's own
    life model; it runs again on the index moved to either load along the asset's sensitivity.  A day that the card
    cannot assess is not assessed at peak either.
    """
    own = sensitivity.select("asset_id", "day", "load_sensitivity", F.coalesce("load_sensitive", F.lit(False)).alias("load_sensitive"), "window_mean_load")
    base = card.withColumnRenamed("prediction_state", "base_state").drop("rul_point", "rul_lower", "rul_upper")
    out = base.join(own, ["asset_id", "day"], "left").crossJoin(F.broadcast(loads)).withColumn("load_sensitive", F.coalesce("load_sensitive", F.lit(False)))  # one row
    for side in ("peak", "offpeak"):
        shift = F.when(F.col("load_sensitive"), F.col("load_sensitivity") * (F.col(f"load_{side}") - F.col("window_mean_load")))
        out = predict(out.withColumn(f"{side}_index", F.col(index) + F.coalesce(shift, F.lit(0.0))), f"{side}_index")
        out = out.withColumnRenamed("prediction_state", f"{side}_state").drop("rul_point", "rul_lower", "rul_upper")
    state, aspect, slope, sensitive, peak = (F.col(c) for c in ("base_state", "aspect", "load_sensitivity", "load_sensitive", "peak_state"))
    reason = (
        F.when(~F.coalesce(state.isin("valid", "threshold_exceeded", "no_worsening_trend"), F.lit(False)), "no_base_estimate")
        .when(state == "threshold_exceeded", "beyond_failure_level")
        .when(aspect == -1, "no_base_estimate")
        .when(slope.isNull(), "too_little_load_contrast")
        .when(~sensitive, "not_load_sensitive")
        .when(peak == "threshold_exceeded", "beyond_failure_level_at_peak")
        .otherwise("within_failure_level_at_peak")
    )
    return out.withColumn("duty", duty_label(state, aspect, slope, sensitive, peak)).withColumn("duty_reason", reason)


def duty_summary(assessed: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row: episodes whose asset showed load sensitivity, or was restricted, by the fault, with median leads; and how often healthy assets were.

    The interval is closed: a restriction on the fault's own instant counts.  Healthy assets have no episode.
    """
    e = episodes.select("episode_id", F.col("asset_id").alias("__a"), "onset_ts", "fault_ts")
    inside = (F.col("asset_id") == F.col("__a")) & (F.col("available_at") >= F.col("onset_ts")) & (F.col("available_at") <= F.col("fault_ts"))
    lead = F.timestamp_diff("MICROSECOND", F.col("available_at"), F.col("fault_ts")) / 86_400_000_000
    marks = {"sensitive": F.col("load_sensitive"), "restricted": F.col("duty") == "off_peak_only"}
    per = e.join(assessed, inside, "left").groupBy("episode_id").agg(*(F.max(F.when(m, lead)).alias(n) for n, m in marks.items()))
    found = per.agg(
        F.count("*").alias("episodes"),
        F.count("sensitive").alias("episodes_sensitive"),
        F.percentile("sensitive", F.lit(0.5)).alias("median_sensitivity_lead_days"),
        F.count("restricted").alias("episodes_restricted"),
        F.percentile("restricted", F.lit(0.5)).alias("median_restriction_lead_days"),
    )
    healthy = assessed.where(F.col("duty") != "not_assessed").join(episodes.select("asset_id").distinct(), "asset_id", "left_anti")
    calm = healthy.agg(F.count("*").alias("healthy_days"), F.count_if(marks["sensitive"]).alias("healthy_days_sensitive"), F.count_if(marks["restricted"]).alias("healthy_days_restricted"))
    return found.crossJoin(F.broadcast(calm))  # one row each
