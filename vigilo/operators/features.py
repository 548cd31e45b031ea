"""Asset-day features and gap-aware trailing trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MIN_CYCLES = 5
MIN_COMPLETENESS = 0.9
EPOCH = "2000-01-01"


def day_index(day: Column) -> Column:
    """Whole days since a fixed date: RANGE frames over it follow elapsed calendar time."""
    return F.datediff(day, F.lit(EPOCH).cast("date"))


def to_daily(cycles: DataFrame, levels: list[str], rates: list[str] = (), contexts: list[str] = (), min_cycles: int = MIN_CYCLES) -> DataFrame:
    """One row per asset and day, in a single aggregation.

    Medians, interquartile ranges and completeness of levels, means of rates and contexts.  A day's row is usable from
    the next midnight.  Quality holds if there are enough cycles and every level is complete enough.
    """
    aggs = [
        F.count("*").alias("n_cycles"),
        F.max("ts").alias("last_observed_at"),
        F.bool_and(F.coalesce("context_supported", F.lit(False))).alias("context_supported"),
        F.first("train_id", ignorenulls=True).alias("train_id"),
    ]
    for c in levels:
        aggs += [F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__q_{c}"), (F.count(c) / F.count("*")).alias(f"{c}_completeness")]
    aggs += [F.avg(c).alias(f"{c}_rate") for c in rates] + [F.avg(c).alias(f"{c}_mean") for c in contexts]
    daily = cycles.withColumn("day", F.col("ts").cast("date")).groupBy("asset_id", "day").agg(*aggs)
    for c in levels:
        q = F.col(f"__q_{c}")
        daily = daily.withColumn(c, q[1]).withColumn(f"{c}_iqr", q[2] - q[0]).drop(f"__q_{c}")
    least = F.least(*(F.col(f"{c}_completeness") for c in levels)) if len(levels) > 1 else F.col(f"{levels[0]}_completeness")
    return (
        daily.withColumn("available_at", F.date_add("day", 1).cast("timestamp_ntz"))
        .withColumn("quality_ready", F.col("n_cycles") >= min_cycles)
        .withColumn("data_quality_ok", F.col("quality_ready") & (least >= MIN_COMPLETENESS))
    )


def trailing(days: int, by: str = "asset_id", day: str = "day") -> WindowSpec:
    """The last ``days`` calendar days, this one included."""
    return Window.partitionBy(by).orderBy(day_index(F.col(day))).rangeBetween(-(days - 1), 0)


def smooth(value: str, days: int, least: int, by: str = "asset_id") -> Column:
    """Trailing median where today has a value and enough days have."""
    w = trailing(days, by)
    return F.when(F.col(value).isNotNull() & (F.count(value).over(w) >= least), F.percentile(value, F.lit(0.5)).over(w))


def add_trend(daily: DataFrame, value: str, smooth_days: int = 3, slope_days: int = 14, by: str = "asset_id") -> DataFrame:
    """``{value}_smooth``, ``_slope`` and ``_vol``.

    The slope is the least-squares slope per elapsed day of the smoothed values, from five days and three values on;
    the volatility is the interquartile range of the raw values and is not masked where today has none.
    """
    if smooth_days < 1 or slope_days < 1:
        raise ValueError("a trend needs a day at least")
    w = trailing(slope_days, by)
    s, x = f"{value}_smooth", day_index(F.col("day"))
    out = daily.withColumn(s, smooth(value, smooth_days, smooth_days, by))
    finite = F.count(s).over(w)
    at = F.when(F.col(s).isNotNull(), x)
    slope = F.regr_slope(F.col(s), x.cast("double")).over(w)
    out = out.withColumn(f"{value}_slope", F.when(F.col(s).isNotNull() & (finite >= 5) & (F.max(at).over(w) > F.min(at).over(w)), slope))
    spread = F.percentile(value, F.lit(0.75)).over(w) - F.percentile(value, F.lit(0.25)).over(w)
    return out.withColumn(f"{value}_vol", F.when(F.count(value).over(w) >= 5, spread))
