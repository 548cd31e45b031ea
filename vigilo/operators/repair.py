"""Reviewed healthy references of maintenance jobs, and what the days after a job say against them.

A job's reference is the latest run of consecutive usable days before its work began, cut to the last of them; it is
frozen, so days after the work never reach it.  Runs are found once for each asset, and jobs meet runs, not days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.operators.decisions import islands
from vigilo.operators.normalise import MAD_TO_SIGMA


@dataclass(frozen=True)
class RepairPolicy:
    reference_days: int = 14
    post_days: int = 3
    settling_days: int = 1
    deviation_limit: float = 3.0
    persistent_days: int = 2

    def __post_init__(self):
        if min(self.reference_days, self.post_days, self.persistent_days) < 1 or self.settling_days < 0 or not self.deviation_limit > 0:
            raise ValueError("invalid repair policy")


def usable(columns: list[str]) -> Column:
    """Quality and context hold, and every column has a value; an unknown flag does not hold."""
    ok = F.coalesce("data_quality_ok", F.lit(False)) & F.coalesce("context_supported", F.lit(False))
    for c in columns:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0)))
    return ok


def _long(df: DataFrame, keys: list[str], columns: list[str], name: str = "channel") -> DataFrame:
    return df.select(*keys, F.stack(F.lit(len(columns)), *(x for c in columns for x in (F.lit(c), F.col(c).cast("double")))).alias(name, "v"))


def reference_windows(jobs: DataFrame, daily: DataFrame, columns: list[str], days: int) -> DataFrame:
    """(job_id, asset_id, first, last): the last ``days`` of the latest run of at least so many consecutive usable days before the job's day.

    ``jobs`` has job_id, asset_id and started_at.  A job without such a run gives no row.
    """
    runs = islands(daily, usable(columns)).select("asset_id", "start", "end")
    before = F.date_sub(F.col("started_at").cast("date"), 1)
    met = jobs.select("job_id", "asset_id", "started_at").join(runs, "asset_id").where(F.col("start") <= before)
    last = F.least("end", before)
    return (
        met.where(F.datediff(last, F.col("start")) + 1 >= days)
        .groupBy("job_id", "asset_id")
        .agg(F.max(last).alias("last"))
        .select("job_id", "asset_id", F.date_sub("last", days - 1).alias("first"), "last")
    )


def _of_window(daily: DataFrame, windows: DataFrame) -> DataFrame:
    return daily.join(windows, "asset_id").where((F.col("day") >= F.col("first")) & (F.col("day") <= F.col("last")))


def references(jobs: DataFrame, daily: DataFrame, channels: list[str], contexts: list[str], days: int) -> DataFrame:
    """(job_id, asset_id, first, last, ended_at, channels, contexts) of each job's window.

    ``channels`` maps a channel to (loc, scale), its median and scaled absolute deviation, ``contexts`` a context to its
    range (lo, hi).  ``ended_at`` is when the last of the days was available.
    """
    if not channels or set(channels) & set(contexts):
        raise ValueError("name distinct channels and contexts")
    held = _of_window(daily, reference_windows(jobs, daily, [*channels, *contexts], days))
    key = ["job_id", "asset_id", "first", "last"]
    values = _long(held, key, channels)
    middle = values.groupBy(*key, "channel").agg(F.percentile("v", F.lit(0.5)).alias("loc"))
    off = values.join(middle, [*key, "channel"]).groupBy(*key, "channel", "loc").agg((F.percentile(F.abs(F.col("v") - F.col("loc")), F.lit(0.5)) * MAD_TO_SIGMA).alias("scale"))
    by_channel = off.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("channel", F.struct("loc", "scale")))).alias("channels"))
    ranges = F.create_map(*(x for c in contexts for x in (F.lit(c), F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"))))) if contexts else F.lit(None)
    by_context = held.groupBy(*key).agg(F.max("available_at").alias("ended_at"), ranges.alias("contexts"))
    return by_channel.join(by_context, key)


def later_work(jobs: DataFrame) -> DataFrame:
    """``jobs`` with later_at: when other work on the asset, recorded by the job's as_of, began at or after the job did.

    Jobs of an asset meet by a range join on their starts, cut at as_of: work that began later cannot be recorded by then.
    """
    other = jobs.select("asset_id", F.col("job_id").alias("__job"), F.col("started_at").alias("__at"), F.col("recorded_at").alias("__rec"))
    met = jobs.select("job_id", "asset_id", "started_at", "as_of").join(other, "asset_id")
    met = met.where((F.col("__job") != F.col("job_id")) & (F.col("__at") >= F.col("started_at")) & (F.col("__at") <= F.col("as_of")) & (F.col("__rec") <= F.col("as_of")))
    return jobs.join(met.groupBy("job_id").agg(F.min("__at").alias("later_at")), "job_id", "left")


def assess_repairs(jobs: DataFrame, daily: DataFrame, channels: list[str], contexts: list[str], policy: RepairPolicy = RepairPolicy()) -> DataFrame:
    """(job_id, asset_id, reference_first, reference_last, observed_days, abnormal_days, status, reason), one row a job.

    ``jobs`` has job_id, asset_id, started_at, completed_at, recorded_at, as_of and reviewed_at, all times.  The last
    ``post_days`` full days before as_of are held against the reference: repeated departures of one channel mean that
    the abnormality persists, none that the signal recovered; all else is insufficient evidence, and ``reason`` says
    which test failed first.
    """
    p = policy
    ref = references(jobs, daily, channels, contexts, p.reference_days)
    rows = later_work(jobs).join(ref, ["job_id", "asset_id"], "left")
    end = F.col("as_of").cast("date")
    done = F.col("completed_at")
    settled = F.date_add(F.when(done == F.date_trunc("DAY", done), done.cast("date")).otherwise(F.date_add(done.cast("date"), 1)), p.settling_days)
    window = rows.select("job_id", "asset_id", "as_of", "channels", "contexts", F.date_sub(end, p.post_days).alias("first"), F.date_sub(end, 1).alias("last"))
    post = _of_window(daily, window).where(F.col("available_at") <= F.col("as_of"))
    within = F.lit(True)
    for c in contexts:
        within = within & (F.col(c) >= F.col("contexts")[c]["lo"]) & (F.col(c) <= F.col("contexts")[c]["hi"])
    far = lambda c: F.try_divide(F.abs(F.col(c) - F.col("channels")[c]["loc"]), F.col("channels")[c]["scale"]) > p.deviation_limit
    seen = post.groupBy("job_id").agg(
        F.count("*").alias("observed_days"), F.bool_and(usable([*channels, *contexts])).alias("ok"), F.bool_and(F.coalesce(within, F.lit(False))).alias("within"), F.greatest(*(F.count_if(far(c)) for c in channels), F.lit(0)).alias("k")
    )
    out = rows.join(seen, "job_id", "left")
    n = F.coalesce("observed_days", F.lit(0).cast("long"))
    flat = F.exists(F.map_values("channels"), lambda x: F.coalesce(x["scale"] <= 1e-9, F.lit(True)))
    tests = [
        (F.col("recorded_at") > F.col("as_of"), "not_recorded"),
        (F.col("first").isNull(), "no_reference"),
        (flat, "flat_reference"),
        (F.greatest("ended_at", "reviewed_at") > F.col("started_at"), "reviewed_too_late"),
        (F.coalesce(F.col("later_at") <= F.col("as_of"), F.lit(False)), "later_work"),
        (F.date_sub(end, p.post_days) < settled, "waiting"),
        ((n != p.post_days) | ~F.coalesce("ok", F.lit(False)), "incomplete_window"),
        (~F.coalesce("within", F.lit(False)), "outside_context"),
        (F.col("k") >= p.persistent_days, "repeated_departures"),
        (F.col("k") == 0, "within_limits"),
    ]
    reason = F.lit("mixed_readings")
    for test, name in reversed(tests):
        reason = F.when(test, name).otherwise(reason)
    judged = F.col("reason").isin("repeated_departures", "within_limits", "mixed_readings")
    status = F.when(F.col("reason") == "repeated_departures", "abnormality_persists").when(F.col("reason") == "within_limits", "signal_recovered").otherwise("insufficient_evidence")
    named = out.withColumn("reason", reason)
    return named.select("job_id", "asset_id", F.col("first").alias("reference_first"), F.col("last").alias("reference_last"), n.alias("observed_days"), F.when(judged, F.col("k")).alias("abnormal_days"), status.alias("status"), "reason")
