"""Expected grids, availability, outages, stress tests, peers, repairs, planner jobs and onboarding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.operators.features import day_index
from vigilo.operators.normalise import MAD_TO_SIGMA


def expected_grid(assets: DataFrame, first: str, last: str) -> DataFrame:
    """(asset_id, day, available_at): every asset on every day; the denominator that outages cannot shrink."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 DAY")))
    return assets.select("asset_id").distinct().select("asset_id", days.alias("day")).withColumn("available_at", F.date_add("day", 1).cast("timestamp_ntz"))


def align(scores: DataFrame, grid: DataFrame, names: list[str]) -> DataFrame:
    return grid.join(scores.select("asset_id", "day", *names), ["asset_id", "day"], "left")


def availability(aligned: DataFrame, name: str, by: list[str] = ()) -> DataFrame:
    return aligned.groupBy(*by).agg(F.count("*").alias("expected_rows"), F.count(name).alias("scored_rows"), (F.count(name) / F.count("*")).alias("availability"))


@dataclass(frozen=True)
class OutagePolicy:
    min_observations: int = 3
    max_age_days: int = 5
    max_gap_days: int = 3


def outage_window(daily: DataFrame, raw: str, policy: OutagePolicy = OutagePolicy()) -> DataFrame:
    """(asset_id, day, score, status, observations, span_days, max_gap_days) over irregular valid days.

    Each supported day takes the newest run of valid days without a hole beyond ``max_gap_days``, back to
    ``max_age_days``; the score is the run's median if it is long enough, else the status says why not.
    """
    ok = F.coalesce("data_quality_ok", F.lit(False)) & F.coalesce("context_supported", F.lit(False))
    idx = day_index(F.col("day"))
    all_days = daily.select("asset_id", "day", ok.alias("ok"), F.col(raw).alias("v"))
    w = Window.partitionBy("asset_id").orderBy("day")
    valid = all_days.where("ok and v is not null").withColumn("i", idx).withColumn("prev", F.lag("i").over(w)).withColumn("step", F.col("i") - F.col("prev"))
    runs = valid.withColumn("g", F.sum(F.coalesce((F.col("step") > policy.max_gap_days).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy("asset_id", "g").orderBy("i").rangeBetween(-policy.max_age_days, 0)
    run = Window.partitionBy("asset_id", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # Steps inside the window: the first row's step leads out of it, so it is measured against the window's start.
    seen = runs.select(
        "asset_id",
        "day",
        F.count("*").over(back).alias("n"),
        F.percentile("v", F.lit(0.5)).over(back).alias("m"),
        (F.col("i") - F.min("i").over(back)).alias("span"),
        F.collect_list("i").over(back).alias("is"),
        F.first("prev").over(run).alias("before"),
        F.first("i").over(run).alias("first"),
        F.col("i"),
    ).withColumn("hole", F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.size("is") - 1, F.lit(1))), lambda k: F.coalesce(F.get("is", k) - F.get("is", k - 1), F.lit(0))), F.lit(0), lambda a, b: F.greatest(a, b)))
    cut = (F.col("span") == F.col("i") - F.col("first")) & F.coalesce(F.col("i") - F.col("before") <= policy.max_age_days, F.lit(False))
    why = F.when(F.col("n") >= policy.min_observations, "supported").when(cut, "gap_too_large").otherwise("too_few_observations")
    status = F.when(~F.col("ok"), "unsupported").when(F.col("v").isNull(), "incomplete").otherwise(why)
    return all_days.join(seen, ["asset_id", "day"], "left").select(
        "asset_id",
        "day",
        F.when(F.col("n") >= policy.min_observations, F.col("m")).alias("score"),
        status.alias("status"),
        F.coalesce("n", F.lit(0)).alias("observations"),
        F.col("span").alias("span_days"),
        F.when(F.col("n").isNotNull(), F.col("hole")).alias("max_gap_days"),
    )


def recovery_days(scored: DataFrame, score: str, assets: DataFrame, resumed_at: Column) -> DataFrame:
    """(asset_id, recovery_days): from telemetry resuming to the first score received; null if none came."""
    after = scored.where(F.col(score).isNotNull() & (F.col("available_at") >= resumed_at)).groupBy("asset_id").agg(F.min("available_at").alias("at"))
    return assets.select("asset_id").distinct().join(after, "asset_id", "left").select("asset_id", (F.timestamp_diff("SECOND", resumed_at, F.col("at")) / 86400.0).alias("recovery_days"))


def recovery_summary(recovered: DataFrame, days: str = "recovery_days") -> DataFrame:
    """(assets, recovered, median_days): the median over all assets, those that never recovered counted as longest.

    Null where the middle falls among them, so that a few quick recoveries do not stand for a fleet that stays dark.
    """
    x = F.coalesce(F.col(days), F.lit(float("inf")))
    got = recovered.agg(F.count("*").alias("assets"), F.count(days).alias("recovered"), F.percentile(x, F.lit(0.5)).alias("m"))
    return got.select("assets", "recovered", F.when(F.col("m") < float("inf"), F.col("m")).alias("median_days"))


def perturb(cycles: DataFrame, scenario: str, after: str, assets: list[str], column: str, context: str, seed: int = 0, key: tuple[str, ...] = ("asset_id", "ts")) -> DataFrame:
    """Label-free stress on some assets from a time on; random losses depend on the row's key alone, so they repeat."""
    t = F.lit(after).cast("timestamp_ntz")
    hit = F.col("asset_id").isin(assets) & (F.col("ts") >= t)
    if scenario == "clean":
        return cycles
    if scenario == "missing_channel":
        lost = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1000)) < 300
        return cycles.withColumn(column, F.when(hit & lost, None).otherwise(F.col(column)))
    if scenario == "sensor_offset":
        return cycles.withColumn(column, F.when(hit, F.col(column) + 0.6).otherwise(F.col(column)))
    if scenario == "unsupported_context":
        return cycles.withColumn(context, F.when(hit, F.col(context) + 20.0).otherwise(F.col(context)))
    if scenario == "missing_days":
        return cycles.where(~(hit & (F.pmod(F.datediff(F.col("ts").cast("date"), t.cast("date")), F.lit(3)) == 0)))
    raise ValueError(f"unknown scenario {scenario!r}")


def blackout(cycles: DataFrame, after: str, assets: list[str], offset_days: int, length_days: int) -> DataFrame:
    """Removes [after + offset, after + offset + length) of some assets."""
    start = F.lit(after).cast("timestamp_ntz") + F.expr(f"INTERVAL {offset_days} DAY")
    end = F.lit(after).cast("timestamp_ntz") + F.expr(f"INTERVAL {offset_days + length_days} DAY")
    return cycles.where(~(F.col("asset_id").isin(assets) & (F.col("ts") >= start) & (F.col("ts") < end)))


def robust_change(daily: DataFrame, channels: list[str], as_of: Column, recent_days: int = 5, reference_days: int = 21, least_recent: int = 3, least_reference: int = 10, shift: float = 3.0) -> DataFrame:
    """(asset_id, channel, change, z, direction): recent median against the reference before it, in reference deviations.

    Too few days or a degenerate scale leave the direction unknown.
    """
    lag = lambda d: as_of - F.expr(f"INTERVAL {d} DAY")
    at = F.col("available_at")
    part = F.when((at > lag(recent_days)) & (at <= as_of), "recent").when((at > lag(recent_days + reference_days)) & (at <= lag(recent_days)), "reference")
    ok = F.coalesce("data_quality_ok", F.lit(False)) & F.coalesce("context_supported", F.lit(False))
    long = daily.where(ok).select("asset_id", part.alias("part"), F.stack(F.lit(len(channels)), *(x for c in channels for x in (F.lit(c), F.col(c).cast("double")))).alias("channel", "v")).where("part is not null and v is not null")
    keys = ["asset_id", "channel"]
    ref, new = F.when(F.col("part") == "reference", F.col("v")), F.when(F.col("part") == "recent", F.col("v"))
    mid = long.groupBy(*keys).agg(F.percentile(ref, F.lit(0.5)).alias("loc"), F.percentile(new, F.lit(0.5)).alias("now"), F.count(ref).alias("n_ref"), F.count(new).alias("n_recent"))
    off = long.where("part = 'reference'").join(mid.select(*keys, "loc"), keys).groupBy(*keys).agg((F.percentile(F.abs(F.col("v") - F.col("loc")), F.lit(0.5)) * MAD_TO_SIGMA).alias("scale"))
    full = mid.join(off, keys, "left")
    good = (F.col("n_recent") >= least_recent) & (F.col("n_ref") >= least_reference) & F.coalesce(F.col("scale") > 1e-9, F.lit(False))
    z = F.when(good, F.try_divide(F.col("now") - F.col("loc"), F.col("scale")))
    return full.select(*keys, F.when(good, F.col("now") - F.col("loc")).alias("change"), z.alias("z"), F.when(~good, "unknown").when(z >= shift, "increase").when(z <= -shift, "decrease").otherwise("no_detected_change").alias("direction"))


def peer_comparison(changes: DataFrame, min_peers: int = 3, share: float = 2.0) -> DataFrame:
    """(asset_id, channel, peers, peer_median_z, shared): does the median of all other assets move the same way?

    The target is never its own peer; with too few peers or an unknown own change the answer is null.  No asset meets
    the others: leaving one value out of n moves the median by one place at most, so four middle values of a channel
    and the side on which one's own lies give everyone's answer.  They come from one aggregation for each channel.
    """
    known = changes.where("z is not null")
    n, z = F.col("n"), F.col("z")
    sizes = known.groupBy("channel").agg(F.count("*").alias("n"))
    # Values at ranks h - 1 to h + 2 of n, h the lower middle; outside the range they are never asked for.
    h = F.floor((n + 1) / 2)
    counted = known.groupBy("channel", "z").agg(F.count("*").alias("c"))
    upto = counted.withColumn("r", F.sum("c").over(Window.partitionBy("channel").orderBy("z").rowsBetween(Window.unboundedPreceding, 0))).join(sizes, "channel")
    at = lambda k: F.min(F.when(F.col("r") >= h + k, z)).alias(f"v{k + 1}")
    middle = upto.groupBy("channel", "n").agg(*(at(k) for k in (-1, 0, 1, 2)))
    met = changes.select("asset_id", "channel", "z").join(middle, "channel", "left")
    own = z.isNotNull()
    low, mid, high = F.col("v0"), F.col("v1"), F.col("v2")
    odd = n % 2 == 1
    # All n; n odd without one: an even number of others, n even: an odd number.
    of_all = F.when(odd, mid).otherwise((mid + high) / 2)
    of_others = F.when(odd, F.when(z < mid, (mid + high) / 2).when(z > mid, (low + mid) / 2).otherwise((low + high) / 2)).otherwise(F.when(z <= mid, high).otherwise(mid))
    peers = F.coalesce(n, F.lit(0)) - F.when(own, 1).otherwise(0)
    agg = met.select("asset_id", "channel", "z", peers.cast("long").alias("peers"), F.when(own, of_others).otherwise(of_all).alias("m"))
    enough = (F.col("peers") >= min_peers) & F.col("z").isNotNull()
    same = (F.abs(F.col("m")) >= share) & (F.signum("m") == F.signum("z"))
    return agg.select("asset_id", "channel", "peers", F.when(F.col("peers") >= min_peers, F.col("m")).alias("peer_median_z"), F.when(enough, same).alias("shared"))


def affine_baseline(view: DataFrame, residual: str, index: str, by: list[str] = ("asset_id",), least: int = 5) -> DataFrame:
    """(by, location, scale, worst): residual = location + scale * index recovered by regression, and its largest miss."""
    rows = view.where(F.col(residual).isNotNull() & F.col(index).isNotNull())
    fit = rows.groupBy(*by).agg(F.regr_intercept(residual, index).alias("location"), F.regr_slope(residual, index).alias("scale"), F.count("*").alias("n")).where(F.col("n") >= least)
    off = rows.join(fit, list(by)).groupBy(*by).agg(F.max(F.abs(F.col(residual) - F.col("location") - F.col("scale") * F.col(index))).alias("worst"))
    return fit.join(off, list(by)).select(*by, "location", "scale", "n", "worst")


def verify_repairs(repairs: DataFrame, reference: DataFrame, daily: DataFrame, channels: list[str], as_of: Column, post_days: int = 3, settling_days: int = 1, limit: float = 3.0, persistent: int = 2) -> DataFrame:
    """(job_id, asset_id, observed_days, abnormal_days, status): do the last full days look like the reviewed reference?

    ``reference`` has (asset_id, channel, loc, scale).  Waiting, missing or unsupported days give insufficient
    evidence; an isolated departure does too, a repeated one means the abnormality persists.
    """
    end = F.date_trunc("DAY", as_of).cast("date")
    first = F.date_sub(end, post_days)
    begin = F.date_add(F.when(F.date_trunc("DAY", F.col("completed_at")) == F.col("completed_at"), F.col("completed_at").cast("date")).otherwise(F.date_add(F.col("completed_at").cast("date"), 1)), settling_days)
    jobs = repairs.withColumn("waiting", first < begin)
    ok = F.coalesce("data_quality_ok", F.lit(False)) & F.coalesce("context_supported", F.lit(False))
    days = daily.where((F.col("day") >= first) & (F.col("day") < end) & (F.col("available_at") <= as_of))
    for c in channels:
        ok = ok & F.col(c).isNotNull()
    state = days.groupBy("asset_id").agg(F.count("*").alias("observed_days"), F.bool_and(ok).alias("ok"))
    long = days.select("asset_id", F.stack(F.lit(len(channels)), *(x for c in channels for x in (F.lit(c), F.col(c).cast("double")))).alias("channel", "v"))
    far = long.join(reference, ["asset_id", "channel"]).withColumn("far", (F.abs(F.col("v") - F.col("loc")) / F.col("scale") > limit).cast("int"))
    per = far.groupBy("asset_id", "channel").agg(F.sum("far").alias("k")).groupBy("asset_id").agg(F.max("k").alias("abnormal_days"), F.count("*").alias("checked"))
    out = jobs.join(state, "asset_id", "left").join(per, "asset_id", "left")
    complete = ~F.col("waiting") & (F.coalesce("observed_days", F.lit(0)) == post_days) & F.coalesce("ok", F.lit(False)) & (F.coalesce("checked", F.lit(0)) == len(channels))
    status = F.when(~complete, "insufficient_evidence").when(F.col("abnormal_days") >= persistent, "abnormality_persists").when(F.col("abnormal_days") == 0, "signal_recovered").otherwise("insufficient_evidence")
    return out.select("job_id", "asset_id", F.coalesce("observed_days", F.lit(0)).alias("observed_days"), F.when(complete, F.col("abnormal_days")).alias("abnormal_days"), status.alias("status"))


def job_states(events: DataFrame, as_of: Column) -> DataFrame:
    """(job_id, asset_id, state, window, priority, minutes): each job's events up to a night, folded in order."""
    item = F.struct("night", "seq", "type", "window", "priority", "minutes")
    held = events.where(F.col("night") <= as_of).groupBy("job_id", "asset_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(None).cast("date").alias("window"), F.lit(None).cast("int").alias("priority"), F.lit(60).alias("minutes"))

    def step(a: Column, e: Column) -> Column:
        planned = e.type.isin("planned", "rescheduled")
        return F.struct(
            F.when(planned | (e.type == "reopened"), "planned").when(e.type == "work_done", "work_done").when(e.type == "verified", "done").when(e.type == "removed", "removed").otherwise(a.state).alias("state"),
            F.when(planned | (e.type == "reopened"), e.window).otherwise(a.window).alias("window"),
            F.when(planned | (e.type == "reordered"), F.coalesce(e.priority, a.priority)).otherwise(a.priority).alias("priority"),
            F.when(e.type == "duration", F.coalesce(e.minutes, a.minutes)).otherwise(a.minutes).alias("minutes"),
        )

    folded = held.select("job_id", "asset_id", F.aggregate("xs", start, step).alias("s"))
    return folded.select("job_id", "asset_id", "s.*").where("state is not null")


def capacity(jobs: DataFrame, cap_minutes: int) -> DataFrame:
    """Adds used_minutes so far in the window, by priority, and whether the job rolls over."""
    w = Window.partitionBy("window").orderBy("priority", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    return jobs.withColumn("used_minutes", F.sum("minutes").over(w)).withColumn("rolls_over", F.col("used_minutes") > cap_minutes)


def onboarding(daily: DataFrame, value: str, as_of: Column, reference_days: int = 21) -> DataFrame:
    """(asset_id, ready_at, loc, scale, status): a new asset's own reference, or why it is refused."""
    first = daily.groupBy("asset_id").agg(F.min("day").alias("first"))
    part = daily.join(first, "asset_id").where((F.col("day") < F.date_add("first", reference_days)) & (F.col("available_at") <= as_of))
    ok = F.coalesce("data_quality_ok", F.lit(False)) & F.coalesce("context_supported", F.lit(False)) & F.col(value).isNotNull()
    stats = part.groupBy("asset_id", "first").agg(F.count_distinct("day").alias("days"), F.bool_and(ok).alias("ok"), F.percentile(value, F.lit(0.5)).alias("loc"))
    off = part.join(stats.select("asset_id", "loc"), "asset_id").groupBy("asset_id").agg((F.percentile(F.abs(F.col(value) - F.col("loc")), F.lit(0.5)) * MAD_TO_SIGMA).alias("scale"))
    ready = F.date_add("first", reference_days)
    complete = (ready.cast("timestamp_ntz") <= as_of) & (F.col("days") == reference_days) & F.col("ok")
    status = F.when(~complete, "reference_incomplete").when(F.coalesce(F.col("scale") <= 1e-9, F.lit(True)), "reference_flat").otherwise("accepted")
    return stats.join(off, "asset_id").select("asset_id", ready.alias("ready_on"), "days", "loc", "scale", status.alias("status"))
