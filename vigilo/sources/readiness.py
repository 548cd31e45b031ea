"""Is a telemetry table fit for the pipeline?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_DAYS = 30


def measure(cycles: DataFrame, signal: str) -> DataFrame:
    """One row of counts: rows, assets, days, nulls, unsupported rows, repeated keys, assets on two trains."""
    whole = cycles.agg(
        F.count("*").alias("rows"),
        F.count_distinct("asset_id").alias("assets"),
        F.count_distinct(F.col("ts").cast("date")).alias("observed_days"),
        (F.count_if(F.col(signal).isNull()) / F.count("*")).alias(f"null_{signal}"),
        F.count_if(~F.coalesce("context_supported", F.lit(False))).alias("unsupported"),
    )
    twice = cycles.groupBy("asset_id", "ts").count().where("count > 1").agg(F.count("*").alias("duplicate_keys"))
    moved = cycles.groupBy("asset_id").agg(F.count_distinct("train_id").alias("t")).where("t > 1").agg(F.count("*").alias("assets_on_two_trains"))
    return whole.crossJoin(twice).crossJoin(moved)  # one-row tables


def assess(cycles: DataFrame, signal: str, episodes: DataFrame | None = None, minimum_fault_groups: int = 3) -> dict:
    """Blockers in words, none if ready."""
    got = measure(cycles, signal).first().asDict()
    blockers = []
    if not got["rows"]:
        blockers.append("no rows")
    if got["observed_days"] < MIN_DAYS:
        blockers.append(f"only {got['observed_days']} observed days; {MIN_DAYS} required")
    if got["duplicate_keys"]:
        blockers.append("repeated (asset_id, ts)")
    if got["assets_on_two_trains"]:
        blockers.append("assets on more than one train")
    if got["unsupported"]:
        blockers.append("rows without supported context")
    if episodes is not None:
        e = episodes.agg(F.count_if(F.col("onset_ts") >= F.col("fault_ts")).alias("bad"), F.count_distinct("train_id").alias("groups")).first()
        if e["bad"]:
            blockers.append("episodes whose onset is not before the fault")
        if e["groups"] < minimum_fault_groups:
            blockers.append("too few independent fault groups")
        if not episodes.join(cycles.select("asset_id").distinct(), "asset_id", "left_anti").isEmpty():
            blockers.append("episodes of assets without telemetry")
    return {**got, "blockers": blockers, "ready": not blockers}
