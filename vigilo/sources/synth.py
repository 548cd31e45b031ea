"""Synthetic door telemetry with episodes of wear, generated on the executors from hashed seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generate(spark: SparkSession, trains: int = 8, doors: int = 2, days: int = 90, per_day: int = 40, faults: int = 4, seed: int = 7, start: str = "2026-01-01") -> tuple[DataFrame, DataFrame]:
    """(cycles, episodes).  Every value depends on its row number and the seed alone, so any partitioning gives the same table.

    Faulty doors drift over the last weeks before their fault; currents follow load and temperature, and every door has
    its own offset.
    """
    n = trains * doors
    noise = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(2_000_001)) / 1_000_000.0 - 1.0)  # noqa: E731  in [-1, 1]
    own = lambda k: (F.pmod(F.xxhash64("door", F.lit(seed), F.lit(k)), F.lit(2001)) / 1000.0 - 1.0)
    base = spark.range(n * days * per_day).select("id", (F.col("id") % n).alias("door"), ((F.col("id") / n).cast("long") % per_day).alias("c"), (F.col("id") / (n * per_day)).cast("int").alias("d"))
    hour = F.lit(5.5) + (F.col("c") + 0.5) * 18.4 / per_day
    eps = [(k, k * (n // faults), days * (k + 2) // (faults + 2)) for k in range(faults)]
    wear = F.lit(0.0)
    for _, door, day in eps:
        wear = F.when((F.col("door") == door) & (F.col("d") <= day) & (F.col("d") > day - 21), (F.col("d") - (day - 21)) / 21.0).otherwise(wear)
    rows = base.withColumn("hour_of_day", hour).withColumn("wear", wear)
    rows = rows.withColumn("load_proxy", F.least(F.greatest(0.35 + 0.3 * F.exp(-F.pow((F.col("hour_of_day") - 8) / 1.5, 2)) + 0.3 * F.exp(-F.pow((F.col("hour_of_day") - 18) / 1.5, 2)) + 0.15 * noise(1), F.lit(0.0)), F.lit(1.0)))
    rows = rows.withColumn("ambient_temp_c", 28 + 3 * F.sin((F.col("hour_of_day") - 9) * 3.141592653589793 / 12) + noise(2))
    name = F.concat(F.lit("TRN"), F.lpad((F.floor(F.col("door") / doors) + 1).cast("string"), 3, "0"))
    ts = F.timestamp_add("SECOND", (F.col("hour_of_day") * 3600).cast("int"), F.date_add(F.lit(start).cast("date"), F.col("d")).cast("timestamp_ntz"))
    cycles = rows.select(
        ts.alias("ts"),
        F.concat(name, F.lit("-DOOR-"), (F.col("door") % doors + 1).cast("string")).alias("asset_id"),
        name.alias("train_id"),
        F.lit("door").alias("subsystem"),
        (3.0 + 0.2 * own(1) + 0.3 * F.col("load_proxy") + 0.5 * F.col("wear") + 0.1 * noise(3)).alias("cycle_duration_s"),
        (6.0 + 0.5 * own(2) + F.col("load_proxy") + 2.0 * F.col("wear") + 0.3 * noise(4)).alias("peak_current_a"),
        (2.5 + 0.2 * own(3) + 0.5 * F.col("load_proxy") + 0.8 * F.col("wear") + 0.1 * noise(5)).alias("mean_current_a"),
        (7.5 + 0.6 * own(4) + 2.0 * F.col("load_proxy") - 0.05 * (F.col("ambient_temp_c") - 28) + 4.0 * F.col("wear") + 0.4 * noise(6)).alias("current_integral_as"),
        (650.0 + 2 * own(5) - 6.0 * F.col("wear") + noise(7)).alias("travel_mm"),
        (noise(8) > 0.96 - 0.1 * F.col("wear")).cast("double").alias("obstruction_flag"),
        F.when(noise(9) > 0.9 - 0.2 * F.col("wear"), 1.0).otherwise(0.0).alias("retry_count"),
        "ambient_temp_c",
        "load_proxy",
        "hour_of_day",
        (F.col("d") * per_day + F.col("c")).cast("double").alias("cycles_since_service"),
        F.lit(False).alias("fault_confirmed"),
        F.lit(None).cast("string").alias("fault_mode"),
        F.lit(True).alias("context_supported"),
    )
    made = [(k, f"TRN{door // doors + 1:03d}-DOOR-{door % doors + 1}", f"TRN{door // doors + 1:03d}", day - 21, day) for k, door, day in eps]
    raw = spark.createDataFrame(made, "episode_id int, asset_id string, train_id string, a int, b int")
    at = lambda c: F.date_add(F.lit(start).cast("date"), F.col(c)).cast("timestamp_ntz")
    return cycles, raw.select("episode_id", "asset_id", "train_id", at("a").alias("onset_ts"), (at("b") + F.expr("INTERVAL 12 HOUR")).alias("fault_ts"))
