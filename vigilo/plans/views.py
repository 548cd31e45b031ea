"""The driver's event table seen as telemetry, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.operators.features import to_daily

LEVELS = ["peak", "charge"]
RATES = ["retry_count"]
CONTEXTS = ["ambient", "load_proxy"]
#: Faults of the demonstration: id, asset, train, onset, fault.
EPISODES = [
    (1, "A01", "T1", "2024-01-08 00:00:00", "2024-01-16 12:00:00"),
    (2, "A04", "T4", "2024-01-10 06:00:00", "2024-01-20 18:00:00"),
    (3, "A07", "T2", "2024-01-12 00:00:00", "2024-01-22 00:00:00"),
    (4, "A10", "T0", "2024-01-15 00:00:00", "2024-01-25 09:00:00"),
    (5, "A13", "T3", "2024-01-18 12:00:00", "2024-01-27 12:00:00"),
    (6, "A16", "T1", "2024-01-19 00:00:00", "2024-01-29 00:00:00"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty assets on five trains; a few readings lost and a few outside the trained conditions."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", k.alias("k"))
    return e.select(
        "event_id",
        "ts",
        F.concat(F.lit("A"), F.lpad((F.col("user_id") % 20).cast("string"), 2, "0")).alias("asset_id"),
        F.concat(F.lit("T"), (F.col("user_id") % 5).cast("string")).alias("train_id"),
        F.lit("door").alias("subsystem"),
        F.when(F.col("k") % 17 != 0, F.col("value")).alias("peak"),
        (F.col("value") * (0.5 + F.col("k") / 200.0)).alias("charge"),
        (F.col("k") % 3).cast("double").alias("retry_count"),
        (20 + (F.col("k") % 21) * 0.5).alias("ambient"),
        (F.col("k") / 100.0).alias("load_proxy"),
        (F.hour("ts") + F.minute("ts") / 60.0).alias("hour_of_day"),
        (F.col("k") < 97).alias("context_supported"),
        F.lit(False).alias("fault_confirmed"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_daily(cycles(spark, sf_dir), LEVELS, RATES, CONTEXTS)


def episodes(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame(EPISODES, "episode_id int, asset_id string, train_id string, onset string, fault string")
    return raw.select("episode_id", "asset_id", "train_id", F.col("onset").cast("timestamp_ntz").alias("onset_ts"), F.col("fault").cast("timestamp_ntz").alias("fault_ts"))


CYC = """cyc AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, 'A' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') AS asset_id,
 'T' || CAST(user_id % 5 AS VARCHAR) AS train_id, CASE WHEN k % 17 <> 0 THEN value END AS peak, value * (0.5 + k / 200.0::DOUBLE) AS charge,
 CAST(k % 3 AS DOUBLE) AS retry_count, 20 + (k % 21) * 0.5::DOUBLE AS ambient, k / 100.0::DOUBLE AS load_proxy,
 hour(ts) + minute(ts) / 60.0::DOUBLE AS hour_of_day, k < 97 AS context_supported
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
DAILY = (
    CYC
    + """, day0 AS (SELECT asset_id, CAST(ts AS DATE) AS day, count(*) AS n_cycles, max(ts) AS last_observed_at, bool_and(context_supported) AS context_supported,
 min(train_id) AS train_id, quantile_cont(peak, 0.5) AS peak, quantile_cont(peak, 0.75) - quantile_cont(peak, 0.25) AS peak_iqr,
 count(peak) / count(*)::DOUBLE AS peak_completeness, quantile_cont(charge, 0.5) AS charge, quantile_cont(charge, 0.75) - quantile_cont(charge, 0.25) AS charge_iqr,
 count(charge) / count(*)::DOUBLE AS charge_completeness, avg(retry_count) AS retry_count_rate, avg(ambient) AS ambient_mean, avg(load_proxy) AS load_proxy_mean
 FROM cyc GROUP BY 1, 2),
 daily AS (SELECT *, CAST(day + INTERVAL 1 DAY AS TIMESTAMP) AS available_at, n_cycles >= 5 AS quality_ready,
 n_cycles >= 5 AND least(peak_completeness, charge_completeness) >= 0.9 AS data_quality_ok, datediff('day', DATE '2000-01-01', day) AS i FROM day0)"""
)
EPS = "eps(episode_id, asset_id, train_id, onset_ts, fault_ts) AS (VALUES " + ", ".join(f"({i}, '{a}', '{t}', TIMESTAMP '{o}', TIMESTAMP '{f}')" for i, a, t, o, f in EPISODES) + ")"
