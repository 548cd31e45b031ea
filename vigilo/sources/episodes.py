"""Fault episodes: scan, checks, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.functions import text

SCHEMA = "asset_id string, train_id string, fault_mode string, onset_ts timestamp_ntz, fault_ts timestamp_ntz, warning_days_available double, detectable_days double, wear_shape double"


def read_episodes(spark: SparkSession, path: str, assets: DataFrame, end: Column | None = None, fmt: str | None = None, source_zone: str | None = None) -> tuple[DataFrame, list[str]]:
    """(episodes, problems): rows of the file by its header, and what makes them unusable as labels.

    Times are read by the rules of ingestion: those with an offset are converted, those without are local, or of
    ``source_zone``; a mix of both without a declared zone is a problem, as are repeated episodes.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in ("asset_id", "train_id", "onset_ts", "fault_ts") if c not in raw.columns]
    if missing:
        return raw, [f"missing column {c}" for c in missing]
    times = {c: text.parse_time(F.col(c), fmt, source_zone=source_zone) for c in ("onset_ts", "fault_ts")}
    mixed = [c for c in times if source_zone is None and text.mixed_times(raw, c)]
    rows = raw.withColumns(times)
    tests = {
        "unreadable times": F.col("onset_ts").isNull() | F.col("fault_ts").isNull(),
        "onset not before fault": F.col("onset_ts") >= F.col("fault_ts"),
    }
    if end is not None:
        tests["fault after the period"] = F.col("fault_ts") > end
    got = rows.agg(*(F.count_if(t).alias(k) for k, t in tests.items())).first().asDict()
    problems = [f"{n} episodes: {k}" for k, n in got.items() if n] + [f"{c} mixes times with and without an offset" for c in mixed]
    twice = rows.groupBy("asset_id", "onset_ts", "fault_ts").count().where("count > 1").count()
    if twice:
        problems.append(f"{twice} episodes: repeated")
    strangers = rows.join(assets.select("asset_id").distinct(), "asset_id", "left_anti").count()
    if strangers:
        problems.append(f"{strangers} episodes: asset not in telemetry")
    return rows, problems


def split(episodes: DataFrame, boundary: Column) -> tuple[DataFrame, DataFrame]:
    """(development, test): faults by the boundary, and later ones."""
    return episodes.where(F.col("fault_ts") <= boundary), episodes.where(F.col("fault_ts") > boundary)


def crossing(episodes: DataFrame, boundary: Column) -> DataFrame:
    """Assets whose episode straddles the boundary."""
    return episodes.where((F.col("onset_ts") <= boundary) & (F.col("fault_ts") > boundary)).select("asset_id").distinct()
