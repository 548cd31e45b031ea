import datetime as dt

from pyspark.sql import functions as F

from vigilo.operators import inspection, monitoring
from vigilo.plans.experiments import matched_error, stress
from vigilo.sources.episodes import crossing, read_episodes
from vigilo.sources.readiness import assess

CHANGES = "asset_id string, channel string, change double, z double, direction string"


def test_cross_channel_and_explanations(spark):
    rows = [
        ("a", "peak", 1.0, 4.0, "increase"),
        ("a", "time", 1.0, 5.0, "increase"),
        ("b", "peak", 1.0, 4.0, "increase"),
        ("b", "time", 0.0, 0.1, "no_detected_change"),
        ("c", "peak", 1.0, -4.0, "decrease"),
        ("c", "time", None, None, "unknown"),
    ]
    changes = spark.createDataFrame(rows, CHANGES)
    cross = inspection.cross_channel(changes, {"peak": "current", "time": "motion"}, {"peak": 1, "time": 1})
    got = {r.asset_id: r for r in cross.collect()}
    assert got["a"].families == ["current", "motion"] and got["a"].wear_consistent and not got["a"].isolated
    assert got["b"].isolated and got["b"].one_family
    assert not got["c"].isolated and not got["c"].wear_consistent
    peers = monitoring.peer_comparison(changes, min_peers=1)
    said = {(r.asset_id, r["rank"]): r.stance for r in inspection.explanations(cross, peers).collect()}
    assert said["a", 0] == "supported" and said["b", 1] == "supported" and said["c", 0] == "unresolved"
    assert inspection.evidence_records(changes, cross, peers, F.lit("now")).count() == 3


def test_display_rows_carry_elevated_aspects(spark):
    d = lambda k: dt.date(2024, 1, k)
    grid = spark.createDataFrame([("a", d(k)) for k in range(1, 6)], "asset_id string, day date")
    rows = spark.createDataFrame([("a", d(1), 0, 9.0, "full_service"), ("a", d(3), 2, 1.0, "full_service")], "asset_id string, day date, aspect int, rul_lower double, duty string")
    shown = inspection.display_rows(grid, rows)
    assert [r.shown_aspect for r in shown.orderBy("day").collect()] == [0, -1, 2, 2, 2]
    assert [tuple(r) for r in inspection.surfaced(shown).collect()] == [("a", "status")]
    assert inspection.dashboard_payload(shown).count() == 1


def test_episode_scan_names_problems(spark, tmp_path):
    (tmp_path / "e.csv").write_text("asset_id,train_id,onset_ts,fault_ts\nA1,T1,2024-01-05 00:00:00,2024-01-02 00:00:00\nA9,T1,2024-01-01 00:00:00,2024-01-09 00:00:00\n")
    assets = spark.createDataFrame([("A1",)], "asset_id string")
    eps, problems = read_episodes(spark, str(tmp_path / "e.csv"), assets, F.lit("2024-01-08").cast("timestamp_ntz"))
    assert eps.count() == 2 and len(problems) == 3
    assert [r.asset_id for r in crossing(eps, F.lit("2024-01-05").cast("timestamp_ntz")).collect()] == ["A9"]


def test_readiness_blockers(spark):
    t = dt.datetime(2024, 1, 1)
    cycles = spark.createDataFrame([("a", "T1", t, 1.0, True), ("a", "T2", t, None, False)], "asset_id string, train_id string, ts timestamp_ntz, x double, context_supported boolean")
    got = assess(cycles, "x")
    assert not got["ready"] and len(got["blockers"]) == 4


def test_stress_keeps_the_denominator(spark):
    t = lambda k: dt.datetime(2024, 1, k, 6)
    cycles = spark.createDataFrame([("a", t(k), 1.0, 20.0) for k in range(1, 11)], "asset_id string, ts timestamp_ntz, x double, temp double")
    grid = monitoring.expected_grid(cycles, "2024-01-01", "2024-01-10")
    scores = lambda c: c.groupBy("asset_id", F.col("ts").cast("date").alias("day")).agg(F.avg("x").alias("s"))
    got = {r.scenario: r.scored_rows for r in stress(cycles, ["clean", "missing_days"], "2024-01-01 00:00:00", ["a"], "x", "temp", scores, grid, "s").collect()}
    assert got == {"clean": 10, "missing_days": 6}
    pred = spark.createDataFrame([("a", dt.date(2024, 1, 1), t(2), 3.0)], "asset_id string, day date, available_at timestamp_ntz, rul_lower double")
    assert matched_error(pred, pred.withColumn("rul_lower", F.col("rul_lower") + 1)).first().mean_shift == 1.0
