"""Streams of asset-days give the numbers of the batch forms: late, shuffled, with gaps, and over a restart."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vigilo.operators import duty, features, monitoring, replay
from vigilo.streaming import alerts, run, windows

D0 = dt.date(2024, 1, 1)
KIND = "asset_id string, day date, v double, data_quality_ok boolean, context_supported boolean, " + ", ".join(f"{c} double" for c in duty.STATS)


def made(seed, assets=5, days=45):
    rng = random.Random(seed)
    rows = []
    for a in range(assets):
        silent = range(20, 20 + 5 * a)  # up to twenty days without a report
        for d in range(days):
            if d in silent or rng.random() < 0.12:
                continue
            load = [(rng.random(), rng.random()) for _ in range(rng.choice([0, 8, 20]))]
            x, y = [p for p, _ in load], [3 * p + q for p, q in load]
            stats = [float(s) for s in (len(x), sum(x), sum(p * p for p in x), sum(y), sum(p * q for p, q in zip(x, y, strict=True)), sum(q * q for q in y))]
            rows.append((f"A{a}", D0 + dt.timedelta(days=d), None if rng.random() < 0.1 else round(rng.gauss(d / 10, 1), 3), rng.random() > 0.1, rng.random() > 0.05, *stats))
    return rows


def batch(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    ends = df.groupBy("asset_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = ends.select("asset_id", F.explode(F.sequence("a", "b")).alias("day"))
    full = grid.join(df.withColumn("reported", F.lit(True)), ["asset_id", "day"], "left")
    out = duty.load_sensitivity(features.add_trend(full, "v"))
    got = out.join(monitoring.outage_window(full, "v"), ["asset_id", "day"])
    return {(r.asset_id, r.day): r for r in got.collect()}


SAME = ["v_smooth", "v_slope", "v_vol", "load_sensitivity", "load_sensitivity_t", "window_mean_load", "score", "status", "observations", "span_days", "max_gap_days"]


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)


def agree(streamed, want, passed):
    got = {(r.asset_id, r.day): r for r in streamed}
    assert len(got) == len(streamed)
    due = {k for k in want if k[1] <= passed}
    assert due <= got.keys() and all(not got[k].reported for k in got.keys() - want.keys())
    for k in due:
        g = got[k]
        mine = [g["smooth" if c == "v_smooth" else c[2:] if c.startswith("v_") else c] for c in SAME]
        bad = [(c, x, want[k][c]) for c, x in zip(SAME, mine, strict=True) if not close(x, want[k][c])]
        assert not bad, (k, bad)
        assert g.reported == bool(want[k]["reported"])


def test_streamed_windows_equal_batch_over_a_restart(spark, tmp_path):
    rows = made(3)
    rng = random.Random(1)
    order = sorted(rows, key=lambda r: (r[1] - D0).days + rng.random() * 3)  # up to three days late, assets mixed
    build = lambda s: windows.stream_windows(s, "v", "4 days")
    src, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    step = -(-len(order) // 8)
    parts = [order[k : k + step] for k in range(0, len(order), step)]
    for half in (parts[:4], parts[4:]):  # the second half meets the state of the first
        for p in half:
            spark.createDataFrame(p, KIND).coalesce(1).write.mode("append").parquet(src)
        got = run.run_available(build, src, spark.createDataFrame([], KIND).schema, sink, cp, 1, spark)
    newest = max(r[1] for r in rows)
    agree(got.collect(), batch(spark, rows), newest - dt.timedelta(days=4))


def test_state_ends_with_a_silent_asset_and_starts_anew(spark, tmp_path):
    rows = [("A", D0 + dt.timedelta(days=d), float(d % 7), True, True, *[0.0] * 6) for d in [*range(20), *range(90, 110)]]
    rows += [("B", D0 + dt.timedelta(days=d), 1.0, True, True, *[0.0] * 6) for d in range(0, 110)]
    build = lambda s: windows.stream_windows(s, "v", "1 day", silent_days=25)
    src, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in (rows[:20] + rows[40:90], rows[90:130], rows[20:40] + rows[130:]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(src)
        got = run.run_available(build, src, spark.createDataFrame([], KIND).schema, sink, cp, 1, spark)
    out = got.collect()
    agree([r for r in out if r.asset_id == "A"], {k: v for k, v in batch(spark, rows).items() if k[0] == "A" and not 45 <= (k[1] - D0).days < 90}, D0 + dt.timedelta(days=107))
    assert {(r.day - D0).days for r in out if r.asset_id == "A"} & set(range(45, 90)) == set()
    with pytest.raises(ValueError):
        windows.stream_windows(spark.createDataFrame(rows, KIND), "v", silent_days=10)


SCORED = "asset_id string, day date, available_at timestamp_ntz, s double, fleet string"


@pytest.mark.parametrize("cooldown", [0, 1.5, 3])
def test_streamed_alerts_equal_replay(spark, tmp_path, cooldown):
    rng = random.Random(4)
    rows = []
    for d in range(25):
        for a in range(15):
            for hour in rng.sample(range(24), rng.choice([0, 1, 2])):
                rows.append((f"A{a:02}", D0 + dt.timedelta(days=d), dt.datetime(2024, 1, 2, hour) + dt.timedelta(days=d), None if rng.random() < 0.1 else round(rng.random(), 2), f"F{a % 2}"))
    df = spark.createDataFrame(rows, SCORED)
    want = {tuple(r) for r in replay.replay_alerts(df, "s", 0.6, 2, cooldown, ["fleet"]).collect()}
    order = sorted(rows, key=lambda r: r[2] + dt.timedelta(hours=40 * rng.random()))
    src, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    build = lambda s: alerts.stream_alerts(s, "s", 0.6, 2, cooldown, "2 days", "fleet")
    for k in range(0, len(order), 60):
        spark.createDataFrame(order[k : k + 60], SCORED).coalesce(1).write.mode("append").parquet(src)
        if k in (180, 360) or k + 60 >= len(order):
            got = run.run_available(build, src, df.schema, sink, cp, 1, spark).collect()
    mine = {(r.fleet, r.asset_id, r.day, r.available_at.replace(tzinfo=None)) for r in got}
    passed = max(r[2] for r in rows if r[3] is not None and r[3] >= 0.6) - dt.timedelta(days=2)
    assert {x for x in want if x[3] <= passed} == {x for x in mine if x[3] <= passed} and mine <= want and len(mine) == len(got)


def brute_replay(rows, threshold, budget, cooldown):
    last, spent, out = {}, {}, set()
    for a, d, t, s, _ in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[2], -r[3], r[0])):
        if s < threshold or spent.get(t.date(), 0) >= budget or a in last and t - last[a] < dt.timedelta(days=cooldown):
            continue
        last[a], spent[t.date()] = t, spent.get(t.date(), 0) + 1
        out.add((a, d, t))
    return out


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("policy", [(2, 3), (1, 0.5), (3, 1.25), (2, 0)])
def test_replay_by_time_equals_the_plain_rule(spark, seed, policy):
    rng = random.Random(seed)
    rows = [
        (f"A{a:02}", D0 + dt.timedelta(days=d), dt.datetime(2024, 1, 2, h) + dt.timedelta(days=d), round(rng.random(), 1), "F")
        for d in range(12)
        for a in range(20)
        for h in rng.sample([0, 5, 11, 17, 23], rng.choice([0, 1, 3]))
    ]
    got = replay.replay_alerts(spark.createDataFrame(rows, SCORED), "s", 0.4, *policy).collect()
    assert {tuple(r) for r in got} == brute_replay(rows, 0.4, *policy)
