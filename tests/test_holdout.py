"""All folds in one plan give what a loop of refits gives."""

import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vigilo.operators import life
from vigilo.plans import holdout
from vigilo.plans.health import LifeModel
from vigilo.session import materialize

D0 = dt.date(2024, 1, 1)
DAILY = "asset_id string, train_id string, day date, available_at timestamp_ntz, last_observed_at timestamp_ntz, context_supported boolean, data_quality_ok boolean, health_index_smooth double, health_index_slope double, health_index_vol double"
POLICY = life.LifePolicy(min_slope=0.05)


@pytest.fixture(scope="module")
def fleet(spark):
    rng = random.Random(7)
    days, eps = [], []
    for t in range(5):
        for a in range(2):
            asset, fault = f"A{t}{a}", 25 + 3 * t + a if a == 0 or t == 2 else None
            for d in range(40):
                near = max(0.0, 14 - (fault - d)) if fault and d <= fault else 0.0
                if rng.random() < 0.1:
                    continue
                x = 0.5 + 0.6 * near + rng.gauss(0, 0.3)
                at = dt.datetime.combine(D0 + dt.timedelta(days=d + 1), dt.time())
                days.append((asset, f"T{t}", D0 + dt.timedelta(days=d), at, at, True, rng.random() > 0.05, x if rng.random() > 0.05 else None, 0.6 * (near > 0) + rng.gauss(0, 0.05), rng.random() if rng.random() > 0.1 else None))
            if fault:
                when = dt.datetime.combine(D0 + dt.timedelta(days=fault), dt.time(9))
                eps.append((len(eps), asset, f"T{t}", when - dt.timedelta(days=13), when))
    daily = materialize(spark.createDataFrame(days, DAILY), "test-holdout-daily")
    episodes = materialize(spark.createDataFrame(eps, "episode_id int, asset_id string, train_id string, onset_ts timestamp_ntz, fault_ts timestamp_ntz"), "test-holdout-episodes")
    return daily, episodes


SHOWN = ["rul_point", "rul_lower", "rul_upper", "prediction_state"]


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def loop(model, daily, episodes, targets=None):
    targets = daily if targets is None else targets
    out = {}
    for (g,) in sorted(episodes.select("train_id").distinct().collect()):
        m = replace(model).fit(daily.where(F.col("train_id") != g), episodes.where(F.col("train_id") != g))
        for r in m.predict(targets.where(F.col("train_id") == g)).collect():
            out[g, r.asset_id, r.day] = [r[c] for c in SHOWN]
    return out


ARMS = {
    "linear": LifeModel(policy=replace(POLICY, form="linear")),
    "ratio": LifeModel(policy=POLICY, mode="ratio"),
    "mondrian": LifeModel(policy=POLICY, mode="mondrian", min_per_bin=12),
    "balanced": LifeModel(policy=POLICY, balanced=True),
    "narrow": LifeModel(policy=POLICY, alpha=0.4),
}


def test_one_plan_equals_the_loop(fleet):
    daily, episodes = fleet
    got = {}
    for r in holdout.held_out(daily, episodes, ARMS).collect():
        got.setdefault(r.arm, {})[r.evaluation_group, r.asset_id, r.day] = [r[c] for c in SHOWN]
    states = set()
    for name, model in ARMS.items():
        want = loop(model, daily, episodes)
        assert got[name].keys() == want.keys() and want
        bad = [(k, got[name][k], want[k]) for k in want if not all(map(same, got[name][k], want[k]))]
        assert not bad, (name, len(bad), bad[:3])
        states |= {v[3] for v in want.values()}
    assert {"valid", "threshold_exceeded", "no_worsening_trend"} <= states


def test_few_groups_leave_nothing_to_calibrate(spark, fleet):
    daily, episodes = fleet
    for n in (1, 2):
        some = episodes.where(F.col("train_id") < f"T{n}")
        got = {(r.evaluation_group, r.asset_id, r.day): [r[c] for c in SHOWN] for r in LifeModel(policy=POLICY).out_of_fold(daily, some).collect()}
        assert got == loop(LifeModel(policy=POLICY), daily, some)
        assert all(v[1] in (None, 0.0) for v in got.values())
    assert LifeModel(policy=POLICY).out_of_fold(daily, episodes.limit(0)).count() == 0


def jobs_of(spark, call):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    call()
    found = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return found


def test_jobs_do_not_grow_with_groups(spark, fleet):
    daily, episodes = fleet
    one = {"ratio": ARMS["ratio"]}
    few = jobs_of(spark, lambda: holdout.held_out(daily, episodes.where("train_id < 'T3'"), one).collect())
    all_ = jobs_of(spark, lambda: holdout.held_out(daily, episodes, one).collect())
    assert abs(few - all_) <= 3  # adaptive execution may join stages


def test_validation_summary(fleet):
    daily, episodes = fleet
    rows = {r.arm: r for r in holdout.validation_summary(daily, episodes, {"narrow": ARMS["narrow"], "ratio": ARMS["ratio"]}).collect()}
    for name in ("narrow", "ratio"):
        pred = life.true_rul(ARMS[name].out_of_fold(daily, episodes), episodes).where("true_rul is not null").collect()
        scored = [r for r in pred if r.rul_lower is not None]
        assert rows[name].episode_rows == len(pred) and rows[name].scored_rows == len(scored)
        assert rows[name].overstated == pytest.approx(sum(r.rul_lower > r.true_rul for r in scored) / len(pred))
        assert rows[name].positive_and_covered == pytest.approx(sum(0 < r.rul_lower <= r.true_rul for r in scored) / len(pred))
        over = [r.rul_lower - r.true_rul for r in scored if r.rul_lower > r.true_rul]
        assert rows[name].mean_overstatement_days == pytest.approx(sum(over) / len(over) if over else 0.0)


def test_onboarding_arms(fleet):
    daily, episodes = fleet
    adapted = daily.withColumn("health_index_smooth", F.col("health_index_smooth") * 1.1)
    arms = {"fleet": (ARMS["narrow"], False), "own": (ARMS["narrow"], True), "own_balanced": (ARMS["balanced"], True)}
    after = F.lit("2024-01-05").cast("timestamp_ntz")
    rows = {r.arm: r for r in holdout.onboarding_comparison(daily, adapted, episodes, arms, after).collect()}
    assert rows.keys() == arms.keys() and rows["fleet"].point_mae_days != rows["own"].point_mae_days
    cutoff = F.lit("2024-02-01").cast("timestamp_ntz")
    rows = {r.arm: r for r in holdout.onboarding_comparison(daily, adapted, episodes, arms, after, cutoff).collect()}
    learn, known = daily.where(F.col("available_at") <= cutoff), episodes.where(F.col("fault_ts") <= cutoff)
    judged = episodes.where(F.col("fault_ts") > cutoff)
    want = 0
    for (g,) in judged.select("train_id").distinct().collect():
        m = replace(ARMS["narrow"]).fit(learn.where(F.col("train_id") != g), known.where(F.col("train_id") != g))
        pred = m.predict(daily.where((F.col("train_id") == g) & (F.col("available_at") > cutoff)))
        want += life.true_rul(pred, judged).where("true_rul is not null").count()
    assert rows["fleet"].episode_rows == want > 0
