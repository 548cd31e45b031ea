import pytest
from pyspark.sql import functions as F

from vigilo import contract
from vigilo.operators import life
from vigilo.plans.health import HealthPipeline, LifeModel
from vigilo.session import materialize
from vigilo.sources.synth import generate


@pytest.fixture(scope="module")
def fleet(spark):
    cycles, episodes = generate(spark, trains=4, doors=2, days=70, per_day=10, faults=4)
    sub = contract.subsystem("door")
    assert contract.validate(cycles, sub).ok
    p = HealthPipeline(["peak_current_a", "current_integral_as", "travel_mm"], [1, 1, -1], ["ambient_temp_c", "load_proxy", "hour_of_day"])
    p.fit(cycles.where(F.col("ts") < F.lit("2026-01-31").cast("timestamp_ntz")))
    daily = materialize(p.transform(cycles), "test-daily")
    episodes = materialize(episodes, "test-episodes")
    return daily, episodes


def test_index_rises_before_faults(fleet):
    daily, episodes = fleet
    hit = life.true_rul(daily, episodes)
    near = hit.where("true_rul < 3").agg(F.avg("health_index")).first()[0]
    calm = hit.where("true_rul is null").agg(F.avg("health_index")).first()[0]
    assert near > calm + 3


def test_life_model_modes(fleet):
    daily, episodes = fleet
    for mode, balanced in (("additive", False), ("ratio", False), ("mondrian", False), ("additive", True)):
        m = LifeModel(policy=life.LifePolicy(min_slope=0.02), mode=mode, balanced=balanced).fit(daily, episodes)
        out = m.predict(daily)
        assert m.threshold > 0 and m.n_calibration > 5
        assert out.where("rul_lower > rul_upper or rul_lower < 0").count() == 0
        assert out.where("prediction_state = 'valid' and rul_lower is null").count() == 0


def test_out_of_fold_covers_each_group(fleet):
    daily, episodes = fleet
    pred = LifeModel(policy=life.LifePolicy(min_slope=0.02)).out_of_fold(daily, episodes)
    groups = {r[0] for r in episodes.select("train_id").collect()}
    assert {r[0] for r in pred.select("evaluation_group").distinct().collect()} == groups
    s = life.coverage_summary(life.true_rul(pred, episodes)).first()
    assert s.evaluated_groups >= 3 and 0 <= s.macro_lower_coverage <= 1
