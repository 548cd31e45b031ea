"""Admission of two views, quality masks, repair references and reconciliation, against plain versions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vigilo.operators import admission as A
from vigilo.operators import repair

D0 = dt.date(2024, 1, 1)
T0 = dt.datetime(2024, 1, 2)
VIEW = "asset_id string, day date, available_at timestamp_ntz, quality_ready boolean, data_quality_ok boolean, context_supported boolean, x_completeness double, y_completeness double, res_x double, res_y double, x_hx double, y_hx double, normalisation_model_id string, model_version string, preprocessing_fitted_at timestamp_ntz"


def view(loc, scale, assets="AB", days=12, seed=1, **change):
    rng = random.Random(seed)
    rows = []
    for a in assets:
        for d in range(days):
            x, y = rng.gauss(5, 2), rng.gauss(-3, 1)
            row = dict(
                asset_id=a, day=D0 + dt.timedelta(days=d), available_at=T0 + dt.timedelta(days=d), quality_ready=True, data_quality_ok=True, context_supported=True, x_completeness=1.0, y_completeness=0.95,
                res_x=x, res_y=y, x_hx=(x - loc) / scale, y_hx=(y - loc) / scale, normalisation_model_id="m1", model_version=None, preprocessing_fitted_at=T0,
            )
            rows.append(row | {k: f(row, d) if callable(f) else f for k, f in change.items()})
    return rows


def compare(spark, a, f, **more):
    names = [c.split()[0] for c in VIEW.split(", ")]
    made = [spark.createDataFrame([tuple(r[c] for c in names) for r in rows], VIEW) for rows in (a, f)]
    return {(r.asset_id, r.channel): r for r in A.compare_references(*made, ["x", "y"], **more).collect()}


def test_both_baselines_are_recovered(spark):
    got = compare(spark, view(2.0, 4.0), view(1.0, 2.0))
    assert got.keys() == {(a, c) for a in "AB" for c in "xy"}
    for r in got.values():
        assert r.status == "recovered" and r.reasons == [] and r.admitted == 12
        assert (r.asset_location, r.fleet_location, r.location_offset) == (pytest.approx(2), pytest.approx(1), pytest.approx(1))
        assert (r.offset_in_fleet_scale, r.offset_in_asset_scale, r.scale_ratio, r.scale_changed) == (pytest.approx(0.5), pytest.approx(0.25), pytest.approx(2), True)


@pytest.mark.parametrize(
    "asset,fleet,reason,status",
    [
        ({"normalisation_model_id": lambda r, d: f"m{d % 2}"}, {}, "asset_reference:normalisation_model_id_not_constant", "demonstration"),
        ({"model_version": "m2"}, {"model_version": "m2"}, "asset_reference:identities_disagree", "demonstration"),
        ({"normalisation_model_id": None}, {"normalisation_model_id": None}, "fleet_reference:no_identity", "demonstration"),
        ({"normalisation_model_id": "m2"}, {}, "different_models", "demonstration"),
        ({"preprocessing_fitted_at": lambda r, d: T0 + dt.timedelta(days=d)}, {}, "asset_reference:fit_time_not_constant", "demonstration"),
        ({"preprocessing_fitted_at": T0 + dt.timedelta(hours=1)}, {}, "different_fit_times", "demonstration"),
        ({"available_at": T0 + dt.timedelta(days=90)}, {}, None, None),
        ({"res_x": lambda r, d: r["res_x"] + (d == 3)}, {}, "residuals_differ", "unavailable"),
        ({"x_hx": 1.0}, {}, "asset_reference:index_does_not_vary", "unavailable"),
        ({"x_hx": lambda r, d: -r["x_hx"]}, {}, "asset_reference:scale_not_positive", "unavailable"),
        ({}, {"x_hx": lambda r, d: r["x_hx"] ** 3}, "fleet_reference:not_affine", "unavailable"),
        ({"context_supported": lambda r, d: d < 4}, {}, "few_matched_days", "unavailable"),
        ({"x_completeness": 0.5, "data_quality_ok": False}, {}, "few_matched_days", "unavailable"),
        ({"x_completeness": 0.5}, {}, "few_matched_days", "unavailable"),
        ({"res_x": float("nan")}, {"res_x": float("nan")}, "few_matched_days", "unavailable"),
    ],
)
def test_every_refusal_is_reached(spark, asset, fleet, reason, status):
    got = compare(spark, view(2.0, 4.0, **asset), view(1.0, 2.0, **fleet), as_of=F.lit("2024-02-01").cast("timestamp_ntz"))
    if reason is None:
        assert got == {}
        return
    r = got["A", "x"]
    assert reason in r.reasons and r.status == status and (r.scale_ratio is None) == (status == "unavailable")


def test_repeated_days_few_shared_days_and_declared_ids(spark):
    a, f = view(2.0, 4.0), view(1.0, 2.0)
    assert "repeated_days" in compare(spark, [*a, a[3]], f)["A", "x"].reasons
    r = compare(spark, [x for x in a if x["day"] < D0 + dt.timedelta(days=3)], f)["A", "x"]
    assert r.status == "unavailable" and {"few_shared_days", "few_matched_days"} <= set(r.reasons)
    good = {"asset_reference": "m1", "fleet_reference": "m1"}
    assert compare(spark, a, f, declared=good)["A", "x"].status == "recovered"
    assert "fleet_reference:declared_conflict" in compare(spark, a, f, declared=good | {"fleet_reference": "m7"})["A", "x"].reasons
    assert compare(spark, [], f) == {}


def test_one_bad_channel_leaves_the_other(spark):
    a = view(2.0, 4.0, x_completeness=0.5, data_quality_ok=False)
    got = compare(spark, a, view(1.0, 2.0, x_completeness=0.5, data_quality_ok=False))
    assert got["A", "x"].status == "unavailable" and got["A", "y"].status == "recovered"


def test_masks_and_context_medians(spark):
    names = [c.split()[0] for c in VIEW.split(", ")]
    rows = view(0.0, 1.0, assets="A", days=4, x_completeness=lambda r, d: [1.0, 0.5, 1.0, None][d], data_quality_ok=lambda r, d: [True, False, False, True][d], res_y=lambda r, d: None if d == 0 else 1.0)
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], VIEW)
    got = {((r.day - D0).days, r.channel): r.refused for r in A.quality_mask(df, ["x", "y"], "res_").collect()}
    assert got == {(0, "x"): None, (0, "y"): "no_value", (1, "x"): "incomplete", (1, "y"): None, (2, "x"): "inconsistent_quality", (2, "y"): "inconsistent_quality", (3, "x"): "inconsistent_quality", (3, "y"): "inconsistent_quality"}
    plain = A.quality_plan(df.drop("quality_ready").columns, ["x", "y"], "res_")
    assert plain.blocking == ["quality_ready"] and not plain.by_channel
    got = {((r.day - D0).days, r.channel): r.refused for r in A.quality_mask(df.drop("quality_ready"), ["x"], "res_").collect()}
    assert [got[d, "x"] for d in range(4)] == [None, "day_quality", "day_quality", None]
    held = df.withColumn("onboarding_status", F.when(F.dayofmonth("day") == 1, "reference_rejected"))
    assert {r.refused for r in A.quality_mask(held, ["x"], "res_").where("day = '2024-01-01'").collect()} == {"onboarding"}
    m = A.context_medians(df.withColumn("load", F.dayofmonth("day").cast("double")), ["load"]).first()
    assert m.load == 2.5 and A.context_medians(df.limit(2).withColumn("load", F.lit(1.0)), ["load"]).first().load is None


# ---- repairs


DAILY = "asset_id string, day date, available_at timestamp_ntz, data_quality_ok boolean, context_supported boolean, v double, w double, load double"
JOB = "job_id long, asset_id string, started_at timestamp_ntz, completed_at timestamp_ntz, recorded_at timestamp_ntz, as_of timestamp_ntz, reviewed_at timestamp_ntz"
P = repair.RepairPolicy(reference_days=4)


def median(xs):
    xs = sorted(xs)
    n = len(xs)
    return xs[n // 2] if n % 2 else (xs[n // 2 - 1] + xs[n // 2]) / 2


def plain_assessment(job, jobs, days):
    i, asset, start, done, rec, as_of, reviewed = job
    own = {d[1]: d for d in days if d[0] == asset}
    ok = lambda d: d in own and own[d][3] and own[d][4] and None not in own[d][5:]
    ref, last = None, None
    d = start.date() - dt.timedelta(days=1)
    while d >= D0:
        win = [d - dt.timedelta(days=k) for k in range(4)]
        if all(map(ok, win)):
            ref, last = win, d
            break
        d -= dt.timedelta(days=1)
    end = as_of.date()
    post = [own[x] for x in (end - dt.timedelta(days=k) for k in (1, 2, 3)) if x in own and own[x][2] <= as_of]
    base = (i, ref[-1] if ref else None, last, len(post))
    if rec > as_of:
        return (*base, None, "not_recorded")
    if not ref:
        return (*base, None, "no_reference")
    stats = []
    for c in (5, 6):
        loc = median([own[x][c] for x in ref])
        stats.append((loc, 1.4826 * median([abs(own[x][c] - loc) for x in ref])))
    if any(s <= 1e-9 for _, s in stats):
        return (*base, None, "flat_reference")
    if max(max(own[x][2] for x in ref), reviewed) > start:
        return (*base, None, "reviewed_too_late")
    if any(j[0] != i and j[1] == asset and j[2] >= start and j[4] <= as_of and j[2] <= as_of for j in jobs):
        return (*base, None, "later_work")
    first = (done.date() if done.time() == dt.time() else done.date() + dt.timedelta(days=1)) + dt.timedelta(days=1)
    if end - dt.timedelta(days=3) < first:
        return (*base, None, "waiting")
    if len(post) != 3 or not all(ok(x[1]) for x in post):
        return (*base, None, "incomplete_window")
    lo, hi = min(own[x][7] for x in ref), max(own[x][7] for x in ref)
    if not all(lo <= x[7] <= hi for x in post):
        return (*base, None, "outside_context")
    k = max(sum(abs(x[c] - stats[c - 5][0]) / stats[c - 5][1] > 3 for x in post) for c in (5, 6))
    return (*base, k, "repeated_departures" if k >= 2 else "within_limits" if k == 0 else "mixed_readings")


def test_assessments_equal_the_plain_rule(spark):
    rng = random.Random(3)
    days, jobs = [], []
    for a in range(12):
        for d in range(40):
            if rng.random() < 0.03:
                continue
            day = D0 + dt.timedelta(days=d)
            drift = 6 if a % 3 == 0 and d > 22 else 0
            days.append((f"A{a}", day, dt.datetime.combine(day, dt.time()) + dt.timedelta(days=1), rng.random() > 0.04, True, None if rng.random() < 0.02 else rng.choice([0.0, 1.0, 2.0, 3.0]) * (a != 7) + drift, rng.choice([0.0, 1.0, 2.0, 3.0]), float(rng.choice([1, 1, 1, 2] if a % 2 else [1]))))
        for _ in range(10):
            start = T0 + dt.timedelta(hours=rng.randrange(4 * 24, 30 * 24))
            done = start + dt.timedelta(hours=rng.choice([1, 24 - start.hour, 30]))
            jobs.append((len(jobs), f"A{a}", start, done, done + dt.timedelta(hours=rng.choice([0, 200])), done + dt.timedelta(days=rng.choice([2, 5, 6]), hours=6), start - dt.timedelta(hours=rng.choice([-5, 1, 1]))))
    df, jb = spark.createDataFrame(days, DAILY), spark.createDataFrame(jobs, JOB)
    got = {(r.job_id, r.reference_first, r.reference_last, r.observed_days, r.abnormal_days, r.reason) for r in repair.assess_repairs(jb, df, ["v", "w"], ["load"], P).collect()}
    want = {plain_assessment(j, jobs, days) for j in jobs}
    assert got == want
    missing = {"not_recorded", "no_reference", "later_work", "waiting", "within_limits", "reviewed_too_late"} - {r[-1] for r in want}
    assert not missing
    assert repair.assess_repairs(jb.limit(0), df, ["v"], ["load"], P).count() == 0
    assert repair.assess_repairs(jb, df.limit(0), ["v"], ["load"], P).where("reason in ('no_reference', 'not_recorded')").count() == len(jobs)
    with pytest.raises(ValueError):
        repair.references(jb, df, ["v"], ["v"], 4)
    assert math.isclose(repair.references(jb, df, ["v"], [], 4).first().channels["v"].scale, repair.references(jb, df, ["v"], [], 4).first().channels["v"].scale)


# ---- reconciliation and the shared store


def test_reconcile_gives_every_violation(spark):
    from vigilo.operators import reconcile as R

    df = lambda rows, kind="k string, why string": spark.createDataFrame(rows, kind)
    expected = df([("a",), ("b",), ("c",), ("d",), ("d",), (None,)], "k string")
    assessed = df([("a",), ("c",), ("c",), ("x",)], "k string")
    unavailable = df([("b", "sensor"), ("c", "sensor"), ("y", " ")])
    kinds = [t.withColumn("why", F.lit(None).cast("string")) if "why" not in t.columns else t for t in (expected, assessed, unavailable)]
    got = {tuple(r) for r in R.reconcile(*kinds, ["k"], "why").collect()}
    assert got == {("d", "missing"), ("d", "repeated_expected"), (None, "missing"), ("c", "both"), ("c", "repeated_assessed"), ("x", "unexpected"), ("y", "unexpected"), ("y", "no_reason")}
    assert R.reconcile(*(k.limit(0) for k in kinds), ["k"]).count() == 0
    report = {r.invariant: (r.violations, r.holds) for r in R.invariants({"one": expected.where("k = 'a'"), "none": assessed.limit(0)}).collect()}
    assert report == {"one": (1, False), "none": (0, True)}


def test_first_match(spark):
    from vigilo.operators import reconcile as R

    rows = [("e1", 2, 0, True, "late"), ("e1", 1, 5, True, "yes"), ("e1", 1, 3, False, "no"), ("e2", 0, 0, False, "no"), ("e3", 9, 9, None, "?")]
    got = R.first_match(spark.createDataFrame(rows, "episode string, a int, b int, ok boolean, what string"), "episode", ["a", "b"], "ok").collect()
    assert [tuple(r) for r in got] == [("e1", 1, 5, "yes")]


def _record(spark, *ids):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, "A", t, t, t, "o", "f", "w") for i in ids], "job_id string, asset_id string, started_at timestamp_ntz, completed_at timestamp_ntz, recorded_at timestamp_ntz, operator string, finding string, work_performed string")


def test_of_two_writers_of_one_key_one_fails(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from vigilo.sources import io

    root = str(tmp_path / "store")

    def write(k):
        try:
            return io.RepairStore(spark, root).record(_record(spark, "same" if k < 3 else f"own{k}"))
        except ValueError:
            return "refused"

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(write, range(6)))
    assert sorted(map(str, got[:3])) == ["1", "refused", "refused"] and got[3:] == [1, 1, 1]
    store = io.RepairStore(spark, root)
    assert sorted(r.job_id for r in store.read("records").collect()) == ["own3", "own4", "own5", "same"] and store.head() == 4
    assert store.read("records", 2).count() == 2 and store.read("records", 0).count() == 0
    assert store.append("records", _record(spark, "same", "more"), ignore=True) == 1


def test_assess_is_one_commit_and_readers_check(spark, tmp_path):
    from vigilo.sources import io

    store, other = io.RepairStore(spark, str(tmp_path / "a")), io.RepairStore(spark, str(tmp_path / "b"))
    store.record(_record(spark, "j1", "j2"))
    other.record(_record(spark, "j2", "j3"))
    assert [r.job_id for r in store.collisions(other).collect()] == ["j2"]
    bad = spark.createDataFrame([("j1", "A", T0, "abnormality_persists", "{}")], io.RepairStore.TABLES["assessments"][0])
    before = store.head()
    assert store.assess(bad) == 1 and store.head() == before + 1 and store.read("followups").count() == 1
    with pytest.raises(ValueError):
        store.assess(bad)
    assert store.head() == before + 1
    reader = io.RepairStore(spark, str(tmp_path / "a"), readonly=True)
    assert reader.read("assessments").count() == 1
    with pytest.raises(PermissionError):
        reader.record(_record(spark, "j9"))
    part = store._parts(store.head())["records"][0]
    spark.range(1).write.mode("overwrite").parquet(f"{store.root}/{part}")
    with pytest.raises(ValueError, match="not a part"):
        io.RepairStore(spark, str(tmp_path / "a"), readonly=True)
    assert not io.put_if_absent(spark, f"{store.root}/_commits/{1:012d}.json", "x") and io.put_if_absent(spark, f"{store.root}/_commits/{99:012d}.json", "x")


# ---- ingestion


def test_mapping_scores_aliases_too():
    from vigilo.sources import adapters

    got = adapters.scored_mapping(["Equipmnt ID", "I Peak", "zzz"], ["asset_id", "peak_current_a", "other"], {"asset_id": ["equipment_id"], "peak_current_a": ["i_peak"]})
    assert got["asset_id"][0] == "Equipmnt ID" and 0.8 < got["asset_id"][1] < 1 and got["peak_current_a"] == ("I Peak", 1.0) and "other" not in got
    assert adapters.suggest_mapping(["a", "a"], [], {}) == {} and adapters.scored_mapping([], ["x"]) == {}


def test_mixed_times_are_refused_unless_a_zone_is_declared(spark, tmp_path):
    from vigilo.functions import text
    from vigilo.sources import episodes

    times = ["2024-01-01 08:00:00", "2024-01-01T08:00:00+08:00", None, ""]
    df = spark.createDataFrame([(t,) for t in times], "t string")
    assert text.mixed_times(df, "t") and not text.mixed_times(df.where("t like '%+%' or t is null"), "t") and not text.mixed_times(df.limit(0), "t")
    path = str(tmp_path / "e.csv")
    with open(path, "w") as f:
        f.write("asset_id,train_id,onset_ts,fault_ts\nA,T,2024-01-01 00:00:00,2024-01-05T00:00:00+00:00\nA,T,2024-01-01 00:00:00,2024-01-05T00:00:00+00:00\nB,T,2024-01-01 00:00:00,2024-01-02 00:00:00\n")
    assets = spark.createDataFrame([("A",), ("B",)], "asset_id string")
    rows, problems = episodes.read_episodes(spark, path, assets)
    assert problems == ["fault_ts mixes times with and without an offset", "1 episodes: repeated"]
    assert {r.fault_ts for r in rows.where("asset_id = 'A'").collect()} == {dt.datetime(2024, 1, 5, 8)}
    rows, problems = episodes.read_episodes(spark, path, assets, source_zone="UTC")
    assert problems == ["1 episodes: repeated"] and rows.where("asset_id = 'B'").first().fault_ts == dt.datetime(2024, 1, 2, 8)


def test_recovery_median_counts_those_that_never_recovered(spark):
    from vigilo.operators import monitoring

    ask = lambda *x: monitoring.recovery_summary(spark.createDataFrame([(v,) for v in x], "recovery_days double")).first()
    assert tuple(ask(1.0, 2.0, None)) == (3, 2, 2.0) and tuple(ask(1.0, None)) == (2, 1, None) and tuple(ask(1.0, 3.0, 5.0, None)) == (4, 3, 4.0) and tuple(ask()) == (0, 0, None)
