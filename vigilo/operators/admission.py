"""Which rows count as evidence for a channel, and when two reference views of an asset may be compared.

Two views hold the same asset-days scored on two baselines, the asset's own and the fleet's.  Their indices are on
different scales, so only what the algebra permits is reported, and only after every row has proved that both come from
one frozen model: locations apart in residual units, and the ratio of scales.  Each refusal is a code in an array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the daily contract.
READY, QUALITY, CONTEXT = "quality_ready", "data_quality_ok", "context_supported"
MODEL_IDS = ("normalisation_model_id", "model_version")
REFUSED = ("reference_rejected", "reference_not_yet_available")
VIEWS = ("asset_reference", "fleet_reference")


@dataclass(frozen=True)
class AdmissionPolicy:
    least_completeness: float = 0.9
    min_matched_days: int = 5
    min_context_days: int = 3
    tolerance: float = 1e-6
    scale_change: float = 0.05

    def __post_init__(self):
        if not 0 < self.least_completeness <= 1 or self.min_matched_days < 1 or self.min_context_days < 1 or not self.tolerance > 0:
            raise ValueError("invalid admission policy")


@dataclass(frozen=True)
class QualityPlan:
    """How a channel's rows are judged: by its own completeness, or by the whole day's flag and why."""

    completeness: dict[str, str] = field(default_factory=dict)
    every: list[str] = field(default_factory=list)
    blocking: list[str] = field(default_factory=list)

    @property
    def by_channel(self) -> bool:
        return not self.blocking


def quality_plan(columns: Sequence[str], channels: list[str], prefix: str = "") -> QualityPlan:
    """From the columns a table has.  Without the readiness flag, or a channel's completeness, one cannot tell why a day failed, so its flag stands."""
    found = {c: next((n for n in (f"{prefix}{c}_completeness", f"{c}_completeness") if n in columns), None) for c in channels}
    blocking = ([] if READY in columns else [READY]) + [f"{c}_completeness" for c, n in found.items() if n is None]
    every = sorted(c for c in columns if c.endswith("_completeness"))
    return QualityPlan({} if blocking else {c: n for c, n in found.items()}, every, blocking)


def _holds(name: str) -> Column:
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def consistent(plan: QualityPlan, policy: AdmissionPolicy) -> Column:
    """Whether the day's flag is what readiness and the completeness of all channels make it; unknown completeness is not."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in plan.every])
    least = F.least(*(F.col(c) for c in plan.every)) if len(plan.every) > 1 else F.col(plan.every[0])
    return F.coalesce(known & (_holds(QUALITY) == (_holds(READY) & (least >= policy.least_completeness))), F.lit(False))


def usable_rows(channel: str, plan: QualityPlan, columns: Sequence[str], policy: AdmissionPolicy = AdmissionPolicy()) -> Column:
    """True for rows that count for ``channel``; never null."""
    ok = _holds(CONTEXT)
    if plan.by_channel:
        share = F.col(plan.completeness[channel])
        ok = ok & _holds(READY) & F.coalesce(share.between(policy.least_completeness, 1.0), F.lit(False)) & consistent(plan, policy)
    else:
        ok = ok & _holds(QUALITY)
    if "onboarding_status" in columns:
        ok = ok & ~F.coalesce(F.col("onboarding_status").isin(*REFUSED), F.lit(False))
    return ok


def quality_mask(daily: DataFrame, channels: list[str], prefix: str = "", policy: AdmissionPolicy = AdmissionPolicy()) -> DataFrame:
    """(asset_id, day, channel, usable, value, refused): every row once for each channel, the value where it counts.

    ``refused`` says what kept a row out, first test first; null where it counts.
    """
    plan = quality_plan(daily.columns, channels, prefix)

    def one(c: str) -> Column:
        x = F.col(f"{prefix}{c}").cast("double")
        finite = x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(x) < float("inf"))
        tests = [(~_holds(CONTEXT), "context")]
        if plan.by_channel:
            tests += [(~consistent(plan, policy), "inconsistent_quality"), (~_holds(READY), "not_ready"), (~F.coalesce(F.col(plan.completeness[c]).between(policy.least_completeness, 1.0), F.lit(False)), "incomplete")]
        else:
            tests.append((~_holds(QUALITY), "day_quality"))
        tests += [(~usable_rows(c, plan, daily.columns, policy), "onboarding"), (~F.coalesce(finite, F.lit(False)), "no_value")]
        refused = F.lit(None).cast("string")
        for test, name in reversed(tests):
            refused = F.when(test, name).otherwise(refused)
        return F.struct(F.lit(c).alias("channel"), refused.isNull().alias("usable"), F.when(refused.isNull(), x).alias("value"), refused.alias("refused"))

    return daily.select("asset_id", "day", F.explode(F.array(*map(one, channels))).alias("m")).select("asset_id", "day", "m.*")


def context_medians(daily: DataFrame, contexts: list[str], policy: AdmissionPolicy = AdmissionPolicy()) -> DataFrame:
    """(asset_id, median of each context over supported rows); null from too few days."""
    held = {c: F.when(_holds(CONTEXT), F.col(c).cast("double")) for c in contexts}
    return daily.groupBy("asset_id").agg(*(F.when(F.count(x) >= policy.min_context_days, F.percentile(x, F.lit(0.5))).alias(c) for c, x in held.items()))


def _codes(tests: list[tuple[Column, str]]) -> Column:
    """The names of the tests that hold, in order; an unknown test holds not."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in tests)))


def view_identity(view: DataFrame, declared: str | None = None) -> DataFrame:
    """(asset_id, rows, model_id, fitted_at, problems) over every row of a view, not its last.

    Each identity column must be constant, all must agree with each other and with a declared id; a fit time is no
    identity and must be constant too.
    """
    ids = [c for c in MODEL_IDS if c in view.columns]
    timed = "preprocessing_fitted_at" in view.columns
    aggs = [F.count("*").alias("rows")]
    for c in ids:
        aggs += [F.count_distinct(c).alias(f"n_{c}"), F.min(F.col(c).cast("string")).alias(f"one_{c}")]
    if timed:
        aggs += [F.count_distinct("preprocessing_fitted_at").alias("n_fit"), F.min("preprocessing_fitted_at").alias("fit")]
    got = view.groupBy("asset_id").agg(*aggs)
    named = F.array_distinct(F.array_compact(F.array(*(F.col(f"one_{c}") for c in ids)))) if ids else F.array().cast("array<string>")
    own = F.when(F.size(named) == 1, named[0])
    varies = reduce(lambda a, b: a | b, [F.col(f"n_{c}") > 1 for c in ids], F.lit(False))
    model = F.lit(declared) if declared is not None else F.when(~varies, own)
    tests = [(F.col(f"n_{c}") > 1, f"{c}_not_constant") for c in ids]
    tests.append((F.size(named) > 1, "identities_disagree"))
    if declared is not None:
        tests.append((F.exists(named, lambda x: x != F.lit(declared)) | varies, "declared_conflict"))
    if timed:
        tests.append((F.col("n_fit") > 1, "fit_time_not_constant"))
    tests.append((F.coalesce(F.trim(model), F.lit("")) == "", "no_identity"))
    fitted = F.when(F.col("n_fit") == 1, F.col("fit")) if timed else F.lit(None).cast("timestamp_ntz")
    return got.select("asset_id", "rows", model.alias("model_id"), fitted.alias("fitted_at"), _codes(tests).alias("problems"))


def shared_identity(asset_view: DataFrame, fleet_view: DataFrame, declared: dict[str, str] | None = None, policy: AdmissionPolicy = AdmissionPolicy()) -> DataFrame:
    """(asset_id, verified, matched_days, problems) of assets in both views; ``problems`` of one view carry its name."""
    declared = declared or {}
    sides = [view_identity(v, declared.get(n)) for n, v in zip(VIEWS, (asset_view, fleet_view), strict=True)]
    a, f = (s.select("asset_id", *(F.col(c).alias(f"{n}_{c}") for c in ("model_id", "fitted_at", "problems"))) for n, s in zip("af", sides, strict=True))
    days = asset_view.select("asset_id", "day").distinct().join(fleet_view.select("asset_id", "day").distinct(), ["asset_id", "day"]).groupBy("asset_id").agg(F.count("*").alias("matched_days"))
    both = a.join(f, "asset_id").join(days, "asset_id", "left").withColumn("matched_days", F.coalesce("matched_days", F.lit(0).cast("long")))
    tell = lambda side, name: F.transform(f"{side}_problems", lambda x: F.concat(F.lit(name + ":"), x))
    across = _codes(
        [
            (F.col("a_model_id") != F.col("f_model_id"), "different_models"),
            (~F.col("a_fitted_at").eqNullSafe(F.col("f_fitted_at")), "different_fit_times"),
            (F.col("matched_days") < policy.min_matched_days, "few_shared_days"),
        ]
    )
    problems = F.concat(tell("a", VIEWS[0]), tell("f", VIEWS[1]), across)
    return both.select("asset_id", (F.size(problems) == 0).alias("verified"), "matched_days", problems.alias("problems"))


def _observations(view: DataFrame, channel: str, prefix: str, suffix: str, policy: AdmissionPolicy, plan: QualityPlan, name: str) -> DataFrame:
    """(asset_id, day, residual, index, copies) of a view's rows that count for the channel and have both numbers."""
    res, idx = F.col(f"{prefix}{channel}").cast("double"), F.col(f"{channel}{suffix}").cast("double")
    finite = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(x) < float("inf")), F.lit(False))
    rows = view.where(usable_rows(channel, plan, view.columns, policy) & finite(res) & finite(idx))
    return rows.groupBy("asset_id", "day").agg(F.min(res).alias(f"{name}_y"), F.min(idx).alias(f"{name}_x"), F.count("*").alias(f"{name}_copies"))


def admitted(asset_view: DataFrame, fleet_view: DataFrame, channels: list[str], prefix: str = "res_", suffix: str = "_hx", policy: AdmissionPolicy = AdmissionPolicy()) -> DataFrame:
    """(asset_id, channel, n, gap, sums..., refused): what both views hold on matched, supported, finite days, in one row.

    Refused are views with two rows for one day, with too few matched days, or whose residuals differ: the two
    baselines were then not applied to the same telemetry.
    """
    plan = quality_plan(sorted(set(asset_view.columns) & set(fleet_view.columns)), channels, prefix)
    parts = []
    for c in channels:
        a, f = (_observations(v, c, prefix, suffix, policy, plan, n) for v, n in ((asset_view, "a"), (fleet_view, "f")))
        parts.append(a.join(f, ["asset_id", "day"], "full_outer").withColumn("channel", F.lit(c)))
    rows = reduce(DataFrame.unionByName, parts)
    on = F.col("a_y").isNotNull() & F.col("f_y").isNotNull()
    aggs = [
        F.max(F.greatest(F.coalesce("a_copies", F.lit(0)), F.coalesce("f_copies", F.lit(0)))).alias("copies"),
        F.count_if(on).alias("n"),
        F.max(F.when(on, F.abs(F.col("a_y") - F.col("f_y")))).alias("gap"),
    ]
    for s in "af":
        x, y = F.when(on, F.col(f"{s}_x")), F.when(on, F.col(f"{s}_y"))
        aggs += [F.regr_slope(y, x).alias(f"{s}_scale"), F.regr_intercept(y, x).alias(f"{s}_loc"), (F.max(x) - F.min(x)).alias(f"{s}_range")]
    got = rows.groupBy("asset_id", "channel").agg(*aggs)
    refused = _codes([(F.col("copies") > 1, "repeated_days"), (F.col("n") < policy.min_matched_days, "few_matched_days"), (F.col("gap") > policy.tolerance, "residuals_differ")])
    miss = lambda s: F.abs(F.col(f"{s}_y") - F.col(f"{s}_loc") - F.col(f"{s}_scale") * F.col(f"{s}_x"))
    off = rows.where(on).join(got.select("asset_id", "channel", "a_loc", "a_scale", "f_loc", "f_scale"), ["asset_id", "channel"])
    off = off.groupBy("asset_id", "channel").agg(*(F.max(miss(s)).alias(f"{s}_miss") for s in "af"), F.max(F.greatest(F.abs("a_y"), F.abs("f_y"))).alias("largest"))
    return got.withColumn("refused", refused).join(off, ["asset_id", "channel"], "left")


def compare_references(
    asset_view: DataFrame, fleet_view: DataFrame, channels: list[str], prefix: str = "res_", suffix: str = "_hx", declared: dict[str, str] | None = None, policy: AdmissionPolicy = AdmissionPolicy(), as_of: Column | None = None
) -> DataFrame:
    """(asset_id, channel, status, reasons, matched_days, admitted, locations, scales, offsets, scale_ratio, scale_changed).

    ``recovered`` needs a proof of identity and admitted days from which both baselines follow exactly; where only the
    identity is lacking the numbers are a ``demonstration``; else ``unavailable``.  Rows not available by ``as_of`` are
    not there.  Assets of one view alone give no row; other columns of the views are not looked at.
    """
    views = [v if as_of is None else v.where(F.col("available_at") <= as_of) for v in (asset_view, fleet_view)]
    who = shared_identity(*views, declared, policy)
    rows = who.select("*", F.explode(F.array(*map(F.lit, channels))).alias("channel")).join(admitted(*views, channels, prefix, suffix, policy), ["asset_id", "channel"], "left")
    tests = []
    for s, name in zip("af", VIEWS, strict=True):
        scale, miss = F.col(f"{s}_scale"), F.col(f"{s}_miss")
        limit = policy.tolerance * F.greatest(F.lit(1.0), F.abs(scale), F.col("largest"))
        still = F.coalesce(F.col(f"{s}_range") <= 1e-12, F.lit(True))
        tests += [(still, f"{name}:index_does_not_vary"), (~still & ~(F.coalesce(scale, F.lit(0.0)) > 0), f"{name}:scale_not_positive"), (~still & (scale > 0) & (miss > limit), f"{name}:not_affine")]
    none = F.coalesce(F.col("refused"), F.array(F.lit("few_matched_days")))
    algebra = F.when(F.size(none) > 0, none).otherwise(_codes(tests))
    sound = F.size(algebra) == 0
    status = F.when(sound & F.col("verified"), "recovered").when(sound & (F.col("matched_days") >= policy.min_matched_days), "demonstration").otherwise("unavailable")
    shown = lambda x: F.when(sound, x)
    offset, ratio = F.col("a_loc") - F.col("f_loc"), F.col("a_scale") / F.col("f_scale")
    return rows.select(
        "asset_id",
        "channel",
        status.alias("status"),
        F.concat("problems", algebra).alias("reasons"),
        "matched_days",
        F.coalesce("n", F.lit(0).cast("long")).alias("admitted"),
        shown(F.col("a_loc")).alias("asset_location"),
        shown(F.col("a_scale")).alias("asset_scale"),
        shown(F.col("f_loc")).alias("fleet_location"),
        shown(F.col("f_scale")).alias("fleet_scale"),
        shown(offset).alias("location_offset"),
        shown(F.try_divide(offset, F.col("f_scale"))).alias("offset_in_fleet_scale"),
        shown(F.try_divide(offset, F.col("a_scale"))).alias("offset_in_asset_scale"),
        shown(F.when(F.col("f_scale") != 0, ratio)).alias("scale_ratio"),
        shown(F.when(F.col("f_scale") != 0, F.abs(ratio - 1) > policy.scale_change)).alias("scale_changed"),
    )
