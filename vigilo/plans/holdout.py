"""Leave-one-group-out remaining-life models, all folds and all arms in one plan.

A loop would fit a model for each group without it.  Here each fold is a row of parameters: thresholds are medians of
the episodes' last values with one or two groups left out of one ordered list, volatility edges are quantiles of the
whole less the group (``ranks``), calibration rows are joined with the folds they serve, and every fold's bounds come
out of one grouped pass.  The number of jobs depends neither on the groups nor on the arms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.operators import life, ranks
from vigilo.plans.health import LifeModel
from vigilo.session import materialize

#: Stands for all of a fold's calibration rows, whatever their bin.
ALL = -1


def fold_thresholds(last: DataFrame) -> DataFrame:
    """(fold, other, threshold): the median of last values without the groups ``fold`` and ``other``, equal ones included.

    ``last`` has train_id and last_value, a row for each episode, null for a group without one; episodes are confirmed faults, few beside telemetry,
    and their ordered list is one row.  Null where the two groups hold all of them.
    """
    kept = F.when(F.col("last_value").isNotNull(), F.struct(F.col("last_value").alias("value"), F.col("train_id").alias("group")))
    one = last.agg(F.array_sort(F.collect_list(kept)).alias("xs"), F.array_sort(F.collect_set("train_id")).alias("groups"))
    folds = one.select("xs", "groups", F.explode("groups").alias("fold")).select("xs", "fold", F.explode("groups").alias("other"))
    return folds.select("fold", "other", ranks.excluded_median(F.col("xs"), [F.col("fold"), F.col("other")]).alias("threshold"))


def fold_edges(daily: DataFrame, difficulty: str, n_bins: int) -> DataFrame:
    """(fold, edges): the bins' edges of each group, from the days of all others."""
    cuts = [k / n_bins for k in range(1, n_bins)]
    found = ranks.quantiles(daily, difficulty, cuts, without="train_id")
    return found.groupBy(F.col("train_id").alias("fold")).agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "quantile"))), lambda x: x["quantile"]).alias("edges"))


def _bin(model: LifeModel) -> Column:
    """The bin of a row beside its fold's ``edges``."""
    if model.mode != "mondrian":
        return F.lit(0)
    v = F.col(model.difficulty)
    return F.when(v.isNull() | F.col("edges").isNull(), 0).otherwise(F.size(F.filter("edges", lambda e: v >= e)))


def _projected(model: LifeModel) -> Column:
    p = model.policy
    return life.project(F.col(model.index), F.col(model.slope), F.col("threshold"), p.min_slope, p.horizon, p.form)


def _calibration(model: LifeModel, rows: DataFrame, pairs: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(fold, group, bin, score): each calibration row once for each fold that may use it, at the threshold without both groups."""
    served = rows.join(pairs.where("fold <> other and threshold is not null"), F.col("train_id") == F.col("other"))
    if edges is not None:
        served = served.join(edges, "fold", "left")
    truth = life.days_between(F.col("available_at"), F.col("fault_ts"))
    scored = served.withColumn("hat", _projected(model)).where("hat is not null")
    score = truth - F.col("hat") if model.mode == "additive" else F.try_divide(truth, F.col("hat"))
    return scored.select("fold", F.col("train_id").alias("group"), _bin(model).alias("bin"), score.alias("score")).where("score is not null")


def _bounds(model: LifeModel, scored: DataFrame) -> DataFrame:
    """(fold, bin, n, lo, hi), with a row for all bins of a fold together."""
    keyed = scored.select("fold", "group", "score", F.explode(F.array(F.lit(ALL), F.col("bin")) if model.mode == "mondrian" else F.array(F.lit(ALL))).alias("bin"))
    by = ["fold", "bin"]
    if not model.balanced:
        return life.rank_bounds(keyed, "score", model.alpha, by)
    weighted = keyed.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy(*by, "group")))
    lo, hi = (life.weighted_quantile(weighted, "score", "w", q, by).withColumnRenamed("quantile", name) for q, name in ((model.alpha, "lo"), (1 - model.alpha, "hi")))
    return keyed.groupBy(*by).agg(F.count("*").alias("n")).join(lo, by).join(hi, by)


def _predicted(model: LifeModel, daily: DataFrame, pairs: DataFrame, edges: DataFrame | None, bounds: DataFrame) -> DataFrame:
    """Each group's days by its own fold's parameters, as ``LifeModel.predict`` gives them."""
    per_fold = bounds.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "lo", "hi")))).alias("pairs"))
    params = pairs.where("fold = other").select("fold", "threshold").join(per_fold, "fold", "left")
    if edges is not None:
        params = params.join(edges, "fold", "left")
    rows = daily.join(params, F.col("train_id") == F.col("fold"))
    own, whole = F.col("pairs")[_bin(model)], F.col("pairs")[F.lit(ALL)]
    pair = F.when(own["n"] >= model.min_per_bin, own).otherwise(whole) if model.mode == "mondrian" else whole
    rows = rows.withColumn("__pair", pair).withColumn("__known", whole["n"].isNotNull())
    out = life.predict(rows, model.index, model.slope, F.col("threshold"), F.when(F.col("__known"), 0.0), F.when(F.col("__known"), 0.0), model.policy)
    p, state = F.col("rul_point"), F.col("prediction_state")
    moved = lambda q: F.greatest(F.lit(0.0), p + q if model.mode == "additive" else p * q)
    # A rank beyond the sample bounds nothing: below it is zero, above it is unbounded.
    low = F.when(F.col("__pair.lo").isNull(), 0.0).otherwise(moved(F.col("__pair.lo")))
    high = F.when(F.col("__pair.hi").isNull(), float("inf")).otherwise(moved(F.col("__pair.hi")))
    known = F.col("__known")
    out = out.withColumn("rul_lower", F.when(known & (state == "valid"), low).when(state == "threshold_exceeded", 0.0))
    out = out.withColumn("rul_upper", F.when(known & (state == "valid"), high))
    if model.mode == "mondrian":
        thin = known & F.col(model.difficulty).isNull() & state.isin("valid", "no_worsening_trend", "elevated_no_trend", "outside_horizon", "threshold_exceeded")
        out = out.withColumns({c: F.when(~thin, F.col(c)) for c in ("rul_point", "rul_lower", "rul_upper")}).withColumn("prediction_state", F.when(thin, "insufficient_history").otherwise(state))
    return out.withColumn("evaluation_group", F.col("train_id")).drop("fold", "threshold", "pairs", "edges", "__pair", "__known")


def held_out(daily: DataFrame, episodes: DataFrame, arms: dict[str, LifeModel], targets: DataFrame | None = None) -> DataFrame:
    """Predictions of every group's days by the model of each arm fitted without the group; adds arm and evaluation_group.

    Groups are the trains of ``episodes``; ``targets`` are the days to predict, ``daily`` itself by default.  An arm
    whose model has nothing to calibrate on predicts no bounds.  Arms share one pass over the episodes' days for each
    index and each set of edges.
    """
    targets = daily if targets is None else targets
    thresholds, cuts = {}, {}
    rows = materialize(life.in_episode(daily.drop("train_id"), episodes).join(episodes.select("episode_id", "train_id"), "episode_id"), "holdout-rows")
    parts = []
    for name, model in arms.items():
        if model.index not in thresholds:
            last = episodes.select("train_id").distinct().join(life.last_before_fault(daily, episodes, model.index), "train_id", "left")
            thresholds[model.index] = materialize(fold_thresholds(last), "holdout-thresholds")
        pairs, edges = thresholds[model.index], None
        if model.mode == "mondrian":
            key = model.difficulty, model.n_bins
            if key not in cuts:
                cuts[key] = materialize(fold_edges(daily, *key), "holdout-edges")
            edges = cuts[key]
        bounds = _bounds(model, _calibration(model, rows, pairs, edges))
        parts.append(_predicted(model, targets, pairs, edges, bounds).withColumn("arm", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def margin_summary(pred: DataFrame, by: list[str]) -> DataFrame:
    """(by, shares of episode days): bounds that are positive and covered, and bounds that overstate, with their mean excess."""
    inside = F.col("true_rul").isNotNull()
    scored = inside & F.col("rul_lower").isNotNull()
    useful = scored & (F.col("rul_lower") > 0) & (F.col("rul_lower") <= F.col("true_rul"))
    over = scored & (F.col("rul_lower") > F.col("true_rul"))
    return pred.groupBy(*by).agg(
        F.try_divide(F.count_if(useful), F.count_if(inside)).alias("positive_and_covered"),
        F.try_divide(F.count_if(over), F.count_if(inside)).alias("overstated"),
        F.coalesce(F.avg(F.when(over, F.col("rul_lower") - F.col("true_rul"))), F.lit(0.0)).alias("mean_overstatement_days"),
    )


def validation_summary(daily: DataFrame, episodes: DataFrame, arms: dict[str, LifeModel], by_group: bool = False) -> DataFrame:
    """(arm, [evaluation_group], coverage, abstention, error, margins) of held-out predictions: one row for each arm."""
    keys = ["arm", "evaluation_group"] if by_group else ["arm"]
    pred = materialize(life.true_rul(held_out(daily, episodes, arms), episodes), "holdout-predictions")
    return life.coverage_summary(pred, by=keys).join(margin_summary(pred, keys), keys)


def onboarding_comparison(base: DataFrame, adapted: DataFrame, episodes: DataFrame, arms: dict[str, tuple[LifeModel, bool]], after: Column, cutoff: Column | None = None) -> DataFrame:
    """(arm, coverage, margins): a new train's days by models that never saw it, on the fleet's baselines or on its own.

    ``base`` and ``adapted`` are the same asset-days on the two baselines; an arm names a model and whether it reads
    ``adapted``.  Days count from ``after`` on.  With ``cutoff`` models learn only from days and episodes up to it and
    are judged on what comes later, on trains with a fault after it; else on all days of each held-out train.
    """
    rows = F.col("available_at") > after
    learn, known, judged = base, episodes, episodes
    if cutoff is not None:
        learn, known, judged = base.where(F.col("available_at") <= cutoff), episodes.where(F.col("fault_ts") <= cutoff), episodes.where(F.col("fault_ts") > cutoff)
        rows = rows & (F.col("available_at") > cutoff)
    trains = judged.select("train_id").distinct()
    # A train without a fault to learn from is left out of no fold: it is a group of its own that the fit never had.
    models = {name: m for name, (m, _) in arms.items()}
    parts = []
    for source, wanted in ((base, False), (adapted, True)):
        mine = {n: models[n] for n, (_, own) in arms.items() if own == wanted}
        if mine:
            parts.append(held_out_new(learn, known, mine, source.where(rows).join(trains, "train_id", "left_semi")))
    pred = materialize(life.true_rul(reduce(DataFrame.unionByName, parts), judged), "onboarding-predictions")
    return life.coverage_summary(pred, by=["arm"]).join(margin_summary(pred, ["arm"]), "arm")


def held_out_new(daily: DataFrame, episodes: DataFrame, arms: dict[str, LifeModel], targets: DataFrame) -> DataFrame:
    """``held_out`` for targets whose trains may have no episode to learn from: such a train's fold leaves only itself out."""
    silent = targets.select("train_id").distinct().join(episodes.select("train_id").distinct(), "train_id", "left_anti")
    # An episode without a last value names the train as a group and counts in no statistic.
    blank = silent.select(
        F.lit(None).cast("int").alias("episode_id"), F.lit(None).cast("string").alias("asset_id"), "train_id", F.lit(None).cast("timestamp_ntz").alias("onset_ts"), F.lit(None).cast("timestamp_ntz").alias("fault_ts")
    )
    named = episodes.select("episode_id", "asset_id", "train_id", "onset_ts", "fault_ts").unionByName(blank)
    return held_out(daily, materialize(named, "holdout-episodes"), arms, targets)
