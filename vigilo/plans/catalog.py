"""Named queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilo.functions import text
from vigilo.operators import decisions as D
from vigilo.operators import detectors as X
from vigilo.operators import duty as U
from vigilo.operators import features as E
from vigilo.operators import inspection as I
from vigilo.operators import life as L
from vigilo.operators import monitoring as M
from vigilo.operators import normalise as N
from vigilo.operators import replay as R
from vigilo.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits)


def ntz(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


# ---- features ----------------------------------------------------------------------------------------------------

_DAILY_OUT = "round(peak, 6) AS peak, round(charge, 6) AS charge, round(retry_count_rate, 6) AS retry_count_rate, round(ambient_mean, 6) AS ambient_mean, round(load_proxy_mean, 6) AS load_proxy_mean"


@query(f"WITH {V.DAILY} SELECT asset_id, day, train_id, n_cycles, context_supported, {_DAILY_OUT} FROM daily")
def daily_features(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    return d.select("asset_id", "day", "train_id", "n_cycles", "context_supported", *(r(c).alias(c) for c in ("peak", "charge", "retry_count_rate", "ambient_mean", "load_proxy_mean")))


@query(f"WITH {V.DAILY} SELECT asset_id, day, round(peak_iqr, 8) AS peak_iqr, round(charge_iqr, 8) AS charge_iqr, round(peak_completeness, 6) AS peak_completeness, round(charge_completeness, 6) AS charge_completeness FROM daily")
def daily_iqr_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return V.daily(spark, sf).select("asset_id", "day", *(r(c, d).alias(c) for c, d in (("peak_iqr", 8), ("charge_iqr", 8), ("peak_completeness", 6), ("charge_completeness", 6))))


@query(f"WITH {V.DAILY} SELECT asset_id, day, quality_ready, data_quality_ok, available_at, last_observed_at FROM daily")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return V.daily(spark, sf).select("asset_id", "day", "quality_ready", "data_quality_ok", "available_at", "last_observed_at")


_W = "PARTITION BY asset_id ORDER BY i RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
#: Trend of the day's charge, nulled on days of poor quality so that gaps occur.
_TREND = f"""WITH {V.DAILY}, v AS (SELECT asset_id, day, i, available_at, last_observed_at, train_id, data_quality_ok, context_supported, CASE WHEN data_quality_ok THEN charge END AS x FROM daily),
 s AS (SELECT *, CASE WHEN x IS NOT NULL AND count(x) OVER w3 >= 3 THEN quantile_cont(x, 0.5) OVER w3 END AS x_smooth,
 CASE WHEN count(x) OVER w14 >= 5 THEN quantile_cont(x, 0.75) OVER w14 - quantile_cont(x, 0.25) OVER w14 END AS x_vol FROM v
 WINDOW w3 AS ({_W.format(2)}), w14 AS ({_W.format(13)})),
 t AS (SELECT *, CASE WHEN x_smooth IS NOT NULL AND count(x_smooth) OVER w14 >= 5 THEN regr_slope(x_smooth, i) OVER w14 END AS x_slope FROM s WINDOW w14 AS ({_W.format(13)}))"""


def trend(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf).withColumn("x", F.when(F.col("data_quality_ok"), F.col("charge")))
    return E.add_trend(d, "x")


@query(_TREND + " SELECT asset_id, day, round(x_smooth, 6) AS x_smooth FROM t")
def trend_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return trend(spark, sf).select("asset_id", "day", r("x_smooth").alias("x_smooth"))


@query(_TREND + " SELECT asset_id, day, round(x_slope, 7) AS x_slope FROM t")
def trend_slope(spark: SparkSession, sf: str) -> DataFrame:
    return trend(spark, sf).select("asset_id", "day", r("x_slope", 7).alias("x_slope"))


@query(_TREND + " SELECT asset_id, day, round(x_vol, 8) AS x_vol FROM t")
def trend_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return trend(spark, sf).select("asset_id", "day", r("x_vol", 8).alias("x_vol"))


# ---- normalisation and baselines ---------------------------------------------------------------------------------

_BASE = f"""WITH {V.DAILY}, f AS (SELECT asset_id, min(day) AS first FROM daily GROUP BY 1),
 ref AS (SELECT d.asset_id, d.charge AS x FROM daily d JOIN f USING (asset_id) WHERE d.day < f.first + 21 AND d.asset_id <> 'A19'),
 m AS (SELECT asset_id, quantile_cont(x, 0.5) AS loc, count(x) AS n FROM ref GROUP BY 1),
 o AS (SELECT asset_id, 1.4826 * quantile_cont(abs(x - loc), 0.5) AS mad, any_value(loc) AS loc, any_value(n) AS n FROM ref JOIN m USING (asset_id) GROUP BY 1),
 fl AS (SELECT quantile_cont(loc, 0.5) AS fl, coalesce(quantile_cont(CASE WHEN mad > 1e-9 THEN mad END, 0.5), 1.0) AS fs FROM o),
 b AS (SELECT asset_id, CASE WHEN n >= 5 THEN loc ELSE fl END AS loc, CASE WHEN n >= 5 AND mad > 1e-9 THEN mad ELSE fs END AS scale FROM o, fl)"""


def _baseline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = V.daily(spark, sf)
    return d, N.fit_baseline(d.where("asset_id <> 'A19'"), "charge")


@query(_BASE + " SELECT asset_id, round(loc, 6) AS loc, round(scale, 6) AS scale FROM b")
def asset_baseline_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _baseline(spark, sf)[1].select("asset_id", r("loc").alias("loc"), r("scale").alias("scale"))


@query(_BASE + " SELECT d.asset_id, d.day, round((charge - coalesce(loc, fl)) / coalesce(scale, fs), 6) AS health_index, CASE WHEN b.asset_id IS NULL THEN 'fleet_fallback' ELSE 'asset_reference' END AS baseline_source FROM daily d LEFT JOIN b USING (asset_id), fl")
def asset_baseline_index(spark: SparkSession, sf: str) -> DataFrame:
    d, b = _baseline(spark, sf)
    return N.apply_baseline(d, b, "charge").select("asset_id", "day", r("health_index").alias("health_index"), "baseline_source")


@query(f"WITH {V.DAILY}, m AS (SELECT asset_id, quantile_cont(peak, 0.5) AS loc, count(peak) AS n FROM daily GROUP BY 1) SELECT asset_id, any_value(n) AS n, round(any_value(loc), 6) AS loc, round(1.4826 * quantile_cont(abs(peak - loc), 0.5), 6) AS mad FROM daily JOIN m USING (asset_id) GROUP BY 1")
def mad_scale(spark: SparkSession, sf: str) -> DataFrame:
    return N.robust_location(V.daily(spark, sf), "peak").select("asset_id", "n", r("loc").alias("loc"), r("mad").alias("mad"))


_SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"


def _normaliser(spark: SparkSession, sf: str) -> tuple[DataFrame, N.ConditionNormaliser]:
    c = V.cycles(spark, sf)
    return c, N.ConditionNormaliser("charge", ["load_proxy"], robust=False).fit(c.where(F.col("ts") < ntz("2024-01-16 00:00:00")))


@query(
    f"""WITH {V.CYC}, r AS (SELECT load_proxy AS a, load_proxy * load_proxy AS b, charge AS y FROM cyc WHERE ts < {_SPLIT}),
 z AS (SELECT (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b, y, avg(a) OVER () AS ma, avg(b) OVER () AS mb, stddev_pop(a) OVER () AS sa, stddev_pop(b) OVER () AS sb FROM r),
 g AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * (y - my)) AS ay, sum(b * (y - my)) AS by_, any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb, any_value(sa) AS sa, any_value(sb) AS sb FROM (SELECT *, avg(y) OVER () AS my FROM z)),
 w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb, my, ma, mb, sa, sb FROM g)
 SELECT event_id, round(charge - (my + wa * (load_proxy - ma) / sa + wb * (load_proxy * load_proxy - mb) / sb), 4) AS residual FROM cyc, w"""
)
def ridge_residual(spark: SparkSession, sf: str) -> DataFrame:
    c, n = _normaliser(spark, sf)
    return n.transform(c).select("event_id", r("residual", 4).alias("residual"))


@query(f"WITH {V.CYC}, q AS (SELECT min(ambient) AS lo, max(ambient) AS hi FROM cyc WHERE asset_id < 'A05' AND ts < TIMESTAMP '2024-01-03 00:00:00') SELECT event_id, ambient IS NULL AS context_missing, ambient >= lo - greatest((hi - lo) * 0.1, 1e-9) AND ambient <= hi + greatest((hi - lo) * 0.1, 1e-9) AS context_supported FROM cyc, q")
def context_support_range(spark: SparkSession, sf: str) -> DataFrame:
    c = V.cycles(spark, sf).drop("context_supported")
    n = N.ConditionNormaliser("charge", ["ambient"]).fit(c.where((F.col("asset_id") < "A05") & (F.col("ts") < ntz("2024-01-03 00:00:00"))))
    return n.transform(c).select("event_id", "context_missing", "context_supported")


@query()
def condition_normaliser(spark: SparkSession, sf: str) -> DataFrame:
    """Robust ridge on every context, hour harmonics included."""
    c = V.cycles(spark, sf).drop("context_supported")
    n = N.ConditionNormaliser("charge", ["ambient", "load_proxy", "hour_of_day"]).fit(c.where(F.col("ts") < ntz("2024-01-16 00:00:00")))
    return n.transform(c).select("event_id", r("expected", 4).alias("expected"), r("residual", 4).alias("residual"), "context_supported")


_REF = "available_at > TIMESTAMP '2024-01-01 00:00:00' AND available_at <= TIMESTAMP '2024-01-16 00:00:00'"


def _reference(d: DataFrame) -> DataFrame:
    return X.reference_frame(d, ntz("2024-01-01 00:00:00"), ntz("2024-01-16 00:00:00"))


@query()
def health_index_projection(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    h = N.HealthIndex(["peak", "charge"], [1, 1]).fit(_reference(d)).transform(d)
    return h.select("asset_id", "day", r("health_index").alias("health_index"), r("contribution_peak").alias("contribution_peak"), "health_inputs_complete")


@query(
    f"""WITH {V.DAILY}, c AS (SELECT covar_samp(peak, peak) + 1e-6 AS a, covar_samp(peak, charge) AS b, covar_samp(charge, charge) + 1e-6 AS d FROM daily WHERE {_REF} AND peak IS NOT NULL AND charge IS NOT NULL)
 SELECT asset_id, day, round(sqrt((c.d * peak * peak - 2 * c.b * peak * charge + c.a * charge * charge) / (c.a * c.d - c.b * c.b)), 5) AS anomaly_distance FROM daily, c"""
)
def anomaly_distance(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    return N.HealthIndex(["peak", "charge"], [1, 1]).fit(_reference(d)).transform(d).select("asset_id", "day", r("anomaly_distance", 5).alias("anomaly_distance"))


# ---- labels, life and coverage -----------------------------------------------------------------------------------


@query(f"WITH {V.DAILY}, {V.EPS} SELECT d.asset_id, d.day, round(max(epoch_us(fault_ts) - epoch_us(available_at)) / 86400e6, 6) AS true_rul FROM daily d LEFT JOIN eps e ON d.asset_id = e.asset_id AND available_at >= onset_ts AND available_at < fault_ts GROUP BY 1, 2")
def true_rul(spark: SparkSession, sf: str) -> DataFrame:
    return L.true_rul(V.daily(spark, sf), V.episodes(spark)).select("asset_id", "day", r("true_rul").alias("true_rul"))


@query(
    f"""WITH {V.DAILY}, {V.EPS} SELECT asset_id, day, CASE WHEN EXISTS (SELECT 1 FROM eps e WHERE e.asset_id = d.asset_id AND d.available_at < e.fault_ts AND e.fault_ts <= d.available_at + INTERVAL 7 DAY) THEN 1.0::DOUBLE
 WHEN d.available_at + INTERVAL 7 DAY <= TIMESTAMP '2024-01-31 00:00:00' THEN 0.0::DOUBLE END AS outcome FROM daily d"""
)
def horizon_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return L.horizon_outcomes(V.daily(spark, sf), V.episodes(spark), 7, ntz("2024-01-31 00:00:00")).select("asset_id", "day", "outcome")


_LAST = f"{_TREND}, {V.EPS}, last AS (SELECT e.episode_id, e.asset_id, e.train_id, arg_max(x_smooth, available_at) AS last_value FROM t JOIN eps e ON t.asset_id = e.asset_id AND t.available_at <= e.fault_ts WHERE x_smooth IS NOT NULL GROUP BY 1, 2, 3)"


def _last(spark: SparkSession, sf: str) -> DataFrame:
    return L.last_before_fault(trend(spark, sf), V.episodes(spark), "x_smooth")


@query(_LAST + " SELECT episode_id, asset_id, round(last_value, 6) AS last_value FROM last")
def asof_last_before_fault(spark: SparkSession, sf: str) -> DataFrame:
    return _last(spark, sf).select("episode_id", "asset_id", r("last_value").alias("last_value"))


@query(_LAST + " SELECT round(quantile_cont(last_value, 0.5), 6) AS threshold FROM last")
def episode_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _last(spark, sf).agg(r(F.percentile("last_value", F.lit(0.5))).alias("threshold"))


@query(_LAST + ", g AS (SELECT DISTINCT train_id AS fold FROM last) SELECT fold, round(quantile_cont(last_value, 0.5), 6) AS threshold FROM g JOIN last ON fold <> train_id GROUP BY 1")
def leave_one_group_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return L.leave_one_group_thresholds(_last(spark, sf)).select("fold", r("threshold").alias("threshold"))


@query(
    f"""WITH {V.DAILY}, x AS (SELECT train_id, round(peak - charge, 6) AS s FROM daily WHERE peak IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY train_id ORDER BY s) AS r, count(*) OVER (PARTITION BY train_id) AS n FROM x)
 SELECT train_id, n, max(CASE WHEN r = floor((n + 1) * 0.1) THEN s END) AS lo, max(CASE WHEN r = ceil((n + 1) * 0.9 - 1e-12) THEN s END) AS hi FROM k GROUP BY 1, 2"""
)
def residual_rank_bounds(spark: SparkSession, sf: str) -> DataFrame:
    x = V.daily(spark, sf).select("train_id", r(F.col("peak") - F.col("charge")).alias("s"))
    return L.rank_bounds(x, "s", 0.1, ["train_id"])


@query(
    f"""WITH {V.DAILY}, x AS (SELECT train_id, round(charge, 6) AS v, 1.0::DOUBLE / count(*) OVER (PARTITION BY asset_id) AS w FROM daily), k AS (SELECT *, sum(w) OVER (PARTITION BY train_id ORDER BY v) / sum(w) OVER (PARTITION BY train_id) AS share FROM x)
 SELECT train_id, min(v) AS quantile FROM k WHERE share >= 0.9 - 1e-12 GROUP BY 1"""
)
def weighted_quantile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    x = d.select("train_id", r("charge").alias("v"), (1.0 / F.count("*").over(Window.partitionBy("asset_id"))).alias("w"))
    return L.weighted_quantile(x, "v", "w", 0.9, ["train_id"])


_T = 130.0
_POINT = f"""CASE WHEN i0 >= {_T} THEN 0.0 WHEN s > 0.25 THEN least(greatest(CASE WHEN i0 >= 1 THEN ln({_T} / i0) / (s / i0) ELSE ({_T} - i0) / s END, 0), 90) END"""
_PRED = (
    _TREND
    + f""", p0 AS (SELECT *, x_smooth AS i0, x_slope AS s FROM t), p1 AS (SELECT *, {_POINT} AS point FROM p0),
 p2 AS (SELECT *, CASE WHEN NOT context_supported THEN 'outside_training_conditions' WHEN NOT data_quality_ok THEN 'insufficient_data' WHEN i0 >= {_T} THEN 'threshold_exceeded'
 WHEN i0 IS NOT NULL AND s IS NOT NULL THEN CASE WHEN s <= 0.25 AND i0 >= 100 THEN 'elevated_no_trend' WHEN s <= 0.25 THEN 'no_worsening_trend' WHEN point >= 90 THEN 'outside_horizon' ELSE 'valid' END
 ELSE 'insufficient_history' END AS prediction_state FROM p1),
 pred AS (SELECT *, CASE WHEN prediction_state IN ('valid', 'threshold_exceeded', 'outside_horizon') THEN point END AS rul_point,
 CASE prediction_state WHEN 'valid' THEN greatest(0.0, point - 2.5) WHEN 'threshold_exceeded' THEN 0.0 END AS rul_lower, CASE WHEN prediction_state = 'valid' THEN greatest(0.0, point + 4.0) END AS rul_upper FROM p2)"""
)


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    return L.predict(trend(spark, sf), "x_smooth", "x_slope", _T, -2.5, 4.0, L.LifePolicy(elevated=100.0))


@query(_PRED + " SELECT asset_id, day, round(point, 4) AS point FROM pred")
def rul_projection(spark: SparkSession, sf: str) -> DataFrame:
    return trend(spark, sf).select("asset_id", "day", r(L.project(F.col("x_smooth"), F.col("x_slope"), F.lit(_T)), 4).alias("point"))


@query(_PRED + " SELECT asset_id, day, prediction_state, round(rul_point, 4) AS rul_point, round(rul_lower, 4) AS rul_lower, round(rul_upper, 4) AS rul_upper FROM pred")
def prediction_states(spark: SparkSession, sf: str) -> DataFrame:
    return _pred(spark, sf).select("asset_id", "day", "prediction_state", *(r(c, 4).alias(c) for c in ("rul_point", "rul_lower", "rul_upper")))


@query(
    _PRED
    + f""", {V.EPS}, tr AS (SELECT p.*, (epoch_us(fault_ts) - epoch_us(available_at)) / 86400e6 AS true_rul FROM pred p JOIN eps e ON p.asset_id = e.asset_id AND available_at >= onset_ts AND available_at < fault_ts),
 g AS (SELECT train_id, count(*) AS rows, count(rul_lower) AS scored, avg(CASE WHEN rul_lower IS NOT NULL THEN (rul_lower <= true_rul)::INT END) AS cov, sum(CASE WHEN rul_lower IS NOT NULL THEN abs(rul_point - true_rul) END) AS err FROM tr GROUP BY 1)
 SELECT CAST(sum(rows) AS BIGINT) AS episode_rows, CAST(sum(scored) AS BIGINT) AS scored_rows, round(1 - sum(scored) / sum(rows), 6) AS abstention_rate, count(cov) AS evaluated_groups, round(avg(cov), 6) AS macro_lower_coverage, round(sum(err) / sum(scored), 4) AS point_mae_days FROM g"""
)
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = L.coverage_summary(L.true_rul(_pred(spark, sf), V.episodes(spark)))
    return s.select("episode_rows", "scored_rows", r("abstention_rate").alias("abstention_rate"), "evaluated_groups", r("macro_lower_coverage").alias("macro_lower_coverage"), r("point_mae_days", 4).alias("point_mae_days"))


# ---- group holdout -----------------------------------------------------------------------------------------------

_PAIRS = _LAST + """, g AS (SELECT DISTINCT train_id FROM eps), pr AS (SELECT a.train_id AS fold, b.train_id AS other FROM g a, g b),
 th AS (SELECT fold, other, quantile_cont(last_value, 0.5) AS threshold FROM pr LEFT JOIN last ON train_id <> fold AND train_id <> other GROUP BY 1, 2)"""
_HAT = "CASE WHEN i0 >= threshold THEN 0.0 WHEN s > 0.25 THEN least(greatest({}, 0), 90) END"
_FORMS = {"loglinear": "CASE WHEN i0 >= 1 THEN ln(threshold / i0) / (s / i0) ELSE (threshold - i0) / s END", "linear": "(threshold - i0) / s"}
_FOLDED = _PAIRS + "".join(
    f""", cal_{form} AS (SELECT fold, rul - hat AS score FROM (SELECT fold, (epoch_us(fault_ts) - epoch_us(available_at)) / 86400e6 AS rul, {_HAT.format(expr)} AS hat
 FROM (SELECT t.available_at, x_smooth AS i0, x_slope AS s, e.fault_ts, fold, threshold FROM t JOIN eps e ON t.asset_id = e.asset_id AND t.available_at >= e.onset_ts AND t.available_at < e.fault_ts JOIN th ON th.other = e.train_id AND fold <> other AND threshold IS NOT NULL)) WHERE hat IS NOT NULL),
 rk_{form} AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score) AS r, count(*) OVER (PARTITION BY fold) AS n FROM cal_{form}),
 bd_{form} AS (SELECT fold, max(CASE WHEN r = floor((n + 1) * 0.1) THEN score END) AS lo, max(CASE WHEN r = ceil((n + 1) * 0.9 - 1e-12) THEN score END) AS hi FROM rk_{form} GROUP BY 1),
 of_{form} AS (SELECT *, CASE prediction_state WHEN 'valid' THEN greatest(0.0, coalesce(point + lo, 0.0)) WHEN 'threshold_exceeded' THEN 0.0 END AS rul_lower, CASE WHEN prediction_state IN ('valid', 'threshold_exceeded', 'outside_horizon') THEN point END AS rul_point FROM (
 SELECT *, CASE WHEN NOT context_supported THEN 'outside_training_conditions' WHEN NOT data_quality_ok THEN 'insufficient_data' WHEN i0 >= threshold THEN 'threshold_exceeded' WHEN i0 IS NULL OR s IS NULL THEN 'insufficient_history'
 WHEN threshold IS NULL OR n IS NULL THEN 'uncalibrated' WHEN s <= 0.25 AND i0 >= 100 THEN 'elevated_no_trend' WHEN s <= 0.25 THEN 'no_worsening_trend' WHEN point >= 90 THEN 'outside_horizon' ELSE 'valid' END AS prediction_state
 FROM (SELECT *, {_HAT.format(expr)} AS point FROM (SELECT t.*, x_smooth AS i0, x_slope AS s, threshold, lo, hi, n FROM t JOIN th ON th.fold = t.train_id AND th.fold = th.other LEFT JOIN bd_{form} b ON b.fold = th.fold LEFT JOIN (SELECT fold, count(*) AS n FROM cal_{form} GROUP BY 1) c ON c.fold = th.fold))))"""
    for form, expr in _FORMS.items()
)


def _arm(form: str):
    from vigilo.plans.health import LifeModel

    return LifeModel(policy=L.LifePolicy(elevated=100.0, form=form), index="x_smooth", slope="x_slope", difficulty="x_vol")


@query(_PAIRS + " SELECT fold, other, round(threshold, 6) AS threshold FROM th")
def fold_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Medians of the episodes' last values without one and without two groups."""
    from vigilo.plans.holdout import fold_thresholds

    last = V.episodes(spark).select("train_id").distinct().join(_last(spark, sf).select("train_id", "last_value"), "train_id", "left")
    return fold_thresholds(last).select("fold", "other", r("threshold").alias("threshold"))


@query(_FOLDED + " SELECT asset_id, day, prediction_state, round(rul_point, 4) AS rul_point, round(rul_lower, 4) AS rul_lower FROM of_loglinear")
def out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Each train's days by thresholds and bounds that never saw the train."""
    out = _arm("loglinear").out_of_fold(trend(spark, sf), V.episodes(spark))
    return out.select("asset_id", "day", "prediction_state", r("rul_point", 4).alias("rul_point"), r("rul_lower", 4).alias("rul_lower"))


@query(
    _FOLDED
    + ", "
    + ", ".join(f"tr_{f} AS (SELECT '{f}' AS arm, p.train_id, rul_lower, rul_point, (epoch_us(fault_ts) - epoch_us(available_at)) / 86400e6 AS true_rul FROM of_{f} p JOIN eps e ON p.asset_id = e.asset_id AND available_at >= onset_ts AND available_at < fault_ts)" for f in _FORMS)
    + """, tr AS (SELECT * FROM tr_loglinear UNION ALL SELECT * FROM tr_linear), gr AS (SELECT arm, train_id, count(*) AS rows, count(rul_lower) AS scored, avg(CASE WHEN rul_lower IS NOT NULL THEN (rul_lower <= true_rul)::INT END) AS cov,
 sum(CASE WHEN rul_lower IS NOT NULL THEN abs(rul_point - true_rul) END) AS err, count(*) FILTER (WHERE rul_lower > 0 AND rul_lower <= true_rul) AS useful, count(*) FILTER (WHERE rul_lower > true_rul) AS over, coalesce(sum(CASE WHEN rul_lower > true_rul THEN rul_lower - true_rul END), 0) AS excess FROM tr GROUP BY 1, 2)
 SELECT arm, CAST(sum(rows) AS BIGINT) AS episode_rows, CAST(sum(scored) AS BIGINT) AS scored_rows, count(cov) AS evaluated_groups, round(avg(cov), 6) AS macro_lower_coverage, round(sum(err) / sum(scored), 4) AS point_mae_days,
 round(sum(useful) / sum(rows), 6) AS positive_and_covered, round(sum(over) / sum(rows), 6) AS overstated, round(CASE WHEN sum(over) > 0 THEN sum(excess) / sum(over) ELSE 0 END, 4) AS mean_overstatement_days FROM gr GROUP BY 1"""
)
def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Two projections, each held out by train, side by side."""
    from vigilo.plans.holdout import validation_summary

    s = validation_summary(trend(spark, sf), V.episodes(spark), {f: _arm(f) for f in _FORMS})
    kept = ["arm", "episode_rows", "scored_rows", "evaluated_groups"]
    return s.select(*kept, *(r(c, d).alias(c) for c, d in (("macro_lower_coverage", 6), ("point_mae_days", 4), ("positive_and_covered", 6), ("overstated", 6), ("mean_overstatement_days", 4))))


# ---- decisions ---------------------------------------------------------------------------------------------------

_RAW = "CASE WHEN {m} IS NULL THEN -1 WHEN {m} < 1 THEN 3 WHEN {m} < 3 THEN 2 WHEN {m} < 21 THEN 1 ELSE 0 END"
_ASPECT = _PRED + ", ra AS (SELECT asset_id, day, prediction_state, rul_lower, rul_point, available_at, CASE WHEN prediction_state = 'no_worsening_trend' THEN 0 WHEN prediction_state IN ('valid', 'threshold_exceeded') THEN " + _RAW.format(m="rul_lower") + " ELSE -1 END AS raw FROM pred)"


def _aspects(spark: SparkSession, sf: str) -> DataFrame:
    return _pred(spark, sf).withColumn("raw_aspect", D.state_aspect(F.col("rul_lower"), F.col("prediction_state")))


@query(_ASPECT + " SELECT asset_id, day, CAST(raw AS INTEGER) AS raw_aspect FROM ra")
def aspect_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _aspects(spark, sf).select("asset_id", "day", "raw_aspect")


_DAMP = (
    _ASPECT.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, n AS (SELECT asset_id, day, raw, row_number() OVER (PARTITION BY asset_id ORDER BY day) AS k FROM ra),
 f(asset_id, day, k, s, b, shown) AS (SELECT asset_id, day, k, raw, 0, CASE WHEN raw = -1 THEN -1 ELSE raw END FROM n WHERE k = 1
 UNION ALL SELECT n.asset_id, n.day, n.k, CASE WHEN n.raw = -1 THEN f.s WHEN f.s = -1 OR n.raw >= f.s OR (CASE WHEN n.day - f.day > 1 THEN 0 ELSE f.b END) + 1 >= 3 THEN n.raw ELSE f.s END,
 CASE WHEN n.raw = -1 OR f.s = -1 OR n.raw >= f.s OR (CASE WHEN n.day - f.day > 1 THEN 0 ELSE f.b END) + 1 >= 3 THEN 0 ELSE (CASE WHEN n.day - f.day > 1 THEN 0 ELSE f.b END) + 1 END,
 CASE WHEN n.raw = -1 THEN CASE WHEN f.s > 0 THEN f.s ELSE -1 END WHEN f.s = -1 OR n.raw >= f.s OR (CASE WHEN n.day - f.day > 1 THEN 0 ELSE f.b END) + 1 >= 3 THEN n.raw ELSE f.s END
 FROM f JOIN n ON n.asset_id = f.asset_id AND n.k = f.k + 1)"""
)


@query(_DAMP + " SELECT asset_id, day, CAST(shown AS INTEGER) AS aspect FROM f")
def aspect_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    return D.damp(_aspects(spark, sf)).select("asset_id", "day", "aspect")


@query(_DAMP + " SELECT day, CAST(shown AS INTEGER) AS aspect, count(*) AS assets FROM f GROUP BY 1, 2")
def aspect_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.damp(_aspects(spark, sf)).groupBy("day", "aspect").agg(F.count("*").alias("assets"))


@query(_PRED + f" SELECT asset_id, day, CASE WHEN rul_point IS NULL OR rul_lower IS NULL THEN 'n/a' WHEN abs({_RAW.format(m='rul_point')} - {_RAW.format(m='rul_lower')}) = 0 THEN 'HIGH' WHEN abs({_RAW.format(m='rul_point')} - {_RAW.format(m='rul_lower')}) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS stability FROM pred")
def decision_stability(spark: SparkSession, sf: str) -> DataFrame:
    return _pred(spark, sf).select("asset_id", "day", D.stability(F.col("rul_point"), F.col("rul_lower")).alias("stability"))


_CMP = "CASE WHEN prediction_state = 'threshold_exceeded' THEN 'threshold_exceeded' WHEN prediction_state <> 'valid' OR rul_lower IS NULL THEN 'unknown' WHEN rul_lower <= 0 THEN 'no_positive_margin' WHEN {h} < rul_lower THEN 'within_margin' ELSE 'exceeds_margin' END"


@query(_PRED + " SELECT asset_id, day, " + ", ".join(f"{_CMP.format(h=h)} AS window_{h}d" for h in (0, 3, 7, 14, 28)) + " FROM pred")
def deferral_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return D.ledger(_pred(spark, sf)).select("asset_id", "day", *(f"window_{h}d" for h in (0, 3, 7, 14, 28)))


@query(_PRED + f" SELECT asset_id, day, round(datediff('second', available_at, TIMESTAMP '2024-02-02 01:30:00') / 3600.0::DOUBLE, 6) AS hours_to_window, {_CMP.format(h="datediff('second', available_at, TIMESTAMP '2024-02-02 01:30:00') / 86400.0::DOUBLE")} AS scheduled_window FROM pred")
def scheduled_window(spark: SparkSession, sf: str) -> DataFrame:
    return D.ledger(_pred(spark, sf), (), ntz("2024-02-02 01:30:00")).select("asset_id", "day", r("hours_to_window").alias("hours_to_window"), "scheduled_window")


@query(
    _TREND
    + """, c AS (SELECT t.*, d.peak_completeness, d.charge_completeness FROM t JOIN daily d USING (asset_id, day)) SELECT asset_id, day,
 CASE WHEN available_at > TIMESTAMP '2024-01-20 06:00:00' THEN 'not_available' WHEN datediff('second', available_at, TIMESTAMP '2024-01-20 06:00:00') > 86400 THEN 'stale' WHEN NOT context_supported THEN 'outside_conditions'
 WHEN NOT data_quality_ok OR peak_completeness < 0.9 OR charge_completeness < 0.9 THEN 'incomplete' WHEN x_smooth IS NULL THEN 'warming_up' ELSE 'supported' END AS status,
 CASE WHEN available_at > TIMESTAMP '2024-01-20 06:00:00' THEN '' ELSE concat_ws(',', CASE WHEN peak_completeness < 0.9 THEN 'peak' END, CASE WHEN charge_completeness < 0.9 THEN 'charge' END) END AS missing_channels FROM c"""
)
def evidence_status(spark: SparkSession, sf: str) -> DataFrame:
    s = D.evidence_status(trend(spark, sf), ntz("2024-01-20 06:00:00"), ["peak_completeness", "charge_completeness"], "x_smooth")
    return s.select("asset_id", "day", "status", F.concat_ws(",", "missing_channels").alias("missing_channels"))


@query(f"WITH {V.DAILY} SELECT asset_id, day, last_value(CASE WHEN data_quality_ok AND context_supported THEN available_at END IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS last_supported_at FROM daily")
def last_supported_carry(spark: SparkSession, sf: str) -> DataFrame:
    return D.carry_supported(V.daily(spark, sf), F.col("data_quality_ok") & F.col("context_supported")).select("asset_id", "day", "last_supported_at")


@query(f"WITH {V.DAILY}, k AS (SELECT asset_id, day, day - CAST(row_number() OVER (PARTITION BY asset_id ORDER BY day) AS INTEGER) AS g FROM daily WHERE data_quality_ok AND context_supported) SELECT asset_id, min(day) AS start, max(day) AS \"end\", count(*) AS days FROM k GROUP BY asset_id, g")
def supported_islands(spark: SparkSession, sf: str) -> DataFrame:
    return D.islands(V.daily(spark, sf), F.col("data_quality_ok") & F.col("context_supported"))


@query(_ASPECT + ", k AS (SELECT asset_id, day, day - CAST(row_number() OVER (PARTITION BY asset_id ORDER BY day) AS INTEGER) AS g FROM ra WHERE raw >= 1), j AS (SELECT asset_id, min(day) AS start, max(day) AS last FROM k GROUP BY asset_id, g) SELECT asset_id, start FROM j WHERE last = DATE '2024-01-28'")
def escalation_start(spark: SparkSession, sf: str) -> DataFrame:
    return D.islands(_aspects(spark, sf), F.col("raw_aspect") >= 1).where(F.col("end") == F.lit("2024-01-28").cast("date")).select("asset_id", "start")


@query(_ASPECT + " SELECT asset_id, day, CAST(max(raw) OVER (PARTITION BY asset_id ORDER BY day ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS INTEGER) AS recent_peak FROM ra")
def recent_peak(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("asset_id").orderBy("day").rowsBetween(-20, 0)
    return _aspects(spark, sf).select("asset_id", "day", F.max("raw_aspect").over(w).alias("recent_peak"))


# ---- duty --------------------------------------------------------------------------------------------------------

_DUTY = f"""WITH {V.CYC}, ds AS (SELECT asset_id, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS n, sum(load_proxy) AS sl, sum(load_proxy * load_proxy) AS sll, sum(charge) AS sy, sum(load_proxy * charge) AS sly, sum(charge * charge) AS syy FROM cyc WHERE context_supported AND charge IS NOT NULL GROUP BY 1, 2),
 c AS (SELECT *, datediff('day', DATE '2000-01-01', day) AS i, greatest(sll - sl * sl / n, 0) AS xx, sly - sl * sy / n AS xy, greatest(syy - sy * sy / n, 0) AS yy FROM ds),
 w AS (SELECT *, sum(xx) OVER q AS sxx, sum(xy) OVER q AS sxy, sum(yy) OVER q AS syyc, count(*) OVER q AS d, sum(n) OVER q AS sn, sum(sl) OVER q AS wl FROM c WINDOW q AS ({_W.format(2)})),
 b AS (SELECT *, CASE WHEN sxx > 0 THEN sxy / sxx END AS b, sn - d - 1 AS dof FROM w),
 u AS (SELECT *, CASE WHEN greatest(syyc - b * sxy, 0) > 0 THEN b / sqrt(greatest(syyc - b * sxy, 0) / greatest(dof, 1) / sxx) END AS t, b IS NOT NULL AND dof > 0 AND sn >= 30 AND sqrt(sxx / sn) >= 0.08 AS ok FROM b),
 e AS (SELECT *, ok AND b > 0 AND coalesce(t >= 1.2, false) AS enter, ok AND b > 0 AND coalesce(t >= 0.6, false) AS stay FROM u),
 g AS (SELECT *, sum(CASE WHEN NOT stay OR coalesce(i - lag_i > 1, false) THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY asset_id ORDER BY i) AS lag_i FROM e)),
 z AS (SELECT *, stay AND max(CASE WHEN enter THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, g ORDER BY i) = 1 AS load_sensitive FROM g)"""


def _duty(spark: SparkSession, sf: str) -> DataFrame:
    return U.load_sensitivity(U.load_stats(V.cycles(spark, sf), "charge"), min_t=1.2, exit_t=0.6)


@query(_DUTY + " SELECT asset_id, day, n AS duty_n, round(sl, 6) AS duty_sum_l, round(sll, 6) AS duty_sum_ll, round(sy, 8) AS duty_sum_y, round(sly, 8) AS duty_sum_ly, round(syy, 4) AS duty_sum_yy FROM ds")
def load_sufficient_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = U.load_stats(V.cycles(spark, sf), "charge")
    return s.select("asset_id", "day", "duty_n", r("duty_sum_l").alias("duty_sum_l"), r("duty_sum_ll").alias("duty_sum_ll"), r("duty_sum_y", 8).alias("duty_sum_y"), r("duty_sum_ly", 8).alias("duty_sum_ly"), r("duty_sum_yy", 4).alias("duty_sum_yy"))


@query(_DUTY + " SELECT asset_id, day, round(CASE WHEN ok THEN b END, 4) AS load_sensitivity, round(CASE WHEN ok THEN t END, 4) AS load_sensitivity_t, round(wl / sn, 6) AS window_mean_load FROM z")
def load_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return _duty(spark, sf).select("asset_id", "day", r("load_sensitivity", 4).alias("load_sensitivity"), r("load_sensitivity_t", 4).alias("load_sensitivity_t"), r("window_mean_load").alias("window_mean_load"))


@query(_DUTY + " SELECT asset_id, day, load_sensitive FROM z")
def schmitt_trigger(spark: SparkSession, sf: str) -> DataFrame:
    return _duty(spark, sf).select("asset_id", "day", "load_sensitive")


_BANDS = f"""WITH {V.CYC}, p AS (SELECT CAST(least(greatest(floor(hour_of_day), 0), 23) AS INTEGER) AS h, quantile_cont(load_proxy, 0.5) AS l FROM cyc GROUP BY 1), q AS (SELECT *, min(l) OVER () AS lo, max(l) OVER () AS hi FROM p),
 k AS (SELECT h, h - row_number() OVER (ORDER BY h) AS g FROM q WHERE hi - lo >= 1e-6 AND l >= lo + 0.5 * (hi - lo)), bands AS (SELECT CAST(min(h) AS INTEGER) AS start_hour, CAST(max(h) + 1 AS INTEGER) AS end_hour FROM k GROUP BY g)"""


@query(_BANDS + " SELECT start_hour, end_hour FROM bands")
def peak_bands(spark: SparkSession, sf: str) -> DataFrame:
    return U.peak_bands(V.cycles(spark, sf))


@query(_BANDS + ", m AS (SELECT load_proxy AS l, EXISTS (SELECT 1 FROM bands WHERE floor(hour_of_day) >= start_hour AND floor(hour_of_day) < end_hour) AS inside FROM cyc) SELECT round(coalesce(quantile_cont(CASE WHEN inside THEN l END, 0.9), avg(l)), 6) AS load_peak, round(coalesce(quantile_cont(CASE WHEN NOT inside THEN l END, 0.5), avg(l)), 6) AS load_offpeak FROM m")
def band_loads(spark: SparkSession, sf: str) -> DataFrame:
    c = V.cycles(spark, sf)
    return U.band_loads(c, U.peak_bands(c)).select(r("load_peak").alias("load_peak"), r("load_offpeak").alias("load_offpeak"))


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    c = V.cycles(spark, sf)
    model = lambda rows, index: L.predict(rows, index, "x_slope", _T, -2.5, 4.0, L.LifePolicy(elevated=100.0))
    return U.assess_duty(D.damp(_aspects(spark, sf)), _duty(spark, sf), U.band_loads(c, U.peak_bands(c)), "x_smooth", model)


_AT = f"CASE WHEN NOT context_supported THEN 'outside_training_conditions' WHEN NOT data_quality_ok THEN 'insufficient_data' WHEN {{i}} >= {_T} THEN 'threshold_exceeded' WHEN {{i}} IS NULL OR s IS NULL THEN 'insufficient_history' WHEN s <= 0.25 AND {{i}} >= 100 THEN 'elevated_no_trend' WHEN s <= 0.25 THEN 'no_worsening_trend' WHEN least(greatest(CASE WHEN {{i}} >= 1 THEN ln({_T} / {{i}}) / (s / {{i}}) ELSE ({_T} - {{i}}) / s END, 0), 90) >= 90 THEN 'outside_horizon' ELSE 'valid' END"
_ASSESSED = (
    _DAMP
    + ", "
    + _DUTY.removeprefix(f"WITH {V.CYC}, ")
    + ", "
    + _BANDS.removeprefix(f"WITH {V.CYC}, ")
    + """, m AS (SELECT load_proxy AS l, EXISTS (SELECT 1 FROM bands WHERE floor(hour_of_day) >= start_hour AND floor(hour_of_day) < end_hour) AS inside FROM cyc),
 bl AS (SELECT coalesce(quantile_cont(CASE WHEN inside THEN l END, 0.9), avg(l)) AS lp, coalesce(quantile_cont(CASE WHEN NOT inside THEN l END, 0.5), avg(l)) AS lo FROM m),
 a0 AS (SELECT pr.*, f.shown, CASE WHEN z.ok THEN z.b END AS sens, coalesce(z.load_sensitive, false) AS sensitive, z.wl / z.sn AS anchor, lp, lo FROM pred pr JOIN f USING (asset_id, day) LEFT JOIN z ON z.asset_id = pr.asset_id AND z.day = pr.day, bl),
 a1 AS (SELECT *, i0 + coalesce(CASE WHEN sensitive THEN sens * (lp - anchor) END, 0) AS peak_index, i0 + coalesce(CASE WHEN sensitive THEN sens * (lo - anchor) END, 0) AS offpeak_index FROM a0),
 a2 AS (SELECT *, """
    + _AT.format(i="peak_index")
    + " AS peak_state, "
    + _AT.format(i="offpeak_index")
    + """ AS offpeak_state FROM a1),
 asd AS (SELECT *, CASE WHEN prediction_state NOT IN ('valid', 'threshold_exceeded', 'no_worsening_trend') THEN 'no_base_estimate' WHEN prediction_state = 'threshold_exceeded' THEN 'beyond_failure_level' WHEN shown = -1 THEN 'no_base_estimate' WHEN sens IS NULL THEN 'too_little_load_contrast'
 WHEN NOT sensitive THEN 'not_load_sensitive' WHEN peak_state = 'threshold_exceeded' THEN 'beyond_failure_level_at_peak' ELSE 'within_failure_level_at_peak' END AS duty_reason FROM a2),
 du AS (SELECT *, CASE duty_reason WHEN 'beyond_failure_level' THEN 'withdraw' WHEN 'beyond_failure_level_at_peak' THEN 'off_peak_only' WHEN 'not_load_sensitive' THEN 'full_service' WHEN 'within_failure_level_at_peak' THEN 'full_service' ELSE 'not_assessed' END AS duty FROM asd)"""
)


@query(_ASSESSED + " SELECT asset_id, day, prediction_state AS base_state, peak_state, offpeak_state, round(peak_index, 4) AS peak_index, duty, duty_reason FROM du")
def duty_label(spark: SparkSession, sf: str) -> DataFrame:
    """The card's states, and the same model again on the index moved to peak and off-peak load."""
    return _assessed(spark, sf).select("asset_id", "day", "base_state", "peak_state", "offpeak_state", r("peak_index", 4).alias("peak_index"), "duty", "duty_reason")


@query(
    _ASSESSED
    + f""", {V.EPS}, ld AS (SELECT episode_id, max(CASE WHEN sensitive THEN (epoch_us(fault_ts) - epoch_us(available_at)) / 86400e6 END) AS s, max(CASE WHEN duty = 'off_peak_only' THEN (epoch_us(fault_ts) - epoch_us(available_at)) / 86400e6 END) AS r
 FROM eps ep LEFT JOIN du ON du.asset_id = ep.asset_id AND available_at >= onset_ts AND available_at <= fault_ts GROUP BY 1), h AS (SELECT * FROM du WHERE duty <> 'not_assessed' AND asset_id NOT IN (SELECT asset_id FROM eps))
 SELECT count(*) AS episodes, count(s) AS episodes_sensitive, round(quantile_cont(s, 0.5), 6) AS median_sensitivity_lead_days, count(r) AS episodes_restricted, round(quantile_cont(r, 0.5), 6) AS median_restriction_lead_days,
 (SELECT count(*) FROM h) AS healthy_days, (SELECT count(*) FROM h WHERE sensitive) AS healthy_days_sensitive, (SELECT count(*) FROM h WHERE duty = 'off_peak_only') AS healthy_days_restricted FROM ld"""
)
def duty_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Closed interval: a restriction on the fault's own instant still counts."""
    s = U.duty_summary(_assessed(spark, sf), V.episodes(spark))
    return s.withColumns({c: r(c) for c in ("median_sensitivity_lead_days", "median_restriction_lead_days")})


# ---- detectors and replay ----------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {V.DAILY}, ref AS (SELECT asset_id, quantile_cont(charge, 0.5) AS c, stddev_samp(charge) AS s FROM daily WHERE {_REF} AND asset_id <> 'A19' GROUP BY 1), fl AS (SELECT quantile_cont(c, 0.5) AS fc, quantile_cont(s, 0.5) AS fs FROM ref),
 z AS (SELECT d.asset_id, d.day, (charge - coalesce(c, fc, 0)) / CASE WHEN s > 1e-9 THEN s WHEN fs > 1e-9 THEN fs ELSE 1.0 END AS z, row_number() OVER (PARTITION BY d.asset_id ORDER BY d.day) AS k FROM daily d LEFT JOIN ref USING (asset_id), fl WHERE charge IS NOT NULL),
 f(asset_id, day, k, e) AS (SELECT asset_id, day, k, z FROM z WHERE k = 1 UNION ALL SELECT z.asset_id, z.day, z.k, f.e * (1 - 0.15) + z.z * 0.15 FROM f JOIN z ON z.asset_id = f.asset_id AND z.k = f.k + 1)
 SELECT d.asset_id, d.day, round(f.e, 5) AS ewma FROM daily d LEFT JOIN f USING (asset_id, day)"""
)
def ewma_chart(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    return X.ewma_chart(d, _reference(d).where("asset_id <> 'A19'"), "charge").select("asset_id", "day", r("ewma", 5).alias("ewma"))


_COV = f"WITH {V.DAILY}, c AS (SELECT avg(peak) AS mp, avg(charge) AS mc, covar_pop(peak, peak) AS a, covar_pop(peak, charge) AS b, covar_pop(charge, charge) AS d FROM daily WHERE {_REF} AND peak IS NOT NULL AND charge IS NOT NULL)"


@query(_COV + " SELECT asset_id, day, round((c.d * (peak - mp) * (peak - mp) - 2 * c.b * (peak - mp) * (charge - mc) + c.a * (charge - mc) * (charge - mc)) / (c.a * c.d - c.b * c.b), 5) AS score FROM daily, c")
def mahalanobis_score(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    return d.select("asset_id", "day", r(X.Mahalanobis(["peak", "charge"]).fit(_reference(d)).score(), 5).alias("score"))


@query(_COV + " SELECT asset_id, day, round(abs((peak - mp) / sqrt(c.a) - sign(c.b) * (charge - mc) / sqrt(c.d)) / sqrt(2::DOUBLE), 5) AS score FROM daily, c")
def pca_reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    """Two standardised columns: what the first component leaves is their difference along the second."""
    d = V.daily(spark, sf)
    return d.select("asset_id", "day", r(X.PCAError(["peak", "charge"], k=1).fit(_reference(d)).score(), 5).alias("score"))


_LOF = (
    _COV
    + f""", st AS (SELECT row_number() OVER (ORDER BY asset_id, day) AS id, (peak - mp) / sqrt(c.a) AS x, (charge - mc) / sqrt(c.d) AS y FROM daily, c WHERE {_REF} AND peak IS NOT NULL AND charge IS NOT NULL),
 n0 AS (SELECT p.id, q.id AS nb, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM st p JOIN st q ON p.id <> q.id),
 n1 AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, nb) <= 20), ra AS (SELECT id, max(d) AS radius FROM n1 GROUP BY 1),
 de AS (SELECT n1.id, 1 / (avg(greatest(d, radius)) + 1e-10) AS density FROM n1 JOIN ra ON ra.id = n1.nb GROUP BY 1),
 qs AS (SELECT asset_id, day, (peak - mp) / sqrt(c.a) AS x, (charge - mc) / sqrt(c.d) AS y FROM daily, c WHERE peak IS NOT NULL AND charge IS NOT NULL),
 m0 AS (SELECT asset_id, day, st.id AS nb, sqrt((qs.x - st.x) * (qs.x - st.x) + (qs.y - st.y) * (qs.y - st.y)) AS d FROM qs, st),
 m1 AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY asset_id, day ORDER BY d, nb) <= 20),
 lf AS (SELECT asset_id, day, avg(density) * (avg(greatest(d, radius)) + 1e-10) AS lof FROM m1 JOIN ra ON ra.id = nb JOIN de ON de.id = nb GROUP BY 1, 2)"""
)


@query(_LOF + " SELECT d.asset_id, d.day, round(lof, 4) AS lof FROM daily d LEFT JOIN lf USING (asset_id, day)")
def lof_score(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty neighbours on two standardised channels; a day without one of them has no score."""
    d = V.daily(spark, sf)
    found = X.LocalOutlierFactor(["peak", "charge"], 20).fit(_reference(d)).scored(d.where("peak is not null and charge is not null"), "lof")
    return d.select("asset_id", "day").join(found, ["asset_id", "day"], "left").withColumn("lof", r("lof", 4))


@query()
def isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    found = X.IsolationForest(["peak", "charge"]).fit(_reference(d)).scored(d.where("peak is not null and charge is not null"), "isolation")
    return d.select("asset_id", "day").join(found, ["asset_id", "day"], "left").withColumn("isolation", r("isolation"))


_RUN = (
    _COV
    + f""", ra AS (SELECT d.asset_id, d.day, i, data_quality_ok AND context_supported AS shown, CASE WHEN n_cycles >= 8 THEN peak END AS raw,
 CASE WHEN n_cycles >= 8 THEN (c.d * (peak - mp) * (peak - mp) - 2 * c.b * (peak - mp) * (charge - mc) + c.a * (charge - mc) * (charge - mc)) / (c.a * c.d - c.b * c.b) END AS maha FROM daily d, c),
 rn AS (SELECT *, CASE WHEN shown AND raw IS NOT NULL AND count(raw) OVER w >= 3 THEN quantile_cont(raw, 0.5) OVER w END AS raw_score, CASE WHEN shown AND maha IS NOT NULL AND count(maha) OVER w >= 3 THEN quantile_cont(maha, 0.5) OVER w END AS maha_score FROM ra WINDOW w AS ({_W.format(4)}))"""
)


@query(_RUN + " SELECT asset_id, day, round(raw_score, 5) AS raw, round(maha_score, 4) AS mahalanobis, CAST(NULL AS DOUBLE) AS thin FROM rn")
def detector_run(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors on one declared reference, days of few cycles never scored; one whose input the reference lacks stays null."""
    late = V.daily(spark, sf).withColumn("busy", F.col("n_cycles") >= 8).withColumn("absent", F.lit(None).cast("double"))
    found = {"raw": X.RawSignal("peak"), "mahalanobis": X.Mahalanobis(["peak", "charge"]), "thin": X.Passthrough("absent")}
    out = X.run(found, late, start=ntz("2024-01-01 00:00:00"), end=ntz("2024-01-16 00:00:00"), valid="busy")
    return out.select("asset_id", "day", r("raw", 5).alias("raw"), r("mahalanobis", 4).alias("mahalanobis"), "thin")


_SMOOTHED = f"WITH {V.DAILY}, m AS (SELECT *, CASE WHEN data_quality_ok AND context_supported THEN charge END AS raw FROM daily), sm AS (SELECT *, CASE WHEN raw IS NOT NULL AND count(raw) OVER q >= 3 THEN quantile_cont(raw, 0.5) OVER q END AS score FROM m WINDOW q AS ({_W.format(2)}))"


@query(_SMOOTHED + " SELECT asset_id, day, round(score, 6) AS score FROM sm")
def frozen_scores(spark: SparkSession, sf: str) -> DataFrame:
    return X.frozen_score(V.daily(spark, sf), F.col("charge"), "score").select("asset_id", "day", r("score").alias("score"))


@query(f"WITH {V.DAILY} SELECT asset_id, day, round(charge, 6) AS charge FROM daily WHERE charge IS NOT NULL ORDER BY daily.charge DESC, day, asset_id LIMIT 40")
def topn_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_n(V.daily(spark, sf), "charge", 40).select("asset_id", "day", r("charge").alias("charge"))


_REPLAY = f"""WITH RECURSIVE {V.DAILY}, n AS (SELECT asset_id, day, available_at, row_number() OVER (ORDER BY day, charge DESC, asset_id) AS k FROM daily WHERE charge >= 40),
 f(k, done) AS (SELECT 0::BIGINT, []::STRUCT(d DATE, a VARCHAR)[] UNION ALL SELECT n.k, CASE WHEN len(list_filter(f.done, lambda x: x.d = n.day)) < 2 AND len(list_filter(f.done, lambda x: x.a = n.asset_id AND n.day - x.d < 3)) = 0 THEN list_append(f.done, {{'d': n.day, 'a': n.asset_id}}) ELSE f.done END FROM f JOIN n ON n.k = f.k + 1),
 fired AS (SELECT x.a AS asset_id, x.d AS day FROM (SELECT unnest(done) AS x FROM (SELECT done FROM f ORDER BY k DESC LIMIT 1)))"""


def _fired(d: DataFrame) -> DataFrame:
    return R.replay_alerts(d, "charge", 40.0, 2, 3).select("asset_id", "day")


@query(_REPLAY + " SELECT asset_id, day FROM fired")
def alert_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _fired(V.daily(spark, sf))


@query(
    _REPLAY
    + f""", {V.EPS}, fd AS (SELECT fired.*, CAST(day + INTERVAL 1 DAY AS TIMESTAMP) AS av FROM fired), hit AS (SELECT fd.*, episode_id, (epoch_us(fault_ts) - epoch_us(av)) / 86400e6 AS lead FROM fd JOIN eps e ON fd.asset_id = e.asset_id AND av >= onset_ts AND av < fault_ts),
 le AS (SELECT episode_id, max(lead) AS lead FROM hit GROUP BY 1), per AS (SELECT e.*, le.lead, coalesce(least(le.lead / ((epoch_us(fault_ts) - epoch_us(onset_ts)) / 86400e6), 1.0), 0.0) AS capture FROM eps e LEFT JOIN le USING (episode_id))
 SELECT count(*) AS n_episodes, count(lead) AS detected, round(quantile_cont(lead, 0.5), 6) AS median_lead_d, round(CASE WHEN count(lead) < count(*) THEN 0.0 ELSE min(lead) END, 6) AS worst_lead_d, round(avg(capture), 6) AS mean_capture,
 (SELECT count(*) FROM fd) AS alarms, round((SELECT count(DISTINCT (asset_id, day)) FROM hit) / nullif((SELECT count(*) FROM fd), 0)::DOUBLE, 6) AS precision FROM per"""
)
def replay_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    fired = d.join(_fired(d), ["asset_id", "day"], "left_semi")
    e = V.episodes(spark)
    m = R.alert_metrics(fired, e, 600)
    hit = L.in_episode(fired.select("asset_id", "available_at"), e).groupBy("episode_id").agg(F.max(L.days_between(F.col("available_at"), F.col("fault_ts")) / L.days_between(F.col("onset_ts"), F.col("fault_ts"))).alias("c"))
    mean = e.join(hit, "episode_id", "left").agg(F.avg(F.coalesce(F.least("c", F.lit(1.0)), F.lit(0.0))).alias("mean_capture"))
    precision = F.when(F.col("alarms") > 0, r("precision"))  # the operator, as the reference, calls it 0 where nothing fired
    return m.crossJoin(mean).select("n_episodes", "detected", r("median_lead_d").alias("median_lead_d"), r("worst_lead_d").alias("worst_lead_d"), r("mean_capture").alias("mean_capture"), "alarms", precision.alias("precision"))


@query(
    f"""WITH {V.DAILY}, {V.EPS}, k AS (SELECT asset_id, day, available_at, row_number() OVER (ORDER BY charge DESC, day, asset_id) AS r FROM daily WHERE charge IS NOT NULL), b(budget) AS (VALUES (10), (50), (150)),
 h AS (SELECT k.r, e.episode_id FROM k LEFT JOIN eps e ON k.asset_id = e.asset_id AND available_at >= onset_ts AND available_at < fault_ts)
 SELECT CAST(budget AS INTEGER) AS budget, count(DISTINCT r) AS alarms, count(DISTINCT episode_id) AS detected, round(count(DISTINCT CASE WHEN episode_id IS NOT NULL THEN r END) / count(DISTINCT r)::DOUBLE, 6) AS precision FROM h JOIN b ON r <= budget GROUP BY 1"""
)
def budget_curve(spark: SparkSession, sf: str) -> DataFrame:
    c = R.budget_curve(V.daily(spark, sf), "charge", V.episodes(spark), [10, 50, 150])
    return c.select("budget", "alarms", "detected", r("precision").alias("precision"))


_PERIODS = ("2024-01-01 00:00:00", "2024-01-11 00:00:00", "2024-01-24 00:00:00")
_GATE = R.SelectionPolicy(threshold_quantile=0.5, minimum_fault_groups=1, minimum_recall=0.1, maximum_false_alerts_per_asset_month=40.0)


def _selection_sql(name: str, after: str, until: str, cut: str) -> str:
    """CTEs of one candidate's replay in (after, until] at threshold ``cut`` and of its metrics, named by the candidate."""
    n = name
    return f"""{n}_in AS (SELECT DISTINCT asset_id FROM eps WHERE fault_ts <= {until} AND onset_ts <= {after} AND fault_ts > {after}),
 {n}_ep AS (SELECT * FROM eps WHERE fault_ts <= {until} AND onset_ts > {after} AND asset_id NOT IN (SELECT asset_id FROM {n}_in)),
 {n}_rows AS (SELECT * FROM daily WHERE available_at > {after} AND available_at <= {until} AND asset_id NOT IN (SELECT asset_id FROM {n}_in)),
 {n}_n AS (SELECT asset_id, day, available_at, row_number() OVER (ORDER BY day, {n} DESC, asset_id) AS k FROM {n}_rows WHERE {n} >= {cut}),
 {n}_f(k, done) AS (SELECT 0::BIGINT, []::STRUCT(d DATE, a VARCHAR)[] UNION ALL SELECT q.k, CASE WHEN len(list_filter(f.done, lambda x: x.d = q.day)) < 2 AND len(list_filter(f.done, lambda x: x.a = q.asset_id AND q.day - x.d < 3)) = 0 THEN list_append(f.done, {{'d': q.day, 'a': q.asset_id}}) ELSE f.done END FROM {n}_f f JOIN {n}_n q ON q.k = f.k + 1),
 {n}_fired AS (SELECT x.a AS asset_id, x.d AS day, CAST(x.d + INTERVAL 1 DAY AS TIMESTAMP) AS av FROM (SELECT unnest(done) AS x FROM (SELECT done FROM {n}_f ORDER BY k DESC LIMIT 1))),
 {n}_hit AS (SELECT f.*, episode_id, (epoch_us(fault_ts) - epoch_us(av)) / 86400e6 AS lead FROM {n}_fired f JOIN {n}_ep e ON f.asset_id = e.asset_id AND av >= onset_ts AND av < fault_ts),
 {n}_per AS (SELECT e.episode_id, max(lead) AS lead FROM {n}_ep e LEFT JOIN {n}_hit h USING (episode_id) GROUP BY 1),
 {n}_m AS (SELECT '{n}' AS name, {cut} AS threshold, (SELECT count(DISTINCT train_id) FROM {n}_ep) AS fault_groups, (SELECT count(*) FROM {n}_per) AS n_episodes, (SELECT count(lead) FROM {n}_per) AS detected,
 (SELECT count(*) FROM {n}_fired) AS alarms, (SELECT count(*) FROM (SELECT DISTINCT asset_id, day FROM {n}_hit)) AS useful, (SELECT count({n}) / count(*)::DOUBLE FROM {n}_rows) AS score_fraction,
 (SELECT CASE WHEN count(lead) < count(*) THEN 0.0 ELSE min(lead) END FROM {n}_per) AS worst_lead_d, (SELECT count(*) FROM {n}_rows) AS rows)"""


def _candidates_sql() -> str:
    c0, c1, v1 = (f"TIMESTAMP '{x}'" for x in _PERIODS)
    cut = "(SELECT quantile_cont({0}, 0.5) FROM daily WHERE available_at > " + c0 + " AND available_at <= " + c1 + ")"
    each = ", ".join(_selection_sql(n, c1, v1, cut.format(n)) for n in ("peak", "charge"))
    return (
        f"WITH RECURSIVE {V.DAILY}, {V.EPS}, {each}"
        + """, al AS (SELECT *, detected / nullif(n_episodes, 0)::DOUBLE AS recall, (alarms - useful) / (rows / 30.0::DOUBLE) AS false_alerts FROM (SELECT * FROM peak_m UNION ALL SELECT * FROM charge_m)),
 sf AS (SELECT *, concat_ws(',', CASE WHEN fault_groups < 1 THEN 'fault_groups' END, CASE WHEN coalesce(recall < 0.1, true) THEN 'recall' END, CASE WHEN score_fraction < 0.5 THEN 'score_fraction' END, CASE WHEN false_alerts > 40 THEN 'false_alerts' END) AS shortfalls FROM al),
 pl AS (SELECT *, CASE WHEN shortfalls = '' THEN row_number() OVER (PARTITION BY shortfalls = '' ORDER BY recall DESC NULLS LAST, false_alerts, worst_lead_d DESC NULLS LAST, name) END AS place FROM sf)"""
    )


_OUT = "round(threshold, 5) AS threshold, fault_groups, n_episodes, detected, alarms, round(score_fraction, 6) AS score_fraction"


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, e = V.daily(spark, sf), V.episodes(spark)
    return R.qualify(d, e, ["peak", "charge"], *_PERIODS, _GATE), d, e


def _shown_candidate(q: DataFrame, *more: str | Column) -> DataFrame:
    return q.select("name", r("threshold", 5).alias("threshold"), "fault_groups", "n_episodes", "detected", "alarms", r("score_fraction").alias("score_fraction"), *more)


@query(_candidates_sql() + f" SELECT name, {_OUT}, round(false_alerts, 6) AS false_alerts, shortfalls, CAST(place AS INTEGER) AS place FROM pl")
def selection_gate(spark: SparkSession, sf: str) -> DataFrame:
    q, _, _ = _candidates(spark, sf)
    return _shown_candidate(q, r("false_alerts_per_asset_month").alias("false_alerts"), F.concat_ws(",", "shortfalls").alias("shortfalls"), "place")


@query(
    _candidates_sql()
    + ", "
    + ", ".join(_selection_sql(n, f"TIMESTAMP '{_PERIODS[2]}'", "(SELECT max(available_at) FROM daily)", f"(SELECT threshold FROM pl WHERE name = '{n}')").replace(f"{n}_", f"{n}_late_") for n in ("peak", "charge"))
    + f" SELECT name, {_OUT} FROM (SELECT * FROM peak_late_m UNION ALL SELECT * FROM charge_late_m) WHERE name = (SELECT name FROM pl WHERE place = 1)"
)
def assess_selected(spark: SparkSession, sf: str) -> DataFrame:
    """The chosen detector at its frozen threshold on what came after validation."""
    q, d, e = _candidates(spark, sf)
    return _shown_candidate(R.assess_selected(q, d, e, _PERIODS[2], _GATE))


@query(f"WITH {V.DAILY} SELECT asset_id, day, charge FROM daily WHERE charge >= (SELECT min(charge) FROM (SELECT charge FROM daily WHERE charge IS NOT NULL ORDER BY charge DESC LIMIT 25))")
def largest_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    return R.largest_with_ties(V.daily(spark, sf), "charge", 25).select("asset_id", "day", "charge")


# ---- grids, outages, stress --------------------------------------------------------------------------------------

_GRID = "g AS (SELECT asset_id, CAST(d AS DATE) AS day, CAST(d + INTERVAL 1 DAY AS TIMESTAMP) AS available_at FROM (SELECT DISTINCT asset_id FROM daily), generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) q(d))"


def _grid(d: DataFrame) -> DataFrame:
    return M.expected_grid(d, "2023-12-30", "2024-02-02")


@query(f"WITH {V.DAILY}, {_GRID} SELECT asset_id, day, available_at FROM g")
def expected_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(V.daily(spark, sf))


@query(f"WITH {V.DAILY}, {_GRID} SELECT g.asset_id, g.day, round(d.charge, 6) AS charge FROM g LEFT JOIN daily d USING (asset_id, day)")
def grid_alignment(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    return M.align(d, _grid(d), ["charge"]).select("asset_id", "day", r("charge").alias("charge"))


@query(_SMOOTHED + f", {_GRID} SELECT g.asset_id, count(*) AS expected_rows, count(score) AS scored_rows, round(count(score) / count(*)::DOUBLE, 6) AS availability FROM g LEFT JOIN sm USING (asset_id, day) GROUP BY 1")
def availability(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    a = M.availability(M.align(X.frozen_score(d, F.col("charge"), "score"), _grid(d), ["score"]), "score", ["asset_id"])
    return a.select("asset_id", "expected_rows", "scored_rows", r("availability").alias("availability"))


@query(
    f"""WITH {V.DAILY}, v AS (SELECT asset_id, day, i, charge AS x FROM daily WHERE data_quality_ok AND context_supported AND charge IS NOT NULL),
 l AS (SELECT *, lag(i) OVER (PARTITION BY asset_id ORDER BY i) AS p FROM v), g AS (SELECT *, sum(CASE WHEN i - p > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY i) AS g FROM l),
 a AS (SELECT t.asset_id, t.day, t.i, count(*) AS n, quantile_cont(u.x, 0.5) AS m, t.i - min(u.i) AS span FROM g t JOIN g u ON t.asset_id = u.asset_id AND t.g = u.g AND u.i <= t.i AND u.i >= t.i - 5 GROUP BY 1, 2, 3),
 b AS (SELECT t.asset_id, t.day, max(CASE WHEN q.i < h.first THEN q.i END) AS before, any_value(h.first) AS first FROM g t JOIN (SELECT asset_id, g, min(i) AS first FROM g GROUP BY 1, 2) h ON h.asset_id = t.asset_id AND h.g = t.g JOIN g q ON q.asset_id = t.asset_id GROUP BY 1, 2)
 SELECT d.asset_id, d.day, round(CASE WHEN n >= 3 THEN m END, 6) AS score, CASE WHEN NOT (d.data_quality_ok AND d.context_supported) THEN 'unsupported' WHEN d.charge IS NULL THEN 'incomplete' WHEN n >= 3 THEN 'supported' WHEN span = a.i - first AND coalesce(a.i - before <= 5, false) THEN 'gap_too_large' ELSE 'too_few_observations' END AS status, coalesce(n, 0) AS observations, CAST(span AS INTEGER) AS span_days
 FROM daily d LEFT JOIN a USING (asset_id, day) LEFT JOIN b USING (asset_id, day)"""
)
def outage_window(spark: SparkSession, sf: str) -> DataFrame:
    return M.outage_window(V.daily(spark, sf), "charge").select("asset_id", "day", r("score").alias("score"), "status", "observations", "span_days")


@query(_SMOOTHED + " SELECT asset_id, round(datediff('second', TIMESTAMP '2024-01-12 06:00:00', min(CASE WHEN score IS NOT NULL AND available_at >= TIMESTAMP '2024-01-12 06:00:00' THEN available_at END)) / 86400.0::DOUBLE, 6) AS recovery_days FROM sm GROUP BY 1")
def recovery_days(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    got = M.recovery_days(X.frozen_score(d, F.col("charge"), "score"), "score", d, ntz("2024-01-12 06:00:00"))
    return got.select("asset_id", r("recovery_days").alias("recovery_days"))


@query(
    _SMOOTHED
    + """, rc AS (SELECT asset_id, datediff('second', TIMESTAMP '2024-01-12 06:00:00', min(CASE WHEN score IS NOT NULL AND available_at >= TIMESTAMP '2024-01-12 06:00:00' THEN available_at END)) / 86400.0::DOUBLE AS x FROM sm GROUP BY 1),
 l AS (SELECT count(*) AS n, count(x) AS k, list_sort(list(x) FILTER (WHERE x IS NOT NULL)) AS xs FROM rc) SELECT n AS assets, k AS recovered, round(CASE WHEN n // 2 + 1 <= k THEN (xs[(n + 1) // 2] + xs[n // 2 + 1]) / 2 END, 6) AS median_days FROM l"""
)
def recovery_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf)
    got = M.recovery_summary(M.recovery_days(X.frozen_score(d, F.col("charge"), "score"), "score", d, ntz("2024-01-12 06:00:00")))
    return got.select("assets", "recovered", r("median_days").alias("median_days"))


@query(f"WITH {V.CYC} SELECT asset_id, CAST(ts AS DATE) AS day, count(*) AS n FROM cyc WHERE NOT (asset_id IN ('A01', 'A02') AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND datediff('day', DATE '2024-01-10', CAST(ts AS DATE)) % 3 = 0) GROUP BY 1, 2")
def perturb_missing_days(spark: SparkSession, sf: str) -> DataFrame:
    c = M.perturb(V.cycles(spark, sf), "missing_days", "2024-01-10 00:00:00", ["A01", "A02"], "charge", "ambient")
    return c.groupBy("asset_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {V.CYC} SELECT event_id, round(CASE WHEN asset_id = 'A03' AND ts >= TIMESTAMP '2024-01-10 00:00:00' THEN charge + 0.6 ELSE charge END, 6) AS charge FROM cyc")
def perturb_offset(spark: SparkSession, sf: str) -> DataFrame:
    return M.perturb(V.cycles(spark, sf), "sensor_offset", "2024-01-10 00:00:00", ["A03"], "charge", "ambient").select("event_id", r("charge").alias("charge"))


@query(f"WITH {V.CYC} SELECT event_id FROM cyc WHERE NOT (asset_id IN ('A05', 'A06') AND ts >= TIMESTAMP '2024-01-12 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00')")
def blackout(spark: SparkSession, sf: str) -> DataFrame:
    return M.blackout(V.cycles(spark, sf), "2024-01-10 00:00:00", ["A05", "A06"], 2, 4).select("event_id")


# ---- evidence, repairs, planner ----------------------------------------------------------------------------------

_CHANGE = f"""WITH {V.DAILY}, lg AS (SELECT asset_id, 'peak' AS channel, peak AS v, available_at FROM daily WHERE data_quality_ok AND context_supported UNION ALL SELECT asset_id, 'charge', charge, available_at FROM daily WHERE data_quality_ok AND context_supported),
 p AS (SELECT *, CASE WHEN available_at > TIMESTAMP '2024-01-24' AND available_at <= TIMESTAMP '2024-01-29' THEN 'recent' WHEN available_at > TIMESTAMP '2024-01-03' AND available_at <= TIMESTAMP '2024-01-24' THEN 'reference' END AS part FROM lg WHERE v IS NOT NULL),
 q AS (SELECT * FROM p WHERE part IS NOT NULL), mid AS (SELECT asset_id, channel, quantile_cont(CASE WHEN part = 'reference' THEN v END, 0.5) AS loc, quantile_cont(CASE WHEN part = 'recent' THEN v END, 0.5) AS now, count(CASE WHEN part = 'reference' THEN 1 END) AS nr, count(CASE WHEN part = 'recent' THEN 1 END) AS nn FROM q GROUP BY 1, 2),
 sc AS (SELECT q.asset_id, q.channel, 1.4826 * quantile_cont(abs(v - loc), 0.5) AS scale FROM q JOIN mid USING (asset_id, channel) WHERE part = 'reference' GROUP BY 1, 2),
 zz AS (SELECT m.*, scale, nn >= 2 AND nr >= 5 AND coalesce(scale > 1e-9, false) AS good FROM mid m LEFT JOIN sc USING (asset_id, channel)),
 ch AS (SELECT asset_id, channel, CASE WHEN good THEN now - loc END AS change, CASE WHEN good THEN (now - loc) / scale END AS z FROM zz)"""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return M.robust_change(V.daily(spark, sf), ["peak", "charge"], ntz("2024-01-29 00:00:00"), least_recent=2, least_reference=5, shift=1.0)


@query(_CHANGE + " SELECT asset_id, channel, round(change, 6) AS change, round(z, 6) AS z, CASE WHEN z IS NULL THEN 'unknown' WHEN z >= 1 THEN 'increase' WHEN z <= -1 THEN 'decrease' ELSE 'no_detected_change' END AS direction FROM ch")
def robust_change(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("asset_id", "channel", r("change").alias("change"), r("z").alias("z"), "direction")


@query(
    _CHANGE
    + """, m AS (SELECT a.asset_id, a.channel, any_value(a.z) AS z, count(b.z) AS peers, quantile_cont(b.z, 0.5) AS m FROM ch a LEFT JOIN ch b ON a.channel = b.channel AND a.asset_id <> b.asset_id AND b.z IS NOT NULL GROUP BY 1, 2)
 SELECT asset_id, channel, peers, round(CASE WHEN peers >= 3 THEN m END, 6) AS peer_median_z, CASE WHEN peers >= 3 AND z IS NOT NULL THEN abs(m) >= 0.1 AND sign(m) = sign(z) END AS shared FROM m"""
)
def peer_comparison(spark: SparkSession, sf: str) -> DataFrame:
    p = M.peer_comparison(_changes(spark, sf), share=0.1)
    return p.select("asset_id", "channel", "peers", r("peer_median_z").alias("peer_median_z"), "shared")


@query(_BASE + ", v AS (SELECT d.asset_id, charge, (charge - loc) / scale AS hx FROM daily d JOIN b USING (asset_id)), k AS (SELECT asset_id, regr_intercept(charge, hx) AS location, regr_slope(charge, hx) AS scale, count(*) AS n FROM v GROUP BY 1) SELECT asset_id, round(location, 7) AS location, round(scale, 6) AS scale, n FROM k WHERE n >= 5")
def reference_affine(spark: SparkSession, sf: str) -> DataFrame:
    d, b = _baseline(spark, sf)
    view = N.apply_baseline(d.where("asset_id <> 'A19'"), b, "charge")
    return M.affine_baseline(view, "charge", "health_index").select("asset_id", r("location", 7).alias("location"), r("scale").alias("scale"), "n")


_FAMILIES = {"peak": "current", "charge": None}
_WEAR = {"peak": 1, "charge": 1}


@query(
    _CHANGE
    + """, d AS (SELECT *, CASE WHEN z IS NULL THEN 'unknown' WHEN z >= 1 THEN 'increase' WHEN z <= -1 THEN 'decrease' ELSE 'no_detected_change' END AS direction FROM ch)
 SELECT asset_id, coalesce(string_agg(CASE WHEN direction IN ('increase', 'decrease') THEN channel END, ',' ORDER BY channel), '') AS shifted, coalesce(string_agg(CASE WHEN direction = 'unknown' THEN channel END, ',' ORDER BY channel), '') AS unknown_channels,
 CASE WHEN bool_or(direction IN ('increase', 'decrease') AND channel = 'peak') THEN 'current' ELSE '' END AS families, coalesce(bool_and(CASE WHEN direction IN ('increase', 'decrease') THEN z > 0 END), false) AS wear_consistent,
 count(*) FILTER (WHERE direction IN ('increase', 'decrease')) = 1 AND count(*) FILTER (WHERE direction = 'unknown') = 0 AS isolated FROM d GROUP BY 1"""
)
def cross_channel(spark: SparkSession, sf: str) -> DataFrame:
    c = I.cross_channel(_changes(spark, sf), _FAMILIES, _WEAR)
    join = lambda x: F.array_join(x, ",")
    return c.select("asset_id", join("shifted").alias("shifted"), join("unknown").alias("unknown_channels"), join("families").alias("families"), "wear_consistent", "isolated")


@query()
def inspection_records(spark: SparkSession, sf: str) -> DataFrame:
    c = _changes(spark, sf)
    return I.evidence_records(c, I.cross_channel(c, _FAMILIES, _WEAR), M.peer_comparison(c, share=0.1), F.lit("2024-01-29"))


_SHOWN = (
    _ASPECT
    + ", "
    + _GRID
    + """, j AS (SELECT g.asset_id, g.day, raw FROM g LEFT JOIN ra USING (asset_id, day)), l AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS last FROM j),
 sh AS (SELECT asset_id, day, CAST(coalesce(raw, CASE WHEN last > 0 THEN last ELSE -1 END) AS INTEGER) AS shown_aspect, raw IS NOT NULL AS reported FROM l)"""
)


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    a = _aspects(spark, sf)
    decided = a.select("asset_id", "day", F.col("raw_aspect").alias("aspect"), "rul_lower", F.lit("full_service").alias("duty"))
    return I.display_rows(_grid(a), decided)


@query(_SHOWN + " SELECT asset_id, day, shown_aspect, reported FROM sh")
def display_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(spark, sf).select("asset_id", "day", "shown_aspect", "reported")


@query(_SHOWN + ", k AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY day DESC) AS k FROM sh), q AS (SELECT asset_id, max(CASE WHEN k = 1 THEN shown_aspect END) AS now, max(shown_aspect) AS peak FROM k WHERE k <= 21 GROUP BY 1) SELECT asset_id, CASE WHEN now > 0 THEN 'status' ELSE 'review' END AS reason FROM q WHERE now > 0 OR peak > 0")
def surfaced_assets(spark: SparkSession, sf: str) -> DataFrame:
    return I.surfaced(_shown(spark, sf))


_STREAM_DAYS = "available_at <= (SELECT max(available_at) FROM daily) - INTERVAL {} DAY"


@query(
    _TREND
    + " SELECT asset_id, day, round(x_smooth, 6) AS x_smooth, round(x_slope, 4) AS x_slope, round(x_vol, 8) AS x_vol FROM t WHERE "
    + _STREAM_DAYS.format(3)
)
def streamed_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Asset-days in batches of some ten days, in no order within them; the days that the watermark has closed."""
    from vigilo.streaming import run, windows

    d = V.daily(spark, sf).withColumn("x", F.when(F.col("data_quality_ok"), F.col("charge"))).select("asset_id", "day", "x", "data_quality_ok", "context_supported")
    out = run.replayed(lambda s: windows.stream_windows(s, "x", "3 days"), d.withColumn("wave", F.floor(F.dayofmonth("day") / 11)), "streamed-trend", order="wave")
    return out.where("reported").select("asset_id", "day", r("smooth").alias("x_smooth"), r("slope", 4).alias("x_slope"), r("vol", 8).alias("x_vol"))


@query(_REPLAY + " SELECT asset_id, day FROM fired WHERE day + 1 <= (SELECT max(available_at) FROM daily WHERE charge >= 40) - INTERVAL 2 DAY")
def streamed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    from vigilo.streaming import alerts, run

    d = V.daily(spark, sf).select("asset_id", "day", "available_at", "charge").withColumn("wave", F.floor(F.dayofmonth("day") / 11))
    return run.replayed(lambda s: alerts.stream_alerts(s, "charge", 40.0, 2, 3, "2 days"), d, "streamed-alerts", order="wave").select("asset_id", "day")


@query()
def dashboard_payload(spark: SparkSession, sf: str) -> DataFrame:
    return I.dashboard_payload(_shown(spark, sf))


@query()
def detector_tournament(spark: SparkSession, sf: str) -> DataFrame:
    from vigilo.plans.experiments import tournament

    d = V.daily(spark, sf).withColumn("context_supported", F.lit(True))
    scores = {"raw": F.col("charge"), "mahalanobis": X.Mahalanobis(["peak", "charge"]).fit(_reference(d)).score()}
    t = tournament(d, V.episodes(spark), scores, ntz("2024-01-14 00:00:00"), 0.8)
    return t.select("name", r("threshold", 5).alias("threshold"), "alarms", "n_episodes", "detected", r("precision").alias("precision"))


_POLICIES = """WITH res AS (SELECT 'm' || CAST(2 + p_size % 3 AS VARCHAR) || '_a' || CAST(4 + p_partkey % 3 AS VARCHAR) || '_g' || CAST(1 + (p_partkey // 3) % 3 AS VARCHAR) AS policy, 2 + p_size % 3 AS m, 4 + p_partkey % 3 AS age, 1 + (p_partkey // 3) % 3 AS gap, p_retailprice / 10000 AS availability, (p_size % 11)::DOUBLE AS unmatched FROM part)"""


@query(
    _POLICIES
    + """, base AS (SELECT avg(availability) AS a0, avg(unmatched) AS u0 FROM res WHERE policy = 'm3_a4_g1'), me AS (SELECT policy, m, age, gap, avg(availability) AS availability, avg(unmatched) AS unmatched FROM res WHERE policy <> 'm3_a4_g1' GROUP BY 1, 2, 3, 4)
 SELECT policy FROM me, base WHERE availability >= a0 - 0.002 AND unmatched <= u0 ORDER BY availability DESC, m DESC, age, gap LIMIT 1"""
)
def policy_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Policies and their results by the parts' numbers: size, key and price."""
    from vigilo.plans.experiments import pick_policy

    k, size = F.col("p_partkey"), F.col("p_size")
    m, age, gap = 2 + size % 3, 4 + k % 3, 1 + F.floor(k / 3) % 3
    name = F.concat(F.lit("m"), m.cast("string"), F.lit("_a"), age.cast("string"), F.lit("_g"), gap.cast("string"))
    df = V.table(spark, sf, "part").select(name.alias("policy"), m.alias("min_observations"), age.alias("max_age_days"), gap.alias("max_gap_days"), (F.col("p_retailprice") / 10000).alias("availability"), (size % 11).cast("double").alias("unmatched"))
    return pick_policy(df, "m3_a4_g1", -0.002).select("policy")


_REPAIRS = [(1, "A01", "2024-01-17 02:30:00"), (2, "A04", "2024-01-21 04:00:00"), (3, "A07", "2024-01-27 23:00:00"), (4, "A10", "2024-01-20 00:00:00"), (5, "A12", "2024-01-12 03:00:00"), (6, "A15", "2024-01-14 03:00:00")]


@query(
    _BASE
    + ", jobs(job_id, asset_id, completed_at) AS (VALUES "
    + ", ".join(f"({j}, '{a}', TIMESTAMP '{t}')" for j, a, t in _REPAIRS)
    + """), w AS (SELECT *, DATE '2024-01-24' < CAST(CASE WHEN date_trunc('day', completed_at) = completed_at THEN completed_at ELSE date_trunc('day', completed_at) + INTERVAL 1 DAY END AS DATE) + 1 AS waiting FROM jobs),
 q AS (SELECT d.asset_id, count(*) AS observed_days, bool_and(data_quality_ok AND charge IS NOT NULL) AS ok, sum(CASE WHEN abs(charge - loc) / scale > 1.0 THEN 1 ELSE 0 END) AS k, count(loc) AS checked FROM daily d LEFT JOIN b USING (asset_id) WHERE day >= DATE '2024-01-24' AND day < DATE '2024-01-27' AND available_at <= TIMESTAMP '2024-01-27 06:00:00' GROUP BY 1),
 x AS (SELECT w.job_id, w.asset_id, coalesce(observed_days, 0) AS observed_days, NOT waiting AND coalesce(observed_days, 0) = 3 AND coalesce(ok, false) AND coalesce(checked, 0) > 0 AS complete, k FROM w LEFT JOIN q USING (asset_id))
 SELECT CAST(job_id AS INTEGER) AS job_id, asset_id, observed_days, CAST(CASE WHEN complete THEN k END AS BIGINT) AS abnormal_days, CASE WHEN NOT complete THEN 'insufficient_evidence' WHEN k >= 2 THEN 'abnormality_persists' WHEN k = 0 THEN 'signal_recovered' ELSE 'insufficient_evidence' END AS status FROM x"""
)
def repair_verification(spark: SparkSession, sf: str) -> DataFrame:
    d, b = _baseline(spark, sf)
    jobs = spark.createDataFrame(_REPAIRS, "job_id int, asset_id string, t string").select("job_id", "asset_id", F.col("t").cast("timestamp_ntz").alias("completed_at"))
    ref = b.select("asset_id", F.lit("charge").alias("channel"), "loc", "scale")
    return M.verify_repairs(jobs, ref, d.withColumn("context_supported", F.lit(True)), ["charge"], ntz("2024-01-27 06:00:00"), limit=1.0)


# ---- inspection: masks and two views -----------------------------------------------------------------------------


@query(
    f"""WITH {V.DAILY}, ch AS (SELECT asset_id, day, 'charge' AS channel, charge AS x, charge_completeness AS comp, d.* EXCLUDE (asset_id, day) FROM daily d UNION ALL SELECT asset_id, day, 'peak', peak, peak_completeness, d.* EXCLUDE (asset_id, day) FROM daily d),
 q AS (SELECT asset_id, day, channel, x, CASE WHEN NOT context_supported THEN 'context' WHEN data_quality_ok <> (quality_ready AND least(charge_completeness, peak_completeness) >= 0.9) THEN 'inconsistent_quality' WHEN NOT quality_ready THEN 'not_ready' WHEN comp < 0.9 THEN 'incomplete' WHEN x IS NULL THEN 'no_value' END AS refused FROM ch)
 SELECT asset_id, day, channel, refused IS NULL AS usable, round(CASE WHEN refused IS NULL THEN x END, 6) AS value, refused FROM q"""
)
def quality_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Each channel by its own completeness, so that one degraded channel does not void the day."""
    from vigilo.operators.admission import quality_mask

    return quality_mask(V.daily(spark, sf), ["charge", "peak"]).withColumn("value", r("value"))


@query(f"WITH {V.DAILY} SELECT asset_id, CASE WHEN count(*) FILTER (WHERE context_supported) >= 3 THEN round(quantile_cont(ambient_mean, 0.5) FILTER (WHERE context_supported), 6) END AS ambient_mean, CASE WHEN count(*) FILTER (WHERE context_supported) >= 3 THEN round(quantile_cont(load_proxy_mean, 0.5) FILTER (WHERE context_supported), 6) END AS load_proxy_mean FROM daily GROUP BY 1")
def context_medians(spark: SparkSession, sf: str) -> DataFrame:
    from vigilo.operators.admission import context_medians

    return context_medians(V.daily(spark, sf), ["ambient_mean", "load_proxy_mean"]).select("asset_id", r("ambient_mean").alias("ambient_mean"), r("load_proxy_mean").alias("load_proxy_mean"))


def _views(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Charge on the asset's and on the fleet's baseline; some assets with flaws, so that admission has to refuse them."""
    d, b = _baseline(spark, sf)
    own = b.select("asset_id", "loc", "scale", F.col("fleet_loc").alias("fl"), F.col("fleet_scale").alias("fs"))
    rows = d.join(own, "asset_id").withColumn("context_supported", F.lit(True)).withColumn("res_charge", F.col("charge")).withColumn("preprocessing_fitted_at", ntz("2024-01-01 00:00:00"))
    a = rows.withColumn("charge_hx", (F.col("charge") - F.col("loc")) / F.col("scale"))
    a = a.withColumn("model_version", F.when((F.col("asset_id") == "A05") & (F.col("day") >= "2024-01-15"), "m2").otherwise("m1"))
    f = rows.withColumn("charge_hx", (F.col("charge") - F.col("fl")) / F.col("fs")).withColumn("model_version", F.lit("m1"))
    f = f.withColumn("preprocessing_fitted_at", F.when(F.col("asset_id") == "A06", ntz("2024-01-02 00:00:00")).otherwise(F.col("preprocessing_fitted_at")))
    return a, f.withColumn("res_charge", F.when(F.col("asset_id") == "A07", F.col("charge") + 1).otherwise(F.col("charge")))


@query(
    _BASE
    + """, n AS (SELECT d.asset_id, count(*) FILTER (WHERE quality_ready AND charge_completeness >= 0.9 AND charge IS NOT NULL) AS admitted, count(*) AS matched_days, count(DISTINCT day >= DATE '2024-01-15') AS halves FROM daily d JOIN b USING (asset_id) GROUP BY 1),
 p AS (SELECT n.*, b.loc, b.scale, fl, fs, list_filter([CASE WHEN asset_id = 'A05' AND halves = 2 THEN 'asset_reference:model_version_not_constant' END, CASE WHEN asset_id = 'A05' AND halves = 2 THEN 'asset_reference:no_identity' END, CASE WHEN asset_id = 'A06' THEN 'different_fit_times' END, CASE WHEN matched_days < 5 THEN 'few_shared_days' END], lambda x: x IS NOT NULL) AS problems,
 list_filter([CASE WHEN admitted < 5 THEN 'few_matched_days' END, CASE WHEN asset_id = 'A07' AND admitted > 0 THEN 'residuals_differ' END], lambda x: x IS NOT NULL) AS algebra FROM n JOIN b USING (asset_id), fl)
 SELECT asset_id, CASE WHEN len(algebra) = 0 AND len(problems) = 0 THEN 'recovered' WHEN len(algebra) = 0 AND matched_days >= 5 THEN 'demonstration' ELSE 'unavailable' END AS status, array_to_string(list_concat(problems, algebra), ',') AS reasons, matched_days, admitted,
 CASE WHEN len(algebra) = 0 THEN round(loc - fl, 2) END AS location_offset, CASE WHEN len(algebra) = 0 THEN round(scale / fs, 4) END AS scale_ratio, CASE WHEN len(algebra) = 0 THEN abs(scale / fs - 1) > 0.05 END AS scale_changed FROM p"""
)
def view_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Two views of every asset: identity over all rows, matched supported days, both baselines recovered from the indices."""
    from vigilo.operators.admission import compare_references

    got = compare_references(*_views(spark, sf), ["charge"])
    return got.select("asset_id", "status", F.array_join("reasons", ",").alias("reasons"), "matched_days", "admitted", r("location_offset", 2).alias("location_offset"), r("scale_ratio", 4).alias("scale_ratio"), "scale_changed")


_WORK_SQL = """work AS (SELECT o_orderkey AS job_id, 'A' || CASE WHEN o_custkey < 10 THEN '0' ELSE '' END || CAST(o_custkey AS VARCHAR) AS asset_id, TIMESTAMP '2024-01-08 00:00:00' + to_hours(CAST(o_orderkey % 600 AS BIGINT)) AS started_at FROM orders),
 jb AS (SELECT job_id, asset_id, started_at, started_at + to_hours(CAST(1 + job_id % 5 AS BIGINT)) AS completed_at, started_at + to_hours(CAST(1 + job_id % 5 + job_id % 3 AS BIGINT)) AS recorded_at,
 CAST(CAST(started_at AS DATE) + 6 AS TIMESTAMP) + INTERVAL 6 HOUR AS as_of, started_at - to_hours(CAST(job_id % 40 AS BIGINT)) + INTERVAL 1 HOUR AS reviewed_at FROM work)"""


def _work(spark: SparkSession, sf: str) -> DataFrame:
    """A maintenance job for each order: the customer's asset, hours by the order's number."""
    hours = lambda start, n: F.timestamp_add("HOUR", n.cast("int"), start)
    o = V.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    asset = F.concat(F.lit("A"), F.when(F.col("o_custkey") < 10, "0").otherwise(""), F.col("o_custkey").cast("string"))
    w = o.select(k.alias("job_id"), asset.alias("asset_id"), hours(ntz("2024-01-08 00:00:00"), k % 600).alias("started_at"))
    j, at = F.col("job_id"), F.col("started_at")
    as_of = hours(F.date_add(at.cast("date"), 6).cast("timestamp_ntz"), F.lit(6))
    return w.select("job_id", "asset_id", "started_at", hours(at, 1 + j % 5).alias("completed_at"), hours(at, 1 + j % 5 + j % 3).alias("recorded_at"), as_of.alias("as_of"), hours(at, 1 - j % 40).alias("reviewed_at"))


_REFERENCE = f"""WITH {V.DAILY}, {_WORK_SQL}, us AS (SELECT *, data_quality_ok AND peak IS NOT NULL AND charge IS NOT NULL AND ambient_mean IS NOT NULL AS u FROM daily),
 k AS (SELECT asset_id, day, day - CAST(row_number() OVER (PARTITION BY asset_id ORDER BY day) AS INTEGER) AS g FROM us WHERE u), ru AS (SELECT asset_id, min(day) AS s, max(day) AS e FROM k GROUP BY asset_id, g),
 wi AS (SELECT job_id, jb.asset_id, max(least(e, CAST(started_at AS DATE) - 1)) AS last FROM jb JOIN ru ON jb.asset_id = ru.asset_id AND s <= CAST(started_at AS DATE) - 1 AND least(e, CAST(started_at AS DATE) - 1) - s + 1 >= 4 GROUP BY 1, 2),
 hd AS (SELECT job_id, last, us.* FROM wi JOIN us ON us.asset_id = wi.asset_id AND us.day > last - 4 AND us.day <= last),
 md AS (SELECT job_id, last, max(available_at) AS ended_at, min(ambient_mean) AS lo, max(ambient_mean) AS hi, quantile_cont(charge, 0.5) AS cl, quantile_cont(peak, 0.5) AS pl FROM hd GROUP BY 1, 2),
 rf AS (SELECT job_id, any_value(md.last) AS last, any_value(ended_at) AS ended_at, any_value(lo) AS lo, any_value(hi) AS hi, any_value(cl) AS cl, any_value(pl) AS pl, 1.4826 * quantile_cont(abs(charge - cl), 0.5) AS cs, 1.4826 * quantile_cont(abs(peak - pl), 0.5) AS ps FROM md JOIN hd USING (job_id) GROUP BY 1)"""


@query(_REFERENCE + " SELECT job_id, jb.asset_id, last - 3 AS first, last, round(cl, 6) AS charge_loc, round(cs, 6) AS charge_scale, round(pl, 6) AS peak_loc, round(ps, 6) AS peak_scale, round(lo, 6) AS ambient_lo, round(hi, 6) AS ambient_hi FROM rf JOIN jb USING (job_id)")
def repair_reference(spark: SparkSession, sf: str) -> DataFrame:
    """The latest four consecutive usable days before each order's job, as its healthy reference."""
    from vigilo.operators import repair

    d = V.daily(spark, sf).withColumn("context_supported", F.lit(True))
    got = repair.references(_work(spark, sf), d, ["charge", "peak"], ["ambient_mean"], 4)
    ch = lambda c, x: r(F.col("channels")[c][x]).alias(f"{c}_{x}")
    cx = F.col("contexts")["ambient_mean"]
    return got.select("job_id", "asset_id", "first", "last", ch("charge", "loc"), ch("charge", "scale"), ch("peak", "loc"), ch("peak", "scale"), r(cx["lo"]).alias("ambient_lo"), r(cx["hi"]).alias("ambient_hi"))


@query(
    _REFERENCE
    + """, lw AS (SELECT a.job_id, min(b.started_at) AS later_at FROM jb a JOIN jb b ON a.asset_id = b.asset_id AND a.job_id <> b.job_id AND b.started_at >= a.started_at AND b.recorded_at <= a.as_of GROUP BY 1),
 ps AS (SELECT jb.job_id, count(*) AS n, bool_and(u) AS ok, bool_and(coalesce(ambient_mean BETWEEN lo AND hi, false)) AS inside, sum(CASE WHEN abs(charge - cl) / cs > 3 THEN 1 ELSE 0 END) AS kc, sum(CASE WHEN abs(peak - pl) / ps > 3 THEN 1 ELSE 0 END) AS kp
 FROM jb JOIN us ON us.asset_id = jb.asset_id AND us.day >= CAST(as_of AS DATE) - 3 AND us.day < CAST(as_of AS DATE) AND us.available_at <= as_of LEFT JOIN rf USING (job_id) GROUP BY 1),
 q AS (SELECT jb.*, rf.last, coalesce(n, 0) AS n, greatest(kc, kp) AS k, CASE WHEN recorded_at > as_of THEN 'not_recorded' WHEN rf.last IS NULL THEN 'no_reference' WHEN coalesce(cs <= 1e-9, true) OR coalesce(rf.ps <= 1e-9, true) THEN 'flat_reference' WHEN greatest(ended_at, reviewed_at) > started_at THEN 'reviewed_too_late'
 WHEN later_at <= as_of THEN 'later_work' WHEN CAST(as_of AS DATE) - 3 < CAST(CASE WHEN date_trunc('day', completed_at) = completed_at THEN completed_at ELSE date_trunc('day', completed_at) + INTERVAL 1 DAY END AS DATE) + 1 THEN 'waiting'
 WHEN coalesce(n, 0) <> 3 OR NOT coalesce(ok, false) THEN 'incomplete_window' WHEN NOT inside THEN 'outside_context' WHEN greatest(kc, kp) >= 2 THEN 'repeated_departures' WHEN greatest(kc, kp) = 0 THEN 'within_limits' ELSE 'mixed_readings' END AS reason
 FROM jb LEFT JOIN rf USING (job_id) LEFT JOIN lw USING (job_id) LEFT JOIN ps USING (job_id))
 SELECT job_id, asset_id, last - 3 AS reference_first, last AS reference_last, n AS observed_days, CAST(CASE WHEN reason IN ('repeated_departures', 'within_limits', 'mixed_readings') THEN k END AS BIGINT) AS abnormal_days,
 CASE reason WHEN 'repeated_departures' THEN 'abnormality_persists' WHEN 'within_limits' THEN 'signal_recovered' ELSE 'insufficient_evidence' END AS status, reason FROM q"""
)
def repair_assessment(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's job held against its own reference; later work on the asset voids it."""
    from vigilo.operators import repair

    d = V.daily(spark, sf).withColumn("context_supported", F.lit(True))
    return repair.assess_repairs(_work(spark, sf), d, ["charge", "peak"], ["ambient_mean"], repair.RepairPolicy(reference_days=4))


#: What befalls a planned job, by its number: (divisor, rest, nights later, sequence, type, window in days, minutes).
_FATE = [
    (3, 0, 1, 0, "duration", None, True),
    (4, 1, 2, 0, "rescheduled", 6, False),
    (5, 2, 3, 0, "work_done", None, False),
    (10, 2, 4, 0, "verified", None, False),
    (7, 3, 2, 1, "removed", None, False),
    (14, 3, 5, 0, "reopened", 8, False),
]


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Planner events of a job for each order: planned, and then what its number says."""
    w = _work(spark, sf).select("job_id", "asset_id")
    k, first = F.col("job_id"), F.date_add(F.lit("2024-01-08").cast("date"), (F.col("job_id") % 8).cast("int"))
    event = lambda after, seq, kind, window, priority, minutes: F.struct(
        F.date_add(first, after).alias("night"), F.lit(seq).alias("seq"), F.lit(kind).alias("type"), window.cast("date").alias("window"), priority.cast("int").alias("priority"), minutes.cast("int").alias("minutes")
    )
    none = F.lit(None)
    planned = event(0, 0, "planned", F.date_add(first, (1 + k % 5).cast("int")), 1 + k % 4, none)
    later = [F.when(k % d == rest, event(after, seq, kind, F.date_add(first, window) if window else none, none, 30 + (k % 10) * 25 if timed else none)) for d, rest, after, seq, kind, window, timed in _FATE]
    return w.select("job_id", "asset_id", F.explode(F.array_compact(F.array(planned, *later))).alias("e")).select("job_id", "asset_id", "e.*")


_JOBSQL = (
    f"""WITH {_WORK_SQL}, kk AS (SELECT job_id, asset_id, DATE '2024-01-08' + CAST(job_id % 8 AS INTEGER) AS d FROM work),
 ev AS (SELECT job_id, asset_id, d AS night, 0 AS seq, 'planned' AS type, d + CAST(1 + job_id % 5 AS INTEGER) AS window_, CAST(1 + job_id % 4 AS INTEGER) AS priority, CAST(NULL AS INTEGER) AS minutes FROM kk"""
    + "".join(
        f" UNION ALL SELECT job_id, asset_id, d + {after}, {seq}, '{kind}', {f'd + {window}' if window else 'NULL'}, NULL, {'CAST(30 + (job_id % 10) * 25 AS INTEGER)' if timed else 'NULL'} FROM kk WHERE job_id % {d} = {rest}"
        for d, rest, after, seq, kind, window, timed in _FATE
    )
    + """), e AS (SELECT *, CAST(night AS VARCHAR) || '#' || seq AS k FROM ev WHERE night <= DATE '2024-01-17'),
 st AS (SELECT job_id, any_value(asset_id) AS asset_id, arg_max(CASE type WHEN 'work_done' THEN 'work_done' WHEN 'verified' THEN 'done' WHEN 'removed' THEN 'removed' ELSE 'planned' END, k) FILTER (WHERE type IN ('planned', 'rescheduled', 'reopened', 'work_done', 'verified', 'removed')) AS state,
 CAST(arg_max(window_, k) FILTER (WHERE type IN ('planned', 'rescheduled', 'reopened')) AS DATE) AS "window", CAST(arg_max(priority, k) FILTER (WHERE type IN ('planned', 'rescheduled', 'reordered') AND priority IS NOT NULL) AS INTEGER) AS priority,
 CAST(coalesce(arg_max(minutes, k) FILTER (WHERE type = 'duration' AND minutes IS NOT NULL), 60) AS INTEGER) AS minutes FROM e GROUP BY 1)"""
)


@query(_JOBSQL + ' SELECT job_id, asset_id, state, "window", priority, minutes FROM st')
def job_state_asof(spark: SparkSession, sf: str) -> DataFrame:
    return M.job_states(_jobs(spark, sf), F.lit("2024-01-17").cast("date"))


@query(_JOBSQL + ' SELECT job_id, "window", CAST(sum(minutes) OVER q AS BIGINT) AS used_minutes, sum(minutes) OVER q > 240 AS rolls_over FROM st WHERE state IN (\'planned\', \'work_done\') WINDOW q AS (PARTITION BY "window" ORDER BY priority, job_id ROWS UNBOUNDED PRECEDING)')
def capacity_rollover(spark: SparkSession, sf: str) -> DataFrame:
    jobs = M.job_states(_jobs(spark, sf), F.lit("2024-01-17").cast("date")).where(F.col("state").isin("planned", "work_done"))
    return M.capacity(jobs, 240).select("job_id", "window", "used_minutes", "rolls_over")


@query(_ASPECT + ", " + _JOBSQL.removeprefix("WITH ") + " SELECT asset_id FROM ra WHERE day = DATE '2024-01-17' AND raw >= 1 AND asset_id NOT IN (SELECT asset_id FROM st WHERE state IN ('planned', 'work_done') AND \"window\" = DATE '2024-01-18')")
def flagged_without_job(spark: SparkSession, sf: str) -> DataFrame:
    on = F.lit("2024-01-17").cast("date")
    open_jobs = M.job_states(_jobs(spark, sf), on).where(F.col("state").isin("planned", "work_done") & (F.col("window") == F.lit("2024-01-18").cast("date")))
    return _aspects(spark, sf).where((F.col("day") == on) & (F.col("raw_aspect") >= 1)).join(open_jobs, "asset_id", "left_anti").select("asset_id")


@query(
    f"""WITH {V.DAILY}, f AS (SELECT asset_id, min(day) AS first FROM daily GROUP BY 1), p AS (SELECT d.*, first FROM daily d JOIN f USING (asset_id) WHERE day < first + 14 AND available_at <= TIMESTAMP '2024-01-20'), s AS (SELECT asset_id, any_value(first) AS first, count(DISTINCT day) AS days, bool_and(data_quality_ok AND charge IS NOT NULL) AS ok, quantile_cont(charge, 0.5) AS loc FROM p GROUP BY 1),
 o AS (SELECT p.asset_id, 1.4826 * quantile_cont(abs(charge - loc), 0.5) AS scale FROM p JOIN s USING (asset_id) GROUP BY 1)
 SELECT s.asset_id, first + 14 AS ready_on, days, round(loc, 6) AS loc, round(scale, 6) AS scale, CASE WHEN NOT (CAST(first + 14 AS TIMESTAMP) <= TIMESTAMP '2024-01-20' AND days = 14 AND ok) THEN 'reference_incomplete' WHEN coalesce(scale <= 1e-9, true) THEN 'reference_flat' ELSE 'accepted' END AS status FROM s JOIN o USING (asset_id)"""
)
def onboarding(spark: SparkSession, sf: str) -> DataFrame:
    d = V.daily(spark, sf).withColumn("context_supported", F.lit(True))
    return M.onboarding(d, "charge", ntz("2024-01-20 00:00:00"), 14).withColumn("loc", r("loc")).withColumn("scale", r("scale"))


@query(
    f"""WITH {V.DAILY}, z AS (SELECT asset_id, day, coalesce(charge >= 30, false) AS e, data_quality_ok AND coalesce(charge < 60, false) AS a, NOT data_quality_ok OR coalesce(charge >= 55, false) AS u, n_cycles < 5 AS quiet FROM daily)
 SELECT * FROM (SELECT asset_id, day, unnest(list_filter([CASE WHEN e AND NOT a AND NOT u THEN 'missing' END, CASE WHEN a AND u THEN 'both' END, CASE WHEN NOT e AND (a OR u) THEN 'unexpected' END, CASE WHEN u AND quiet THEN 'no_reason' END], lambda x: x IS NOT NULL)) AS violation FROM z)"""
)
def coverage_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """High days should each be assessed or declared unavailable with a reason; what is not so, as rows."""
    from vigilo.operators.reconcile import reconcile

    d = V.daily(spark, sf).withColumn("why", F.when(F.col("n_cycles") >= 5, "channel"))
    keep = ["asset_id", "day", "why"]
    ok = F.col("data_quality_ok")
    return reconcile(d.where("charge >= 30").select(keep), d.where(ok & (F.col("charge") < 60)).select(keep), d.where(~ok | F.coalesce(F.col("charge") >= 55, F.lit(False))).select(keep), ["asset_id", "day"], "why")


@query(
    f"""WITH {V.DAILY}, {_WORK_SQL} SELECT job_id, CAST(min(d.day - CAST(started_at AS DATE)) AS INTEGER) AS days_after, arg_min(d.day, d.day) AS day FROM jb JOIN daily d ON d.asset_id = jb.asset_id AND d.day > CAST(started_at AS DATE) AND d.day <= CAST(started_at AS DATE) + 8
 WHERE quality_ready AND charge < 30 GROUP BY 1"""
)
def verification_search(spark: SparkSession, sf: str) -> DataFrame:
    """For each order's job the first of the eight days after it that reads as recovered."""
    from vigilo.operators.reconcile import first_match

    d = V.daily(spark, sf).select("asset_id", "day", "quality_ready", "charge")
    j = _work(spark, sf).select("job_id", "asset_id", F.col("started_at").cast("date").alias("start"))
    after = F.datediff("day", "start")
    met = j.join(d, "asset_id").where((after >= 1) & (after <= 8)).select("job_id", after.alias("days_after"), "day", (F.col("quality_ready") & (F.col("charge") < 30)).alias("ok"))
    return first_match(met, "job_id", ["days_after"], "ok")


# ---- ingestion ---------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name_key FROM part")
def name_squash(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select("p_partkey", text.squash(F.col("p_name")).alias("name_key"))


@query(f"WITH {V.CYC} SELECT event_id, round(hour_of_day, 6) AS hour_of_day, round(charge * load_proxy, 8) AS charge_integral, round(CASE WHEN load_proxy <> 0 THEN charge / load_proxy END, 8) AS mean_current, split_part(replace(replace(asset_id || '-DOOR 1', ' ', '-'), '_', '-'), '-', 1) AS train_from_asset FROM cyc")
def derive_columns(spark: SparkSession, sf: str) -> DataFrame:
    c = V.cycles(spark, sf).withColumn("asset_name", F.concat("asset_id", F.lit("-DOOR 1")))
    return c.select("event_id", r(text.hour_of_day(F.col("ts"))).alias("hour_of_day"), r(F.col("charge") * F.col("load_proxy"), 8).alias("charge_integral"), r(text.mean_current(F.col("charge"), F.col("load_proxy")), 8).alias("mean_current"), text.first_token(F.col("asset_name")).alias("train_from_asset"))


@query("SELECT o_orderkey, CASE lower(trim(o_orderstatus)) WHEN 'f' THEN true WHEN 'o' THEN false WHEN 'p' THEN false END AS confirmed FROM orders")
def boolean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "orders").select("o_orderkey", text.boolean(F.col("o_orderstatus"), {"f": True, "o": False, "p": False}).alias("confirmed"))


@query(f"WITH {V.EPS} SELECT CAST(episode_id AS INTEGER) AS episode_id, asset_id, CASE WHEN fault_ts <= TIMESTAMP '2024-01-22 00:00:00' THEN 'development' ELSE 'test' END AS part FROM eps")
def episode_split(spark: SparkSession, sf: str) -> DataFrame:
    from vigilo.sources.episodes import split

    dev, test = split(V.episodes(spark), ntz("2024-01-22 00:00:00"))
    return dev.select("episode_id", "asset_id", F.lit("development").alias("part")).unionByName(test.select("episode_id", "asset_id", F.lit("test").alias("part")))


_READY = f"""WITH {V.CYC} SELECT count(*) AS rows, count(DISTINCT asset_id) AS assets, count(DISTINCT CAST(ts AS DATE)) AS observed_days, round(count(*) FILTER (WHERE peak IS NULL) / count(*)::DOUBLE, 6) AS null_peak,
 count(*) FILTER (WHERE NOT context_supported) AS unsupported, (SELECT count(*) FROM (SELECT asset_id, ts FROM cyc GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicate_keys, (SELECT count(*) FROM (SELECT asset_id FROM cyc GROUP BY 1 HAVING count(DISTINCT train_id) > 1)) AS assets_on_two_trains FROM cyc"""


@query(_READY)
def readiness_report(spark: SparkSession, sf: str) -> DataFrame:
    from vigilo.sources.readiness import measure

    return measure(V.cycles(spark, sf), "peak").withColumn("null_peak", r("null_peak"))


@query(f"WITH {V.CYC}, {V.EPS} SELECT DISTINCT asset_id FROM cyc WHERE asset_id NOT IN (SELECT asset_id FROM eps)")
def assets_without_episode(spark: SparkSession, sf: str) -> DataFrame:
    return V.cycles(spark, sf).select("asset_id").distinct().join(V.episodes(spark), "asset_id", "left_anti")


@query(f"WITH {V.DAILY}, k AS (SELECT asset_id, day, sha256(asset_id || '|' || CAST(day AS VARCHAR) || '|' || CAST(n_cycles AS VARCHAR)) AS row_hash FROM daily) SELECT * FROM k")
def row_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return V.daily(spark, sf).select("asset_id", "day", F.sha2(F.concat_ws("|", "asset_id", F.col("day").cast("string"), F.col("n_cycles").cast("string")), 256).alias("row_hash"))


# ---- the same operators on the star schema -----------------------------------------------------------------------

_SHIP = """WITH c AS (SELECT l_suppkey % 50 AS asset, s_nationkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, l_extendedprice AS x, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
 d AS (SELECT asset, day, count(*) AS n, quantile_cont(x, 0.5) AS x, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS x_iqr, avg(q) AS q_rate FROM c GROUP BY 1, 2)"""


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    li = V.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    s = V.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    c = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("l_suppkey") % 50).alias("asset"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("day"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("q"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return c.groupBy("asset", "day").agg(F.count("*").alias("n"), q.alias("p"), F.avg("q").alias("q_rate")).select("asset", "day", "n", F.col("p")[1].alias("x"), (F.col("p")[2] - F.col("p")[0]).alias("x_iqr"), "q_rate")


@query(_SHIP + " SELECT asset, day, n, round(x, 4) AS x, round(x_iqr, 4) AS x_iqr, round(q_rate, 6) AS q_rate FROM d")
def shipment_features(spark: SparkSession, sf: str) -> DataFrame:
    return shipments(spark, sf).select("asset", "day", "n", r("x", 4).alias("x"), r("x_iqr", 4).alias("x_iqr"), r("q_rate").alias("q_rate"))


@query(_SHIP + " SELECT asset, day, round(avg(x) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 7) AS x_mean, rank() OVER (PARTITION BY day ORDER BY round(x, 4) DESC) AS place FROM d")
def shipment_ranking(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("asset").orderBy("day").rowsBetween(-5, 0)
    p = Window.partitionBy("day").orderBy(F.desc(r("x", 4)))
    return shipments(spark, sf).select("asset", "day", r(F.avg("x").over(w), 7).alias("x_mean"), F.rank().over(p).cast("long").alias("place"))
