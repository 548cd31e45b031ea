"""Condition normalisation, per-asset robust baselines and the multivariate health index.

Fits reduce the data to sufficient statistics with one or two aggregations; only those reach the driver, where systems
of at most a dozen unknowns are solved.  Scoring is plain column arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.operators.ranks import column_quantiles

MAD_TO_SIGMA = 1.4826
CYCLIC = {"hour_of_day": 24.0}


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


@dataclass
class ConditionNormaliser:
    """Ridge of a signal on contexts; residuals compare cycles as if run in like conditions."""

    signal: str
    contexts: list[str]
    alpha: float = 1.0
    robust: bool = True
    trim: float = 0.01
    fills: dict[str, float] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    terms: list[str] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def design(self) -> list[tuple[str, Column]]:
        out = []
        for c in self.contexts:
            x = F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c]))
            if c in CYCLIC:
                for k in (1, 2):
                    angle = x * (2 * math.pi * k / CYCLIC[c])
                    out += [(f"{c}_sin{k}", F.sin(angle)), (f"{c}_cos{k}", F.cos(angle))]
            else:
                out += [(c, x), (f"{c}^2", x * x)]
        return out

    def _solve(self, rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
        p = len(mean)
        z = [(F.col(f"x{i}") - float(mean[i])) / float(scale[i]) for i in range(p)]
        aggs = [F.count("*").alias("n"), F.sum("y").alias("sy")]
        aggs += [F.sum(z[i]).alias(f"s{i}") for i in range(p)] + [F.sum(z[i] * F.col("y")).alias(f"r{i}") for i in range(p)]
        aggs += [F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i + 1)]
        got = rows.agg(*aggs).first()
        n, sy = got["n"], got["sy"]
        s = np.array([got[f"s{i}"] for i in range(p)])
        r = np.array([got[f"r{i}"] for i in range(p)]) - s * sy / n
        g = np.array([[got[f"g{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)]) - np.outer(s, s) / n
        beta = np.linalg.solve(g + self.alpha * np.eye(p), r)
        return beta, sy / n - float(beta @ s) / n

    def fit(self, df: DataFrame) -> ConditionNormaliser:
        if not self.contexts:
            raise ValueError("context columns are required")
        ends = column_quantiles(df, self.contexts, [0.0, 0.5, 1.0])
        for c in self.contexts:
            low, middle, high = ends[c]
            if middle is None:
                raise ValueError(f"no observations for context {c}")
            self.fills[c], self.ranges[c] = float(middle), (float(low), float(high))
        named = self.design()
        self.terms = [n for n, _ in named]
        rows = df.select(*(x.alias(f"x{i}") for i, (_, x) in enumerate(named)), F.col(self.signal).cast("double").alias("y"))
        p = len(named)
        # Standardised over all rows, those without the signal included.
        stats = rows.agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(p)), *(F.stddev_pop(f"x{i}").alias(f"d{i}") for i in range(p)), F.count("y").alias("n")).first()
        if stats["n"] < 5:
            raise ValueError("too few observations of the signal")
        mean = np.array([stats[f"m{i}"] for i in range(p)])
        scale = np.array([stats[f"d{i}"] if stats[f"d{i}"] >= 1e-12 else 1.0 for i in range(p)])
        seen = rows.where("y is not null")
        beta, b0 = self._solve(seen, mean, scale)
        if self.robust and stats["n"] > 100:
            fitted = total([(F.col(f"x{i}") - float(mean[i])) / float(scale[i]) * float(beta[i]) for i in range(p)]) + b0
            off = seen.withColumn("off", F.abs(F.col("y") - fitted))
            cut = column_quantiles(off, ["off"], [1 - self.trim])["off"][0]
            beta, b0 = self._solve(off.where(F.col("off") <= cut), mean, scale)
        # Back on the raw terms, so that scoring needs no standardisation.
        self.coefficients = [float(b / s) for b, s in zip(beta, scale, strict=True)]
        self.intercept = float(b0 - np.sum(beta * mean / scale))
        return self

    def expected(self) -> Column:
        return total([x * b for (_, x), b in zip(self.design(), self.coefficients, strict=True)]) + self.intercept

    def supported(self) -> Column:
        """Every context known and within the fitted range, a tenth of it allowed beyond either end."""
        tests = []
        for c in self.contexts:
            lo, hi = self.ranges[c]
            pad = max((hi - lo) * 0.1, 1e-9)
            tests.append(F.coalesce((F.col(c) >= lo - pad) & (F.col(c) <= hi + pad), F.lit(False)))
        return reduce(lambda a, b: a & b, tests)

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.contexts])
        return df.withColumns(
            {
                f"{prefix}expected": self.expected(),
                f"{prefix}residual": F.col(self.signal) - self.expected(),
                f"{prefix}context_missing": missing,
                f"{prefix}context_supported": self.supported(),
            }
        )

    def explain(self) -> list[tuple[str, float]]:
        """Terms by the size of their coefficients."""
        return sorted(zip(self.terms, self.coefficients, strict=True), key=lambda x: -abs(x[1]))


def robust_location(df: DataFrame, value: str, by: str = "asset_id") -> DataFrame:
    """(by, n, loc, mad): median and scaled median absolute deviation of each group."""
    centre = df.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("loc"), F.count(value).alias("n"))
    off = df.select(by, value).join(centre, by).select(by, F.abs(F.col(value) - F.col("loc")).alias("d"))
    return centre.join(off.groupBy(by).agg((F.percentile("d", F.lit(0.5)) * MAD_TO_SIGMA).alias("mad")), by)


def fit_baseline(daily: DataFrame, value: str, reference_days: int | None = 21, least: int = 5, by: str = "asset_id", day: str = "day") -> DataFrame:
    """(by, loc, scale, fleet_loc, fleet_scale) of each asset's own first ``reference_days``; null days bound nothing.

    Assets with fewer than ``least`` values, or no spread, take the fleet's.
    """
    ref = daily
    if reference_days is not None:
        first = daily.groupBy(by).agg(F.min(day).alias("__first"))
        ref = daily.join(first, by).where(F.col(day) < F.date_add("__first", reference_days))
    own = robust_location(ref.select(by, value), value, by)
    spread = F.when(F.col("mad") > 1e-9, F.col("mad"))
    fleet = own.agg(F.percentile("loc", F.lit(0.5)).alias("fleet_loc"), F.coalesce(F.percentile(spread, F.lit(0.5)), F.lit(1.0)).alias("fleet_scale"))
    enough = F.col("n") >= least
    return own.crossJoin(F.broadcast(fleet)).select(  # the fleet is one row
        by,
        F.when(enough, F.col("loc")).otherwise(F.col("fleet_loc")).alias("loc"),
        F.when(enough & (F.col("mad") > 1e-9), F.col("mad")).otherwise(F.col("fleet_scale")).alias("scale"),
        "fleet_loc",
        "fleet_scale",
    )


def apply_baseline(df: DataFrame, baseline: DataFrame, value: str, out: str = "health_index", by: str = "asset_id") -> DataFrame:
    """Adds ``out`` = (value - loc) / scale and baseline_source; assets without a baseline take the fleet's.

    The fleet's pair comes along as a second, one-row table, so it is there for assets the fit never saw.
    """
    fleet = baseline.agg(F.first("fleet_loc").alias("__fl"), F.first("fleet_scale").alias("__fs"))
    own = baseline.select(by, F.col("loc").alias("__l"), F.col("scale").alias("__s"))
    joined = df.join(own, by, "left").crossJoin(F.broadcast(fleet))  # one row
    score = (F.col(value) - F.coalesce("__l", "__fl")) / F.coalesce("__s", "__fs")
    source = F.when(F.col("__s").isNotNull(), "asset_reference").otherwise("fleet_fallback")
    return joined.withColumn(out, score).withColumn("baseline_source", source).drop("__l", "__s", "__fl", "__fs")


@dataclass
class HealthIndex:
    """Whitened combination of signals along the direction of wear; larger is worse."""

    columns: list[str]
    wear: list[int]
    ridge: float = 1e-6
    whitening: np.ndarray | None = None
    weights: np.ndarray | None = None
    inverse: np.ndarray | None = None

    def fit(self, reference: DataFrame) -> HealthIndex:
        cols, p = self.columns, len(self.columns)
        rows = reference.select(*(F.col(c) * s for c, s in zip(cols, self.wear, strict=True))).toDF(*cols).dropna()
        got = rows.agg(F.count("*").alias("n"), *(F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1))).first()
        if got["n"] < p + 2:
            raise ValueError("too few complete reference rows")
        sigma = np.array([[got[f"c{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)])
        w, v = np.linalg.eigh(sigma + self.ridge * np.eye(p))
        self.whitening = v @ np.diag(w**-0.5) @ v.T
        self.inverse = np.linalg.inv(sigma + self.ridge * np.eye(p))
        raw = np.clip(self.whitening @ np.ones(p), 0, None)
        raw = raw if raw.sum() > 0 else np.ones(p)
        spread = math.sqrt(float(raw @ self.whitening @ sigma @ self.whitening @ raw) * (got["n"] - 1) / got["n"])
        self.weights = self.whitening.T @ raw / (spread or 1.0)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """health_index, anomaly_distance, contributions and completeness; null where a signal is missing."""
        x = [F.col(c) * s for c, s in zip(self.columns, self.wear, strict=True)]
        parts = {f"contribution_{c}": v * float(w) for c, v, w in zip(self.columns, x, self.weights, strict=True)}
        p = len(x)
        square = total([x[i] * x[j] * float(self.inverse[i, j]) for i in range(p) for j in range(p)])
        complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in self.columns])
        return df.withColumns({**parts, "health_index": total(list(parts.values())), "anomaly_distance": F.sqrt(square), "health_inputs_complete": complete})
