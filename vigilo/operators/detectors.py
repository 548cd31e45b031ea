"""Anomaly detectors over asset-days: fits reduce to small parameters, scores are column expressions wherever they can be."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import add, and_
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.operators.features import smooth
from vigilo.session import materialize

KEY = ("asset_id", "day")
#: Complete reference rows without which nothing is fitted.
LEAST_REFERENCE = 5


class Detector(Protocol):
    """Fitted on a reference, scores complete rows; a higher score is more anomalous."""

    needs: list[str]

    def fit(self, reference: DataFrame) -> Detector: ...

    def scored(self, rows: DataFrame, out: str) -> DataFrame:
        """(asset_id, day, out) of each row."""


class _ByColumn:
    """A detector whose score is a column expression."""

    def scored(self, rows: DataFrame, out: str) -> DataFrame:
        return rows.select(*KEY, self.score().alias(out))


@dataclass
class Passthrough(_ByColumn):
    """A score that is there already."""

    column: str

    @property
    def needs(self) -> list[str]:
        return [self.column]

    def fit(self, reference: DataFrame) -> Passthrough:
        return self

    def score(self) -> Column:
        return F.col(self.column).cast("double")


class RawSignal(Passthrough):
    """The signal as measured: what every other detector must beat."""


def reference_frame(daily: DataFrame, start: Column, end: Column, valid: Column | None = None) -> DataFrame:
    """Rows that became available after ``start`` and by ``end``."""
    out = daily.where((F.col("available_at") > start) & (F.col("available_at") <= end))
    return out if valid is None else out.where(F.coalesce(valid, F.lit(False)))


def moments(reference: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population covariance of complete rows, in one aggregation."""
    p = len(columns)
    rows = reference.select(*columns).dropna()
    got = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1))).first()
    n = got["n"]
    if n < LEAST_REFERENCE:
        raise ValueError("fewer than five complete reference rows")
    mean = np.array([got[f"m{i}"] for i in range(p)], float)
    cov = np.array([[got[f"c{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)], float)
    return n, mean, cov


def _spread(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    return np.where(sd > 0, sd, 1.0)


def _quadratic(columns: list[str], mean: np.ndarray, form: np.ndarray) -> Column:
    d = [F.col(c) - float(m) for c, m in zip(columns, mean, strict=True)]
    return reduce(add, [d[i] * d[j] * float(form[i, j]) for i in range(len(d)) for j in range(len(d))])


@dataclass
class Mahalanobis(_ByColumn):
    """Squared distance of standardised columns from the reference centre, maximum-likelihood covariance."""

    needs: list[str]
    mean: np.ndarray | None = None
    inverse: np.ndarray | None = None

    def fit(self, reference: DataFrame) -> Mahalanobis:
        _, self.mean, cov = moments(reference, self.needs)
        scale = np.outer(_spread(cov), _spread(cov))
        self.inverse = np.linalg.pinv(cov / scale) / scale
        return self

    def score(self) -> Column:
        return _quadratic(self.needs, self.mean, self.inverse)


@dataclass
class PCAError(_ByColumn):
    """Length of what the first ``k`` components leave of a standardised row; null where a channel is missing."""

    needs: list[str]
    k: int = 3
    mean: np.ndarray | None = None
    rest: np.ndarray | None = None

    def fit(self, reference: DataFrame) -> PCAError:
        _, self.mean, cov = moments(reference, self.needs)
        scale = np.outer(_spread(cov), _spread(cov))
        _, v = np.linalg.eigh(cov / scale)
        left = v[:, : max(0, len(self.needs) - self.k)]  # ascending eigenvalues: the first are the least
        self.rest = (left @ left.T) / scale
        return self

    def score(self) -> Column:
        square = _quadratic(self.needs, self.mean, self.rest)
        return F.when(square.isNotNull(), F.sqrt(F.greatest(square, F.lit(0.0))))  # rounding may leave it just below zero


def ewma(df: DataFrame, value: str, lam: float = 0.15, out: str = "ewma", by: str = "asset_id", day: str = "day") -> DataFrame:
    """Adds the exponentially weighted mean of the known values so far: one ordered fold per asset."""
    held = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(value).cast("double").alias("v")))).alias("xs"))
    start = F.struct(F.lit(None).cast("double").alias("s"), F.array().cast("array<struct<d:date,e:double>>").alias("o"))

    def step(acc: Column, x: Column) -> Column:
        e = F.when(acc.s.isNull(), x.v).otherwise(acc.s * (1 - lam) + x.v * lam)
        return F.struct(e.alias("s"), F.concat(acc.o, F.array(F.struct(x.d.alias("d"), e.alias("e")))).alias("o"))

    rows = held.select(by, F.explode(F.aggregate("xs", start, step, lambda a: a.o)).alias("o")).select(by, F.col("o.d").alias(day), F.col("o.e").alias(out))
    return df.join(rows, [by, day], "left")


def ewma_chart(daily: DataFrame, reference: DataFrame, value: str, lam: float = 0.15, out: str = "ewma") -> DataFrame:
    """EWMA of (value - centre) / sigma, centre and deviation from the reference, the fleet's medians where it has none."""
    own = reference.groupBy("asset_id").agg(F.percentile(value, F.lit(0.5)).alias("c"), F.stddev_samp(value).alias("s"))
    fleet = own.agg(F.percentile("c", F.lit(0.5)).alias("fc"), F.percentile("s", F.lit(0.5)).alias("fs"))
    good = F.when(F.col("fs") > 1e-9, F.col("fs")).otherwise(1.0)
    z = daily.join(own, "asset_id", "left").crossJoin(F.broadcast(fleet))  # one row
    z = z.withColumn("__z", (F.col(value) - F.coalesce("c", "fc", F.lit(0.0))) / F.when(F.col("s") > 1e-9, F.col("s")).otherwise(good))
    return ewma(z.drop("c", "s", "fc", "fs"), "__z", lam, out).drop("__z")


@dataclass
class EWMA:
    """The chart as a detector; centres and deviations are fitted per asset."""

    column: str
    lam: float = 0.15
    reference: DataFrame | None = None

    @property
    def needs(self) -> list[str]:
        return [self.column]

    def fit(self, reference: DataFrame) -> EWMA:
        self.reference = reference
        return self

    def scored(self, rows: DataFrame, out: str) -> DataFrame:
        return ewma_chart(rows, self.reference, self.column, self.lam, out).select(*KEY, out)


#: Reference points of one cell, about, and query rows that are compared with a cell at a time.
BLOCK_ROWS = 2_000
#: Cells at most; their pivots and bounds are what the driver and every task hold.
MOST_CELLS = 4_096


def _points_of(reference: DataFrame, k: int) -> DataFrame:
    """(x, ids): distinct points with their smallest ``k`` ids; equal rows are one point, so they cost no comparisons."""
    place = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    return reference.select("x", "id", place.alias("r")).where(F.col("r") <= k).groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


@dataclass(frozen=True)
class Cells:
    """Pivots, the reach of each cell, and the distances of its nearest points to its pivot, padded with infinity."""

    pivots: np.ndarray  # cells x columns
    reach: np.ndarray  # cells
    near: np.ndarray  # cells x wanted

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = _distances(x, self.pivots)
        at = d.argmin(axis=1)
        return at, d[np.arange(len(x)), at]

    def visits(self, x: np.ndarray, wanted: int) -> np.ndarray:
        """Which cells can hold one of the ``wanted`` nearest points of each row: rows x cells.

        A point lies no farther than its pivot and its own distance to it together, so the wanted-th smallest of these
        sums bounds the neighbours' distance; a cell whose pivot is farther than that by more than its reach holds none.
        """
        d = _distances(x, self.pivots)
        sums = (d[:, :, None] + self.near[None]).reshape(len(x), -1)
        bound = np.partition(sums, min(wanted, sums.shape[1]) - 1, axis=1)[:, min(wanted, sums.shape[1]) - 1]
        return d - self.reach[None] <= (bound * (1 + 1e-9) + 1e-12)[:, None]


def _cells(reference: DataFrame, wanted: int, size: int) -> tuple[DataFrame, Cells]:
    """(x, ids, cell) of the distinct reference points, and the cells' bounds; pivots are points taken by hash."""
    points = materialize(_points_of(reference, wanted), "near-points")
    n = min(MOST_CELLS, max(1, -(-size // BLOCK_ROWS)))
    pivots = np.array([r.x for r in points.orderBy(F.xxhash64("x"), "x").limit(n).collect()], float)
    start = Cells(pivots, np.zeros(0), np.zeros(0))

    def assign(batches):
        for batch in batches:
            for s in range(0, len(batch), 1024):
                part = batch.iloc[s : s + 1024]
                cell, d = start.home(np.array(part["x"].tolist(), float))
                yield part.assign(cell=cell.astype("int32"), d=d)

    placed = materialize(points.mapInPandas(assign, "x array<double>, ids array<long>, cell int, d double"), "near-cells")
    # Points of several ids count as often, up to the wanted number.
    each = placed.select("cell", "d", F.explode("ids"))
    nearest = each.select("cell", "d", F.row_number().over(Window.partitionBy("cell").orderBy("d")).alias("r")).where(F.col("r") <= wanted)
    held = {r.cell: sorted(r.ds) for r in nearest.groupBy("cell").agg(F.collect_list("d").alias("ds")).collect()}
    far = {r.cell: r.far for r in placed.groupBy("cell").agg(F.max("d").alias("far")).collect()}
    near = np.full((len(pivots), wanted), np.inf)
    for c, ds in held.items():
        near[c, : len(ds)] = ds
    return placed, Cells(pivots, np.array([far.get(c, -np.inf) for c in range(len(pivots))]), near)


def _visiting(queries: DataFrame, cells: Cells, wanted: int) -> DataFrame:
    """(id, x, cell): each query with every cell that can hold one of its nearest points."""
    step = max(1, 4_000_000 // max(1, cells.near.size))

    def visit(batches):
        for batch in batches:
            for s in range(0, len(batch), step):
                part = batch.iloc[s : s + step]
                row, cell = np.nonzero(cells.visits(np.array(part["x"].tolist(), float), wanted))
                yield part.iloc[row].assign(cell=cell.astype("int32"))

    return queries.select("id", "x").mapInPandas(visit, "id long, x array<double>, cell int")


def _nearest(queries: DataFrame, reference: DataFrame, k: int, n_queries: int, n_reference: int, same: bool) -> DataFrame:
    """(q, near): the ``k`` nearest reference rows of each query, nearest first; both have (id, x array<double>).

    Exact, by cells around pivots and the triangle inequality: a query meets only cells that can hold one of its nearest
    rows, some of it at a time, and keeps the best of each.  With ``same`` a row is not its own neighbour.  Ties go to
    the smaller id.
    """
    wanted = k + same
    if wanted < 1:
        return queries.sparkSession.createDataFrame([], "q long, near array<struct<d:double,id:long>>")
    placed, cells = _cells(reference, wanted, n_reference)
    blocks = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_queries // BLOCK_ROWS))))
    left = _visiting(queries, cells, wanted).groupBy("cell", blocks.alias("b")).agg(F.collect_list(F.struct("id", "x")).alias("xs"))
    left = left.select("cell", F.transform("xs", lambda s: s.id).alias("qids"), F.flatten(F.transform("xs", lambda s: s.x)).alias("qx"))
    right = placed.groupBy("cell").agg(F.collect_list(F.struct("x", "ids")).alias("xs"))
    right = right.select("cell", F.transform("xs", lambda s: s.ids).alias("ids"), F.flatten(F.transform("xs", lambda s: s.x)).alias("x"))

    def best(batches):
        for batch in batches:
            for qids, qx, ids, x in zip(batch["qids"], batch["qx"], batch["ids"], batch["x"], strict=True):
                copies = [len(i) for i in ids]
                point = np.repeat(np.arange(len(ids)), copies)
                flat = np.concatenate([np.asarray(i) for i in ids])
                order = np.argsort(flat)
                flat, x = flat[order], np.asarray(x, float).reshape(len(ids), -1)[point[order]]
                qids = np.asarray(qids)
                qx = np.asarray(qx, float).reshape(len(qids), -1)
                step = max(1, 2_000_000 // max(1, x.size))
                for s in range(0, len(qids), step):
                    d = _distances(qx[s : s + step], x)
                    if same:
                        d[qids[s : s + step, None] == flat[None]] = np.inf
                    at = np.argsort(d, axis=1, kind="stable")[:, :k]
                    far = np.take_along_axis(d, at, axis=1)
                    q, c = np.nonzero(np.isfinite(far))
                    yield pd.DataFrame({"q": qids[s + q], "d": far[q, c], "id": flat[at[q, c]]})

    found = left.join(right, "cell").select("qids", "qx", "ids", "x").mapInPandas(best, "q long, d double, id long")
    return found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k).alias("near"))


@dataclass
class LocalOutlierFactor:
    """How much sparser a row's neighbourhood is than those of its neighbours in the reference; columns standardised."""

    needs: list[str]
    k: int = 35
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    model: DataFrame | None = None
    size: int = 0

    def _points(self, df: DataFrame) -> DataFrame:
        return df.withColumn("x", F.array(*((F.col(c) - float(m)) / float(s) for c, m, s in zip(self.needs, self.mean, self.scale, strict=True))))

    def fit(self, reference: DataFrame) -> LocalOutlierFactor:
        self.size, self.mean, cov = moments(reference, self.needs)
        self.scale = _spread(cov)
        rows = materialize(self._points(reference.select(*self.needs).dropna()).select("x", F.monotonically_increasing_id().alias("id")), "lof-reference")
        near = materialize(_nearest(rows, rows, min(self.k, self.size - 1), self.size, self.size, same=True), "lof-near")
        radius = near.select(F.col("q").alias("id"), F.element_at("near", -1)["d"].alias("radius"))
        reach = near.select("q", F.explode("near").alias("n")).select("q", "n.*").join(radius, "id")
        density = reach.groupBy(F.col("q").alias("id")).agg((1 / (F.avg(F.greatest("d", "radius")) + 1e-10)).alias("density"))
        self.model = materialize(rows.join(radius, "id").join(density, "id"), "lof-model")
        return self

    def scored(self, rows: DataFrame, out: str) -> DataFrame:
        held = materialize(self._points(rows.select(*KEY, *self.needs)).select(*KEY, "x", F.monotonically_increasing_id().alias("q")), "lof-rows")
        near = _nearest(held.select(F.col("q").alias("id"), "x"), self.model.select("id", "x"), min(self.k, self.size - 1), held.count(), self.size, same=False)
        met = near.select("q", F.explode("near").alias("n")).select("q", "n.*").join(self.model.select("id", "radius", "density"), "id")
        lof = met.groupBy("q").agg((F.avg("density") * (F.avg(F.greatest("d", "radius")) + 1e-10)).alias(out))
        return held.select(*KEY, "q").join(lof, "q", "left").drop("q")


@dataclass
class IsolationForest:
    """Random isolation trees; a higher score is easier to isolate.

    Each tree grows on ``sample`` reference rows.  All trees' rows, the smallest hashes of the key, reach the driver:
    at most trees x sample, however long the reference.
    """

    needs: list[str]
    trees: int = 300
    sample: int = 256
    seed: int = 0
    grown: list = field(default_factory=list)

    def fit(self, reference: DataFrame) -> IsolationForest:
        drawn = reference.dropna(subset=self.needs).orderBy(F.xxhash64(*KEY, F.lit(self.seed)), *KEY).limit(self.trees * self.sample)
        x = drawn.select(*self.needs).toPandas().to_numpy(float)
        rng = np.random.default_rng(self.seed)
        n = min(self.sample, len(x))
        depth = math.ceil(math.log2(max(n, 2)))
        if len(x) == self.trees * self.sample:
            samples = np.split(rng.permutation(len(x)), self.trees)
        else:
            samples = [rng.choice(len(x), n, replace=False) for _ in range(self.trees)]
        self.grown = [self._grow(x[at], rng, depth) for at in samples]
        self.norm = _path(n)
        return self

    def _grow(self, x: np.ndarray, rng, depth: int):
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(0)
        live = np.flatnonzero(spread > 0)
        if depth == 0 or len(x) <= 1 or not len(live):
            return len(x)
        f = int(rng.choice(live))
        at = rng.uniform(x[:, f].min(), x[:, f].max())
        left = x[:, f] < at
        return f, at, self._grow(x[left], rng, depth - 1), self._grow(x[~left], rng, depth - 1)

    def scored(self, rows: DataFrame, out: str) -> DataFrame:
        trees, norm, needs = self.grown, self.norm, self.needs

        def lengths(node, x, at, depth, total):
            if isinstance(node, int):
                total[at] += depth + _path(node)
                return
            f, cut, a, b = node
            left = x[at, f] < cut
            if left.any():
                lengths(a, x, at[left], depth + 1, total)
            if not left.all():
                lengths(b, x, at[~left], depth + 1, total)

        def apply(batches):
            for b in batches:
                x = b[needs].to_numpy(float)
                ok = np.flatnonzero(np.isfinite(x).all(axis=1))
                total = np.zeros(len(b))
                for t in trees:
                    lengths(t, x, ok, 0, total)
                score = pd.Series(np.nan, index=b.index)
                score.iloc[ok] = 2.0 ** (-total[ok] / len(trees) / norm)
                yield b[list(KEY)].assign(score=score)

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        return rows.select(*KEY, *needs).mapInPandas(apply, ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", score double").withColumnRenamed("score", out)


def _path(n: int) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def run(
    detectors: Mapping[str, Detector],
    daily: DataFrame,
    reference_days: int = 30,
    smooth_days: int = 5,
    *,
    start: Column | None = None,
    end: Column | None = None,
    assets: list[str] | None = None,
    valid: str | None = None,
    reference_valid: str | None = None,
) -> DataFrame:
    """``daily`` with one smoothed score column for each detector, all on the same reference.

    The reference is either the first ``reference_days`` days of the table or, by availability, (start, end], of
    ``assets`` alone if given.  Only with the latter may columns name which rows are scored (``valid``) and which the
    fit may see (``reference_valid``); a row that is not true there never enters a detector's state or the smoothing.
    Rows that lack a needed column have no score; fewer than five complete reference rows leave a detector's column
    null.  Scores are trailing medians over ``smooth_days``, of three days or more, and null on days without quality or
    outside the trained conditions.
    """
    explicit = start is not None or end is not None
    if explicit and (start is None or end is None):
        raise ValueError("a declared reference has both ends")
    if not explicit and (assets is not None or valid or reference_valid):
        raise ValueError("assets and validity go with a declared reference")
    true = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(True)
    if explicit:
        reference = reference_frame(daily, start, end, true(reference_valid))
        reference = reference if assets is None else reference.where(F.col("asset_id").isin(assets))
    else:
        first = daily.agg(F.min("day")).first()[0]
        reference = daily.where(F.col("day") < F.date_add(F.lit(first).cast("date"), reference_days))
    complete = {n: reduce(and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in d.needs]) for n, d in detectors.items()}
    found = reference.agg(*(F.count_if(c).alias(n) for n, c in complete.items())).first()
    out = daily
    for name, detector in detectors.items():  # a handful of detectors
        if found[name] < LEAST_REFERENCE:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        fitted, ok = detector.fit(reference.where(complete[name])), complete[name] & true(valid)
        if isinstance(fitted, _ByColumn):
            out = out.withColumn("__raw", F.when(ok, fitted.score()))
        else:
            out = out.join(fitted.scored(daily.where(ok), "__raw"), list(KEY), "left")
        shown = reduce(and_, [true(c) for c in ("data_quality_ok", "context_supported") if c in daily.columns], F.lit(True))
        out = out.withColumn("__smooth", smooth("__raw", smooth_days, min(3, smooth_days))).withColumn(name, F.when(shown, F.col("__smooth"))).drop("__raw", "__smooth")
    return out


def frozen_score(daily: DataFrame, score: Column, name: str, days: int = 3) -> DataFrame:
    """A fitted score, unsupported rows nulled before smoothing, a full window of days required."""
    ok = F.coalesce("data_quality_ok", F.lit(False)) & F.coalesce("context_supported", F.lit(False))
    return daily.withColumn("__raw", F.when(ok, score)).withColumn(name, smooth("__raw", days, days)).drop("__raw")
