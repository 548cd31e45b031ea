"""Exact order statistics and quantiles by counting passes.

A wanted rank is searched in a value range, at first from the least to the largest value.  A pass cuts the range into
``BUCKETS`` and counts them; the bucket that holds the rank, from its own least to its own largest value, is the next
range, and a bucket of one value is the answer.  So a task keeps at most ``BUCKETS`` counts of a range, however many
rows or distinct values a group has, and counts combine before they are shuffled.  Two or three passes are usual.

With ``without`` the statistics are those of all rows but one group's, for each such group: the counts of the whole
less the group's own, out of the same passes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.session import materialize

BUCKETS = 1 << 16
#: Rows up to which ``column_quantiles`` lets one aggregation hold a column's values.
SMALL = 2_000_000
#: Parts of a range of ``column_quantiles``; their counts reach the driver.
PARTS = 1 << 12
MOST_PASSES = 200


def _finite(df: DataFrame, value: str, keep: list[str]) -> DataFrame:
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).select(*keep, x.alias("__v"))


def _bucket(v: Column, lo: Column, hi: Column, buckets: int = BUCKETS) -> Column:
    """The part of the range lo < hi that holds ``v``; it never falls as the value rises.

    Parts are even in the logarithm where the range has one sign, so that a few huge values don't leave all others in
    one part, and else, or where logarithms do not tell the ends apart, even in the value.
    """
    part = lambda x, a, b: F.try_divide(x - a, b - a)
    log = lambda x: F.ln(F.abs(x))
    up = F.when(log(lo) < log(hi), part(log(v), log(lo), log(hi)))
    down = F.when(log(lo) > log(hi), part(-log(v), -log(lo), -log(hi)))
    wide = hi - lo == F.lit(float("inf"))
    even = F.when(wide, part(v / 2, lo / 2, hi / 2)).otherwise(part(v, lo, hi))
    share = F.coalesce(F.when(lo > 0, up).when(hi < 0, down), even)
    return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * buckets).cast("int")


def order_statistics(df: DataFrame, value: str, targets: DataFrame, by: list[str] = (), without: str | None = None) -> DataFrame:
    """``targets`` (by, without, rank) with the ``rank``-th smallest value, from 0, of its group as ``statistic``.

    Nulls and NaN are no values.  ``by`` and ``without`` hold no nulls.  Ranks beyond a group's rows, and groups
    without rows, give no row.  Repeated targets give a row each; an empty table gives none.
    """
    by, own = list(by), [without] if without else []
    rows = _finite(df, value, [*by, *own]).withColumn("__k", F.lit(0))
    key = ["__k", *by]
    ends = rows.groupBy(*key).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    state = targets.withColumn("__k", F.lit(0)).join(ends, key).withColumn("below", F.lit(0).cast("long"))
    state = materialize(state, "rank-targets")
    settled = None
    for _ in range(MOST_PASSES):
        found = state.where("lo = hi")
        settled = found if settled is None else settled.unionByName(found)
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        ranges = open_.select(*key, "lo", "hi").distinct()  # two for each quantile of a group at most
        inside = rows.join(ranges, key).where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        counts = inside.groupBy(*key, "lo", "hi", _bucket(F.col("__v"), F.col("lo"), F.col("hi")).alias("bucket"), *own).agg(F.count("*").alias("n"), F.min("__v").alias("a"), F.max("__v").alias("b"))
        cell = [*key, "lo", "hi", "bucket"]
        if without:
            whole = counts.groupBy(*cell).agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
            each = open_.select(*key, *own, "lo", "hi").distinct().join(whole, [*key, "lo", "hi"])
            mine = counts.select(*cell, *own, F.col("n").alias("own"))
            counts = each.join(mine, [*cell, *own], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
        line = Window.partitionBy(*key, *own, "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("upto", F.sum("n").over(line))
        met = open_.join(placed, [*key, *own, "lo", "hi"])
        at = F.col("rank") - F.col("below")
        met = met.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("n")))
        state = materialize(met.select(*targets.columns, "__k", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("below") + F.col("upto") - F.col("n")).alias("below")), "rank-targets")
    else:
        raise RuntimeError("ranks did not settle")
    return settled.select(*targets.columns, F.col("lo").alias("statistic"))


def group_sizes(df: DataFrame, value: str, by: list[str] = (), without: str | None = None) -> DataFrame:
    """(by, without, n): values in each group; with ``without`` those of all other groups of ``by``."""
    by, own = list(by), [without] if without else []
    sizes = _finite(df, value, [*by, *own]).groupBy(*by, *own).agg(F.count("*").alias("n"))
    if not without:
        return sizes
    whole = Window.partitionBy(*(by or [F.lit(0)]))  # a row for each group
    return sizes.withColumn("n", F.sum("n").over(whole) - F.col("n"))


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] = (), without: str | None = None) -> DataFrame:
    """(by, without, n, share, quantile): exact, linear between order statistics, as ``percentile`` gives them.

    With ``without``, for each of its groups the quantiles of all rows but that group's.  Groups without values give no row.
    """
    by, own = list(by), [without] if without else []
    sizes = materialize(group_sizes(df, value, by, without).where("n > 0"), "rank-sizes")
    wanted = sizes.select("*", F.explode(F.array(*map(F.lit, sorted(set(map(float, shares)))))).alias("share"))
    at = (F.col("n") - 1) * F.col("share")
    wanted = wanted.withColumn("low", F.floor(at)).withColumn("part", at - F.floor(at))
    pair = F.array(F.col("low"), F.col("low") + (F.col("part") > 0).cast("long"))
    ranks = wanted.select(*by, *own, F.explode(pair).alias("rank")).distinct()
    found = materialize(order_statistics(df, value, ranks, by, without), "rank-found").withColumn("__k", F.lit(0))
    key = ["__k", *by, *own]
    side = lambda name: found.select(*key, F.col("rank").alias(f"__{name}"), F.col("statistic").alias(name))
    out = wanted.withColumn("__k", F.lit(0)).join(side("a").withColumnRenamed("__a", "low"), [*key, "low"])
    out = out.join(side("b"), key).where(F.col("__b") == F.col("low") + (F.col("part") > 0).cast("long"))
    value_at = F.when(F.col("part") == 0, F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    return out.select(*by, *own, "n", "share", value_at.alias("quantile"))


def _at_ranks(rows: DataFrame, wanted: dict[str, set[int]], ends: dict[str, tuple[float, float, int]]) -> dict[tuple[str, int], float]:
    """(column, rank) with the order statistic of each wanted rank; ``ends`` has least, largest and number of a column's values.

    All open ranges of all columns are counted in one scan a pass; ``PARTS`` counts of each reach the driver.
    """
    found = {}
    state = [(c, r, ends[c][0] if r < ends[c][2] - 1 else ends[c][1], ends[c][1] if r else ends[c][0], 0) for c, ranks in wanted.items() for r in ranks]
    for _ in range(MOST_PASSES):
        found |= {(c, r): lo for c, r, lo, hi, _ in state if lo == hi}
        state = [x for x in state if x[2] < x[3]]
        if not state:
            return found
        ranges = sorted({(c, lo, hi) for c, _, lo, hi, _ in state})
        cells = []
        for k, (c, lo, hi) in enumerate(ranges):
            v = F.col(c)
            cell = F.struct(F.lit(k).alias("k"), _bucket(v, F.lit(lo), F.lit(hi), PARTS).alias("bucket"), v.alias("v"))
            cells.append(F.when((v >= lo) & (v <= hi), cell))
        held = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
        counts = {k: [] for k in range(len(ranges))}
        for row in held.groupBy("k", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k", "bucket").collect():
            counts[row.k].append(row)
        narrowed = []
        for c, r, lo, hi, below in state:
            for row in counts[ranges.index((c, lo, hi))]:
                if r < below + row.n:
                    narrowed.append((c, r, row.a, row.b, below))
                    break
                below += row.n
        state = narrowed
    raise RuntimeError("ranks did not settle")


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float], small: int = SMALL) -> dict[str, list[float | None]]:
    """The quantiles of whole columns, for fits: a few numbers.  One aggregation for up to ``small`` rows, else counting passes over all columns at once."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    real = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    stats = [f(x).alias(f"{n}{k}") for k, x in enumerate(real.values()) for n, f in (("n", F.count), ("a", F.min), ("b", F.max))]
    ends = rows.agg(F.count("*").alias("rows"), *stats).first()
    if ends["rows"] <= small:
        got = rows.agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(f"q{k}") for k, c in enumerate(columns))).first()
        return {c: list(got[k]) if got[k] is not None else [None] * len(shares) for k, c in enumerate(columns)}
    held = {c: (ends[f"a{k}"], ends[f"b{k}"], ends[f"n{k}"]) for k, c in enumerate(columns) if ends[f"n{k}"]}
    at = {c: [((n - 1) * float(s)) for s in shares] for c, (_, _, n) in held.items()}
    found = _at_ranks(rows.select(*(x.alias(c) for c, x in real.items())), {c: {r for x in xs for r in (math.floor(x), math.ceil(x))} for c, xs in at.items()}, held)

    def between(c: str, x: float) -> float:
        low, part = math.floor(x), x - math.floor(x)
        return (1 - part) * found[c, low] + part * found[c, low + 1] if part else found[c, low]

    return {c: [between(c, x) for x in at[c]] if c in at else [None] * len(shares) for c in columns}


def excluded_median(values: Column, out: list[Column]) -> Column:
    """The median of ``values``, an ascending array of (value, group), without the groups ``out``; null if none is left.

    For ranks among few values: leaving groups out moves the middle, nothing is sorted again.
    """
    kept = F.filter(values, lambda x: ~F.exists(F.array(*out), lambda g: g == x["group"]))
    n = F.size(kept)
    at = lambda k: F.get(kept, k.cast("int"))["value"]
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)
