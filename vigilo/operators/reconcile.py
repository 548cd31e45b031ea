"""Reconciliation of what should be there with what is: coverage, disjointness and repeats, violations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = ("expected", "assessed", "unavailable")


def reconcile(expected: DataFrame, assessed: DataFrame, unavailable: DataFrame, keys: list[str], reason: str | None = None) -> DataFrame:
    """(keys, violation): none, if every expected key is either assessed or declared unavailable, once, and no other key is.

    ``missing``: neither; ``both``: assessed and unavailable; ``unexpected``: not asked for; ``repeated_<table>``: a key
    twice in it; ``no_reason``: declared unavailable without a text in ``reason``.  One aggregation of all three tables;
    null keys are keys like any other; empty tables are allowed.
    """
    blank = F.length(F.trim(F.coalesce(F.col(reason).cast("string"), F.lit("")))) == 0 if reason else F.lit(False)
    parts = []
    for name, df in zip(NAMES, (expected, assessed, unavailable), strict=True):
        marks = [F.lit(int(n == name)).cast("long").alias(f"__{n}") for n in NAMES]
        parts.append(df.select(*keys, *marks, (blank if name == "unavailable" else F.lit(False)).alias("__blank")))
    held = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*(F.sum(f"__{n}").alias(f"__{n}") for n in NAMES), F.bool_or("__blank").alias("__blank"))
    e, a, u = (F.col(f"__{n}") for n in NAMES)
    tests = [
        ((e > 0) & (a + u == 0), "missing"),
        ((a > 0) & (u > 0), "both"),
        ((e == 0) & (a + u > 0), "unexpected"),
        *((F.col(f"__{n}") > 1, f"repeated_{n}") for n in NAMES),
        (F.col("__blank"), "no_reason"),
    ]
    found = F.array_compact(F.array(*(F.when(t, F.lit(name)) for t, name in tests)))
    return held.select(*keys, F.explode(found).alias("violation"))


def invariants(checks: dict[str, DataFrame]) -> DataFrame:
    """(invariant, violations, holds): each check is a table of its violations, empty where it holds; all in one plan."""
    counted = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("invariant"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted).withColumn("holds", F.col("violations") == 0)


def first_match(candidates: DataFrame, key: str, order: list[str], test: str) -> DataFrame:
    """For each ``key`` the first candidate by ``order`` for which the boolean column ``test`` holds; keys without one give no row.

    A search over candidates keeps only the smallest so far in each task, and no list of a key's candidates is made.
    """
    kept = F.struct(*order, *(F.col(c) for c in candidates.columns if c not in [*order, key, test]))
    return candidates.where(F.col(test)).groupBy(key).agg(F.min(kept).alias("__first")).select(key, "__first.*")
