"""Order statistics by counting passes equal sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilo.operators import ranks

KIND = "g string, h string, v double"


def made(seed, n=400):
    rng = random.Random(seed)
    kinds = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(0, 3)), lambda: rng.choice([-1e308, 1e308, 0.0, -0.0, 5e-324]), lambda: 10 ** rng.uniform(-200, 200), lambda: None, lambda: float("nan")]
    return [(rng.choice("ab"), rng.choice("xyz"), rng.choice(kinds)()) for _ in range(n)] + [("c", "x", 1.0), ("d", "x", None)]


def values(rows, keep):
    return np.sort([v for g, h, v in rows if v is not None and v == v and keep(g, h)])


@pytest.mark.parametrize("seed,buckets", [(0, 1 << 16), (1, 64)])
def test_quantiles_equal_sorting(spark, seed, buckets, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKETS", buckets)
    rows = made(seed, 150)
    df = spark.createDataFrame(rows, KIND)
    shares = [0.0, 0.1, 0.5, 0.977, 1.0]
    got = {(r.g, r.share): (r.n, r.quantile) for r in ranks.quantiles(df, "v", shares, ["g"]).collect()}
    assert {g for g, _ in got} == {"a", "b", "c"}
    for g in "abc":
        v = values(rows, lambda a, _, g=g: a == g)
        for q in shares:
            p = (len(v) - 1) * q
            k, f = int(p), p - int(p)
            want = v[k] if f == 0 else (1 - f) * v[k] + f * v[k + 1]
            assert got[g, q][0] == len(v) and got[g, q][1] == pytest.approx(want, rel=1e-12)
    assert ranks.quantiles(df.limit(0), "v", shares).count() == 0


def test_quantiles_of_all_but_one_group(spark):
    rows = made(5, 300)
    df = spark.createDataFrame(rows, KIND).where("h is not null")
    got = {(r.h, r.share): (r.n, r.quantile) for r in ranks.quantiles(df, "v", [0.25, 0.5], without="h").collect()}
    for h in "xyz":
        v = values(rows, lambda _, b, h=h: b != h)
        for q in (0.25, 0.5):
            p = (len(v) - 1) * q
            k, f = int(p), p - int(p)
            assert got[h, q][0] == len(v) and got[h, q][1] == pytest.approx(v[k] if f == 0 else (1 - f) * v[k] + f * v[k + 1], rel=1e-12)


def test_both_ways_agree_and_keep_few_counts(spark):
    df = spark.range(200_000).select((F.randn(3) * 7).alias("v"), F.lit(None).cast("double").alias("w"))
    one = ranks.column_quantiles(df, ["v", "w"], [0.5, 0.99])
    two = ranks.column_quantiles(df, ["v", "w"], [0.5, 0.99], small=0)
    assert two["v"] == pytest.approx(one["v"], rel=1e-12) and one["w"] == two["w"] == [None, None]


def test_ranks_beyond_a_group_give_no_row(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], KIND)
    wanted = spark.createDataFrame([("a", 0), ("a", 1), ("a", 1), ("a", 2), ("b", 0)], "g string, rank long")
    assert sorted((r["rank"], r.statistic) for r in ranks.order_statistics(df, "v", wanted, ["g"]).collect()) == [(0, 1.0), (1, 2.0), (1, 2.0)]


def test_excluded_median(spark):
    df = spark.createDataFrame([([(1.0, "a"), (2.0, "b"), (4.0, "b"), (9.0, "c")],)], "xs array<struct<value:double,group:string>>")
    ask = lambda *g: df.select(ranks.excluded_median(F.col("xs"), [F.lit(x) for x in g]).alias("m")).first().m
    assert ask("q") == 3.0 and ask("a") == 4.0 and ask("b") == 5.0 and ask("a", "b") == 9.0 and ask("a", "b", "c") is None or ask("c") == 2.0


def test_whole_columns_share_their_passes(spark):
    df = spark.range(30000).select(F.sin("id").alias("a"), (F.col("id") % 7).alias("b"), F.when(F.col("id") % 3 == 0, F.exp(F.sqrt("id"))).alias("c"), F.lit(None).cast("double").alias("d"), F.lit(2.5).alias("e"))
    shares = [0.0, 0.25, 0.5, 0.99, 1.0]
    want = ranks.column_quantiles(df, df.columns, shares)
    spark.sparkContext.setJobGroup("whole-columns", "")
    try:
        got = ranks.column_quantiles(df, df.columns, shares, small=0)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole-columns"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert got["d"] == want["d"] == [None] * 5 and all(got[c] == pytest.approx(want[c], rel=1e-12) for c in "abce")
    assert jobs <= 20  # one scan for the ends, then one a pass for all columns
