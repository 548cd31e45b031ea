"""Neighbours by cells and bounds equal brute force, and queries meet few cells."""

import numpy as np
import pytest

from vigilo.operators import detectors as X

KIND = "id long, x array<double>"


def brute(queries, reference, k, same):
    out = {}
    for q, x in queries:
        found = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in reference if not (same and i == q))
        out[q] = [i for _, i in found[:k]]
    return out


def data(seed, n):
    rng = np.random.default_rng(seed)
    rows = [[0.5, 0.5]] * (n // 3) + rng.normal(0, 1, (n // 3, 2)).tolist() + (rng.integers(0, 4, (n // 6, 2)) * 1.0).tolist() + (100 * rng.random((n - n // 3 - n // 3 - n // 6, 2))).tolist()
    return [(i, list(map(float, x))) for i, x in enumerate(rows)]


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("block", [7, 40, 5000])
def test_neighbours_equal_brute_force(spark, monkeypatch, same, block):
    monkeypatch.setattr(X, "BLOCK_ROWS", block)
    reference = data(1, 180)
    queries = reference if same else [(1000 + i, x) for i, x in data(2, 90)]
    for k in (1, 6):
        got = X._nearest(spark.createDataFrame(queries, KIND), spark.createDataFrame(reference, KIND), k, len(queries), len(reference), same)
        assert {r.q: [n.id for n in r.near] for r in got.collect()} == brute(queries, reference, k, same)


def test_fewer_rows_than_wanted_and_none(spark):
    ref = [(1, [0.0]), (2, [1.0])]
    df = spark.createDataFrame(ref, KIND)
    assert {r.q: [n.id for n in r.near] for r in X._nearest(df, df, 5, 2, 2, True).collect()} == {1: [2], 2: [1]}
    assert X._nearest(df, df, 0, 2, 2, False).count() == 0


def test_visits_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_ROWS", 50)
    share = []
    for n in (1000, 4000):
        rng = np.random.default_rng(3)
        df = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(rng.random((n, 2)))], KIND)
        _, cells = X._cells(df, 6, n)
        share.append(X._visiting(df, cells, 6).count() / n)
    assert len(cells.pivots) == 80 and share[1] < 1.3 * share[0] and share[1] < 12
