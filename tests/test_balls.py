"""Exact neighbours by reference balls against brute force, and how the pairs grow."""

import numpy as np
import pytest

from tidemark.operators import balls


def brute(x, k, include_self=False):
    out = []
    for i, v in enumerate(x):
        d = np.sqrt(((x - v) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if include_self or j != i][:k]
        out.append(([int(j) for j in order], float(d[order].mean()) if order else None))
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, x array<double>").repartition(6)


def clustered(n, dims, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.random((max(4, n // 60), dims))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * spread / 10


@pytest.mark.parametrize(("n", "dims", "k"), [(700, 2, 4), (500, 12, 3), (40, 3, 6)])
def test_neighbours_equal_brute_force(spark, n, dims, k):
    x = clustered(n, dims).round(6)
    got = {r.k: r for r in balls.nearest(frame(spark, x), "k", "x", k).collect()}
    for i, (ids, mean) in enumerate(brute(x, k)):
        assert got[i].nearest == ids and got[i].mean_distance == pytest.approx(mean)


def test_copies_ties_and_rows_without_vectors(spark):
    x = np.array([[0.0, 0]] * 30 + [[1, 0]] * 2 + [[0, 1], [5, 5]])
    got = {r.k: r for r in balls.nearest(frame(spark, x), "k", "x", 3).collect()}
    assert [got[i].nearest for i in range(len(x))] == [b[0] for b in brute(x, 3)]
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, float("nan")]), (4, [None, 1.0])], "k long, x array<double>")
    assert [(r.k, r.mean_distance, r.nearest) for r in balls.nearest(odd, "k", "x", 2).collect()] == [(1, None, [])]
    assert balls.nearest(odd.limit(0), "k", "x", 2).count() == 0
    with_self = {r.k: r.nearest for r in balls.nearest(frame(spark, x[30:]), "k", "x", 2, include_self=True).collect()}
    assert [with_self[i] for i in range(4)] == [b[0] for b in brute(x[30:], 2, True)]


def test_pairs_grow_clearly_slower_than_all(spark):
    pairs = []
    for n in (3000, 24000):
        seen = []
        assert balls.nearest(frame(spark, clustered(n, 4)), "k", "x", 3, count=seen).count() == n
        pairs.append(sum(seen))
    assert pairs[1] < 0.05 * 24000**2 and pairs[1] / pairs[0] < 30 < 64
