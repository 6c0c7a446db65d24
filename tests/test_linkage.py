"""Linkage in rounds against the nearest pair at a time over all rows."""

import numpy as np
import pytest

from tidemark.operators import linkage


def brute(x, clusters, method):
    parts = [[i] for i in range(len(x))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def far(p, q):
        block = d[np.ix_(p, q)]
        if method == "ward":
            return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(x[p].mean(0) - x[q].mean(0))
        return {"single": block.min, "complete": block.max, "average": block.mean}[method]()

    while len(parts) > clusters:
        _, i, j = min((far(parts[i], parts[j]), i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)))
        parts[i] += parts.pop(j)
    parts.sort(key=min)
    return {i: c for c, p in enumerate(parts) for i in p}


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, x array<double>").repartition(5)


def got(spark, x, clusters, method, **how):
    return {r.k: r.cluster for r in linkage.linkage(frame(spark, x), "k", "x", clusters, method, **how).collect()}


@pytest.mark.parametrize(("method", "finish"), [("single", 1), ("complete", 1), ("complete", 9), ("average", 1), ("ward", 9), ("ward", 1)])
def test_rounds_equal_nearest_pair_at_a_time(spark, method, finish):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in ((0, 1, 9), (6, 0.5, 7), (14, 2, 6))])
    x = np.concatenate([x, x[[3, 3, 12]]])  # copies weigh
    want = brute(x, 4, method)
    assert got(spark, x, 4, method, finish=finish) == want


def test_spanning_tree_length(spark):
    x = np.random.default_rng(5).random((150, 3))
    rows = linkage.spanning_tree(frame(spark, x).toDF("pid", "x")).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    inside, near = np.zeros(len(x), bool), d[0].copy()
    inside[0], total = True, 0.0
    for _ in range(len(x) - 1):
        j = int(np.where(inside, np.inf, near).argmin())
        total += near[j]
        inside[j], near = True, np.minimum(near, d[j])
    assert len(rows) == len(x) - 1
    assert sum(r.d for r in rows) == pytest.approx(total, rel=1e-12)


@pytest.mark.parametrize("method", ["single", "complete"])
def test_edge_cases(spark, method):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [9.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, x array<double>").selectExpr("*", "'a' AS id", "1 AS CLUSTER", "2 AS pid")
    of = {r.k: r.cluster for r in linkage.linkage(df, "k", "x", 5, method).collect()}
    assert of == {1: 0, 2: 0, 3: None, 4: None, 5: 1}
    assert {r.cluster for r in linkage.linkage(df.filter("k < 3"), "k", "x", 1, method).collect()} == {0}
    assert linkage.linkage(df.limit(0), "k", "x", 2, method).count() == 0
    with pytest.raises(ValueError, match="method"):
        linkage.linkage(df, "k", "x", 2, "centroid")


def test_more_rows_than_one_task_took(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.2, (700, 2)), rng.normal(9, 0.2, (500, 2)), rng.normal(20, 0.2, (900, 2))])
    of = got(spark, x, 3, "complete")
    assert [of[i] for i in range(2100)] == [0] * 700 + [1] * 500 + [2] * 900
