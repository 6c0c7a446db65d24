"""Boosting and forests against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees


def sample(spark, n=600, seed=1, nulls=True):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(size=n).round(2), rng.integers(0, 9, n), rng.random(n).round(3)].astype(float)
    y = ((x[:, 0] + 0.4 * x[:, 1] - 2 * (x[:, 2] > 0.5) + rng.normal(size=n) * 0.4) > 1).astype(int)
    if nulls:
        x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(i, int(t), *[None if math.isnan(v) else float(v) for v in r]) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "k long, y int, a double, b double, c double").repartition(5)


def plain_boost(x, y, edges, rounds, depth, rate, l2, least, squared=False, leaves=None, weight=1.0):
    """(splits, values) of each tree, one node after another, over bin numbers."""
    b = np.full(x.shape, -1)
    for f, e in enumerate(edges):
        b[:, f] = [-1 if math.isnan(v) else sum(u < v for u in e) for v in x[:, f]]
    m, w, out = np.zeros(len(y)), np.where(y == 1, weight, 1.0), []
    for _ in range(rounds):
        p = m if squared else 1 / (1 + np.exp(-m))
        g, h = ((p - y), np.ones(len(y))) if squared else ((p - y) * w, p * (1 - p) * w)
        node, splits = np.ones(len(y), int), {}
        for level in range(depth):
            found = []
            for n in range(2**level, 2 ** (level + 1)):
                here, best = node == n, None
                score = lambda s: g[s].sum() ** 2 / (h[s].sum() + l2)  # noqa: B023, E731
                for f in range(x.shape[1]):
                    for t in sorted(set(b[here, f]) - {-1}):
                        for left in (True, False):
                            go = here & np.where(b[:, f] < 0, left, b[:, f] <= t)
                            no = here & ~go
                            if go.any() and no.any() and h[go].sum() >= least and h[no].sum() >= least:
                                gain = 0.5 * (score(go) + score(no) - score(here))
                                rank = (round(gain, 9), -f, -t, left)
                                if best is None or rank > best[0]:
                                    best = (rank, f, t, left, gain)
                if best and best[4] > 0:
                    found.append((-round(best[4], 9), n, best))
            found.sort(key=lambda r: r[:2])
            if leaves is not None:
                found = found[: max(0, leaves - 1 - len(splits))]
            for _, n, (_, f, t, left, gain) in found:
                splits[n] = (f, [*edges[f], math.inf][t], left, gain)
                here = node == n
                node[here] = 2 * n + np.where(b[here, f] < 0, not left, b[here, f] > t)
        values = {int(n): -rate * g[node == n].sum() / (h[node == n].sum() + l2) for n in set(node)}
        m = m + np.array([values[n] for n in node])
        out.append((splits, values))
    return out, m


@pytest.mark.parametrize("how", [{}, {"squared": True}, {"leaves": 3}, {"weight": 2.5}])
def test_boosting_equals_a_plain_version(spark, how, monkeypatch):
    monkeypatch.setattr(trees, "REFRESH", 2)
    x, y, df = sample(spark)
    m = trees.boost(df, ["a", "b", "c"], "y", 5, 3, 0.3, bins=12, min_hessian=2.0, objective="squared" if how.get("squared") else "logistic", leaves=how.get("leaves"), positive_weight=how.get("weight", 1.0))
    edges = trees.bin_edges(df, ["a", "b", "c"], 12)
    want, margin = plain_boost(x, y, edges, 5, 3, 0.3, 1.0, 2.0, **how)
    for tree, (splits, values) in zip(m.trees, want, strict=True):
        assert {n: s[:3] for n, s in tree.splits.items()} == {n: s[:3] for n, s in splits.items()}
        assert tree.values == pytest.approx(values)
    got = {r.k: r.margin for r in m.predict(df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], margin)
    if "leaves" in how:
        assert all(len(t.values) == 3 for t in m.trees)


def test_boosting_learns_where_nulls_go_and_what_matters(spark):
    x, y, df = sample(spark, 3000, 2, nulls=False)
    df = df.withColumn("d", F.when(F.col("y") == 0, F.rand(1))).withColumn("b", F.when(F.col("b") > 6, None).otherwise(F.col("b")))
    m = trees.boost(df, ["a", "b", "c", "d"], "y", 10, 3, 0.5)
    hit = m.predict(df).select(F.avg(((F.col("probability") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert hit > 0.999 and next(iter(trees.gains(m.trees, m.columns))) == "d" and sum(trees.gains(m.trees, m.columns).values()) == pytest.approx(1)
    n = df.select("y").rdd.map(lambda r: r.y).sum()
    skewed = trees.boost(df, ["a", "c"], "y", 1, 1, 1.0, positive_weight=None)
    plain = trees.boost(df, ["a", "c"], "y", 1, 1, 1.0, positive_weight=(3000 - n) / n)
    assert skewed.trees == plain.trees


def test_boosting_of_odd_tables(spark):
    schema = "k long, y int, a double, margin double"
    nothing = trees.boost(spark.createDataFrame([], schema), ["a"], "y", 2, 2)
    assert nothing.trees == [] and nothing.table(spark).count() == 0
    rows = [(i, i % 2, v, 9.0) for i, v in enumerate([None, float("nan"), float("inf"), 1.0, 1.0, 1.0])] + [(9, None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    m = trees.boost(df, ["a"], "y", 2, 2, min_hessian=0.1)
    assert len(m.trees) == 2 and [s[:2] for s in m.trees[0].splits.values()] == [(0, 1.0)]  # one value: only the missing ones can be parted from it
    one = [r for r in m.predict(df, "score").collect()]
    assert len(one) == len(rows) and {r.margin for r in one} == {9.0, 1.0}
    with pytest.raises(ValueError):
        trees.boost(df, ["a"], "y", depth=17)
    with pytest.raises(ValueError):
        trees.boost(df, ["a"], "y", objective="poisson")


def plain_tree(x, y, w, depth, least, criterion, points=100, n=1):
    """node -> (feature, threshold) or class; rows counted w times."""
    out = {}

    def impurity(c):
        p = c[c > 0] / c.sum()
        return 1 - (p * p).sum() if criterion == "gini" else -(p * np.log2(p)).sum()

    def visit(n, s, level):
        count = lambda s: np.bincount(y[s], w[s], 3)
        best = None
        if level < depth:
            for f in range(x.shape[1]):
                lo, hi = x[s, f].min(), x[s, f].max()
                for k, at in enumerate(lo + (hi - lo) * (np.arange(points) / (points - 1))):
                    a, b = s[x[s, f] <= at], s[x[s, f] > at]
                    if w[a].sum() >= max(1, least) and w[b].sum() >= max(1, least):
                        gain = round(impurity(count(s)) - (w[a].sum() * impurity(count(a)) + w[b].sum() * impurity(count(b))) / w[s].sum(), 9)
                        if gain > 0 and (best is None or (gain, -f, -k) > best[0]):
                            best = ((gain, -f, -k), f, at, a, b)
        if best is None:
            out[n] = int(count(s).argmax())
        else:
            out[n] = (best[1], best[2])
            visit(2 * n, best[3], level + 1)
            visit(2 * n + 1, best[4], level + 1)

    visit(1, np.flatnonzero(w > 0), 0)
    return out


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_forest_equals_plain_trees(spark, criterion):
    x, y, df = sample(spark, 400, 3, nulls=False)
    y = y + (x[:, 1] > 6)
    df = df.withColumn("y", F.col("y") + (F.col("b") > 6).cast("int"))
    m = trees.forest(df, "k", ["a", "b", "c"], "y", 3, 3, least=4, criterion=criterion, seed=7)
    hashes = {r.k: r.h for r in df.select("k", F.xxhash64(F.lit(7), F.col("k")).alias("h")).collect()}
    w = trees._weights(np.array([hashes[i] for i in range(len(y))]), 3)
    assert 0.8 < w.mean() < 1.2 and 0.3 < (w == 0).mean() < 0.45
    votes = np.zeros((len(y), 3))
    for t, tree in enumerate(m.trees):
        want = plain_tree(x, y, w[:, t], 3, 4, criterion)
        assert {n: s[:2] for n, s in tree.splits.items()} == {n: v for n, v in want.items() if isinstance(v, tuple)}
        assert tree.values == {n: v for n, v in want.items() if not isinstance(v, tuple)}
        votes[np.arange(len(y)), tree.apply(x).astype(int)] += 1
    got = {r.k: r.prediction for r in m.votes(df, "k").collect()}
    assert [got[i] for i in range(len(y))] == votes.argmax(1).tolist()


def test_forest_out_of_bag_accuracy_is_that_of_new_rows(spark):
    _, _, df = sample(spark, 4000, 4, nulls=False)
    grown, new = df.filter("k < 2500"), df.filter("k >= 2500")
    m = trees.forest(grown, "k", ["a", "b", "c"], "y", 12, 6, least=3, features=2)
    right = lambda d, c: d.filter(f"{c} is not null").select(F.avg((F.col(c) == F.col("y")).cast("double"))).first()[0]
    oob, fresh = right(m.votes(grown, "k", "y"), "out_of_bag"), right(m.votes(new, "k", "y"), "prediction")
    assert fresh > 0.85 and abs(oob - fresh) < 0.03
    again = trees.forest(grown.repartition(3), "k", ["a", "b", "c"], "y", 12, 6, least=3, features=2)
    assert again.trees == m.trees


def test_forest_of_odd_tables(spark):
    empty = spark.createDataFrame([], "k long, y int, a double")
    assert trees.forest(empty, "k", ["a"], "y").votes(empty, "k", "y").count() == 0
    df = spark.createDataFrame([(1, 4, 1.0), (2, 4, 1.0), (3, 4, None), (4, None, 1.0)], "k long, y int, a double")
    got = trees.forest(df, "k", ["a"], "y", 2, 3, bagged=False).votes(df, "k", "y").collect()
    assert len(got) == 4 and {(r.prediction, r.out_of_bag) for r in got} == {(4, None)}
