import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import cluster, evaluate, models, relate, text, trends
from tidemark.sources import files
from tests.oracle import DATA


def test_running_sums_and_vocabularies_over_many_ranges(spark):
    df = spark.createDataFrame([(f"k{i:03d}", (i * 7) % 13 + 1) for i in range(300)], "key string, n long")
    got = [(r.key, r.running) for r in relate.running_sum(df, "n", F.desc("n"), "key").orderBy("running").collect()]
    want, total = [], 0
    for i in sorted(range(300), key=lambda i: (-((i * 7) % 13 + 1), f"k{i:03d}")):
        total += (i * 7) % 13 + 1
        want.append((f"k{i:03d}", total))
    assert got == want
    assert trends.pareto(df, "key").agg(F.max("percent")).first()[0] == 100.0
    for key in ("d long", "d string"):
        docs = spark.createDataFrame([(5, "b a b c"), (-2, "z b")] if "long" in key else [("5", "b a b c"), ("-2", "z b")], f"{key}, t string")
        assert [tuple(r) for r in text.vocabulary(text.tokens(docs, "d", "t"), "d").orderBy("id").collect()] == [("z", 0, 1), ("b", 1, 3), ("a", 2, 1), ("c", 3, 1)]


def test_entities_with_equal_file_names(spark, tmp_path):
    for d, v in (("a", 1), ("b b", 2)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "2007.txt").write_text(f"{v} x\n{v} y\n")
    cat = spark.createDataFrame([("A", f"{tmp_path}/a/2007.txt"), ("B", f"{tmp_path}/b b/2007.txt")], "code string, path string")
    got = files.read_entities(spark, cat, ["n", "s"]).collect()
    assert sorted((r.code, r.n, r.s) for r in got) == [("A", "1", "x"), ("A", "1", "y"), ("B", "2", "x"), ("B", "2", "y")]


def test_em_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (200, 2)), rng.normal(5, 0.7, (100, 2)) @ np.array([[1, 0.5], [0, 1]])]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    table, history = cluster.em_mixture(df, "x", [[0.0, 1.0], [4.0, 4.0]], 8)
    w, m, c, ll = np.full(2, 0.5), np.array([[0.0, 1.0], [4.0, 4.0]]), np.stack([np.eye(2)] * 2), []
    for _ in range(8):
        z = x[:, None] - m
        logp = np.log(w) - 0.5 * (2 * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + np.einsum("ngi,gij,ngj->ng", z, np.linalg.inv(c), z))
        top = logp.max(1, keepdims=True)
        all_ = top + np.log(np.exp(logp - top).sum(1, keepdims=True))
        ll.append(all_.mean())
        r = np.exp(logp - all_)
        w, m = r.mean(0), (r.T @ x) / r.sum(0)[:, None]
        c = np.stack([(r[:, g, None] * x).T @ x / r[:, g].sum() - np.outer(m[g], m[g]) + 1e-6 * np.eye(2) for g in range(2)])
    got = table.orderBy("component").collect()
    assert np.allclose([r.weight for r in got], w) and np.allclose([r["mean"] for r in got], m) and np.allclose([r.covariance for r in got], c) and np.allclose(history, ll)
    assert all(b > a - 1e-9 for a, b in zip(history, history[1:]))


def test_extra_trees_learn_and_keep_their_limits(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, c double, y int")
    out = models.extra_trees(df, "k", ["a", "b", "c"], "y", 8, 8, 3).collect()
    assert np.mean([r.y == r.prediction for r in out]) > 0.9 and len(out) == 800
    one = models.extra_trees(df.withColumn("y", F.lit(4)), "k", ["a"], "y", 2, 3).collect()
    assert {r.prediction for r in one} == {4}
    again = models.extra_trees(df.repartition(5), "k", ["a", "b", "c"], "y", 8, 8, 3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out))
    with pytest.raises(ValueError):
        models.extra_trees(df, "k", ["a"], "y", 1000, 30)


def test_tree_grid_has_ninety_rows(spark):
    g = catalog.QUERIES["tree_grid"](spark, DATA).collect()
    assert len(g) == 90 and len({tuple(r)[:4] for r in g}) == 90 and all(0.5 < r.accuracy <= 1 for r in g)
    assert sum(r.depth is None for r in g) == 18


def test_macro_and_micro_curves_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 3, 400), np.round(rng.normal(size=(400, 3)), 1)
    s[np.arange(400), y] += 0.7
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, s, strict=True)], "y int, s0 double, s1 double, s2 double")
    got = {r.kind: r.auc for r in evaluate.macro_micro_auc(evaluate.one_vs_rest(df, "y", {k: F.col(f"s{k}") for k in range(3)})).collect()}

    def curve(score, hit):
        cuts = np.unique(score)[::-1]
        return np.r_[0, [(score[~hit] >= c).mean() for c in cuts]], np.r_[0, [(score[hit] >= c).mean() for c in cuts]]

    area = lambda f, t: float(((f[1:] - f[:-1]) * (t[1:] + t[:-1]) / 2).sum())
    assert got["micro"] == pytest.approx(area(*curve(s.ravel(), (y[:, None] == np.arange(3)).ravel())))
    grid, mean = np.linspace(0, 1, 101), np.zeros(101)
    for k in range(3):
        f, t = curve(s[:, k], y == k)
        top = {a: max(t[f == a]) for a in f}
        for i, g in enumerate(grid):
            at = max(a for a in top if a <= g + 1e-12)
            nxt = [a for a in top if a > g + 1e-12]
            low = min(t[f == min(nxt)]) if nxt else 0
            mean[i] += (top[at] + (low - top[at]) * (g - at) / (min(nxt) - at) if nxt and g - at > 1e-12 else top[at]) / 3
    assert got["macro"] == pytest.approx(area(grid, mean), abs=1e-9)


def test_labels_that_do_not_settle_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        cluster.connected(path, spark.range(41).withColumnRenamed("id", "k"), "k", most_rounds=1)
