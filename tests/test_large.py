"""Steps that were bounded after runs on larger tables: the same results, and no task, shuffle or table that grows faster than the input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.operators import balls, blocks, cluster, models, relate, text


def test_word_vectors_train_in_several_tasks(spark):
    lines = [(f"w{i % 7} w{i % 5} w{i % 3} near far " * 4,) for i in range(60)] + [(None,), ("",), ("rare",)]
    df = spark.createDataFrame(lines, "text string").repartition(4)
    one, many = (text.word_vectors(df, "text", 4, share=n).collect() for n in (1 << 25, 800))
    words = {f"w{i}" for i in range(7)} | {"near", "far"}
    assert {r.token for r in one} == {r.token for r in many} == words
    assert all(abs(v) < 10 for r in many for v in r.vector) and {r.token: r.vector for r in one} != {r.token: r.vector for r in many}


def test_word_vectors_train_on_shares_without_the_vocabulary(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("MLlib holds the vocabulary in the driver and in each task")

    monkeypatch.setattr("pyspark.ml.feature.Word2Vec.fit", refuse)
    rng = np.random.default_rng(4)
    lines = [(" ".join(f"{'ab'[k]}{i}" for i in rng.integers(0, 100, 40)) + f" few{i % 300}",) for i, k in enumerate(rng.integers(0, 2, 1200))]
    df = spark.createDataFrame([*lines, ("common\u00a0sign",), ("common\u00a0sign",), (None,)], "text string").repartition(3)
    got = [{r.token: r.vector for r in text.word_vectors(df, "text", 8, share=1 << 16).collect()} for _ in range(2)]
    assert sorted(got[0]) == sorted(f"{c}{i}" for c in "ab" for i in range(100))  # those of four places are left out
    assert all(np.allclose(got[0][w], v, atol=1e-9) for w, v in got[1].items())


def test_bags_tell_words_of_two_kinds_apart():
    rng = np.random.default_rng(4)
    v = np.zeros((601, 8), np.float32)
    v[:-1] = (rng.random((600, 8)) - 0.5) / 8
    rows = [np.r_[[600] * 5, rng.integers(0, 300, 20) + 300 * k] for k in rng.integers(0, 2, 20_000)]
    text.bag_of_words(np.concatenate([*rows, [600] * 5]).astype(np.int32), v, 5, 1)
    u = v[:-1] / np.linalg.norm(v[:-1], axis=1, keepdims=True)
    a, b = u[:300].mean(0), u[300:].mean(0)
    assert min(a @ a, b @ b) > a @ b + 0.3


def test_words_of_a_text_are_its_tokens(spark):
    lines = ["The cat, the\nhat.", "\t a\r\n\u00a0b  c\x0b\f", "", " \n", "?!", None, "x\u2003y.z", "A  B"]
    got = spark.createDataFrame([(x,) for x in lines], "t string").select(scalar.spaced_words(F.col("t")), F.array_join(scalar.spaced_tokens(F.col("t")), " ")).collect()
    assert all(a == b for a, b in got) and got[0][0] == "the cat , the hat ."


@pytest.mark.parametrize("words", [1, 2, 9])
def test_bags_of_few_words_stay_finite(words):
    v = np.zeros((words + 1, 4), np.float32)
    v[:-1] = np.random.default_rng(1).random((words, 4)) / 4 - 0.125
    ids = np.r_[np.full(5, words), np.arange(60_000) % words, np.full(5, words)].astype(np.int32)
    text.bag_of_words(ids, v, 5, 1)
    assert np.isfinite(v).all() and abs(v).max() <= text.MOST and not v[-1].any()


def test_contexts_of_texts_equal_those_of_tokens(spark):
    df = spark.createDataFrame([(1, "The cat, the\nhat."), (2, "a b c d"), (3, "a b c d e"), (4, None), (5, "")], "k int, t string")
    got = text.text_contexts(df, "t", 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, text.contexts(text.tokens(df, "k", "t"), "k", 2).select("token", "context").collect()))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def vectors(spark, n, dims, kind):
    x = np.random.default_rng(3).normal(size=(n, dims)).round(3)
    x[5] = x[6]
    x = x.astype(np.float32).astype(float) if kind == "float" else x
    return x, spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], f"k long, x array<{kind}>, label int").repartition(4)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_in_many_dimensions_meet_in_blocks(spark, kind, monkeypatch):
    monkeypatch.setattr(blocks, "number", lambda n, dims: 3)
    x, df = vectors(spark, 600, 48, kind)
    seen = []
    got = {r.k: r for r in balls.nearest(df, "k", "x", 4, count=seen).collect()}
    assert seen[-1] == 599 * 600 // 2  # pairs, each once (two rows are one point), not visits of rows to balls
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:4]
        assert got[i].nearest == [j for _, j in order] and got[i].mean_distance == pytest.approx(np.mean([v for v, _ in order]))
    flags = cluster.far_from_others(df, "k", "x", 4, 7.0).filter("is_outlier").count()
    assert flags == sum(r.mean_distance > 7.0 for r in got.values()) and 0 < flags < 600


@pytest.mark.parametrize("n", [1, 4])
def test_silhouettes_by_pairs_of_blocks(spark, n, monkeypatch):
    x, df = vectors(spark, 90, 5, "double")
    monkeypatch.setattr(blocks, "number", lambda *_: n)
    got = {r.k: r.silhouette for r in cluster.silhouette(df.unionByName(spark.createDataFrame([(90, None, 1)], df.schema)), "k", "x", "label").collect()}
    d, g = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.arange(90) % 3
    for i in range(90):
        a = d[i, g == g[i]].sum() / 29
        b = min(d[i, g == c].mean() for c in range(3) if c != g[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)
    assert got[90] == 0


def test_blocks_move_rows_in_proportion_up_to_131_000():
    assert [blocks.number(n, 64) for n in (500, 8192, 100_000, 600_000)] == [1, 8, 8, 37] and blocks.number(10**6, 4096) == 1954


@pytest.mark.parametrize(("least", "spread", "n"), [(1, 30, 300), (5, 30, 300), (5, 12, 400), (1, 60, 300)])
def test_components_of_cells_equal_those_of_links(spark, least, spread, n):
    rng = np.random.default_rng(n + spread)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate((rng.random((n, 2)) * spread).round(0 if spread == 12 else 1))]
    pts += [(n + i, 100.0, 100.0) for i in range(6)] + [(n + 6, 102.0, 100.0), (n + 7, 200.0, 0.0), (n + 8, None, 0.0), (n + 9, -0.5, -0.5)]
    df = spark.createDataFrame(pts, "k long, x double, y double")
    got = sorted(map(tuple, cluster.near_components(df, "k", "x", "y", 2.0, least).collect()))
    assert got == sorted(map(tuple, cluster.connected(relate.close_pairs(df, "k", "x", "y", 2.0), df, "k", least).collect()))


def test_dense_points_meet_few_others(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.random((4000, 2)) * 10)], "k long, x double, y double")
    for least in (1, 5):
        met = []
        assert {r.component for r in cluster.near_components(df, "k", "x", "y", 2.0, least, met).collect()} == {0}
        assert sum(met) < 2 * 4000


def test_kernel_margin_deals_out_rows_before_features(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b), float(a * a + b * b > 0.5)) for a, b in rng.random((400, 2)) * 2 - 1], "x double, y double, label double").coalesce(1)
    seen, whole = [], models.fourier_features
    monkeypatch.setattr(models, "fourier_features", lambda f, *a: seen.append(f.rdd.getNumPartitions()) or whole(f, *a))
    monkeypatch.setattr(models, "FITTED", 50, raising=False)
    out = models.kernel_margin(df, ["x", "y"], "label")
    assert seen == [8, 1] and out.filter("prediction = label").count() > 360 and out.columns == ["x", "y", "label", "prediction"]


def test_kernel_margin_keeps_no_features_and_fits_as_well_as_mllib(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(a), float(b), float(np.sin(2 * a) > b) if rng.random() > 0.1 else 0.0, 1.0 + float(a > 0)) for a, b in rng.normal(size=(600, 2))], "x double, y double, label double, w double").coalesce(2)
    f = models.fourier_features(df, ["x", "y"], 16, 0.5, 1, "f")
    m = LinearSVC(featuresCol="f", labelCol="label", weightCol="w", maxIter=50).fit(f)
    waves, rows = models._waves(["x", "y"], 16, 0.5, 1), df.selectExpr("x", "y", "2 * label - 1 _y", "w _w")
    lost = models.hinge_losses(rows, waves, np.r_[m.coefficients.toArray(), m.intercept][None])[0][0] / df.agg(F.sum("w")).first()[0]

    def refuse(*_):
        raise AssertionError("MLlib keeps the features of all rows")

    found, descend = [], models.descend
    monkeypatch.setattr(LinearSVC, "fit", refuse)
    monkeypatch.setattr(models, "descend", lambda *a: found.append(descend(*a)) or found[-1])
    assert models.kernel_margin(df, ["x", "y"], "label", "w", n=16).filter("label = prediction").count() > 480
    assert found[0][1] < 1.02 * lost
    for bad in (df.withColumn("label", F.lit(2.0)), df.withColumn("w", F.lit(-1.0)), df.limit(0)):
        with pytest.raises(ValueError, match="kernel margin"):
            models.kernel_margin(bad, ["x", "y"], "label", "w", n=16)


@pytest.mark.parametrize("search", ["forest", "tree"])
def test_grids_work_their_folds_out_once_and_equal_cross_validation(spark, search):
    x = np.random.default_rng(5).normal(size=(240, 3)).round(2)
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def label(a, b):
        read.add(1)
        return float(a + b * b > 0.5)

    plain = spark.createDataFrame([(i, *map(float, r), i % 3) for i, r in enumerate(x)], "k int, a double, b double, c double, fold int").repartition(4, "k")
    df = plain.select(array_to_vector(F.array("a", "b", "c")).alias("x"), label("a", "b").alias("y"), "fold")
    if search == "forest":
        got, est = models.grid_search(df, "x", "y", "fold", 3, [1, 3], [2, 4]).collect(), RandomForestClassifier(featuresCol="x", labelCol="y", seed=1)
        grid = [{est.maxDepth: r.depth, est.numTrees: r.trees} for r in got]
        assert [(r.depth, r.trees) for r in got] == [(1, 2), (1, 4), (3, 2), (3, 4)]
    else:
        got, est = models.tree_grid(df, "x", "y", "fold", 3, [None, 2], [2], [3], ("gini",)).collect(), DecisionTreeClassifier(featuresCol="x", labelCol="y", seed=1)
        grid = [{est.maxDepth: r.depth or 30, est.minInstancesPerNode: r.min_leaf} for r in got]
        assert [r.depth for r in got] == [None, 2]
    assert read.value == 240  # no row is worked out twice, whatever the folds and settings
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"), numFolds=3, foldCol="fold").fit(df)
    assert [r.accuracy for r in got] == pytest.approx(cv.avgMetrics, abs=1e-12) and min(cv.avgMetrics) < 1


def test_grids_refuse_folds_out_of_range_or_without_rows(spark):
    df = spark.createDataFrame([(float(i % 2), i % 3) for i in range(12)], "y double, fold int").withColumn("x", array_to_vector(F.array("y")))
    for folds, k in ((F.col("fold"), 2), (F.col("fold"), 4), (F.lit(0), 1), (F.when(F.col("fold") > 0, 1), 2)):
        with pytest.raises(ValueError, match="fold"):
            models.grid_search(df.withColumn("fold", folds), "x", "y", "fold", k, [1], [1])


def test_offsets_of_running_sums_are_broadcast_up_to_a_limit(spark, monkeypatch):
    df = spark.createDataFrame([(i % 3 or None, (i * 7) % 200, i % 5) for i in range(200)], "g int, k int, v int").repartition(4)
    set_before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table too large to be broadcast by its own size
    try:
        for sent, joins in ((1000, "BroadcastHashJoin"), (1, "SortMergeJoin")):
            monkeypatch.setattr(relate, "SENT", sent, raising=False)
            out = relate.running_sums(df, {"s": F.col("v")}, ["g"], "k")
            assert joins in out._jdf.queryExecution().executedPlan().toString()
            want = df.selectExpr("g", "k", "sum(v) over (partition by g order by k) s")
            assert sorted(map(str, out.select("g", "k", "s").collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", set_before)
