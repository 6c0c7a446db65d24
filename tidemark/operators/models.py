"""Supervised models on MLlib, with what it lacks: out-of-bag scores, boosted stumps, linear leaves."""

from __future__ import annotations

import math
import time
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .trees import forest


#: Rows on which a task fits a kernel margin at most, about, and rows whose features it holds at a time.
FITTED, HELD = 100_000, 512


def linear_fit(df: DataFrame, features: str, label: str, robust: bool = False) -> DataFrame:
    """term, coefficient: least squares, or Huber's loss (MLlib needs epsilon over 1, so 1.0001)."""
    how = {"loss": "huber", "epsilon": 1.0001, "maxIter": 200, "tol": 1e-9} if robust else {"solver": "normal"}
    m = LinearRegression(featuresCol=features, labelCol=label, **how).fit(df)
    rows = [("intercept", float(m.intercept)), *[(f"x{i}", float(c)) for i, c in enumerate(m.coefficients)]]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def bagged_trees(df: DataFrame, key: str, features: str, label: str, trees: int = 10, depth: int = 10, seed: int = 1, subset: float = 0.7) -> tuple[DataFrame, float]:
    """(key, label, prediction) by soft vote, and the out-of-bag accuracy.

    A row's weight in a tree is a Poisson(1) draw by a hash of key and tree; rows with weight 0 are out of its bag.
    All trees' votes are expressions over one pass; nothing is collected but the models.
    """
    n_classes = int(df.agg(F.max(label)).first()[0]) + 1
    u = lambda t: (F.pmod(F.xxhash64(F.lit(seed * 1000 + t), F.col(key)), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(6)])
    votes = df.select(key, label, features)
    zero = F.array(*[F.lit(0.0)] * n_classes)
    votes = votes.withColumns({"_all": zero, "_oob": zero})
    for t in range(trees):
        w = sum((F.when(u(t) > float(s), 1.0).otherwise(0.0) for s in steps[1:]), F.when(u(t) > float(steps[0]), 1.0).otherwise(0.0))
        boot = df.withColumn("_w", w).filter("_w > 0")
        model = DecisionTreeClassifier(featuresCol=features, labelCol=label, weightCol="_w", maxDepth=min(depth, 30), seed=seed + t, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(boot)
        votes = model.transform(votes.withColumn("_w", w))
        p = vector_to_array("_p")
        votes = votes.withColumns({"_all": F.zip_with("_all", p, lambda a, b: a + b), "_oob": F.when(F.col("_w") == 0, F.zip_with("_oob", p, lambda a, b: a + b)).otherwise(F.col("_oob"))}).drop("_p", "_r", "_y", "_w")
    best = lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("double")
    out = votes.select(key, label, best("_all").alias("prediction"), F.when(F.array_max("_oob") > 0, best("_oob")).alias("_o"))
    oob = out.filter("_o is not null").agg(F.avg((F.col("_o") == F.col(label)).cast("double"))).first()[0]
    return out.drop("_o"), float(oob)


def adaboost(df: DataFrame, features: str, label: str, rounds: int = 10, depth: int = 1, seed: int = 1) -> list[tuple[float, object]]:
    """(weight, tree) of boosted trees for labels 0 and 1. Row weights are expressions of the trees so far."""
    out: list[tuple[float, object]] = []
    for r in range(rounds):
        w = df
        margin = F.lit(0.0)
        for k, (a, m) in enumerate(out):
            w = m.transform(w).withColumn(f"_h{k}", 2 * F.col("_y") - 1).drop("_y", "_p", "_r")
            margin = margin + F.lit(a) * F.col(f"_h{k}")
        w = w.withColumn("_w", F.exp(-(2 * F.col(label) - 1) * margin)).drop(*[f"_h{k}" for k in range(len(out))])
        m = DecisionTreeClassifier(featuresCol=features, labelCol=label, weightCol="_w", maxDepth=depth, seed=seed + r, predictionCol="_y", probabilityCol="_p", rawPredictionCol="_r").fit(w)
        e = m.transform(w).agg((F.sum(F.when(F.col("_y") != F.col(label), F.col("_w")).otherwise(0.0)) / F.sum("_w"))).first()[0]
        if e >= 0.5 or e <= 0:
            out += [(1.0, m)] if not out else []
            break
        out.append((0.5 * math.log((1 - e) / e), m))
    return out


def boosted_predict(df: DataFrame, boosted: list[tuple[float, object]]) -> DataFrame:
    margin = F.lit(0.0)
    for k, (a, m) in enumerate(boosted):
        df = m.transform(df).withColumn(f"_h{k}", 2 * F.col("_y") - 1).drop("_y", "_p", "_r")
        margin = margin + F.lit(a) * F.col(f"_h{k}")
    return df.withColumns({"score": margin, "prediction": (margin > 0).cast("double")}).drop(*[f"_h{k}" for k in range(len(boosted))])


def _fold_accuracy(df: DataFrame, estimator, grid: list[dict], features: str, label: str, fold: str, k: int, parallel: int = 1) -> list[float]:
    """Mean accuracy over the folds 0 .. k - 1 of each setting in ``grid``, as CrossValidator has it.

    That works the folds out anew for every part it keeps or looks into, and fits the best setting to all rows in the end. Here
    they are worked out once and kept (on disk where memory ends) while the models of the folds, ``parallel`` at a time, are fitted.
    """
    spark = df.sparkSession
    rows = df.select(features, label, fold).persist()
    try:
        sizes = {r[0]: r[1] for r in rows.groupBy(fold).count().collect()}
        if any(f is None or not 0 <= f < k for f in sizes):
            raise ValueError(f"{fold} must be from 0 to {k - 1}, found {sorted(sizes, key=str)}")
        if k < 2 or any(f not in sizes for f in range(k)):
            raise ValueError(f"{k} folds need two with rows at least, and rows in each; found {sorted(sizes)}")

        def accuracy(at: tuple[int, dict]) -> float:
            i, setting = at
            model = estimator.fit(rows.filter(F.col(fold) != i), setting)
            tried = model.transform(rows.filter(F.col(fold) == i))
            return tried.agg(F.avg((F.col(model.getPredictionCol()) == F.col(label)).cast("double"))).first()[0]

        with ThreadPool(parallel) as pool:
            got = pool.map(inheritable_thread_target(spark)(accuracy), [(i, s) for i in range(k) for s in grid], 1)
    finally:
        rows.unpersist()
    return [float(a) for a in np.mean(np.reshape(got, (k, len(grid))), 0)]


def grid_search(df: DataFrame, features: str, label: str, fold: str, k: int, depths: list[int], trees: list[int], seed: int = 1) -> DataFrame:
    """depth, trees, accuracy of a random forest over stratified folds given in ``fold``."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, depths).addGrid(rf.numTrees, trees).build()
    accuracy = _fold_accuracy(df, rf, grid, features, label, fold, k)
    rows = [(int(p[rf.maxDepth]), int(p[rf.numTrees]), a) for p, a in zip(grid, accuracy, strict=True)]
    return df.sparkSession.createDataFrame(rows, "depth int, trees int, accuracy double")


def tree_grid(df: DataFrame, features: str, label: str, fold: str, k: int, depths: list[int | None], splits: list[int], leaves: list[int], criteria: tuple[str, ...] = ("gini", "entropy"), seed: int = 1) -> DataFrame:
    """criterion, depth (null: none), min_split, min_leaf, accuracy of a decision tree over folds given in ``fold``.

    MLlib knows no least size of a node to split, so a leaf gets half of it at the least; a depth of none is 30, MLlib's
    most. Combinations that come to the same are fitted once.
    """
    tree = DecisionTreeClassifier(featuresCol=features, labelCol=label, seed=seed)
    real = lambda c, d, s, m: (c, min(d or 30, 30), max(m, -(-s // 2)))
    wanted = [(c, d, s, m) for c in criteria for d in depths for s in splits for m in leaves]
    settings = list(dict.fromkeys(real(*w) for w in wanted))
    grid = [{tree.impurity: c, tree.maxDepth: d, tree.minInstancesPerNode: m} for c, d, m in settings]
    accuracy = dict(zip(settings, _fold_accuracy(df, tree, grid, features, label, fold, k, 4), strict=True))
    rows = [(*w, accuracy[real(*w)]) for w in wanted]
    return df.sparkSession.createDataFrame(rows, "criterion string, depth int, min_split int, min_leaf int, accuracy double")


def extra_trees(df: DataFrame, key: str, features: list[str], label: str, trees: int = 10, depth: int = 8, least: int = 1, seed: int = 1) -> DataFrame:
    """key, label, prediction by extremely randomised trees: all rows in each tree, and one random threshold a node and
    feature, of which the one with the best Gini gain is used. Soft vote; ties go to the lower label. See trees.forest()."""
    grown = forest(df, key, features, label, trees, depth, least=least, bagged=False, random=True, soft=True, seed=seed)
    return grown.votes(df, key, label, soft=True).drop("out_of_bag")


def importances(df: DataFrame, features: str, label: str, names: list[str], n: int = 10, seed: int = 1) -> DataFrame:
    m = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=20, seed=seed).fit(df)
    rows = sorted(((names[i], float(v)) for i, v in enumerate(m.featureImportances.toArray())), key=lambda r: (-r[1], r[0]))[:n]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def compare(df: DataFrame, features: str, label: str, seed: int = 1) -> DataFrame:
    """model, accuracy, fit_seconds, score_seconds of several classifiers on the rows they were fitted to (labels 0, 1)."""
    width = len(df.select(vector_to_array(features)).first()[0])
    models = {
        "forest": RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=20, seed=seed),
        "boosted": GBTClassifier(featuresCol=features, labelCol=label, maxIter=10, seed=seed),
        "tree": DecisionTreeClassifier(featuresCol=features, labelCol=label, seed=seed),
        "margin": OneVsRest(classifier=LinearSVC(maxIter=20), featuresCol=features, labelCol=label),
        "perceptron": MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[width, 8, 2], maxIter=50, seed=seed),
    }
    rows = []
    for name, est in models.items():
        a = time.perf_counter()
        m = est.fit(df)
        b = time.perf_counter()
        acc = m.transform(df).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        rows.append((name, float(acc), b - a, time.perf_counter() - b))
    return df.sparkSession.createDataFrame(rows, "model string, accuracy double, fit_seconds double, score_seconds double")


def _linear_rss(n: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (the constant last) and residual of least-squares lines from sums of 1, z and z z', y being the
    last of z. Residuals within rounding of the sums count as 0."""
    c = two - one[..., :, None] * one[..., None, :] / n[..., None, None]
    w = np.einsum("...ij,...j->...i", np.linalg.pinv(c[..., :-1, :-1], rcond=1e-10, hermitian=True), c[..., :-1, -1])
    rss = c[..., -1, -1] - (w * c[..., :-1, -1]).sum(-1)
    mean = one / n[..., None]
    return np.concatenate([w, mean[..., -1:] - (w * mean[..., :-1]).sum(-1, keepdims=True)], -1), np.where(rss > 1e-12 * two[..., -1, -1], rss, 0.0)


def _leaf_sums(rows: DataFrame, d: int, splits: list[dict], grids: dict, points: int, shift: np.ndarray, scale: np.ndarray) -> pd.DataFrame:
    """For each open node of a tree, feature and interval between its ``points`` thresholds: weighted sums of 1, z and
    z z' (z: the shifted and scaled x and y) and the least and largest x. A row a node, feature and interval."""
    upper = np.triu_indices(d + 1)
    sums = [f"s{i}" for i in range(1 + d + 1 + len(upper[0]))]
    ends = [f"{e}{i}" for e in ("lo", "hi") for i in range(d)]

    def run(batches):
        held = {at: (np.zeros((d, points + 1, len(sums))), np.full((d, points + 1, d), np.inf), np.full((d, points + 1, d), -np.inf)) for at in grids}
        for batch in batches:
            v = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(float)
            for t, split in enumerate(splits):
                if not any(tree == t for tree, _ in grids):
                    continue
                mine = v[v[:, d + 1 + t] > 0]
                node = np.ones(len(mine), np.int64)
                for k, (f, cut) in split.items():  # parents come before their children
                    here = node == k
                    node[here] = 2 * k + (mine[here, f] > cut)
                for (tree, k), grid in grids.items():
                    here = mine[node == k] if tree == t else mine[:0]
                    if len(here):
                        x, w, z = here[:, :d], here[:, d + 1 + t], (here[:, : d + 1] - shift) / scale
                        terms = np.c_[np.ones(len(z)), z, z[:, upper[0]] * z[:, upper[1]]] * w[:, None]
                        total, low, high = held[tree, k]
                        for f in range(d):
                            b = np.searchsorted(grid[f], x[:, f], "left")
                            total[f] += np.stack([np.bincount(b, col, points + 1) for col in terms.T], 1)
                            np.minimum.at(low[f], b, x)
                            np.maximum.at(high[f], b, x)
        out = []
        for (t, k), (total, low, high) in held.items():
            f, b = np.nonzero(total[:, :, 0])
            out.append(np.c_[np.full(len(f), t), np.full(len(f), k), f, b, total[f, b], low[f, b], high[f, b]])
        table = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64) if i < 4 else c) for i, c in enumerate(table.T)], names=["t", "k", "f", "b", *sums, *ends])

    kinds = ", ".join(["t long, k long, f long, b long", *[f"{c} double" for c in (*sums, *ends)]])
    how = [F.sum(c).alias(c) for c in sums] + [(F.min if c[0] == "l" else F.max)(c).alias(c) for c in ends]
    return rows.mapInArrow(run, kinds).groupBy("t", "k", "f", "b").agg(*how).toPandas()


def linear_leaf_forest(df: DataFrame, key: str, columns: list[str], label: str, trees: int = 8, sample: int | None = None, seed: int = 1, depth: int = 4, points: int = 100, least: int = 10, ratio: float = 0.9) -> DataFrame:
    """key, label, prediction: the mean of regression trees whose leaves are least-squares lines, fitted to all rows.

    A row's weight in a tree is a Poisson(1) draw by a hash of key and tree; with ``sample``, a tree takes so many rows
    of the least hashes instead. A node splits at one of ``points`` thresholds a feature, evenly between the ends of
    its rows, while that cuts the residual below ``ratio`` and leaves ``least`` rows. Each level takes one pass over
    the table; what is collected are sums, a row for each node, feature and interval between thresholds.
    """
    d, xs = len(columns), [f"_x{i}" for i in range(len(columns))]
    rows = df.select(key, F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs, strict=True)])
    known = rows.filter(" and ".join(f"abs({c}) < double('infinity')" for c in (*xs, "_y")))
    weights = []
    for t in range(trees):
        rank = F.xxhash64(F.lit(seed * 1000 + t), F.col(key))
        if sample is None:
            u = (F.pmod(rank, F.lit(1_000_003)) + 0.5) / 1_000_003.0
            steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])
            weights.append(sum((F.when(u > float(s), 1.0).otherwise(0.0) for s in steps[1:]), F.when(u > float(steps[0]), 1.0).otherwise(0.0)))
        else:
            last = known.select(rank.alias("r")).orderBy("r").limit(sample).agg(F.max("r")).first()[0]
            weights.append((rank <= F.lit(last)).cast("double"))
    wide = known.select(*xs, "_y", *[w.alias(f"_w{t}") for t, w in enumerate(weights)])
    ends = [e(F.when(F.col(f"_w{t}") > 0, F.col(x))) for t in range(trees) for e in (F.min, F.max) for x in xs]
    got = list(wide.agg(*[F.avg(c) for c in (*xs, "_y")], *[F.stddev_pop(c) for c in (*xs, "_y")], *ends).first())
    # A tree without rows has no ends; only tables of a few rows have such.
    bounds = {(t, 1): np.array(got[2 * d + 2 + 2 * d * t :][: 2 * d], float).reshape(2, d) for t in range(trees) if got[2 * d + 2 + 2 * d * t] is not None}
    shift, scale = (np.array(got[i : i + d + 1], float) for i in (0, d + 1))
    scale = np.where(scale > 0, scale, 1.0)
    upper, splits, lines, open_nodes = np.triu_indices(d + 1), [{} for _ in range(trees)], {}, bounds

    def fit(s):
        two = np.zeros((*s.shape[:-1], d + 1, d + 1))
        two[..., upper[0], upper[1]] = two[..., upper[1], upper[0]] = s[..., d + 2 :]
        return _linear_rss(s[..., 0], s[..., 1 : d + 2], two)

    for _ in range(depth):
        if not open_nodes:
            break
        grids = {at: np.linspace(*ends, points + 2)[1:-1].T for at, ends in open_nodes.items()}
        sums = _leaf_sums(wide, d, splits, grids, points, shift, scale).to_numpy(float)
        kids = {}
        for (t, k), grid in grids.items():
            here = sums[(sums[:, 0] == t) & (sums[:, 1] == k)]
            f, b = here[:, 2].astype(int), here[:, 3].astype(int)
            n_sums = sums.shape[1] - 4 - 2 * d
            part = np.zeros((d, points + 1, n_sums))
            part[f, b] = here[:, 4 : 4 + n_sums]
            low, high = np.full((d, points + 1, d), np.inf), np.full((d, points + 1, d), -np.inf)
            low[f, b], high[f, b] = here[:, 4 + n_sums : 4 + n_sums + d], here[:, 4 + n_sums + d :]
            lines[t, k], rss = fit(part[0].sum(0))
            left, right = part.cumsum(1)[:, :-1], part[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
            enough = np.argwhere((left[..., 0] >= least) & (right[..., 0] >= least))  # by feature and threshold
            if not len(enough):
                continue
            i, j = enough.T
            one, two = fit(left[i, j]), fit(right[i, j])
            cost = one[1] + two[1]
            best = int(np.flatnonzero(cost <= cost.min() + 1e-9 * rss)[0])
            if cost[best] >= ratio * rss:
                continue
            f, b = int(i[best]), int(j[best])
            splits[t][k] = f, float(grid[f][b])
            lines[t, 2 * k], lines[t, 2 * k + 1] = one[0][best], two[0][best]
            kids[t, 2 * k] = np.stack([low[f, : b + 1].min(0), high[f, : b + 1].max(0)])
            kids[t, 2 * k + 1] = np.stack([low[f, b + 1 :].min(0), high[f, b + 1 :].max(0)])
        open_nodes = kids

    forest = []
    for t in sorted({t for t, _ in lines}):
        slope = {k: w[:-1] * scale[-1] / scale[:-1] for (tree, k), w in lines.items() if tree == t}
        forest.append((splits[t], {k: np.r_[a, shift[-1] + scale[-1] * lines[t, k][-1] - a @ shift[:-1]] for k, a in slope.items()}))

    @F.pandas_udf("double")
    def predict(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in cols], 1)
        total = np.zeros(len(x))
        for split, line in forest:
            node = np.ones(len(x), np.int64)
            for k, (f, cut) in split.items():
                here = node == k
                node[here] = 2 * k + ~(x[here, f] <= cut)
            for k, w in line.items():
                if k not in split:
                    at = np.flatnonzero(node == k)
                    total[at] += np.c_[x[at], np.ones(len(at))] @ w
        return pd.Series(total / len(forest) if forest else np.full(len(x), shift[-1]))

    return rows.withColumn("prediction", predict(*xs)).select(key, F.col("_y").alias(label), "prediction")


def _waves(columns: list[str], n: int, gamma: float, seed: int):
    """The function that gives the Fourier features of rows of numbers."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (n, len(columns))), rng.uniform(0, 2 * math.pi, n)

    def waves(x):
        f = x @ w.T
        f += b
        np.cos(f, out=f)
        f *= math.sqrt(2 / n)
        return f

    return waves


def _numbers(columns: list[pa.Array]) -> np.ndarray:
    if any(c.null_count for c in columns):
        raise ValueError("a kernel margin needs rows without nulls")
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], 1)


def fourier_features(df: DataFrame, columns: list[str], n: int, gamma: float, seed: int = 1, out: str = "features") -> DataFrame:
    """Random Fourier features: their dot products approximate exp(-gamma |x - y|^2), so that a linear margin on them
    stands in for a kernel machine. They are worked out in Arrow batches; expressions over arrays took some 60 us a row."""
    from pyspark.ml.functions import array_to_vector

    waves = _waves(columns, n, gamma, seed)

    @F.arrow_udf("array<double>")
    def features(*x: pa.Array) -> pa.Array:
        f = waves(_numbers(x))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * n), pa.array(f.ravel()))

    return df.withColumn(out, array_to_vector(features(*[F.col(c).cast("double") for c in columns])))


def hinge_losses(rows: DataFrame, waves, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of weighted hinge losses, and its gradient, at each point (a row of coefficients, the intercept last), in one pass.

    ``rows`` has the columns of the features, then _y (-1, 1) and _w. A task works features out as it goes and keeps none.
    """
    k, many = points.shape

    def run(batches):
        total = np.zeros((k, many + 1))
        for batch in batches:
            x = _numbers(batch.columns)
            for i in range(0, len(x), HELD):
                f, y, w = waves(x[i : i + HELD, :-2]), x[i : i + HELD, -2, None], x[i : i + HELD, -1, None]
                short = 1 - y * (f @ points[:, :-1].T + points[:, -1])
                pull = np.where(short > 0, -y * w, 0)
                total[:, 0] += (np.maximum(short, 0) * w).sum(0)
                total[:, 1:-1] += pull.T @ f
                total[:, -1] += pull.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])

    sums = rows.mapInArrow(run, "sums array<double>").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col")).collect()
    total = np.array([v for _, v in sorted(map(tuple, sums))]).reshape(k, many + 1)
    return total[:, 0], total[:, 1:]


def descend(losses, x: np.ndarray, steps: int, tol: float = 1e-6, memory: int = 10) -> tuple[np.ndarray, float]:
    """A point of low loss, and the loss, by L-BFGS from x. ``losses(points)`` gives values and gradients of several points
    at once, so that all lengths of a step cost one pass over the rows."""
    (value, *_), (grad, *_) = losses(x[None])
    first, pairs = value, []
    for _ in range(steps):
        d, taken = -grad, []
        for s, y in reversed(pairs):
            taken.append(s @ d / (s @ y))
            d = d - taken[-1] * y
        if pairs:
            s, y = pairs[-1]
            d = d * (s @ y / (y @ y))
        for (s, y), a in zip(pairs, reversed(taken), strict=True):
            d = d + (a - y @ d / (s @ y)) * s
        slope, size = grad @ d, np.linalg.norm(grad)
        if not slope < 0:
            break
        for least in (-5, -13):
            lengths = 2.0 ** np.arange(least, least + 8) / (1 if pairs else size)
            values, grads = losses(x + lengths[:, None] * d)
            lower = values <= value + 1e-4 * lengths * slope
            if lower.any():
                break
        else:
            break
        flat = lower & (grads @ d >= 0.9 * slope)
        at = min(np.flatnonzero(flat if flat.any() else lower), key=lambda j: values[j])
        s, y, gain = lengths[at] * d, grads[at] - grad, value - values[at]
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        x, value, grad = x + s, values[at], grads[at]
        if gain <= tol * first:
            break
    return x, value


def kernel_margin(df: DataFrame, columns: list[str], label: str, weight: str | None = None, n: int = 64, gamma: float = 0.5, seed: int = 1) -> DataFrame:
    """The rows with a prediction (labels 0, 1) by a linear margin on random Fourier features; with row weights if given.

    The margin has the least mean hinge loss, as MLlib's LinearSVC has, which keeps all features: they are far larger than the rows.
    Here only the rows are kept, dealt out FITTED to a task, and each pass works their features out anew.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.when(y.isin(0.0, 1.0), 2 * y - 1).alias("_y"), w.alias("_w"))
    parts = math.ceil(rows.count() / FITTED)
    if not parts:
        raise ValueError("a kernel margin needs rows")
    rows = (rows.repartition(parts) if parts > 1 else rows).persist()
    try:
        if rows.filter("_y is null or _w is null or _w < 0").limit(1).count() or not rows.filter("_w > 0").limit(1).count():
            raise ValueError("a kernel margin needs labels of 0 and 1, and weights that aren't negative")
        known = fourier_features(rows, columns, n, gamma, seed, "_f").filter("_w > 0").agg(Summarizer.metrics("mean", "std").summary(F.col("_f"), F.col("_w")).alias("m"), F.sum("_w").alias("w")).first()
        mean, std, waves = known.m["mean"].toArray(), known.m["std"].toArray(), _waves(columns, n, gamma, seed)
        to = np.diag(np.r_[np.divide(1, std, out=np.zeros(n), where=std > 0), 1])  # from coefficients of centred features of standard deviation 1
        to[:-1, -1] = -mean * to.diagonal()[:-1]

        def losses(points):
            values, grads = hinge_losses(rows, waves, points @ to)
            return values / known.w, grads @ to.T / known.w

        point = descend(losses, np.zeros(n + 1), 50)[0] @ to
    finally:
        rows.unpersist()

    @F.arrow_udf("double")
    def side(f: pa.Array) -> pa.Array:
        return pa.array((f.flatten().to_numpy().reshape(-1, n) @ point[:-1] + point[-1] > 0).astype(float))

    return fourier_features(df, columns, n, gamma, seed, "_f").withColumn("prediction", side(vector_to_array("_f"))).drop("_f")
