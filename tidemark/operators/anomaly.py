"""Outlier scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import chi2_quantile

EULER = 0.5772156649


def mahalanobis(df: DataFrame, columns: list[str], out: str = "t2") -> DataFrame:
    """Squared Mahalanobis distance by the sample covariance, as a column expression (the matrix has a cell a pair of columns)."""
    n = len(columns)
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    aggs += [F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    s = df.agg(*aggs).first()
    cov = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float)
    inv = np.linalg.pinv(cov)
    d = [F.col(c) - F.lit(float(s[f"m{i}"])) for i, c in enumerate(columns)]
    terms = [F.lit(float(inv[i, j])) * d[i] * d[j] for i in range(n) for j in range(n)]
    return df.withColumn(out, sum(terms[1:], terms[0]))


def hotelling(df: DataFrame, columns: list[str], alpha: float = 0.005) -> DataFrame:
    """t2 and is_outlier: beyond the 1 - alpha quantile of a chi-square law with a degree a column."""
    return mahalanobis(df, columns).withColumn("is_outlier", F.col("t2") > chi2_quantile(1 - alpha, len(columns)))


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among n; the published constant for 2 is 1, here the formula holds."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


class IsolationForest:
    """Trees on small samples: fitted from a bounded sample of rows, scored on all of them."""

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 1):
        self.trees, self.sample, self.seed = trees, sample, seed
        self.forest: list[list[tuple]] = []
        self.n = 0

    def fit(self, df: DataFrame, key: str, columns: list[str]) -> IsolationForest:
        """Draws trees * sample rows, 50,000 at most, by hashes of the key, so that reruns agree. A tree takes ``sample``
        of them; the trees of a larger forest share rows."""
        most = min(self.trees * self.sample, 50_000)
        rows = df.select(key, *columns).orderBy(F.xxhash64(F.lit(self.seed), F.col(key)), key).limit(most).toPandas()
        x = rows[columns].to_numpy(float)
        rng = np.random.default_rng(self.seed)
        self.columns, self.n = columns, min(self.sample, len(x))
        depth = math.ceil(math.log2(max(self.n, 2)))
        self.forest = [self._grow(x[rng.choice(len(x), self.n, replace=False)], depth, rng) for _ in range(self.trees)]
        return self

    @staticmethod
    def _grow(x: np.ndarray, depth: int, rng) -> list[tuple]:
        """Nodes (feature, threshold, left, right, size); feature -1 is a leaf."""
        nodes: list[tuple] = []

        def add(rows: np.ndarray, left: int) -> int:
            at = len(nodes)
            nodes.append(())
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
            if left == 0 or len(rows) <= 1 or not len(spread):
                nodes[at] = (-1, 0.0, 0, 0, len(rows))
                return at
            f = int(rng.choice(spread))
            t = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            go = rows[:, f] <= t
            a = add(rows[go], left - 1)
            nodes[at] = (f, t, a, add(rows[~go], left - 1), len(rows))
            return at

        add(x, depth)
        return nodes

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """2 ** -(mean depth / c): nearer 1 the easier a row is to isolate."""
        packed = [tuple(np.array(v) for v in zip(*t, strict=True)) for t in self.forest]
        depth_of = [np.array([path_length(s) for s in t[4]]) for t in packed]
        c = max(path_length(self.n), 1e-12)

        @F.pandas_udf("double")
        def one(*cols: pd.Series) -> pd.Series:
            x = np.stack([s.to_numpy(float) for s in cols], 1)
            total = np.zeros(len(x))
            for (feature, threshold, left, right, _), rest in zip(packed, depth_of, strict=True):
                at, depth, open_ = np.zeros(len(x), int), np.zeros(len(x)), np.ones(len(x), bool)
                while open_.any():
                    f = feature[at]
                    open_ = f >= 0
                    rows = np.flatnonzero(open_)
                    go = x[rows, f[rows]] <= threshold[at[rows]]
                    at[rows] = np.where(go, left[at[rows]], right[at[rows]])
                    depth[rows] += 1
                total += depth + rest[at]
            return pd.Series(2.0 ** (-total / len(packed) / c))

        return df.withColumn(out, one(*[F.col(x).cast("double") for x in self.columns]))


def flag_share(df: DataFrame, score: str, contamination: float, out: str = "is_outlier") -> DataFrame:
    """Flags scores over the 1 - contamination quantile. The quantile is exact: one aggregate row, broadcast."""
    cut = df.agg(F.percentile(score, F.lit(1 - contamination)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn(out, F.col(score) > F.col("_cut")).drop("_cut")


def mixture_distance(df: DataFrame, features: str, k: int, seed: int = 1, out: str = "distance") -> DataFrame:
    """Mahalanobis distances to a mixture's components, weighted by the posterior."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import vector_to_array

    model = GaussianMixture(k=k, seed=seed, featuresCol=features, probabilityCol="_p").fit(df)
    parts = [(g.mean.toArray(), np.linalg.pinv(g.cov.toArray())) for g in (r for r in model.gaussiansDF.collect())]

    @F.pandas_udf("double")
    def one(x: pd.Series, p: pd.Series) -> pd.Series:
        a, w = np.stack(x.to_list()), np.stack(p.to_list())
        d = np.stack([np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", a - m, inv, a - m), 0)) for m, inv in parts], 1)
        return pd.Series((d * w).sum(1))

    return model.transform(df).withColumn(out, one(vector_to_array(features), vector_to_array("_p"))).drop("_p", "prediction")
