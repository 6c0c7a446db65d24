"""Operators as pyspark.ml estimators, to be passed as arguments, tuned and put in pipelines."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anomaly import chi2_quantile


class _DistanceParams(HasInputCols, HasOutputCol, HasPredictionCol):
    alpha = Param(Params._dummy(), "alpha", "share of a normal law beyond the flag", TypeConverters.toFloat)


class DistanceOutlier(Estimator, _DistanceParams):
    """Squared distances to the mean by the covariance of the rows it is fitted to; flags beyond the 1 - alpha quantile
    of a chi-square law. fit() reads the rows once, into one aggregate row."""

    def __init__(self, *, inputCols=None, outputCol="distance", predictionCol="is_outlier", alpha=0.005):
        super().__init__()
        self._set(inputCols=inputCols, outputCol=outputCol, predictionCol=predictionCol, alpha=alpha)

    def _fit(self, df: DataFrame) -> DistanceOutlierModel:
        import numpy as np

        cols = self.getInputCols()
        n = len(cols)
        row = df.agg(*[F.avg(c) for c in cols], *[F.covar_samp(a, b) for a in cols for b in cols]).first()
        return self._copyValues(DistanceOutlierModel(list(map(float, row[:n])), np.linalg.pinv(np.array(row[n:], float).reshape(n, n)).tolist()))


class DistanceOutlierModel(Model, _DistanceParams):
    def __init__(self, mean=None, inverse=None):
        super().__init__()
        self.mean, self.inverse = mean, inverse

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        z = [F.col(c) - m for c, m in zip(cols, self.mean, strict=True)]
        d = sum((z[i] * z[j] * self.inverse[i][j] for i in range(len(z)) for j in range(len(z))), F.lit(0.0))
        out = df.withColumn(self.getOutputCol(), d)
        return out.withColumn(self.getPredictionCol(), F.col(self.getOutputCol()) > chi2_quantile(1 - self.getOrDefault("alpha"), len(cols)))
