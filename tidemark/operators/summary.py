"""Moments, quantiles, modes, correlation and covariance."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, column: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Mean, population spread, biased skewness, excess kurtosis, ends and count."""
    x = F.col(column).cast("double")
    r = lambda c: F.round(c, digits)
    aggs = [F.count(x).alias("n"), r(F.avg(x)).alias("mean"), r(F.stddev_pop(x)).alias("std"), r(F.var_pop(x)).alias("variance"), r(F.skewness(x)).alias("skew"), r(F.kurtosis(x)).alias("excess_kurtosis"), F.min(x).alias("low"), F.max(x).alias("high")]
    return df.groupBy(*(by or [])).agg(*aggs)


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """probability, value: exact quantiles with linear interpolation, one pass for all."""
    ps = F.array(*map(F.lit, probabilities))
    q = df.groupBy(*(by or [])).agg(F.percentile(F.col(column).cast("double"), ps).alias("q"))
    return q.select(*(by or []), F.inline(F.arrays_zip(ps.alias("probability"), F.col("q").alias("value"))))


def mode_smallest(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.mode(column, deterministic=True).alias("mode"))


def mode_first_seen(df: DataFrame, column: str, order_col: str, by: list[str]) -> DataFrame:
    """The most frequent value by group; of equals the one seen first in ``order_col``."""
    n = df.groupBy(*by, column).agg(F.count("*").alias("n"), F.min(order_col).alias("first_at"))
    return n.groupBy(*by).agg(F.max_by(column, F.struct("n", (-F.col("first_at")).alias("f"))).alias("mode"))


def skew_ranking(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    row = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.round(F.skewness(F.col(c).cast("double")), digits).alias("skew"), F.max(F.col(c).cast("double")).alias("high")).alias(c) for c in columns])
    return row.select(F.inline(F.array(*columns))).orderBy(F.desc("skew"), "column_name")


def _pairs(df: DataFrame, columns: list[str], fn, name: str, digits: int) -> DataFrame:
    row = df.agg(*[F.round(fn(F.col(a).cast("double"), F.col(b).cast("double")), digits).alias(f"{a}~{b}") for a, b in combinations_with_replacement(columns, 2)])
    cells = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"`{min((a, b), key=columns.index)}~{max((a, b), key=columns.index)}`").alias(name)) for a in columns for b in columns]
    return row.select(F.inline(F.array(*cells)))


def correlation_matrix(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Pearson's r of each pair over the rows where both are there, all pairs in one scan."""
    return _pairs(df, columns, F.corr, "r", digits)


def covariance_matrix(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return _pairs(df, columns, F.covar_pop, "covariance", digits)


def correlated_features(df: DataFrame, columns: list[str], label: str, least: float = 0.1) -> DataFrame:
    """The features whose r with the label is at least ``least`` either way."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(c, 6).alias("r")) for c in columns])
    return row.select(F.inline(cells)).filter(F.abs("r") >= least)
