"""Time series: gaps, filling, smoothing, windows. A series is (series column, epoch seconds, value).

All windows are partitioned by series. A missing value is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(series: str, at: str) -> Window:
    return Window.partitionBy(series).orderBy(at)


def gaps(df: DataFrame, series: str, at: str, step: int) -> DataFrame:
    """series, gap_start, gap_end, missing: where the next sample is over a step and a second away."""
    nxt = F.lead(at).over(_w(series, at))
    g = df.select(series, F.col(at).alias("gap_start"), nxt.alias("gap_end"))
    g = g.filter(F.col("gap_end") - F.col("gap_start") > step + 1)
    return g.withColumn("missing", F.floor((F.col("gap_end") - F.col("gap_start")) / step).cast("long") - 1)


def fill_gaps(df: DataFrame, series: str, at: str, value: str, step: int) -> DataFrame:
    """The samples with the missing times between them, whose value is null."""
    df = df.select(series, F.col(at).alias("_a"), value, F.lead(at).over(_w(series, at)).alias("_next"))
    last = F.when(F.col("_next") - F.col("_a") > step + 1, F.col("_next") - 1).otherwise(F.col("_a"))
    rows = df.select(series, "_a", value, F.explode(F.sequence(F.col("_a"), last, F.lit(step).cast("long"))).alias(at))
    return rows.select(series, at, F.when(F.col(at) == F.col("_a"), F.col(value)).alias(value))


def bad_to_null(value: Column, threshold: float) -> Column:
    return F.when(F.abs(value) <= threshold, value)


def interpolate(df: DataFrame, series: str, at: str, value: str, out: str = "filled") -> DataFrame:
    """Linear by position between the known neighbours; before the first and after the last the nearest holds."""
    w = _w(series, at)
    i = F.row_number().over(w)
    df = df.withColumn("_i", i)
    known = F.when(F.col(value).isNotNull(), F.col("_i"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({
        "_pv": F.last(value, True).over(back), "_pi": F.last(known, True).over(back),
        "_nv": F.first(value, True).over(ahead), "_ni": F.first(known, True).over(ahead),
    })
    between = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_i") - F.col("_pi")) / F.nullif(F.col("_ni") - F.col("_pi"), F.lit(0))
    return df.withColumn(out, F.coalesce(value, between, "_pv", "_nv")).drop("_i", "_pv", "_pi", "_nv", "_ni")


def moving_median(df: DataFrame, series: str, at: str, value: str, reach: int = 20, out: str = "median") -> DataFrame:
    """Median of the rows up to ``reach`` before and after, fewer at the ends."""
    return df.withColumn(out, F.percentile(F.col(value).cast("double"), F.lit(0.5)).over(_w(series, at).rowsBetween(-reach, reach)))


def moving_average_fill(df: DataFrame, series: str, at: str, value: str, reach: int = 4, out: str = "filled") -> DataFrame:
    """A missing value becomes the mean of the known ones up to ``reach`` rows either side."""
    return df.withColumn(out, F.coalesce(value, F.avg(value).over(_w(series, at).rowsBetween(-reach, reach))))


def sliding_arrays(df: DataFrame, series: str, at: str, value: str, width: int, stride: int = 1, drop_last: bool = False) -> DataFrame:
    """series, window_start (row number from 0), values: every ``stride``-th full window of ``width`` rows."""
    w = _w(series, at)
    df = df.select(series, (F.row_number().over(w) - 1).cast("long").alias("window_start"), F.collect_list(value).over(w.rowsBetween(0, width - 1)).alias("values"), F.count("*").over(Window.partitionBy(series)).alias("_n"))
    full = (F.size("values") == width) & (F.col("window_start") % stride == 0)
    if drop_last:
        full &= F.col("window_start") + width + stride <= F.col("_n")
    return df.filter(full).select(series, "window_start", "values")


def exponential_threshold(df: DataFrame, series: str, value: str, p: float = 0.9995, most: float = 100.0) -> DataFrame:
    """The value that an exponential law with the series' mean exceeds with chance 1 - p, ``most`` at most."""
    return df.groupBy(series).agg(F.least(F.lit(most), F.avg(value) * -math.log(1 - p)).alias("threshold"))


def series_statistics(df: DataFrame, series: str, value: Column, done: DataFrame | None = None) -> DataFrame:
    """series, mean, std, n of the known values, for series that aren't in ``done``, which come along as they are."""
    todo = df.join(done.select(series), series, "left_anti") if done is not None else df
    new = todo.groupBy(series).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    return new.unionByName(done) if done is not None else new


def every_nth(df: DataFrame, series: str, at: str, n: int) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(_w(series, at)) - 1).filter(F.col("_i") % n == 0).drop("_i")


def first_rows(df: DataFrame, series: str, at: str, columns: list[str]) -> DataFrame:
    """The first row of each series, without sorting any."""
    return df.groupBy(series).agg(F.min_by(F.struct(*columns), at).alias("r")).select(series, "r.*")


def _in_numpy(df: DataFrame, series: str, at: str, value: str, out: str, fill) -> DataFrame:
    """A series is one group; ``fill`` gets its values in order (NaN where missing) and returns them filled."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        pdf[out] = fill(pdf[value].to_numpy(float)) if pdf[value].notna().any() else float("nan")
        return pdf

    kinds = {c: df.schema[c].dataType.simpleString() for c in (series, at, value)}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + f", {out} double"
    return df.select(series, at, value).groupBy(series).applyInPandas(one, schema)


def spline_fill(df: DataFrame, series: str, at: str, value: str, out: str = "filled") -> DataFrame:
    """A natural cubic spline through the known values by position; beyond the ends the nearest holds."""
    import numpy as np

    def fill(v):
        x = np.flatnonzero(~np.isnan(v)).astype(float)
        y = v[~np.isnan(v)]
        n, at_ = len(x), np.arange(len(v), dtype=float)
        if n < 3:
            return np.interp(at_, x, y)
        h, m = np.diff(x), np.zeros(n)
        # Second derivatives of the knots: one tridiagonal sweep down and one back.
        diag, right = 2 * (h[:-1] + h[1:]), 6 * (np.diff(y[1:]) / h[1:] - np.diff(y[:-1]) / h[:-1])
        for i in range(1, n - 2):
            f = h[i] / diag[i - 1]
            diag[i] -= f * h[i]
            right[i] -= f * right[i - 1]
        for i in range(n - 3, -1, -1):
            m[i + 1] = (right[i] - (h[i + 1] * m[i + 2] if i < n - 3 else 0)) / diag[i]
        t = np.clip(at_, x[0], x[-1])
        k = np.clip(np.searchsorted(x, t, side="right") - 1, 0, n - 2)
        a, b = x[k + 1] - t, t - x[k]
        return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b

    return _in_numpy(df, series, at, value, out, fill)


def level_fill(df: DataFrame, series: str, at: str, value: str, ratio: float = 0.5, out: str = "filled") -> DataFrame:
    """Missing values from a local-level Kalman filter and smoother. ``ratio``: level noise over sample noise."""
    import numpy as np

    def fill(v):
        scale = max(float(np.nanvar(np.diff(v[~np.isnan(v)]))) if (~np.isnan(v)).sum() > 2 else 1.0, 1e-12)
        r, q = scale / (2 + ratio), scale * ratio / (2 + ratio)
        n, m, p = len(v), float(v[~np.isnan(v)][0]), 1e6 * scale
        ms, ps = np.zeros(n), np.zeros(n)
        for i in range(n):
            p += q
            if not np.isnan(v[i]):
                g = p / (p + r)
                m, p = m + g * (v[i] - m), (1 - g) * p
            ms[i], ps[i] = m, p
        for i in range(n - 2, -1, -1):
            ms[i] += ps[i] / (ps[i] + q) * (ms[i + 1] - ms[i])
        return np.where(np.isnan(v), ms, v)

    return _in_numpy(df, series, at, value, out, fill)


FILLS = {"linear": interpolate, "spline": spline_fill, "average": moving_average_fill, "level": level_fill}


def prepare(df: DataFrame, series: str, at: str, value: str, step: int, threshold: float, method: str = "linear", outlier=None) -> DataFrame:
    """Bad values to null, gaps filled with rows, then missing values by ``method``; 'skip' leaves them out.

    ``outlier``: Column -> Column, true where a filled value is an outlier; those are filled anew.
    """
    df = fill_gaps(df.withColumn(value, bad_to_null(F.col(value), threshold)), series, at, value, step)
    if method == "skip":
        return df.filter(F.col(value).isNotNull()).withColumn("filled", F.col(value))
    fill = FILLS[method]
    out = fill(df, series, at, value)
    if outlier is not None:
        out = out.withColumn(value, F.when(~outlier(F.col("filled")), F.col("filled"))).drop("filled")
        out = fill(out, series, at, value)
    return out
