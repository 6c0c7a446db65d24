"""Spectra of series and of sliding windows.

A whole-series transform runs in one task a series (NumPy, a million samples take about 100 MB); sliding windows are
independent rows and spread over all tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linalg import hamming, hann


def dft(df: DataFrame, series: str, at: str, value: str) -> DataFrame:
    """series, k, re, im of each whole series by the definition; for short series, as it takes n products a sample."""
    w = Window.partitionBy(series)
    rows = df.select(series, (F.row_number().over(w.orderBy(at)) - 1).alias("i"), F.count("*").over(w).alias("n"), F.col(value).cast("double").alias("x"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    angle = 2 * F.pi() * (F.col("k") * F.col("i") % F.col("n")) / F.col("n")
    return rows.groupBy(series, "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), (-F.sum(F.col("x") * F.sin(angle))).alias("im"))


def periodogram(df: DataFrame, series: str, at: str, value: str, step_hours: float, window: str = "none") -> DataFrame:
    """series, k, period_hours, psd: one-sided power of the mean-free series, with an optional taper."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(at)[value].to_numpy(float)
        n = len(x)
        x = x - x.mean()
        x = x * (hann(n, False) if window == "hann" else hamming(n) if window == "hamming" else 1.0)
        f = np.fft.fft(x) / n
        k = np.arange(1, n // 2 + 1)
        return pd.DataFrame({series: pdf[series].iloc[0], "k": k, "period_hours": step_hours * n / k, "psd": 2 * np.abs(f[k]) ** 2})

    kind = df.schema[series].dataType.simpleString()
    return df.select(series, at, value).groupBy(series).applyInPandas(one, f"{series} {kind}, k long, period_hours double, psd double")


def spectral_peaks(psd: DataFrame, series: str, reach: int = 20, prominence: float = 10.0, apart: float = 0.1, most: int = 10) -> DataFrame:
    """series, rank, period_hours, psd: lines over ``prominence`` times the local median, the strongest first.

    A line closer than ``apart`` of its period to a stronger one is left out. All candidates of a
    series are folded in order, ``most`` comparisons each.
    """
    med = F.percentile("psd", F.lit(0.5)).over(Window.partitionBy(series).orderBy("k").rowsBetween(-reach, reach))
    top = psd.withColumn("m", med).filter((F.col("m") > 0) & (F.col("psd") / F.col("m") > prominence))
    cands = top.groupBy(series).agg(F.array_sort(F.collect_list(F.struct((-F.col("psd")).alias("s"), F.col("period_hours").alias("p")))).alias("c"))
    kind = "array<struct<s:double,p:double>>"

    def step(acc: Column, x: Column) -> Column:
        near = F.exists(acc, lambda y: F.abs(x["p"] - y["p"]) < apart * y["p"])
        return F.when(near | (F.size(acc) >= most), acc).otherwise(F.array_append(acc, x))

    kept = cands.select(series, F.posexplode(F.aggregate("c", F.array().cast(kind), step)).alias("rank", "x"))
    return kept.select(series, (F.col("rank") + 1).alias("rank"), F.col("x.p").alias("period_hours"), (-F.col("x.s")).alias("psd"))


def parseval(df: DataFrame, psd: DataFrame, series: str, value: str) -> DataFrame:
    """series, variance, power: equal for an untapered series. For an even number of samples the last line, which
    has no mirror image, counts half."""
    v = df.groupBy(series).agg(F.var_pop(value).alias("variance"), F.count(value).alias("n"))
    last = F.when((F.col("n") % 2 == 0) & (F.col("k") * 2 == F.col("n")), 0.5).otherwise(1.0)
    p = psd.join(v.select(series, "n"), series).groupBy(series).agg(F.sum(F.col("psd") * last).alias("power"))
    return v.join(p, series).select(series, "variance", "power")


def stft_power(windows: DataFrame, values: str = "values", out: str = "power") -> DataFrame:
    """Power of each mean-free window under a periodic Hann taper, unscaled, frequencies 0 .. w / 2."""

    @F.pandas_udf("array<double>")
    def power(s: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(w, float) for w in s]) if len(s) else np.zeros((0, 1))
        x = (x - x.mean(1, keepdims=True)) * hann(x.shape[1], True)
        return pd.Series(list(np.abs(np.fft.rfft(x, axis=1)) ** 2))

    return windows.withColumn(out, power(values))


def spectrogram(windows: DataFrame, taper: str = "none", values: str = "values", out: str = "log_power") -> DataFrame:
    """log10(2 |X / w|^2 + 1e-14) of each mean-free window, without frequency 0."""

    @F.pandas_udf("array<double>")
    def one(s: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(w, float) for w in s]) if len(s) else np.zeros((0, 2))
        n = x.shape[1]
        x = (x - x.mean(1, keepdims=True)) * (hann(n, False) if taper == "hann" else 1.0)
        return pd.Series(list(np.log10(2 * np.abs(np.fft.rfft(x, axis=1)[:, 1:] / n) ** 2 + 1e-14)))

    return windows.withColumn(out, one(values))


def band_columns(df: DataFrame, power: str, every: int, most: int) -> DataFrame:
    """f_0, f_5, ...: every ``every``-th frequency of a window's power."""
    return df.select("*", *[F.get(power, F.lit(i)).alias(f"f_{i}") for i in range(0, most + 1, every)])


def weibull_fit(df: DataFrame, series: str, value: str, rounds: int = 60) -> DataFrame:
    """series, n, mean, std, shape, scale by maximum likelihood (location 0) over the positive values.

    Newton's steps need three sums over the series each; the series is one group.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        x = x[x > 0]
        if len(x) < 2 or x.min() == x.max():
            return pd.DataFrame({series: [pdf[series].iloc[0]], "n": [len(x)], "mean": [x.mean() if len(x) else None], "std": [0.0], "shape": [None], "scale": [None]})
        top = x.max()
        z, c = np.log(x / top), 1.2
        for _ in range(rounds):
            w = np.exp(c * z)
            a, b, d = w.sum(), (w * z).sum(), (w * z * z).sum()
            g, slope = b / a - 1 / c - z.mean(), d / a - (b / a) ** 2 + 1 / c**2
            nxt = max(c - g / slope, c / 4)
            if abs(nxt - c) < 1e-12 * c:
                break
            c = nxt
        return pd.DataFrame({series: [pdf[series].iloc[0]], "n": [len(x)], "mean": [x.mean()], "std": [x.std()], "shape": [c], "scale": [top * np.exp(c * z).mean() ** (1 / c)]})

    kind = df.schema[series].dataType.simpleString()
    return df.select(series, value).filter(F.col(value).isNotNull()).groupBy(series).applyInPandas(one, f"{series} {kind}, n long, mean double, std double, shape double, scale double")


def weibull_threshold(fit: DataFrame, p: float = 0.9995) -> DataFrame:
    """The value that the largest of a series' samples stays below with chance p."""
    tail = -F.ln(1 - F.pow(F.lit(p), 1.0 / F.col("n")))
    return fit.withColumn("threshold", F.col("scale") * F.pow(tail, 1.0 / F.col("shape")))


def exponential_quantile(mean: float, p: float) -> float:
    return -mean * math.log(1 - p)
