"""Small dense algebra in NumPy, for columns of arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fft(x: np.ndarray) -> np.ndarray:
    """Discrete Fourier transform of 2^k samples: even and odd halves, level by level from pairs up."""
    x = np.asarray(x, complex)
    n = len(x)
    if n & (n - 1) or not n:
        raise ValueError("the length must be a power of two")
    rows = x.reshape(n, 1).T if n == 1 else x[_bit_reversed(n)].reshape(-1, 1)
    while rows.shape[0] > 1:
        size = rows.shape[1]
        turn = np.exp(-1j * np.pi * np.arange(size) / size)
        even, odd = rows[0::2], rows[1::2] * turn
        rows = np.concatenate([even + odd, even - odd], 1)
    return rows[0]


def _bit_reversed(n: int) -> np.ndarray:
    order = np.zeros(1, int)
    while len(order) < n:
        order = np.concatenate([order * 2, order * 2 + 1])
    return order


def inverse_fft(x: np.ndarray) -> np.ndarray:
    return np.conj(fft(np.conj(x))) / len(x)


def determinant(matrices: Column) -> Column:
    """Determinants of an array<array<double>> column, by LU decomposition."""

    @F.pandas_udf("double")
    def det(s: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else float(np.linalg.det(np.array([list(r) for r in m], float))) for m in s])

    return det(matrices)


def hann(n: int, periodic: bool) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else max(n - 1, 1)))


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / max(n - 1, 1))


def chi2_quantile(p: float, k: int) -> float:
    """Where a chi-square law of k degrees has distribution p: series for the lower gamma function, then bisection."""
    from math import exp, lgamma, log

    a = k / 2

    def cdf(x: float) -> float:
        if x <= 0:
            return 0.0
        z, term = x / 2, 1 / a
        total, i = term, 0
        while term > total * 1e-16 and i < 10_000:
            i += 1
            term *= z / (a + i)
            total += term
        return total * exp(a * log(z) - z - lgamma(a))

    low, high = 0.0, k + 10.0
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2
