"""ARIMA filling by ranges against a serial run."""

import math

import numpy as np
import pytest

from tidemark.operators import arima


def made(kind, n=1500, seed=1, lost=0.2):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    x = np.zeros(n)
    for i in range(n):
        x[i] = {"ar": 0.8, "arma": 0.9, "walk": 1.0, "ma": 1.0, "ar2": 1.2}[kind] * (x[i - 1] if i else 0) + e[i]
        x[i] += {"arma": 0.5, "ma": -0.6}.get(kind, 0) * (e[i - 1] if i else 0) - (0.5 * x[i - 2] if kind == "ar2" and i > 1 else 0)
    x = (x + 50).round(3)
    x[rng.random(n) < lost] = math.nan
    x[n // 3 : n // 3 + 40] = math.nan
    return x


def plain(v, orders=arima.ORDERS):
    """The filled values and order of a serial run."""
    k = v[~np.isnan(v)]
    mean = k.mean()

    def cov(x, lag, m):
        a, b = x[: len(x) - lag], x[lag:]
        ok = ~np.isnan(a) & ~np.isnan(b)
        a, b = a[ok], b[ok]
        return (a * b).mean() - m * (a.mean() + b.mean()) + m * m

    g = [cov(v, i, mean) for i in range(3)]
    d = [cov(np.diff(v), i, 0.0) for i in range(2)]
    clip = lambda x, m: max(-m, min(m, x))

    def theta(rho):
        r = clip(rho, 0.499)
        return 0.0 if abs(r) < 1e-9 else (1 - math.sqrt(1 - 4 * r * r)) / (2 * r)

    r1, r2 = g[1] / g[0], g[2] / g[0]
    p1, p2 = r1 * (1 - r2) / (1 - r1 * r1), (r2 - r1 * r1) / (1 - r1 * r1)
    phi = clip(g[2] / g[1], 0.99)
    u = (1 + phi * phi) * g[0] - 2 * phi * g[1], (1 + phi * phi) * g[1] - phi * (g[0] + g[2])
    how = {
        (1, 0, 0): (0, clip(r1, 0.99), 0, 0), (2, 0, 0): (0, p1, p2, 0) if abs(p2) < 0.99 and abs(p1) + p2 < 0.99 else None,
        (1, 0, 1): (0, phi, 0, theta(u[1] / u[0])), (0, 1, 0): (1, 0, 0, 0), (1, 1, 0): (1, clip(d[1] / d[0], 0.99), 0, 0), (0, 1, 1): (1, 0, 0, theta(d[1] / d[0])),
    }
    best = None
    for i, o in enumerate(orders):
        if how[o] is not None:
            out, sq, lg = arima.serial_fill(v, arima.state_space(*how[o]), mean)
            n = len(k) - 1
            aic = round(n * math.log(sq / n) + lg + 2 * (o[0] + o[2] + 1), 9)
            if best is None or (aic, i) < best[:2]:
                best = (aic, i, out)
    return best[2], ",".join(map(str, orders[best[1]]))


@pytest.mark.parametrize("size", [30, 700, 4000])
def test_ranges_give_the_values_of_a_serial_run(spark, size):
    series = {k: made(k) for k in ("ar", "arma", "walk", "ma", "ar2")}
    rows = [(k, 60 * i, None if math.isnan(x) else float(x)) for k, v in series.items() for i, x in enumerate(v)]
    got = arima.kalman_fill(spark.createDataFrame(rows, "s string, t long, v double").repartition(7), "s", "t", "v", size=size).orderBy("s", "t").collect()
    orders = {}
    for k, v in series.items():
        mine = [r for r in got if r.s == k]
        want, orders[k] = plain(v)
        assert {r.order for r in mine} == {orders[k]} and [r.t for r in mine] == [60 * i for i in range(len(v))]
        assert np.allclose([r.filled for r in mine], want, atol=1e-6)
        assert all(r.v is None or r.filled == r.v for r in mine)
    assert orders["ar"] == "1,0,0" and orders["ar2"] == "2,0,0" and orders["ma"] == "0,1,1"


def test_steps_are_associative():
    v, model = made("arma", 40), arima.state_space(0, 0.9, 0.0, 0.5)
    x = arima._steps(v - 50, *model[:3])
    whole, parts = arima._all(x), arima._all([np.concatenate(p) for p in zip(arima._all([c[:13] for c in x]), arima._all([c[13:] for c in x]), strict=True)])
    assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))
    assert all(np.allclose(a[-1], b[0]) for a, b in zip(arima._prefixes(x), whole, strict=True))


def test_odd_series(spark):
    rows = [("none", i, None) for i in range(4)] + [("one", 0, None), ("one", 1, 5.0), ("one", 2, None)] + [("same", i, None if i == 2 else 7.0) for i in range(6)] + [(None, i, float(i) if i % 2 else math.nan) for i in range(9)]
    df = spark.createDataFrame(rows, "s string, t long, v double")
    got = {(r.s, r.t): r.filled for r in arima.kalman_fill(df, "s", "t", "v", size=3).collect()}
    assert len(got) == len(rows) and all(got["none", i] is None for i in range(4))
    assert [got["one", i] for i in range(3)] == pytest.approx([5, 5, 5]) and got["same", 2] == pytest.approx(7)
    assert [got[None, i] for i in (1, 3, 5, 7)] == [1, 3, 5, 7] and got[None, 4] == pytest.approx(4, abs=0.5)
    assert arima.kalman_fill(df.limit(0), "s", "t", "v").count() == 0
