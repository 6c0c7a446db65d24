"""Missing values of time series from ARIMA models in state space, by scans over ranges of a series.

A series is cut into ranges of RANGE rows, and a range is a row. The Kalman filter's steps form an associative
operation, so each range composes its steps by itself, the ranges of a series, a few numbers each, are scanned in
order, and every range then filters from the state it starts with. The backward recursion of the smoother is an
affine map and goes the same way. A series of any length is thus many tasks, and the values are those of a serial run.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .relate import running_sums

#: Rows of a range, variance of a level nothing is known of (in innovations' variances), and the largest coefficients.
RANGE = 2048
LEVEL = 1e6
MOST_PHI, MOST_RHO = 0.99, 0.499
#: Orders (p, d, q) that are compared, and their states: level, ARMA process and what is to come of it.
ORDERS = ((1, 0, 0), (2, 0, 0), (1, 0, 1), (0, 1, 0), (1, 1, 0), (0, 1, 1))
STATES = 3


def to_ranges(df: DataFrame, series: str, at: str, value: str, size: int = RANGE) -> DataFrame:
    """series, range, ats, values (nan where missing), and up to three values before the range: rows in order, ``size`` a row."""
    rows = df.select(F.col(series).alias("series"), F.col(at).alias("at"), F.col(value).cast("double").alias("v"))
    rows = running_sums(rows, {"pos": F.lit(1)}, ["series"], "at", "v").withColumn("pos", F.col("pos") - 1)
    r = F.floor(F.col("pos") / size)
    # The last rows of a range also go to the next one, whose lags reach back to them.
    spots = F.when(F.col("pos") % size >= size - STATES, F.array(r, r + 1)).otherwise(F.array(r))
    rows = rows.withColumn("range", F.explode(spots)).withColumn("own", F.col("range") == r)
    one = F.struct("pos", "at", F.coalesce("v", F.lit(float("nan"))).alias("v"), "own")
    g = rows.groupBy("series", "range").agg(F.array_sort(F.collect_list(one)).alias("t"))
    own = F.filter("t", lambda x: x["own"])
    g = g.select("series", "range", F.transform(own, lambda x: x["at"]).alias("ats"), F.transform(own, lambda x: x["v"]).alias("values"), F.transform(F.filter("t", lambda x: ~x["own"]), lambda x: x["v"]).alias("before"))
    return g.filter(F.size("values") > 0)


def _moment_sums(v: np.ndarray, start: int) -> list[float]:
    """Over rows from ``start`` on: n and sum; for lags 0 to 2 the pairs' number, product and both sums; for differences the number and products of lags 0 and 1."""
    out = []
    for lag in range(3):
        a, b = v[max(start - lag, 0) : len(v) - lag], v[max(start, lag) :]
        ok = ~np.isnan(a) & ~np.isnan(b)
        a, b = a[ok], b[ok]
        out += [float(ok.sum()), float((a * b).sum()), float(a.sum()), float(b.sum())]
    d = np.diff(v, prepend=np.nan)
    for lag in range(2):
        a, b = d[max(start - lag, 0) : len(v) - lag], d[max(start, lag) :]
        ok = ~np.isnan(a) & ~np.isnan(b)
        out += [float(ok.sum()), float((a[ok] * b[ok]).sum())]
    return out


_SUMS = [*(f"{c}{k}" for k in range(3) for c in ("n", "p", "a", "b")), "dn0", "dp0", "dn1", "dp1"]


def moments(ranges: DataFrame) -> DataFrame:
    """series, n, mean, the covariances g0, g1, g2 of known values and d0, d1 of their differences, by lag."""

    def run(batches):
        for batch in batches:
            rows = [_moment_sums(np.array([*b, *v], float), len(b)) for b, v in zip(batch.column("before").to_pylist(), batch.column("values").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("series"), *map(pa.array, zip(*rows, strict=True))], names=["series", *_SUMS]) if rows else pa.RecordBatch.from_pylist([])

    kind = ranges.schema["series"].dataType.simpleString()
    s = ranges.mapInArrow(run, f"series {kind}, " + ", ".join(f"{c} double" for c in _SUMS)).groupBy("series").agg(*[F.sum(c).alias(c) for c in _SUMS])
    s = s.withColumn("mean", F.col("a0") / F.nullif("n0", F.lit(0.0)))
    cov = lambda k: ((F.col(f"p{k}") - F.col("mean") * (F.col(f"a{k}") + F.col(f"b{k}"))) / F.nullif(f"n{k}", F.lit(0.0)) + F.col("mean") * F.col("mean")).alias(f"g{k}")
    return s.select("series", F.col("n0").alias("n"), "mean", *[cov(k) for k in range(3)], *[(F.col(f"dp{k}") / F.nullif(f"dn{k}", F.lit(0.0))).alias(f"d{k}") for k in range(2)])


def _within(x: Column, most: float) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(-most), x))


def _theta(rho: Column) -> Column:
    """The coefficient under 1 of a moving average with the correlation ``rho`` at lag 1."""
    r = _within(rho, MOST_RHO)
    return F.when(F.abs(r) < 1e-9, 0.0).otherwise((1 - F.sqrt(1 - 4 * r * r)) / (2 * F.nullif(r, F.lit(0.0))))


def candidates(m: DataFrame, orders=ORDERS) -> DataFrame:
    """series, order (its place), mean, d, phi1, phi2, theta: coefficients from moments. A model that isn't stationary or has no moments is left out.

    (0, 1, 0) needs none and always stays.
    """
    zero = F.lit(0.0)
    r1, r2, s1 = F.col("g1") / F.nullif("g0", zero), F.col("g2") / F.nullif("g0", zero), F.col("d1") / F.nullif("d0", zero)
    two = (r1 * (1 - r2) / F.nullif(1 - r1 * r1, zero), (r2 - r1 * r1) / F.nullif(1 - r1 * r1, zero))
    fits = (F.abs(two[1]) < MOST_PHI) & (two[1] + two[0] < MOST_PHI) & (two[1] - two[0] < MOST_PHI)
    phi = _within(F.col("g2") / F.nullif("g1", zero), MOST_PHI)
    u0, u1 = (1 + phi * phi) * F.col("g0") - 2 * phi * F.col("g1"), (1 + phi * phi) * F.col("g1") - phi * (F.col("g0") + F.col("g2"))
    how = {
        (1, 0, 0): (_within(r1, MOST_PHI), zero, zero),
        (2, 0, 0): (F.when(fits, two[0]), two[1], zero),
        (1, 0, 1): (phi, zero, _theta(u1 / F.nullif(u0, zero))),
        (0, 1, 0): (zero, zero, zero),
        (1, 1, 0): (_within(s1, MOST_PHI), zero, zero),
        (0, 1, 1): (zero, zero, _theta(s1)),
    }
    each = [F.struct(F.lit(i).alias("order"), F.lit(o[1]).alias("d"), *[c.alias(x) for c, x in zip(how[o], ("phi1", "phi2", "theta"), strict=True)]) for i, o in enumerate(orders)]
    c = m.select("series", F.coalesce("mean", zero).alias("mean"), F.inline(F.array(*each)))
    return c.filter("phi1 is not null and phi2 is not null and theta is not null")


def state_space(d: int, phi1: float, phi2: float, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """T, R, H and the variance of the state before the first row, the innovations' variance being 1. States: level, process, what is to come of it."""
    t = np.array([[float(d), float(d), 0], [0, phi1, 1], [0, phi2, 0]])
    r, h = np.array([0.0, 1, theta]), np.array([float(d), 1, 0])
    # The process' own variance solves P = T P T' + R R'.
    a = t[1:, 1:]
    p = np.zeros((STATES, STATES))
    p[1:, 1:] = np.linalg.solve(np.eye(4) - np.kron(a, a), np.outer(r, r)[1:, 1:].ravel()).reshape(2, 2)
    p[0, 0] = LEVEL * d
    return t, r, h, p


# ---- scans. An element is (A, b, C, eta, J), stacked in the first axis; a step goes from the filtered state before a row to that of the row.


def _t(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def _mv(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (a @ v[..., None])[..., 0]


def _steps(y: np.ndarray, t: np.ndarray, r: np.ndarray, h: np.ndarray):
    """The elements of the rows' steps; ``y`` has nan where a value is missing."""
    n, m, q = len(y), STATES, np.outer(r, r)
    known = ~np.isnan(y)
    z = np.where(known, y, 0.0)
    s = float(h @ q @ h)
    k, to = q @ h / s, t.T @ h / s
    a = np.where(known[:, None, None], (np.eye(m) - np.outer(k, h)) @ t, t)
    c = np.where(known[:, None, None], (np.eye(m) - np.outer(k, h)) @ q, q)
    j = np.where(known[:, None, None], np.outer(to, t.T @ h), np.zeros((m, m)))
    return a, z[:, None] * k * known[:, None], c, z[:, None] * to * known[:, None], np.broadcast_to(j, (n, m, m)).copy()


def _join(x, y):
    """The steps of ``x``, then those of ``y``."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = x, y
    eye = np.eye(STATES)
    m = np.linalg.inv(eye + c1 @ j2)
    n = _t(m)  # (I + J C)^-1, C and J being symmetric
    am = a2 @ m
    return am @ a1, _mv(am, b1 + _mv(c1, e2)) + b2, am @ c1 @ _t(a2) + c2, _mv(_t(a1) @ n, e2 - _mv(j2, b1)) + e1, _t(a1) @ n @ j2 @ a1 + j1


def _all(x):
    """All steps as one."""
    while len(x[0]) > 1:
        n = len(x[0]) // 2 * 2
        rest = [v[n:] for v in x]
        x = [np.concatenate([v, w]) for v, w in zip(_join([v[0:n:2] for v in x], [v[1:n:2] for v in x]), rest, strict=True)]
    return x


def _prefixes(x):
    """For each place, all steps up to it as one."""
    far = 1
    while far < len(x[0]):
        joined = _join([v[:-far] for v in x], [v[far:] for v in x])
        x = [np.concatenate([v[:far], w]) for v, w in zip(x, joined, strict=True)]
        far *= 2
    return x


def _from(state: tuple[np.ndarray, np.ndarray], x):
    """Filtered means and variances from a state before the steps (``x``: prefixes)."""
    a, b, c, e, j = x
    m0, p0 = state
    m = np.linalg.inv(np.eye(STATES) + p0 @ j)
    am = a @ m
    return _mv(am, m0 + _mv(p0[None], e)) + b, am @ p0 @ _t(a) + c


def _affine_prefixes(lam: np.ndarray, c: np.ndarray):
    """Compositions r -> lam r + c of all maps from the last to each place."""
    far = 1
    while far < len(lam):
        # place i takes what stands at i + far: first that, then its own
        lam2, c2 = lam.copy(), c.copy()
        lam2[:-far] = lam[:-far] @ lam[far:]
        c2[:-far] = _mv(lam[:-far], c[far:]) + c[:-far]
        lam, c, far = lam2, c2, far * 2
    return lam, c


def _filtered(y: np.ndarray, model, state):
    """Predicted means and variances of each row, its innovation and that one's variance, and the state after the last row."""
    t, r, h, _ = model
    m, p = _from(state, _prefixes(_steps(y, t, r, h)))
    before_m = np.concatenate([state[0][None], m[:-1]])
    before_p = np.concatenate([state[1][None], p[:-1]])
    a, big = _mv(t[None], before_m), t @ before_p @ t.T + np.outer(r, r)
    return a, big, y - a @ h, h @ big @ h, (m[-1], p[-1])


def _backward(known: np.ndarray, big: np.ndarray, v: np.ndarray, f: np.ndarray, t: np.ndarray, h: np.ndarray):
    """The maps r_t -> r_(t-1) of the smoother, row by row."""
    gain = _mv(t @ big, np.broadcast_to(h, (len(v), STATES))) / f[:, None]
    keep = t - gain[:, :, None] * h
    return _t(np.where(known[:, None, None], keep, t)), np.where(known[:, None], h * (np.where(known, v, 0.0) / f)[:, None], 0.0)


_MODEL = ["d", "phi1", "phi2", "theta", "mean"]
_STATE = "m array<double>, p array<double>"


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True)


def _flat(parts) -> list[float]:
    return np.concatenate([np.ravel(x) for x in parts]).tolist()


def kalman_fill(df: DataFrame, series: str, at: str, value: str, out: str = "filled", orders=ORDERS, size: int = RANGE) -> DataFrame:
    """series, at, value, ``out``, order ('p,d,q'): missing values are the smoothed ones of the series' ARIMA model.

    Coefficients come from autocovariances of the known values; the order is the one of the least AIC, from exact likelihoods
    (the first known value aside). Known values stay; nan counts as missing. A series without known values stays null. Times
    of a series should differ; equal ones sort by value. Infinite values aren't allowed. No rows: no rows.
    """
    ready = df.withColumn(value, F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
    ranges = cut(to_ranges(ready, series, at, value, size))
    kind, time_kind = ranges.schema["series"].dataType.simpleString(), df.schema[at].dataType.simpleString()
    models = cut(candidates(moments(ranges), orders))
    first = ranges.filter(F.exists("values", lambda x: ~F.isnan(x))).groupBy(F.col("series").alias("s")).agg(F.min("range").alias("first"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = models.select(F.col("series").alias("of"), "order", *_MODEL)
    todo = ranges.join(named, same("series", "of")).select("series", "range", "values", "order", *_MODEL)

    def elements(batches):
        for batch in batches:
            out = []
            for s, k, v, o, d, a, b, c, mean in _rows(batch):
                t, r, h, _ = state_space(d, a, b, c)
                out.append((s, k, o, d, a, b, c, _flat(_all(_steps(np.array(v, float) - mean, t, r, h)))))
            yield _batch(out, ["series", "range", "order", *_MODEL[:4], "x"], batch.schema.field("series").type)

    def _batch(rows, names, series_type):
        types = {"series": series_type, "range": pa.int64(), "order": pa.int32(), "d": pa.int32(), "phi1": pa.float64(), "phi2": pa.float64(), "theta": pa.float64(), "x": pa.list_(pa.float64()), "n": pa.int64(), "sq": pa.float64(), "lg": pa.float64(), "m": pa.list_(pa.float64()), "p": pa.list_(pa.float64()), "r": pa.list_(pa.float64())}
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for c, n in zip(cols, names, strict=True)], names=names)

    composed = todo.mapInArrow(elements, f"series {kind}, range long, order int, d int, phi1 double, phi2 double, theta double, x array<double>")

    def starts(table: pa.Table) -> pa.Table:
        """The state each range starts with. A row a range: a few dozen numbers."""
        table = table.sort_by("range")
        d, a, b, c = (table.column(x)[0].as_py() for x in _MODEL[:4])
        state, ms, ps = (np.zeros(STATES), state_space(d, a, b, c)[3]), [], []
        for x in table.column("x").to_pylist():
            ms.append(state[0].tolist())
            ps.append(state[1].ravel().tolist())
            parts = np.split(np.array(x), np.cumsum([9, 3, 9, 3])[:4])
            el = [p.reshape((1, STATES, STATES) if len(p) == 9 else (1, STATES)) for p in parts]
            m, p = _from(state, el)
            state = m[0], p[0]
        return pa.Table.from_arrays([table.column("series"), table.column("range"), table.column("order"), pa.array(ms, pa.list_(pa.float64())), pa.array(ps, pa.list_(pa.float64()))], names=["series", "range", "order", "m", "p"])

    begun = cut(composed.groupBy("series", "order").applyInArrow(starts, f"series {kind}, range long, order int, {_STATE}"))
    begun = begun.select(F.col("series").alias("bs"), F.col("range").alias("br"), F.col("order").alias("bo"), "m", "p")
    ready = todo.join(begun, same("series", "bs") & (F.col("range") == F.col("br")) & (F.col("order") == F.col("bo")))
    ready = cut(ready.join(first, same("series", "s"), "left").select("series", "range", "values", "order", *_MODEL, "m", "p", "first"))

    def state_of(m, p):
        return np.array(m, float), np.array(p, float).reshape(STATES, STATES)

    def likelihoods(batches):
        for batch in batches:
            out = []
            for s, k, v, o, d, a, b, c, mean, m, p, head in _rows(batch):
                y = np.array(v, float) - mean
                _, _, e, f, _ = _filtered(y, state_space(d, a, b, c), state_of(m, p))
                ok = np.flatnonzero(~np.isnan(y))
                ok = ok[1:] if k == head else ok
                out.append((s, o, len(ok), float((e[ok] ** 2 / f[ok]).sum()), float(np.log(f[ok]).sum())))
            yield _batch(out, ["series", "order", "n", "sq", "lg"], batch.schema.field("series").type)

    fit = ready.mapInArrow(likelihoods, f"series {kind}, order int, n long, sq double, lg double").groupBy("series", "order").agg(F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.sum("lg").alias("lg"))
    free = F.element_at(F.array(*[F.lit(p + q + 1) for p, _, q in orders]), F.col("order") + 1)
    aic = F.when((F.col("n") > 0) & (F.col("sq") > 0), F.col("n") * F.log(F.col("sq") / F.col("n")) + F.col("lg") + 2 * free)
    # Without an AIC (constant or too few values) the simplest model goes: no coefficients.
    rank = F.struct(F.coalesce(F.round(aic, 9), F.when(free == 1, -1e300).otherwise(1e300)), "order")
    best = cut(fit.groupBy("series").agg(F.min_by("order", rank).alias("best")))
    best = best.select(F.col("series").alias("ws"), "best")
    chosen = cut(ready.join(best, same("series", "ws") & (F.col("order") == F.col("best"))).drop("ws", "best"))

    def maps(batches):
        for batch in batches:
            out = []
            for s, k, v, _, d, a, b, c, mean, m, p, _ in _rows(batch):
                y, model = np.array(v, float) - mean, state_space(d, a, b, c)
                _, big, e, f, _ = _filtered(y, model, state_of(m, p))
                lam, con = _affine_prefixes(*_backward(~np.isnan(y), big, e, f, model[0], model[2]))
                out.append((s, k, _flat((lam[0], con[0]))))
            yield _batch(out, ["series", "range", "x"], batch.schema.field("series").type)

    def ends(table: pa.Table) -> pa.Table:
        """What each range's last row gets from the ranges after it."""
        table = table.sort_by([("range", "descending")])
        r, out = np.zeros(STATES), []
        for x in table.column("x").to_pylist():
            out.append(r.tolist())
            r = np.array(x[:9]).reshape(STATES, STATES) @ r + np.array(x[9:])
        return pa.Table.from_arrays([table.column("series"), table.column("range"), pa.array(out, pa.list_(pa.float64()))], names=["series", "range", "r"])

    back = chosen.mapInArrow(maps, f"series {kind}, range long, x array<double>").groupBy("series").applyInArrow(ends, f"series {kind}, range long, r array<double>")
    back = back.select(F.col("series").alias("es"), F.col("range").alias("er"), "r")
    full = chosen.join(back, same("series", "es") & (F.col("range") == F.col("er")))
    times = ranges.select(F.col("series").alias("ts"), F.col("range").alias("tr"), "ats")
    full = full.join(times, same("series", "ts") & (F.col("range") == F.col("tr"))).select("series", "range", "values", "order", *_MODEL, "m", "p", "r", "ats", "first")

    def smooth(batches):
        for batch in batches:
            for s, _, v, o, d, a, b, c, mean, m, p, r, ats, head in _rows(batch):
                raw = np.array(v, float)
                y, model = raw - mean, state_space(d, a, b, c)
                pred, big, e, f, _ = _filtered(y, model, state_of(m, p))
                known = ~np.isnan(y)
                lam, con = _affine_prefixes(*_backward(known, big, e, f, model[0], model[2]))
                rs = _mv(lam, np.broadcast_to(np.array(r, float), (len(y), STATES))) + con
                got = np.where(known, raw, (pred + _mv(big, rs)) @ model[2] + mean)
                n = len(y)
                at_type = batch.schema.field("ats").type.value_type
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * n, batch.schema.field("series").type), pa.array(ats, at_type), pa.array(raw, mask=~known), pa.array(got, mask=np.full(n, head is None)), pa.array([",".join(map(str, orders[o]))] * n)],
                    names=[series, at, value, out, "order"],
                )

    return full.mapInArrow(smooth, f"`{series}` {kind}, `{at}` {time_kind}, `{value}` double, `{out}` double, order string")


def serial_fill(v: np.ndarray, model, mean: float) -> tuple[np.ndarray, float, float]:
    """The same values row after row, and sums of squared scaled innovations and of their log variances."""
    t, r, h, p = model
    m = np.zeros(STATES)
    y, kept = np.asarray(v, float) - mean, []
    for x in y:
        a, big = t @ m, t @ p @ t.T + np.outer(r, r)
        f = h @ big @ h
        e = x - h @ a
        m, p = (a, big) if math.isnan(x) else (a + big @ h * e / f, big - np.outer(big @ h, big @ h) / f)
        kept.append((a, big, e, f))
    r_, out = np.zeros(STATES), np.empty(len(y))
    for i in range(len(y) - 1, -1, -1):
        a, big, e, f = kept[i]
        if math.isnan(y[i]):
            r_ = t.T @ r_
        else:
            gain = t @ big @ h / f
            r_ = h * e / f + (t - np.outer(gain, h)).T @ r_
        out[i] = h @ (a + big @ r_) + mean if math.isnan(y[i]) else v[i]
    ok = [k for k, x in zip(kept, y, strict=True) if not math.isnan(x)][1:]
    return out, sum(e * e / f for *_, e, f in ok), sum(math.log(f) for *_, f in ok)
