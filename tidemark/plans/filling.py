"""Queries on filling by ARIMA models, beside a filter and smoother that run row by row in recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arima, series
from .registry import query
from .relations import _FILLED, hourly

_PHI = lambda x: f"least(0.99::DOUBLE, greatest(-0.99::DOUBLE, {x}))"
_RHO = lambda x: f"least(0.499::DOUBLE, greatest(-0.499::DOUBLE, {x}))"


def _theta(rho: str) -> str:
    return f"CASE WHEN abs({_RHO(rho)}) < 1e-9 THEN 0 ELSE (1 - sqrt(1 - 4 * {_RHO(rho)} * {_RHO(rho)})) / (2 * {_RHO(rho)}) END"


def _cov(lag: int) -> str:
    b = f"v{lag}" if lag else "v"
    both = f"FILTER (WHERE v IS NOT NULL AND {b} IS NOT NULL)"
    return f"avg(v * {b}) - any_value(mean) * (avg(v) {both} + avg({b}) {both}) + any_value(mean) ** 2 AS c{lag}"


_MODELS = f"""i AS (SELECT event_type, tick, v, row_number() OVER (PARTITION BY event_type ORDER BY tick) AS i FROM g),
mu AS (SELECT event_type, avg(v) AS mean FROM i GROUP BY 1),
j AS (SELECT *, lag(v, 1) OVER w AS v1, lag(v, 2) OVER w AS v2, lag(v, 1) OVER w - lag(v, 2) OVER w AS dv1 FROM i JOIN mu USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY i)),
mo AS (SELECT event_type, any_value(mean) AS mean, {_cov(0)}, {_cov(1)}, {_cov(2)}, avg((v - v1) ** 2) AS d0, avg((v - v1) * dv1) AS d1 FROM j GROUP BY 1),
mr AS (SELECT *, c1 / c0 AS r1, c2 / c0 AS r2, d1 / d0 AS s1, {_PHI("c2 / c1")} AS f FROM mo),
ma AS (SELECT *, r1 * (1 - r2) / (1 - r1 * r1) AS p1, (r2 - r1 * r1) / (1 - r1 * r1) AS p2, ((1 + f * f) * c1 - f * (c0 + c2)) / ((1 + f * f) * c0 - 2 * f * c1) AS u FROM mr),
ca AS (SELECT event_type, mean, 0 AS o, '1,0,0' AS name, 2 AS k, 0.0::DOUBLE AS d, {_PHI("r1")} AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM ma
UNION ALL SELECT event_type, mean, 1, '2,0,0', 3, 0, p1, p2, 0 FROM ma WHERE abs(p2) < 0.99 AND p2 + p1 < 0.99 AND p2 - p1 < 0.99
UNION ALL SELECT event_type, mean, 2, '1,0,1', 3, 0, f, 0, {_theta("u")} FROM ma
UNION ALL SELECT event_type, mean, 3, '0,1,0', 1, 1, 0, 0, 0 FROM ma
UNION ALL SELECT event_type, mean, 4, '1,1,0', 2, 1, {_PHI("s1")}, 0, 0 FROM ma
UNION ALL SELECT event_type, mean, 5, '0,1,1', 2, 1, 0, 0, {_theta("s1")} FROM ma)"""

# k: state after row i (m, p), and what was predicted of the row (x, q), its innovation e and that one's variance f.
_FILTER = f"""s AS (SELECT *, (2 * a * c / (1 - b) + c * c + 1) / (1 - a * a - b * b - 2 * a * a * b / (1 - b)) AS z FROM ca),
k AS (SELECT event_type, mean, o, name, k AS free, d, a, b, c, 0::BIGINT AS i, NULL::DOUBLE AS v, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS m2, 0.0::DOUBLE AS m3, {arima.LEVEL}::DOUBLE * d AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p13, z AS p22, (a * b * z + c) / (1 - b) AS p23, b * b * z + c * c AS p33,
0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS x3, 0.0::DOUBLE AS q11, 0.0::DOUBLE AS q12, 0.0::DOUBLE AS q13, 0.0::DOUBLE AS q22, 0.0::DOUBLE AS q23, 0.0::DOUBLE AS q33, 0.0::DOUBLE AS e, 1.0::DOUBLE AS f FROM s
UNION ALL SELECT event_type, mean, o, name, free, d, a, b, c, i, v, x1 + h1 * w, x2 + h2 * w, x3 + h3 * w, q11 - h1 * h1 * g, q12 - h1 * h2 * g, q13 - h1 * h3 * g, q22 - h2 * h2 * g, q23 - h2 * h3 * g, q33 - h3 * h3 * g, x1, x2, x3, q11, q12, q13, q22, q23, q33, coalesce(e, 0), f
FROM (SELECT *, CASE WHEN v IS NULL THEN 0 ELSE e / f END AS w, CASE WHEN v IS NULL THEN 0 ELSE 1 / f END AS g FROM (SELECT *, v - mean - (d * x1 + x2) AS e, d * h1 + h2 AS f FROM (SELECT *, d * q11 + q12 AS h1, d * q12 + q22 AS h2, d * q13 + q23 AS h3
FROM (SELECT k.event_type, mean, o, name, free, d, a, b, c, n.i, n.v, d * (m1 + m2) AS x1, a * m2 + m3 AS x2, b * m2 AS x3, d * (p11 + 2 * p12 + p22) AS q11, d * (a * (p12 + p22) + p13 + p23) AS q12, d * b * (p12 + p22) AS q13, a * a * p22 + 2 * a * p23 + p33 + 1 AS q22, b * (a * p22 + p23) + c AS q23, b * b * p22 + c * c AS q33 FROM k JOIN i n ON n.event_type = k.event_type AND n.i = k.i + 1)))))"""

_BEST = """y AS (SELECT event_type, o, any_value(free) AS free, count(*) AS n, sum(e * e / f) AS sq, sum(ln(f)) AS lg FROM (SELECT *, row_number() OVER (PARTITION BY event_type, o ORDER BY i) AS nth FROM k WHERE v IS NOT NULL) WHERE nth > 1 GROUP BY 1, 2),
z AS (SELECT event_type, arg_min(o, (round(n * ln(sq / n) + lg + 2 * free, 9), o)) AS o FROM y GROUP BY 1),
t AS (SELECT k.*, d * q11 + q12 AS h1, d * q12 + q22 AS h2, d * q13 + q23 AS h3 FROM k JOIN z ON k.event_type = z.event_type AND k.o = z.o WHERE i > 0),
b AS (SELECT event_type, max(i) + 1 AS i, 0.0::DOUBLE AS r1, 0.0::DOUBLE AS r2, 0.0::DOUBLE AS r3 FROM t GROUP BY 1
UNION ALL SELECT event_type, i, d * r1 + d * u, d * r1 + a * r2 + b * r3 + u, r2 FROM (SELECT t.*, r1, r2, r3, CASE WHEN v IS NULL THEN 0 ELSE (e - d * (h1 + h2) * r1 - (a * h2 + h3) * r2 - b * h2 * r3) / f END AS u FROM b w JOIN t ON t.event_type = w.event_type AND t.i = w.i - 1))
SELECT t.event_type, i.tick, round(coalesce(t.v, d * (x1 + q11 * r1 + q12 * r2 + q13 * r3) + x2 + q12 * r1 + q22 * r2 + q23 * r3 + mean), 5) AS filled, t.name AS "order" FROM t JOIN b ON b.event_type = t.event_type AND b.i = t.i JOIN i ON i.event_type = t.event_type AND i.i = t.i"""


@query(f"WITH RECURSIVE {_FILLED}, {_MODELS}, {_FILTER}, {_BEST}")
def arima_fill(t):
    g = series.fill_gaps(hourly(t), "event_type", "tick", "v", 3600)
    return arima.kalman_fill(g, "event_type", "tick", "v").select("event_type", "tick", F.round("filled", 5).alias("filled"), "order")
