"""Queries on trees: second-order boosting and forests, each beside the SQL of a small model of the same kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trees
from .registry import query

_BINS, _RATE, _L2, _LEAST = 16, 0.3, 1.0, 1.0
_NAMES = ("days", "price", "customer")
# Orders with a null customer in one of seven rows.
_ORDERS = """SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS days, CAST(o_totalprice AS DOUBLE) AS price, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS customer FROM orders"""


def _orders(t):
    return t.orders.select(
        F.col("o_orderkey").alias("k"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double").alias("days"),
        F.col("o_totalprice").cast("double").alias("price"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("double")).alias("customer"),
    )


def _boost_sql(rounds: int, depth: int) -> str:
    """Each level of each tree is a table of sums (s), one of best splits (b) and the rows a level lower (d)."""
    edge = ", ".join(f"list_sort(list_distinct(quantile_disc({c}, [{', '.join(f'{k / _BINS}::DOUBLE' for k in range(1, _BINS))}]))) AS e{i}" for i, c in enumerate(_NAMES))
    bins = ", ".join(f"CASE WHEN {c} IS NULL THEN 255 ELSE len(list_filter(e{i}, lambda e: e < {c})) END AS b{i}" for i, c in enumerate(_NAMES))
    parts = [f"o AS ({_ORDERS})", f"e AS (SELECT {edge} FROM o)", f"m0 AS (SELECT k, y, 0.0::DOUBLE AS m, {bins} FROM o, e)"]
    each = " UNION ALL ".join(f"SELECT node, {i} AS f, b{i} AS bin, g, h FROM {{d}}" for i in range(len(_NAMES)))
    score = lambda g, h: f"({g}) ** 2 / ({h} + {_L2}::DOUBLE)"
    out = []
    for r in range(rounds):
        parts.append(f"d{r}_0 AS (SELECT *, 1 AS node, 1 / (1 + exp(-m)) - y AS g, (1 / (1 + exp(-m))) * (1 - 1 / (1 + exp(-m))) AS h FROM m{r})")
        for v in range(depth):
            i = f"{r}_{v}"
            parts += [
                f"s{i} AS (SELECT node, f, bin, sum(g) AS g, sum(h) AS h FROM ({each.format(d=f'd{i}')}) GROUP BY 1, 2, 3)",
                f"c{i} AS (SELECT node, f, bin, sum(g) OVER a AS g, sum(h) OVER a AS h, coalesce(sum(g) FILTER (WHERE bin < 255) OVER w, 0) AS g0, coalesce(sum(h) FILTER (WHERE bin < 255) OVER w, 0) AS h0, coalesce(sum(g) FILTER (WHERE bin = 255) OVER a, 0) AS gm, coalesce(sum(h) FILTER (WHERE bin = 255) OVER a, 0) AS hm FROM s{i} WINDOW a AS (PARTITION BY node, f), w AS (PARTITION BY node, f ORDER BY bin))",
                f"t{i} AS (SELECT node, f, bin, g, h, z AS nulls_left, CASE WHEN z THEN g0 + gm ELSE g0 END AS gl, CASE WHEN z THEN h0 + hm ELSE h0 END AS hl FROM c{i}, (VALUES (TRUE), (FALSE)) v(z) WHERE bin < 255)",
                f"u{i} AS (SELECT *, 0.5::DOUBLE * ({score('gl', 'hl')} + {score('g - gl', 'h - hl')} - {score('g', 'h')}) AS gain FROM t{i} WHERE hl >= {_LEAST}::DOUBLE AND h - hl >= {_LEAST}::DOUBLE)",
                f"b{i} AS (SELECT * FROM u{i} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, bin, nulls_left DESC) = 1)",
                f"d{r}_{v + 1} AS (SELECT d.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN d.node ELSE 2 * d.node + CASE WHEN CASE b.f WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END = 255 THEN CASE WHEN nulls_left THEN 0 ELSE 1 END WHEN CASE b.f WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END > bin THEN 1 ELSE 0 END END AS node FROM d{i} d LEFT JOIN b{i} b ON d.node = b.node)",
            ]
            threshold = "coalesce(CASE f WHEN 0 THEN e0[bin + 1] WHEN 1 THEN e1[bin + 1] ELSE e2[bin + 1] END, 'infinity'::DOUBLE)"
            feature = "CASE f " + " ".join(f"WHEN {j} THEN '{c}'" for j, c in enumerate(_NAMES)) + " END"
            out.append(f"SELECT {r} AS tree, node, {feature} AS feature, {threshold} AS threshold, nulls_left, round(gain, 6) AS gain, NULL::DOUBLE AS value FROM b{i}, e")
        parts += [
            f"l{r} AS (SELECT node, -{_RATE}::DOUBLE * sum(g) / (sum(h) + {_L2}::DOUBLE) AS value FROM d{r}_{depth} GROUP BY 1)",
            f"m{r + 1} AS (SELECT k, y, m + value AS m, b0, b1, b2 FROM d{r}_{depth} JOIN l{r} USING (node))",
        ]
        out.append(f"SELECT {r}, node, NULL, NULL, NULL, NULL, round(value, 6) FROM l{r}")
    return f"WITH {', '.join(parts)} SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS BIGINT) AS node, feature, threshold, nulls_left, gain, value FROM ({' UNION ALL '.join(out)})"


@query(_boost_sql(2, 2))
def boosted_second_order(t):
    m = trees.boost(_orders(t), list(_NAMES), "y", 2, 2, _RATE, l2=_L2, min_hessian=_LEAST, bins=_BINS)
    return m.table(t.spark).withColumns({c: F.round(c, 6) for c in ("gain", "value")})


def _forest_sql(points: int, least: int) -> str:
    """One tree of depth 2 on all rows: every node's thresholds are even steps between the ends of its own rows."""
    parts = ["o AS (SELECT p_partkey AS k, p_size % 3 AS y, CAST(p_retailprice AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS x1 FROM part)", "d0 AS (SELECT *, 1 AS node FROM o)"]
    each = " UNION ALL ".join(f"SELECT node, y, {i} AS f, x{i} AS x FROM d{{v}}" for i in range(2))
    out = []
    for v in range(2):
        parts += [
            f"a{v} AS ({each.format(v=v)})",
            f"g{v} AS (SELECT node, f, min(x) AS lo, max(x) AS hi FROM a{v} GROUP BY 1, 2)",
            f"q{v} AS (SELECT node, f, i, lo + (hi - lo) * (i / {points - 1}.0::DOUBLE) AS z FROM g{v}, range({points}) r(i))",
            f"n{v} AS (SELECT q.node, q.f, q.i, any_value(z) AS z, y, count(*) FILTER (WHERE x <= z)::DOUBLE AS l, count(*)::DOUBLE AS t FROM q{v} q JOIN a{v} a ON a.node = q.node AND a.f = q.f GROUP BY 1, 2, 3, y)",
            f"s{v} AS (SELECT node, f, i, any_value(z) AS z, sum(l) AS nl, sum(t - l) AS nr, sum(t) AS nt, sum(l * l) AS sl, sum((t - l) ** 2) AS sr, sum(t * t) AS st FROM n{v} GROUP BY 1, 2, 3)",
            f"b{v} AS (SELECT *, round(1 - st / (nt * nt) - (nl * (1 - sl / (nl * nl)) + nr * (1 - sr / (nr * nr))) / nt, 9) AS gain FROM s{v} WHERE nl >= {least} AND nr >= {least} QUALIFY gain > 0 AND row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, i) = 1)",
            f"d{v + 1} AS (SELECT d.* EXCLUDE (node), CASE WHEN b.node IS NULL THEN d.node ELSE 2 * d.node + CASE WHEN CASE f WHEN 0 THEN x0 ELSE x1 END > z THEN 1 ELSE 0 END END AS node FROM d{v} d LEFT JOIN b{v} b ON d.node = b.node)",
        ]
        out.append(f"SELECT node, CASE f WHEN 0 THEN 'price' ELSE 'size' END AS feature, round(z, 6) AS threshold, gain, NULL::DOUBLE AS class FROM b{v}")
    out.append("SELECT node, NULL, NULL, NULL, arg_max(y, (n, -y))::DOUBLE FROM (SELECT node, y, count(*) AS n FROM d2 GROUP BY 1, 2) GROUP BY 1")
    return f"WITH {', '.join(parts)} SELECT CAST(node AS BIGINT) AS node, feature, threshold, gain, class FROM ({' UNION ALL '.join(out)})"


def _parts(t):
    return t.part.select("p_partkey", (F.col("p_size") % 3).alias("y"), F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"))


@query(_forest_sql(100, 5))
def forest_own_tree(t):
    m = trees.forest(_parts(t), "p_partkey", ["price", "size"], "y", 1, 2, least=5, bagged=False)
    return m.table(t.spark).select("node", "feature", F.round("threshold", 6).alias("threshold"), F.round("gain", 9).alias("gain"), F.col("value").alias("class"))


@query()
def forest_own_votes(t):
    """k, y, prediction, out_of_bag by ten bootstrapped trees of entropy, two columns drawn for a node."""
    o = _orders(t).fillna(0.0, ["customer"])
    return trees.forest(o, "k", list(_NAMES), "y", 10, 4, least=10, features=2, criterion="entropy").votes(o, "k", "y")
