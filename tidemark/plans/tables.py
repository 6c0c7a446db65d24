"""Queries on frequencies, summaries, bins and recoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import binning, profile, recode, summary
from .registry import query


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def frequency_priority(t):
    return profile.frequency(t.orders, "o_orderpriority")


@query("""WITH f AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM f)
SELECT value, n FROM r WHERE k <= 5 UNION ALL SELECT 'other', CAST(sum(n) AS BIGINT) FROM r WHERE k > 5 HAVING count(*) > 0""")
def topk_other_brand(t):
    return profile.top_k_other(t.part, "p_brand", 5)


@query("""WITH f AS (SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY 1) SELECT value, n FROM f ORDER BY n DESC, value LIMIT 20""")
def topk_only_nations(t):
    return profile.top_k_other(t.customer, "c_nationkey", 20, drop_other=True)


@query("""SELECT 'value' AS column_name, count(*) FILTER (WHERE v IS NULL) AS n_null FROM (SELECT CASE WHEN value <= 100 THEN value END AS v FROM events)
UNION ALL SELECT 'kind', count(*) FILTER (WHERE nullif(event_type, 'error') IS NULL) FROM events
UNION ALL SELECT 'event_id', count(*) FILTER (WHERE event_id IS NULL) FROM events""")
def null_profile_events(t):
    e = t.events.select("event_id", F.when(F.col("value") <= 100, F.col("value")).alias("value"), F.nullif("event_type", F.lit("error")).alias("kind"))
    return profile.null_profile(e)


@query("""SELECT unnest(['p_partkey','p_brand','p_type','p_size']) AS column_name, unnest([count(DISTINCT p_partkey), count(DISTINCT p_brand), count(DISTINCT p_type), count(DISTINCT p_size)]) AS n_distinct FROM part""")
def distinct_profile_part(t):
    return profile.distinct_profile(t.part, ["p_partkey", "p_brand", "p_type", "p_size"])


@query("""SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) v(column_name, data_type)""")
def type_profile_nation(t):
    return profile.type_profile(t.nation)


@query("SELECT count(*) AS n_rows, CAST(9 AS BIGINT) - 3 AS n_columns FROM part")
def shape_profile_part(t):
    return profile.shape_profile(t.part)


@query("""SELECT min(d) AS first_day, max(d) AS last_day, count(DISTINCT d) AS n_days, count(*) AS n_rows FROM (SELECT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'error' OR value > 100)""")
def incomplete_span_events(t):
    e = t.events.select("ts", F.nullif("event_type", F.lit("error")).alias("kind"), F.when(F.col("value") <= 100, F.col("value")).alias("value"))
    return profile.incomplete_span(e, "ts", ["kind", "value"])


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(c_mktsegment, '')) AS value FROM customer) WHERE value <> '' GROUP BY 1")
def charset_frequency_names(t):
    return profile.char_frequency(t.customer, "c_mktsegment")


@query("SELECT CAST(length(p_name) AS BIGINT) AS length, count(*) AS n FROM part GROUP BY 1")
def length_frequency(t):
    return profile.length_frequency(t.part, "p_name")


@query("""SELECT d.value, count(e.label) AS n FROM (SELECT unnest(range(0, 13)) AS value) d LEFT JOIN embeddings e ON e.label = d.value GROUP BY 1""")
def cluster_size_zero_filled(t):
    return profile.zero_filled_counts(t.embeddings, "label", 0, 12)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS total, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def sum_by_key(t):
    return profile.basic_counts(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("total", F.round("total", 2))


@query("""WITH m AS (SELECT l_returnflag, avg(l_quantity) AS a, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1)
SELECT l.l_returnflag, count(*) AS n, round(any_value(a), 6) AS mean, round(any_value(s), 6) AS std, round(var_pop(l_quantity), 6) AS variance,
round(avg((l_quantity - a) ** 3) / any_value(s) ** 3, 6) AS skew, round(kurtosis_pop(l_quantity), 6) AS excess_kurtosis, min(l_quantity) AS low, max(l_quantity) AS high
FROM lineitem l JOIN m USING (l_returnflag) GROUP BY 1""")
def moments_lineitem(t):
    return summary.moments(t.lineitem, "l_quantity", ["l_returnflag"])


@query("""SELECT o_orderpriority, unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS probability, round(unnest(quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95])), 4) AS value FROM orders GROUP BY 1""")
def quantiles_totalprice(t):
    q = summary.quantiles(t.orders, "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95], ["o_orderpriority"])
    return q.withColumn("value", F.round("value", 4))


@query("""SELECT p_brand, p_size AS mode FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY 1, 2) WHERE k = 1""")
def mode_size(t):
    return summary.mode_smallest(t.part, "p_size", ["p_brand"])


@query("""SELECT p_brand, p_size AS mode FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, min(p_partkey)) AS k FROM part GROUP BY 1, 2) WHERE k = 1""")
def mode_first_seen_size(t):
    return summary.mode_first_seen(t.part, "p_size", "p_partkey", ["p_brand"])


@query("""WITH m AS (SELECT avg(p_size) a1, stddev_pop(p_size) s1, avg(p_retailprice) a2, stddev_pop(p_retailprice) s2, avg(p_partkey) a3, stddev_pop(p_partkey) s3 FROM part)
SELECT 'p_size' AS column_name, round(avg((p_size - a1) ** 3) / any_value(s1) ** 3, 6) AS skew, CAST(max(p_size) AS DOUBLE) AS high FROM part, m
UNION ALL SELECT 'p_retailprice', round(avg((p_retailprice - a2) ** 3) / any_value(s2) ** 3, 6), max(p_retailprice) FROM part, m""")
def skew_ranking_part(t):
    return summary.skew_ranking(t.part, ["p_size", "p_retailprice"])


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql(fn: str, name: str, digits: int) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({fn}({a}, {b}), {digits}) AS {name} FROM lineitem" for a in _LI for b in _LI)


@query(_matrix_sql("corr", "r", 6))
def correlation_matrix(t):
    return summary.correlation_matrix(t.lineitem, _LI)


@query(_matrix_sql("covar_pop", "covariance", 3))
def covariance_matrix(t):
    return summary.covariance_matrix(t.lineitem, _LI, 3)


@query("""SELECT * FROM (SELECT 'l_extendedprice' AS column_name, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem UNION ALL SELECT 'l_discount', round(corr(l_discount, l_quantity), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(corr(l_tax, l_quantity), 6) FROM lineitem) WHERE abs(r) >= 0.1""")
def correlated_features(t):
    return summary.correlated_features(t.lineitem, ["l_extendedprice", "l_discount", "l_tax"], "l_quantity")


def _hist_sql(table: str, x: str, bins: str, top: str, width: str) -> str:
    return f"""WITH v AS (SELECT {x} AS x FROM {table}), s AS (SELECT count(x) AS n, min(x) AS low, max(x) AS high FROM v),
p AS (SELECT *, {bins} AS bins, {top} AS top FROM s), w AS (SELECT *, {width} AS width FROM p),
b AS (SELECT CAST(CASE WHEN width > 0 THEN greatest(0, least(floor((x - low) / width), bins - 1)) ELSE 0 END AS BIGINT) AS bin, low, width FROM v, w WHERE x IS NOT NULL)
SELECT bin, round(low + bin * width, 6) AS low_edge, round(low + (bin + 1) * width, 6) AS high_edge, count(*) AS n FROM b GROUP BY bin, low, width"""


_STURGES = "CAST(1 + floor(log2(n)) AS BIGINT)"
_EVEN = "(top - low) / bins"


@query(_hist_sql("orders", "o_totalprice", _STURGES, "high + 1", _EVEN))
def sturges_histogram(t):
    return binning.sturges_histogram(t.orders, "o_totalprice")


@query(_hist_sql("customer", "log10(greatest(c_acctbal, 1.0))", _STURGES, "high + 1", _EVEN))
def log_histogram(t):
    return binning.sturges_histogram(t.customer, "c_acctbal", log=True)


@query(_hist_sql("part", "CAST(p_size AS DOUBLE)", _STURGES, "high", _EVEN))
def closed_edge_histogram(t):
    return binning.closed_histogram(t.part, "p_size")


@query(_hist_sql("events", "value", "CAST(8 AS BIGINT)", "high", _EVEN))
def closed_histogram_8(t):
    return binning.closed_histogram(t.events, "value", 8)


@query(_hist_sql("customer", "c_acctbal", "CAST(12 AS BIGINT)", "high", "greatest(floor((top - low) / bins), 1.0)"))
def floor_width_histogram(t):
    return binning.floor_width_histogram(t.customer, "c_acctbal", 12)


@query("""WITH b AS (SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 AND l_quantity <= 50 THEN 2 END AS bin FROM lineitem)
SELECT CAST(bin AS BIGINT) AS bin, [0.0::DOUBLE, 10, 25][bin + 1] AS low_edge, [10.0::DOUBLE, 25, 50][bin + 1] AS high_edge, count(*) AS n FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def explicit_edges(t):
    return binning.explicit_edges(t.lineitem, "l_quantity", [0, 10, 25, 50])


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 40 THEN CAST(floor(l_quantity / 10) AS BIGINT) END AS label FROM lineitem) GROUP BY 1""")
def half_open_labels(t):
    return t.lineitem.groupBy(binning.half_open_label(F.col("l_quantity"), 10, 40).alias("label")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(floor((value - lo) / nullif(hi - lo, 0) * 9.9) AS INTEGER) AS color, count(*) AS n FROM events, s GROUP BY 1""")
def color_buckets(t):
    e = t.events.crossJoin(F.broadcast(t.events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))))
    return e.groupBy(S.color_bucket(F.col("value"), F.col("lo"), F.col("hi")).alias("color")).agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT log10(greatest(o_totalprice, 1.0)) AS x FROM orders), s AS (SELECT count(x) AS n, min(x) AS low, max(x) + 1 AS top FROM v), p AS (SELECT *, CAST(1 + floor(log2(n)) AS BIGINT) AS bins FROM s),
h AS (SELECT least(floor((x - low) / ((top - low) / bins)), bins - 1) AS bin, low, (top - low) / bins AS width, count(*) AS n FROM v, p GROUP BY ALL),
e AS (SELECT round(low + bin * width, 6) AS a, lead(round(low + bin * width, 6)) OVER (ORDER BY bin) AS b, n FROM h), m AS (SELECT (a + b) / 2 AS mid, n FROM e WHERE b IS NOT NULL),
g AS (SELECT sum(mid * n) / sum(n) AS mean, sum(n) AS total FROM m),
q AS (SELECT mean, sum((mid - mean) ** 2 * n) / any_value(total) AS m2, sum((mid - mean) ** 3 * n) / any_value(total) AS m3, sum((mid - mean) ** 4 * n) / any_value(total) AS m4 FROM m, g GROUP BY mean)
SELECT round(mean, 6) AS mean, round(m2, 6) AS variance, round(m3 / m2 ** 1.5, 5) AS skew, round(m4 / m2 ** 2 - 3, 5) AS excess_kurtosis, (SELECT round(mid, 6) FROM m ORDER BY n DESC, mid LIMIT 1) AS mode FROM q""")
def binned_log_stats(t):
    return binning.binned_statistics(t.orders, "o_totalprice")


@query("""SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE 'rest' END AS segment, count(*) AS n FROM customer GROUP BY 1""")
def recode_segment(t):
    seg = recode.recode(F.col("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"}, F.lit("rest"))
    return t.customer.groupBy(seg.alias("segment")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""")
def onehot_drop_first(t):
    return recode.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], drop_first=True).drop("o_orderstatus")


@query("""SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS s_F, CAST(o_orderstatus = 'O' AS INTEGER) AS s_O, CAST(o_orderstatus = 'P' AS INTEGER) AS s_P FROM orders""")
def onehot_all(t):
    return recode.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], prefix="s").drop("o_orderstatus")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part")
def label_encode(t):
    return recode.label_encode(t.part.select("p_partkey", "p_type"), "p_type").select("p_partkey", "code")


@query("""WITH s AS (SELECT avg(c_acctbal) a, stddev_pop(c_acctbal) d FROM customer) SELECT c_custkey, round((c_acctbal - a) / d, 6) AS z FROM customer, s""")
def zscore_population(t):
    return recode.zscore(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal_z", 6).alias("z"))


@query("""WITH s AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) q FROM customer) SELECT c_custkey, round((c_acctbal - q[2]) / (q[3] - q[1]), 6) AS r FROM customer, s""")
def robust_scale(t):
    return recode.robust_scale(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal_r", 6).alias("r"))


@query("""WITH s AS (SELECT min(p_size) a, max(p_size) b FROM part) SELECT p_partkey, round((p_size - a) / (b - a)::DOUBLE, 6) AS m FROM part, s""")
def minmax_scale(t):
    return recode.minmax_scale(t.part.select("p_partkey", "p_size"), ["p_size"]).select("p_partkey", F.round("p_size_m", 6).alias("m"))


@query("""WITH s AS (SELECT avg(p_retailprice) a FROM part) SELECT p_partkey, round(p_retailprice - a, 5) AS c FROM part, s""")
def mean_center(t):
    return recode.center(t.part.select("p_partkey", "p_retailprice"), ["p_retailprice"]).select("p_partkey", F.round("p_retailprice_c", 5).alias("c"))


@query("""WITH v AS (SELECT event_id, CASE WHEN value <= 100 THEN value END AS v FROM events), s AS (SELECT avg(v) a FROM v) SELECT event_id, round(coalesce(v, a), 6) AS value FROM v, s""")
def impute_mean(t):
    e = t.events.select("event_id", F.when(F.col("value") <= 100, F.col("value")).alias("value"))
    return recode.impute_mean(e, ["value"]).withColumn("value", F.round("value", 6))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS d FROM orders), s AS (SELECT max(d) m FROM v) SELECT o_orderkey, CAST(coalesce(d, m + 31) AS DATE) AS d FROM v, s""")
def date_fill_max_plus_31(t):
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("d"))
    return recode.fill_date_after_max(o, "d")


@query("""SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos FROM orders""")
def cyclic_month(t):
    s, c = S.cyclic_month(F.month("o_orderdate").cast("double"))
    return t.orders.select("o_orderkey", (F.round(s, 6) + 0.0).alias("month_sin"), (F.round(c, 6) + 0.0).alias("month_cos"))


@query("""SELECT event_id, round((value - 32) * 5 / 9, 6) AS celsius, round(value * 1852 / 3600, 6) AS mps, round(1013.25::DOUBLE * (value / 29.92::DOUBLE), 6) AS hpa FROM events""")
def unit_convert(t):
    v = F.col("value")
    return t.events.select("event_id", F.round(S.fahrenheit_to_celsius(v), 6).alias("celsius"), F.round(S.knots_to_mps(v), 6).alias("mps"), F.round(S.inches_to_hpa(v), 6).alias("hpa"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '?' WHEN 1 THEN ' ' || CAST(event_id AS VARCHAR) || ' ' WHEN 2 THEN '///' WHEN 3 THEN '1.5x' ELSE '2.5' END AS s FROM events)
SELECT event_id, TRY_CAST(trim(s) AS DOUBLE) AS value, coalesce(TRY_CAST(trim(s) AS DOUBLE), 0) AS filled FROM v""")
def dirty_number_parse(t):
    i = F.col("event_id")
    s = F.when(i % 5 == 0, "?").when(i % 5 == 1, F.concat(F.lit(" "), i.cast("string"), F.lit(" "))).when(i % 5 == 2, "///").when(i % 5 == 3, "1.5x").otherwise("2.5")
    return t.events.select("event_id", S.number(s).alias("value"), S.number_or_zero(s).alias("filled"))


@query("""SELECT event_id, coalesce(map {'N': 0.0::DOUBLE, 'SSW': 202.5, 'E': 90, 'NW': 315}[d], -1) AS degrees FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'SSW' WHEN 2 THEN 'E' WHEN 3 THEN 'NW' ELSE 'calm' END AS d FROM events)""")
def compass_degrees(t):
    i = F.col("event_id") % 5
    d = F.when(i == 0, "北").when(i == 1, "南南西").when(i == 2, "E").when(i == 3, "NW").otherwise("calm")
    return t.events.select("event_id", S.compass_degrees(d).alias("degrees"))


@query("""SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP) ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 7 HOUR END, '%Y-%m-%d %H:%M') AS at FROM orders""")
def hour24_rollover(t):
    hh = F.when(F.col("o_orderkey") % 3 == 0, "24:00").otherwise("07:00")
    return t.orders.select("o_orderkey", F.date_format(S.hour24(F.col("o_orderdate").cast("date"), hh), "yyyy-MM-dd HH:mm").alias("at"))


@query("""SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'patched' WHEN 7 THEN 'mended' ELSE n_name END AS n_name FROM nation""")
def point_update(t):
    return recode.point_update(t.nation, "n_nationkey", "n_name", {3: "patched", 7: "mended"}).select("n_nationkey", "n_name")


@query("""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, round(sum(least(greatest(o_totalprice, 1000), 200000)), 2) AS clipped FROM orders GROUP BY 1""")
def parse_and_clip(t):
    day = F.to_date(F.date_format("o_orderdate", "MM/dd/yyyy"), "MM/dd/yyyy").cast("string")
    return t.orders.groupBy(day.alias("day")).agg(F.round(F.sum(S.clip(F.col("o_totalprice"), 1000, 200000)), 2).alias("clipped"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) - 32400 AS BIGINT) AS epoch FROM orders")
def local_epochs(t):
    return t.orders.select("o_orderkey", S.local_epoch(F.col("o_orderdate").cast("date"), "Asia/Tokyo").alias("epoch"))


@query("""WITH r AS (SELECT CASE WHEN value <= 60 THEN value END AS v, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT CAST(i * 20 // n AS INTEGER) AS bucket, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS v FROM r GROUP BY 1""")
def null_matrix(t):
    return profile.null_matrix(t.events.select("event_id", F.when(F.col("value") <= 60, F.col("value")).alias("v")), ["v"], "event_id")
