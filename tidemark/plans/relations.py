"""Queries on joins, sets, trends and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relate, series, trends
from .registry import query


@query("SELECT n.n_nationkey, n.n_name, count(s.s_suppkey) AS n FROM nation n LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2")
def lookup_zero_fill_nations(t):
    return relate.lookup_zero_fill(t.nation.select("n_nationkey", "n_name"), "n_nationkey", t.supplier.filter("s_acctbal > 5000"), "s_nationkey")


@query("SELECT c.c_custkey, n.n_regionkey FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey")
def strict_lookup(t):
    c = t.customer.select("c_custkey", F.concat(F.lit("Key"), F.col("c_nationkey").cast("string")).alias("k"))
    d = t.nation.select(F.concat(F.lit("KEY"), F.col("n_nationkey").cast("string")).alias("d"), "n_regionkey")
    return relate.strict_lookup(c, "k", d, "d", ["n_regionkey"]).select("c_custkey", "n_regionkey")


@query("SELECT event_type AS key, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def strict_lookup_audit(t):
    dim = t.spark.createDataFrame([("CLICK",), ("VIEW",)], "name string")
    return relate.lookup_audit(t.events, "event_type", dim, "name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def resume_anti_join(t):
    done = t.orders.select(F.col("o_custkey").alias("c_custkey"))
    return relate.not_done(t.customer.select("c_custkey"), done, ["c_custkey"])


@query("""WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS i FROM part) SELECT s_suppkey, p_partkey FROM a JOIN b USING (i)""")
def positional_zip(t):
    return relate.positional_zip(t.supplier.select("s_suppkey"), t.part.select("p_partkey"), "s_suppkey", "p_partkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_index FROM orders")
def row_numbers(t):
    return relate.row_index(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "row_index")


@query("""WITH d AS (SELECT unnest(generate_series(min(p_size)::BIGINT * 3, max(p_size)::BIGINT * 3)) AS value FROM part) SELECT d.value, count(p.p_partkey) AS n FROM d LEFT JOIN part p ON p.p_size * 3 = d.value GROUP BY 1""")
def dense_domain_fill(t):
    return relate.dense_domain(t.part.select((F.col("p_size") * 3).alias("v")), "v")


@query("""SELECT p_partkey, CAST(unnest(CASE WHEN p_size >= 40 THEN range(0, 7) ELSE range(0, 1) END) AS INTEGER) AS copy FROM part""")
def oversample_rare(t):
    return relate.oversample(t.part.select("p_partkey", "p_size"), F.col("p_size") >= 40, 6).drop("p_size")


@query("""SELECT CAST(y AS INTEGER) AS y, count(*) AS n FROM (SELECT year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT year(o_orderdate) FROM orders WHERE year(o_orderdate) IN (1997, 1998)) GROUP BY 1""")
def union_periods(t):
    o = t.orders.select(F.year("o_orderdate").alias("y"))
    return o.filter("y = 1996").unionByName(o.filter(F.col("y").isin(1997, 1998))).groupBy("y").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_brand, list(DISTINCT p_size) FILTER (WHERE p_type LIKE 'P%' OR p_type LIKE 'S%') AS a, list(DISTINCT p_size) FILTER (WHERE p_retailprice > 1200) AS b FROM part GROUP BY 1),
c AS (SELECT p_brand, coalesce(a, []) AS a, coalesce(b, []) AS b FROM a)
SELECT p_brand, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either FROM c""")
def set_algebra_parts(t):
    g = t.part.groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_type").rlike("^[PS]"), F.col("p_size"))).alias("a"), F.collect_set(F.when(F.col("p_retailprice") > 1200, F.col("p_size"))).alias("b"))
    g = g.select("p_brand", *relate.set_algebra(F.col("a"), F.col("b")))
    return g.select("p_brand", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("both", "only_a", "either")])


_POINTS = "SELECT s_suppkey AS k, CAST(s_acctbal / 100 AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier"


@query(f"WITH p AS ({_POINTS}) SELECT a.k AS a, b.k AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM p a JOIN p b ON a.k < b.k AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 16")
def eps_pairs_small(t):
    p = t.supplier.select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return relate.close_pairs(p, "k", "x", "y", 4.0).withColumn("distance", F.round("distance", 6))


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(v), 2) AS total, round(sum(CASE WHEN o_orderstatus = 'F' THEN v ELSE 0 END), 2) AS first, round(sum(CASE WHEN o_orderstatus <> 'F' THEN v ELSE 0 END), 2) AS rest FROM (SELECT *, CASE WHEN o_totalprice > 5000 THEN o_totalprice END AS v FROM orders) GROUP BY 1""")
def yearly_conditional_sums(t):
    o = t.orders.withColumn("v", F.when(F.col("o_totalprice") > 5000, F.col("o_totalprice")))
    c = trends.conditional_sums(o, F.year("o_orderdate").alias("y"), "v", F.col("o_orderstatus") == "F")
    return c.select("y", *[F.round(x, 2).alias(x) for x in ("total", "first", "rest")])


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS y, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS "F", arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS "O", arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def last_row_wins_pivot(t):
    return trends.last_row_wins(t.orders, F.year("o_orderdate").alias("y"), "o_orderstatus", "o_totalprice", "o_orderkey", ["F", "O", "P"])


@query("""WITH p AS (SELECT c_nationkey AS k, count(*) AS pop FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT k, round(n / pop::DOUBLE * 100000, 6) AS rate FROM s JOIN p USING (k)""")
def rate_per_population(t):
    p = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("pop"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return trends.per_population(s.join(p, "k"), F.col("n"), F.col("pop")).select("k", F.round("rate", 6).alias("rate"))


_DAILY = "SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2"


@query(f"""WITH d AS ({_DAILY}), l AS (SELECT *, lead(v) OVER w AS nv, lead(day) OVER w AS nd FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)) SELECT event_type, day, round(greatest(0.0, (nv - v) / date_diff('day', day, nd)), 4) AS change FROM l WHERE nd IS NOT NULL""")
def clamped_daily_change(t):
    d = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    return trends.daily_change(d, "event_type", "day", "v").select("event_type", "day", F.round("change", 4).alias("change"))


@query("""WITH f AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n, CAST(sum(n) OVER w AS BIGINT) AS running, round(100.0::DOUBLE * sum(n) OVER w / sum(n) OVER (), 6) AS percent FROM f WINDOW w AS (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING)""")
def pareto_cumulative(t):
    return trends.pareto(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand")


@query("""WITH s AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS new_label FROM embeddings GROUP BY 1) SELECT e.vec_id, s.new_label FROM embeddings e JOIN s USING (label)""")
def relabel_by_size(t):
    return trends.relabel_by_size(t.embeddings.select("vec_id", "label"), "label").select("vec_id", "new_label")


def hourly(t):
    """event_type, tick (epoch seconds of the hour), v: mean value, null in hours whose mean is over 60."""
    tick = (F.unix_timestamp(F.date_trunc("hour", "ts").cast("timestamp"))).alias("tick")
    h = t.events.groupBy("event_type", tick).agg(F.round(F.avg("value"), 3).alias("v"))
    return h.withColumn("v", F.when(F.col("v") <= 60, F.col("v")))


_HOURLY = "SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS tick, CASE WHEN round(avg(value), 3) <= 60 THEN round(avg(value), 3) END AS v FROM events GROUP BY 1, 2"
_FILLED = f"""h AS ({_HOURLY}), l AS (SELECT *, lead(tick) OVER (PARTITION BY event_type ORDER BY tick) AS nx FROM h),
f AS (SELECT event_type, unnest(generate_series(tick, CASE WHEN nx - tick > 3601 THEN nx - 1 ELSE tick END, 3600)) AS tick, tick AS a, v FROM l), g AS (SELECT event_type, tick, CASE WHEN tick = a THEN v END AS v FROM f)"""


@query(f"WITH h AS ({_HOURLY}), l AS (SELECT event_type, tick AS gap_start, lead(tick) OVER (PARTITION BY event_type ORDER BY tick) AS gap_end FROM h) SELECT *, (gap_end - gap_start) // 3600 - 1 AS missing FROM l WHERE gap_end - gap_start > 3601")
def gap_detection(t):
    return series.gaps(hourly(t), "event_type", "tick", 3600)


@query(f"WITH {_FILLED} SELECT * FROM g")
def gap_fill(t):
    return series.fill_gaps(hourly(t), "event_type", "tick", "v", 3600)


_KNOWN = f"""{_FILLED}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY tick) AS i FROM g),
k AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM i
WINDOW b AS (PARTITION BY event_type ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_BETWEEN = "coalesce(v, pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0), pv, nv)"


@query(f"WITH {_KNOWN} SELECT event_type, tick, round({_BETWEEN}, 6) AS filled FROM k")
def hourly_rate_filled(t):
    g = series.fill_gaps(hourly(t), "event_type", "tick", "v", 3600)
    return series.interpolate(g, "event_type", "tick", "v").select("event_type", "tick", F.round("filled", 6).alias("filled"))


@query(f"WITH h AS ({_HOURLY}) SELECT event_type, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS n FROM h GROUP BY 1")
def skip_missing_stats(t):
    return series.series_statistics(hourly(t), "event_type", F.col("v")).select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("SELECT event_type, event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING), 6) AS median FROM events")
def moving_median_41(t):
    return series.moving_median(t.events.select("event_type", "event_id", "ts", "value"), "event_type", "ts", "value").select("event_type", "event_id", F.round("median", 6).alias("median"))


@query(f"WITH h AS ({_HOURLY}) SELECT event_type, tick, round(coalesce(v, avg(v) OVER (PARTITION BY event_type ORDER BY tick ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)), 6) AS filled FROM h")
def moving_average_fill(t):
    return series.moving_average_fill(hourly(t), "event_type", "tick", "v").select("event_type", "tick", F.round("filled", 6).alias("filled"))


@query("""WITH w AS (SELECT event_type, row_number() OVER p - 1 AS window_start, list(event_id) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM events WINDOW p AS (PARTITION BY event_type ORDER BY ts))
SELECT event_type, window_start, array_to_string(v, ',') AS ids FROM w WHERE len(v) = 8 AND window_start % 4 = 0""")
def sliding_arrays(t):
    s = series.sliding_arrays(t.events.select("event_type", "ts", "event_id"), "event_type", "ts", "event_id", 8, 4)
    return s.select("event_type", "window_start", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT event_type, round(least(100.0, avg(value) * -ln(1 - 0.9995::DOUBLE)), 5) AS threshold FROM events GROUP BY 1")
def exp_outlier_threshold(t):
    return series.exponential_threshold(t.events, "event_type", "value").withColumn("threshold", F.round("threshold", 5))


@query("SELECT event_type, CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE round(avg(value), 6) END AS mean, CASE WHEN event_type = 'view' THEN 2.0::DOUBLE ELSE round(stddev_pop(value), 6) END AS std, CASE WHEN event_type = 'view' THEN 3 ELSE count(*) END AS n FROM events GROUP BY 1")
def station_stats_resume(t):
    done = t.spark.createDataFrame([("view", 1.0, 2.0, 3)], "event_type string, mean double, std double, n long")
    s = series.series_statistics(t.events, "event_type", F.col("value"), done)
    return s.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM events) WHERE i % 10 = 0")
def every_nth_row(t):
    return series.every_nth(t.events.select("event_type", "ts", "event_id"), "event_type", "ts", 10).select("event_type", "event_id")


@query("SELECT event_type, arg_min(event_id, ts) AS event_id, arg_min(user_id, ts) AS user_id FROM events GROUP BY 1")
def first_row_metadata(t):
    return series.first_rows(t.events, "event_type", "ts", ["event_id", "user_id"])


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN abs(value) <= 100 THEN value END), 4) AS total FROM events")
def bad_threshold(t):
    return t.events.agg(F.count("*").alias("n"), F.round(F.sum(series.bad_to_null(F.col("value"), 100)), 4).alias("total"))
