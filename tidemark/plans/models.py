"""Queries on spectra, clusters, outliers and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import anomaly, cluster, linalg, linkage, models, relate, series, signal, splits
from .registry import query
from .relations import _BETWEEN, _FILLED, _KNOWN, hourly


def _filled(t):
    g = series.fill_gaps(hourly(t), "event_type", "tick", "v", 3600)
    return series.interpolate(g, "event_type", "tick", "v")


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS x FROM events GROUP BY 1, 2), e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d), k AS (SELECT *, unnest(range(n)) AS k FROM e)
SELECT event_type, k, round(sum(x * cos(2 * pi() * (k * i % n) / n)), 4) + 0.0 AS re, round(-sum(x * sin(2 * pi() * (k * i % n) / n)), 4) + 0.0 AS im FROM k GROUP BY 1, 2""")
def dft_small_sql(t):
    d = t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("x"))
    d = signal.dft(d, "event_type", "day", "x")
    return d.select("event_type", "k", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


def _daily(t):
    return t.events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("x"))


_DAY = "d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS x FROM events GROUP BY 1, 2)"


_HOUR = f"{_KNOWN}, d AS (SELECT event_type, tick AS day, {_BETWEEN} AS x FROM k)"


def _lines_sql(taper: str, values: str = _DAY, hours: int = 24) -> str:
    return f"""WITH {values}, e AS (SELECT event_type, x - avg(x) OVER (PARTITION BY event_type) AS x, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d),
t AS (SELECT event_type, i, n, x * {taper} AS x FROM e), s AS (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM t)
SELECT event_type, k, round({hours}.0::DOUBLE * any_value(n) / k, 6) AS period_hours, round(2 * (sum(x * cos(2 * pi() * (k * i % n) / n)) ** 2 + sum(x * sin(2 * pi() * (k * i % n) / n)) ** 2) / any_value(n) ** 2, 6) + 0.0 AS psd FROM s GROUP BY 1, 2"""


_NO_TAPER, _HANN = "1.0::DOUBLE", "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / (n - 1)))"


def _shown(p):
    return p.select("event_type", "k", F.round("period_hours", 6).alias("period_hours"), (F.round("psd", 6) + 0.0).alias("psd"))


def _lines(t, window):
    return _shown(signal.periodogram(_daily(t), "event_type", "day", "x", 24.0, window))


def _hourly_lines(t, window="none"):
    return signal.periodogram(_filled(t), "event_type", "tick", "filled", 1.0, window)


@query(_lines_sql(_NO_TAPER, _HOUR, 1))
def periodogram(t):
    return _shown(_hourly_lines(t))


@query(_lines_sql(_HANN, _HOUR, 1))
def periodogram_hann(t):
    return _shown(_hourly_lines(t, "hann"))


@query(_lines_sql(_NO_TAPER))
def periodogram_daily(t):
    return _lines(t, "none")


@query(_lines_sql(_HANN))
def periodogram_daily_hann(t):
    return _lines(t, "hann")


def _frames_sql(taper: str, first: int, power: str, digits: int) -> str:
    return f"""WITH {_DAY}, e AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d),
s AS (SELECT a.event_type, a.i AS window_start, b.i - a.i AS j, b.x - avg(b.x) OVER (PARTITION BY a.event_type, a.i) AS x FROM e a JOIN e b ON a.event_type = b.event_type AND b.i BETWEEN a.i AND a.i + 7 WHERE a.i + 8 <= a.n),
h AS (SELECT event_type, window_start, j, x * {taper} AS x, unnest(range({first}, 5)) AS k FROM s),
p AS (SELECT event_type, window_start, k, sum(x * cos(2 * pi() * (k * j % 8) / 8)) ** 2 + sum(x * sin(2 * pi() * (k * j % 8) / 8)) ** 2 AS p FROM h GROUP BY 1, 2, 3)
SELECT event_type, window_start, CAST(k AS INTEGER) AS k, round({power}, {digits}) + 0.0 AS power FROM p"""


def _frames(t):
    return series.sliding_arrays(_daily(t), "event_type", "day", "x", 8)


@query(_frames_sql("(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 8))", 0, "p", 6))
def stft_daily(t):
    p = signal.stft_power(_frames(t)).select("event_type", "window_start", F.posexplode("power").alias("k", "p"))
    return p.select("event_type", "window_start", "k", (F.round("p", 6) + 0.0).alias("power"))


@query(_frames_sql("(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 7))", 1, "log10(2 * p / 64 + 1e-14)", 6))
def spectrogram_daily(t):
    p = signal.spectrogram(_frames(t), "hann").select("event_type", "window_start", F.posexplode("log_power").alias("k", "p"))
    return p.select("event_type", "window_start", (F.col("k") + 1).alias("k"), (F.round("p", 6) + 0.0).alias("power"))


@query(f"""WITH RECURSIVE p AS ({_lines_sql(_NO_TAPER, _HOUR, 1).replace("round(2 *", "(2 *").replace(", 6) + 0.0 AS psd", ") AS psd")}),
o AS (SELECT *, median(psd) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS m FROM p), c AS (SELECT event_type, list({{'s': psd, 'p': period_hours}} ORDER BY psd DESC, period_hours) AS c FROM o WHERE m > 0 AND psd / m > 5 GROUP BY 1),
r AS (SELECT event_type, c, 1 AS i, c[1:0] AS kept FROM c UNION ALL SELECT event_type, c, i + 1, CASE WHEN len(kept) >= 10 OR len(list_filter(kept, lambda y: abs(c[i].p - y.p) < 0.1 * y.p)) > 0 THEN kept ELSE list_append(kept, c[i]) END FROM r WHERE i <= len(c)),
u AS (SELECT event_type, unnest(range(1, len(kept) + 1)) AS rank, unnest(kept) AS y FROM r WHERE i > len(c)) SELECT event_type, CAST(rank AS INTEGER) AS rank, round(y.p, 6) AS period_hours, round(y.s, 6) AS psd FROM u""")
def spectral_peaks(t):
    p = signal.spectral_peaks(_hourly_lines(t), "event_type", prominence=5.0)
    return p.select("event_type", "rank", F.round("period_hours", 6).alias("period_hours"), F.round("psd", 6).alias("psd"))


@query("""SELECT event_type, TRUE AS equal FROM events GROUP BY 1""")
def parseval_check(t):
    f = _filled(t)
    p = signal.parseval(f, signal.periodogram(f, "event_type", "tick", "filled", 1.0), "event_type", "filled")
    return p.select("event_type", (F.abs(F.col("variance") - F.col("power")) < 1e-6 * F.col("variance")).alias("equal"))


def _windows(t, stride=12, drop_last=False):
    return series.sliding_arrays(_filled(t), "event_type", "tick", "filled", 24, stride, drop_last)


@query()
def stft_power(t):
    return signal.stft_power(_windows(t, 1)).select("event_type", "window_start", "power")


@query()
def spectrogram_log(t):
    return signal.spectrogram(_windows(t), "hann").select("event_type", "window_start", "log_power")


@query(f"""WITH {_HOUR}, e AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d),
s AS (SELECT a.event_type, a.i AS window_start, b.i - a.i AS j, b.x - avg(b.x) OVER (PARTITION BY a.event_type, a.i) AS x FROM e a JOIN e b ON a.event_type = b.event_type AND b.i BETWEEN a.i AND a.i + 23 WHERE a.i % 12 = 0 AND a.i + 24 <= a.n),
w AS (SELECT event_type, window_start, j, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 24)) AS x, unnest([0, 5, 10]) AS f FROM s),
p AS (SELECT event_type, window_start, f, sum(x * cos(2 * pi() * (f * j % 24) / 24)) ** 2 + sum(x * sin(2 * pi() * (f * j % 24) / 24)) ** 2 AS p FROM w GROUP BY 1, 2, 3)
SELECT event_type, window_start, round(max(p) FILTER (WHERE f = 0), 6) + 0.0 AS f_0, round(max(p) FILTER (WHERE f = 5), 6) + 0.0 AS f_5, round(max(p) FILTER (WHERE f = 10), 6) + 0.0 AS f_10, CAST(window_start BETWEEN 100 AND 299 AS INTEGER) AS state FROM p GROUP BY 1, 2""")
def stft_state_labels(t):
    p = signal.band_columns(signal.stft_power(_windows(t)), "power", 5, 10)
    state = F.when(F.col("window_start").between(100, 299), 1).otherwise(0)
    return p.select("event_type", "window_start", *[(F.round(c, 6) + 0.0).alias(c) for c in ("f_0", "f_5", "f_10")], state.alias("state"))


@query()
def stft_anomalies(t):
    p = signal.band_columns(signal.stft_power(_windows(t, 1)), "power", 4, 12).withColumn("key", F.xxhash64("event_type", "window_start"))
    f = anomaly.IsolationForest(50).fit(p, "key", ["f_4", "f_8", "f_12"])
    flagged = anomaly.flag_share(f.score(p), "score", 0.05)
    return flagged.filter("is_outlier").select("event_type", (F.col("window_start") + 12).alias("centre"), "score")


def _weibull_sql(rounds: int = 15) -> str:
    """Newton's steps for the shape, one after the other."""
    steps = ["c0 AS (SELECT event_type, 1.2::DOUBLE AS c FROM m)"]
    for k in range(rounds):
        sums = f"SELECT event_type, c, sum(exp(c * z)) AS a, sum(z * exp(c * z)) AS b, sum(z * z * exp(c * z)) AS d, avg(z) AS l FROM z JOIN c{k} USING (event_type) GROUP BY 1, 2"
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT event_type, greatest(c - (b / a - 1 / c - l) / (d / a - (b / a) ** 2 + 1 / c ** 2), c / 4) AS c FROM ({sums}))")
    return f"""v AS (SELECT event_type, value::DOUBLE AS x FROM events WHERE value > 0), m AS (SELECT event_type, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, max(x) AS top FROM v GROUP BY 1), z AS MATERIALIZED (SELECT event_type, ln(x / top) AS z FROM v JOIN m USING (event_type)),
{", ".join(steps)}, w AS (SELECT event_type, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std, any_value(c) AS shape, any_value(top) * avg(exp(c * z)) ** (1 / any_value(c)) AS scale FROM z JOIN m USING (event_type) JOIN c{rounds} USING (event_type) GROUP BY 1)"""


_WEIBULL = "event_type, n, round(mean, 6) AS mean, round(std, 6) AS std, round(shape, 6) AS shape, round(scale, 6) AS scale"


def _weibull(df):
    return df.select("event_type", "n", *[F.round(c, 6).alias(c) for c in df.columns[2:]])


@query(f"WITH {_weibull_sql()} SELECT {_WEIBULL} FROM w")
def weibull_fit(t):
    return _weibull(signal.weibull_fit(t.events, "event_type", "value"))


@query(f"WITH {_weibull_sql()} SELECT {_WEIBULL}, round(scale * (-ln(1 - 0.9995::DOUBLE ** (1.0::DOUBLE / n))) ** (1 / shape), 6) AS threshold FROM w")
def weibull_threshold(t):
    return _weibull(signal.weibull_threshold(signal.weibull_fit(t.events, "event_type", "value")))


@query("""WITH m AS (SELECT n_nationkey AS k, [[n_nationkey + 1.0::DOUBLE, 2, 3], [1, n_regionkey + 2.0::DOUBLE, 1], [2, 1, 4]] AS m FROM nation)
SELECT k, round(m[1][1] * (m[2][2] * m[3][3] - m[2][3] * m[3][2]) - m[1][2] * (m[2][1] * m[3][3] - m[2][3] * m[3][1]) + m[1][3] * (m[2][1] * m[3][2] - m[2][2] * m[3][1]), 6) AS det FROM m""")
def determinants(t):
    d = lambda *v: F.array(*[x.cast("double") if hasattr(x, "cast") else F.lit(float(x)) for x in v])
    m = F.array(d(F.col("n_nationkey") + 1, 2, 3), d(1, F.col("n_regionkey") + 2, 1), d(2, 1, 4))
    return t.nation.select(F.col("n_nationkey").alias("k"), F.round(linalg.determinant(m), 6).alias("det"))


def _vectors(t):
    return cluster.with_vector(t.embeddings.select("vec_id", "label", F.col("embedding").alias("x")), "x")


@query()
def kmeans_elbow(t):
    return cluster.elbow(_vectors(t), [2, 4, 6])


@query()
def kmeans_labels(t):
    m = cluster.kmeans(_vectors(t), 4, 2)
    return relate_labels(m.transform(_vectors(t)).select("vec_id", "cluster"))


def relate_labels(df):
    from ..operators.trends import relabel_by_size

    return relabel_by_size(df, "cluster").select("vec_id", "new_label")


_E = "SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"


@query(f"""WITH e AS ({_E}), d AS (SELECT a.vec_id, a.label AS g, b.label AS o, avg(list_distance(a.x, b.x)) AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), s AS (SELECT vec_id, g, max(m) FILTER (WHERE o = g) AS a, min(m) FILTER (WHERE o <> g) AS b FROM d GROUP BY 1, 2)
SELECT g AS label, round(avg(coalesce((b - a) / greatest(a, b), 0)), 5) AS silhouette FROM s GROUP BY 1""")
def silhouette_mean(t):
    s = cluster.silhouette(_vectors(t), "vec_id", "x", "label")
    return s.groupBy(F.col("label").cast("int").alias("label")).agg(F.round(F.avg("silhouette"), 5).alias("silhouette"))


@query(f"""WITH e AS ({_E}), d AS (SELECT a.vec_id, a.label AS g, b.label AS o, avg(list_distance(a.x, b.x)) AS m FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3), s AS (SELECT vec_id, g, max(m) FILTER (WHERE o = g) AS a, min(m) FILTER (WHERE o <> g) AS b FROM d GROUP BY 1, 2)
SELECT vec_id, g AS label, row_number() OVER (PARTITION BY g ORDER BY round(coalesce((b - a) / greatest(a, b), 0), 9) DESC, vec_id) AS rank FROM s""")
def silhouette_ranked(t):
    return cluster.silhouette(_vectors(t), "vec_id", "x", "label").select("vec_id", F.col("label").cast("int").alias("label"), "rank")


_FAR = "list_sum(list_transform(list_zip(x, m), lambda z: (z[1] - z[2]) ** 2))"
_STEP = f"""r{{n}} AS (SELECT vec_id, x, arg_min(c, (round(d, 9), c)) AS c FROM (SELECT r.vec_id, r.x, m.c, {_FAR} AS d FROM r{{p}} r, m{{p}} m) GROUP BY 1, 2), m{{n}} AS (SELECT c, list(a ORDER BY i) AS m FROM (SELECT c, i, avg(v) AS a FROM (SELECT c, unnest(x) AS v, unnest(range(len(x))) AS i FROM r{{n}}) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH e AS ({_E}), r0 AS (SELECT vec_id, x, vec_id % 4 AS c FROM e), m0 AS (SELECT c, list(a ORDER BY i) AS m FROM (SELECT c, i, avg(v) AS a FROM (SELECT c, unnest(x) AS v, unnest(range(len(x))) AS i FROM r0) GROUP BY 1, 2) GROUP BY 1), {_STEP.format(n=1, p=0)}, {_STEP.format(n=2, p=1)}, {_STEP.format(n=3, p=2)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster FROM r3""")
def lloyd_rounds(t):
    return cluster.lloyd(t.embeddings.select("vec_id", "embedding"), "embedding", F.col("vec_id") % 4, 4, 3).select("vec_id", "cluster")


@query("SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS x0, round(avg(embedding[2]::DOUBLE), 6) AS x1 FROM embeddings GROUP BY 1")
def cluster_profile(t):
    e = t.embeddings.select("label", F.col("embedding")[0].cast("double").alias("x0"), F.col("embedding")[1].cast("double").alias("x1"))
    return cluster.profile(e, "label", ["x0", "x1"]).select("label", "n", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS k, s_acctbal / 100 AS x, s_nationkey::DOUBLE AS y FROM supplier), e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 16), r AS (SELECT k AS a, k AS b FROM p UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS s_suppkey, min(b) AS component FROM r GROUP BY 1""")
def eps_components(t):
    p = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return cluster.near_components(p, "s_suppkey", "x", "y", 4.0)


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS k, s_acctbal / 100 AS x, s_nationkey::DOUBLE AS y FROM supplier), e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k <> b.k AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 16), c AS (SELECT a AS k FROM e GROUP BY 1 HAVING count(*) >= 4),
r AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a JOIN c ON e.b = c.k), m AS (SELECT a AS k, min(b) AS c FROM r GROUP BY 1), n AS (SELECT e.a AS k, min(m.c) AS c FROM e JOIN m ON e.b = m.k GROUP BY 1)
SELECT p.k AS s_suppkey, coalesce(m.c, n.c) AS component FROM p LEFT JOIN m USING (k) LEFT JOIN n USING (k)""")
def eps_components_core(t):
    p = t.supplier.select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return cluster.near_components(p, "s_suppkey", "x", "y", 4.0, least=5)


@query()
def gmm_bic(t):
    e = t.events.select(array_to_vector(F.array("value")).alias("features"))
    return cluster.mixture_bic(e, [1, 2, 3], 1)


@query()
def pca_projection(t):
    out, _, _ = cluster.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 2)
    return out.select("vec_id", "pca")


@query()
def pca_variance(t):
    return cluster.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 5)[1]


@query()
def pca_top_loadings(t):
    return cluster.top_loadings(cluster.pca(t.embeddings.select("vec_id", "embedding"), "embedding", 2)[2])


@query("""WITH RECURSIVE n AS (SELECT c_nationkey, avg(c_acctbal) AS x, count(*)::DOUBLE AS y, row_number() OVER (ORDER BY c_nationkey) AS i FROM customer GROUP BY 1), d AS (SELECT a.i AS i, b.i AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM n a, n b),
r AS (SELECT i, i AS c, 0 AS round FROM n UNION ALL (WITH m AS (SELECT p.c AS c, q.c AS e, max(d) AS far FROM r p JOIN r q ON p.c < q.c JOIN d ON d.i = p.i AND d.j = q.i GROUP BY 1, 2), b AS (SELECT arg_min(c, (far, c, e)) AS c, arg_min(e, (far, c, e)) AS e FROM m HAVING count(*) > 3) SELECT r.i, CASE WHEN r.c = b.e THEN b.c ELSE r.c END, r.round + 1 FROM r, b)),
l AS (SELECT i, c FROM r WHERE round = (SELECT max(round) FROM r)) SELECT n.c_nationkey, dense_rank() OVER (ORDER BY l.c) - 1 AS cluster FROM l JOIN n USING (i)""")
def complete_linkage_small(t):
    n = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("b"), F.count("*").cast("double").alias("n"))
    return linkage.linkage(n.select("c_nationkey", F.array("b", "n").alias("x")), "c_nationkey", "x", 3)


@query("""WITH s AS (SELECT avg(l_quantity) a, avg(l_extendedprice) b, covar_samp(l_quantity, l_quantity) p, covar_samp(l_quantity, l_extendedprice) q, covar_samp(l_extendedprice, l_extendedprice) r FROM lineitem)
SELECT l_orderkey, l_linenumber, round((r * (l_quantity - a) ** 2 - 2 * q * (l_quantity - a) * (l_extendedprice - b) + p * (l_extendedprice - b) ** 2) / (p * r - q * q), 5) AS t2 FROM lineitem, s""")
def hotelling_t2(t):
    h = anomaly.hotelling(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return h.select("l_orderkey", "l_linenumber", F.round("t2", 5).alias("t2"))


@query(f"""WITH e AS ({_E}), d AS (SELECT a.vec_id, list_distance(a.x, b.x) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d) SELECT vec_id, round(avg(d), 5) AS mean_distance FROM r WHERE k <= 5 GROUP BY 1""")
def knn_mean_distance(t):
    n = cluster.nearest(_vectors(t), "vec_id", "x", 5)
    return n.select("vec_id", F.round("mean_distance", 5).alias("mean_distance"))


@query(f"""WITH e AS ({_E}), d AS (SELECT a.vec_id, list_distance(a.x, b.x) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS k FROM d) SELECT vec_id, avg(d) > 1.25 AS is_outlier FROM r WHERE k <= 5 GROUP BY 1""")
def knn_outliers(t):
    return cluster.far_from_others(_vectors(t), "vec_id", "x", 5, 1.25).select("vec_id", "is_outlier")


@query("""WITH s AS (SELECT avg(l_quantity) a, avg(l_extendedprice) b, covar_samp(l_quantity, l_quantity) p, covar_samp(l_quantity, l_extendedprice) q, covar_samp(l_extendedprice, l_extendedprice) r FROM lineitem)
SELECT l_orderkey, l_linenumber, (r * (l_quantity - a) ** 2 - 2 * q * (l_quantity - a) * (l_extendedprice - b) + p * (l_extendedprice - b) ** 2) / (p * r - q * q) > -2 * ln(0.05) AS is_outlier FROM lineitem, s""")
def hotelling_flags(t):
    h = anomaly.hotelling(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 0.05)
    return h.select("l_orderkey", "l_linenumber", "is_outlier")


@query("""WITH s AS (SELECT avg(c_acctbal) a, avg(c_nationkey) b, covar_samp(c_acctbal, c_acctbal) p, covar_samp(c_acctbal, c_nationkey) q, covar_samp(c_nationkey, c_nationkey) r FROM customer), d AS (SELECT c_custkey, (r * (c_acctbal - a) ** 2 - 2 * q * (c_acctbal - a) * (c_nationkey - b) + p * (c_nationkey - b) ** 2) / (p * r - q * q) AS d FROM customer, s) SELECT c_custkey, round(d, 6) AS distance, d > -2 * ln(0.1) AS is_outlier FROM d""")
def distance_estimator(t):
    from ..operators.estimators import DistanceOutlier

    e = DistanceOutlier(inputCols=["c_acctbal", "c_nationkey"], alpha=0.1)
    return e.fit(t.customer).transform(t.customer).select("c_custkey", F.round("distance", 6).alias("distance"), "is_outlier")


def _em_sql(rounds: int) -> str:
    """The rounds one after the other: densities of each row under each component, their shares, new moments."""
    steps = ["m0 AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 5.0::DOUBLE), (1, 5.0::DOUBLE, 12.0::DOUBLE), (2, 9.0::DOUBLE, 20.0::DOUBLE)) v(g, a, b), (SELECT 1 / 3.0::DOUBLE AS w, 1.0::DOUBLE AS p, 0.0::DOUBLE AS q, 1.0::DOUBLE AS r))"]
    for k in range(rounds):
        logs = f"SELECT i, x, y, g, ln(w) - 0.5::DOUBLE * (2 * ln(2 * pi()) + ln(p * r - q * q) + (r * (x - a) ** 2 - 2 * q * (x - a) * (y - b) + p * (y - b) ** 2) / (p * r - q * q)) AS l FROM x, m{k}"
        tops = f"SELECT *, exp(l - max(l) OVER (PARTITION BY i)) AS e FROM ({logs})"
        shares = f"SELECT *, e / sum(e) OVER (PARTITION BY i) AS s FROM ({tops})"
        sums = f"SELECT g, sum(s) AS s, sum(s * x) / sum(s) AS a, sum(s * y) / sum(s) AS b, sum(s * x * x) / sum(s) AS xx, sum(s * x * y) / sum(s) AS xy, sum(s * y * y) / sum(s) AS yy FROM ({shares}) GROUP BY 1"
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT g, a, b, s / (SELECT count(*) FROM x) AS w, xx - a * a + 1e-6 AS p, xy - a * b AS q, yy - b * b + 1e-6 AS r FROM ({sums}))")
    return ", ".join(steps)


@query(f"""WITH x AS (SELECT c_custkey AS i, c_acctbal / 1000 AS x, c_nationkey::DOUBLE AS y FROM customer), {_em_sql(10)}
SELECT CAST(g AS INTEGER) AS component, round(w, 5) AS weight, round(a, 5) AS mean_0, round(b, 5) AS mean_1, round(p, 5) AS covariance_00, round(q, 5) + 0.0 AS covariance_01, round(r, 5) AS covariance_11 FROM m10""")
def em_mixture(t):
    e = t.customer.select(F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("x"))
    m = cluster.em_mixture(e, "x", [[0.0, 5.0], [5.0, 12.0], [9.0, 20.0]], 10)[0]
    moments = [("mean_0", F.col("mean")[0]), ("mean_1", F.col("mean")[1])] + [(f"covariance_{i}{j}", F.col("covariance")[i][j]) for i, j in ((0, 0), (0, 1), (1, 1))]
    return m.select("component", F.round("weight", 5).alias("weight"), *[(F.round(c, 5) + 0.0).alias(name) for name, c in moments])


@query()
def tree_grid(t):
    p = t.part.select("p_partkey", (F.col("p_retailprice") + 20 * (F.col("p_size") % 5) > 1500).cast("double").alias("label"), array_to_vector(F.array("p_retailprice", (F.col("p_size") % 5).cast("double"))).alias("features"))
    return models.tree_grid(splits.folds(p, "p_partkey", "label", 2), "features", "label", "fold", 2, [None, 5, 10, 20, 30], [2, 5, 10], [1, 2, 4])


@query()
def extra_trees(t):
    p = t.part.select("p_partkey", (F.col("p_retailprice") + 20 * (F.col("p_size") % 5) > 1500).cast("int").alias("label"), "p_retailprice", (F.col("p_size") % 5).alias("m"))
    return models.extra_trees(p, "p_partkey", ["p_retailprice", "m"], "label", 5, 6)


@query()
def isolation_scores(t):
    f = anomaly.IsolationForest(50).fit(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"])
    return anomaly.flag_share(f.score(t.customer), "score", 0.01).select("c_custkey", "score", "is_outlier")


@query()
def gmm_distance(t):
    v = t.customer.select("c_custkey", array_to_vector(F.array("c_acctbal", F.col("c_nationkey").cast("double"))).alias("features"))
    return anomaly.mixture_distance(v, "features", 3).select("c_custkey", "distance")


def _orders(t):
    """Order key, a label (urgent or not) and features."""
    x = F.array(F.col("o_totalprice") / 1000, F.month("o_orderdate").cast("double"), (F.col("o_custkey") % 7).cast("double"))
    y = (F.col("o_totalprice") + 30000 * (F.col("o_custkey") % 7) > 300000).cast("double")
    return t.orders.select("o_orderkey", y.alias("label"), array_to_vector(x).alias("features"))


@query("""SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coefficient FROM lineitem UNION ALL SELECT 'x0', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem""")
def ols_fit(t):
    v = t.lineitem.select(array_to_vector(F.array("l_quantity")).alias("features"), "l_extendedprice")
    return models.linear_fit(v, "features", "l_extendedprice").withColumn("coefficient", F.round("coefficient", 3))


@query()
def huber_fit(t):
    c = relate.lookup_zero_fill(t.nation, "n_nationkey", t.supplier, "s_nationkey").join(t.customer.groupBy("c_nationkey").count(), F.col("n_nationkey") == F.col("c_nationkey"))
    v = c.select(array_to_vector(F.array(F.col("count").cast("double"))).alias("features"), F.col("n").cast("double").alias("y"))
    return models.linear_fit(v, "features", "y", robust=True)


@query()
def forest_oob(t):
    df = _orders(t)
    votes, oob = models.bagged_trees(df, "o_orderkey", "features", "label", 3, 5)
    return votes.groupBy("label", "prediction").agg(F.count("*").alias("n")).withColumn("oob", F.lit(oob))


@query()
def grid_search_forest(t):
    return models.grid_search(splits.folds(_orders(t), "o_orderkey", "label", 3), "features", "label", "fold", 3, [2, 4], [5])


@query()
def forest_importance(t):
    return models.importances(_orders(t), "features", "label", ["price", "month", "customer"])


@query()
def boosted_stumps(t):
    df = _orders(t)
    out = models.boosted_predict(df, models.adaboost(df, "features", "label", 4))
    return out.groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query()
def model_comparison(t):
    return models.compare(_orders(t), "features", "label").select("model", "accuracy")


@query()
def linear_leaf_forest(t):
    p = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_discount", "l_extendedprice")
    return models.linear_leaf_forest(p, "k", ["l_quantity", "l_discount"], "l_extendedprice", 2)


_PLACED = f"""{_FILLED}, i AS MATERIALIZED (SELECT event_type, tick, v, row_number() OVER (PARTITION BY event_type ORDER BY tick) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM g)"""


@query(f"""WITH RECURSIVE {_PLACED}, q AS MATERIALIZED (SELECT event_type, i AS x, v AS y, row_number() OVER s AS j, lag(i) OVER s AS x0, lag(v) OVER s AS y0, lead(i) OVER s AS x1, lead(v) OVER s AS y1 FROM i WHERE v IS NOT NULL WINDOW s AS (PARTITION BY event_type ORDER BY i)),
t AS MATERIALIZED (SELECT event_type, j, x - x0 AS h0, x1 - x AS h1, 2.0::DOUBLE * (x1 - x0) AS d, 6 * ((y1 - y) / (x1 - x) - (y - y0) / (x - x0)) AS r FROM q WHERE x0 IS NOT NULL AND x1 IS NOT NULL),
down AS (SELECT event_type, j, h1, d, r FROM t WHERE j = 2 UNION ALL SELECT t.event_type, t.j, t.h1, t.d - t.h0 / down.d * t.h0, t.r - t.h0 / down.d * down.r FROM down JOIN t ON t.event_type = down.event_type AND t.j = down.j + 1),
s AS MATERIALIZED (SELECT *, max(j) OVER (PARTITION BY event_type) AS last FROM down), up AS (SELECT event_type, j, r / d AS m FROM s WHERE j = last UNION ALL SELECT s.event_type, s.j, (s.r - s.h1 * up.m) / s.d FROM up JOIN s ON s.event_type = up.event_type AND s.j = up.j - 1),
o AS (SELECT q.event_type, x, y, x1, y1, coalesce(a.m, 0) AS m, coalesce(b.m, 0) AS m1 FROM q LEFT JOIN up a ON a.event_type = q.event_type AND a.j = q.j LEFT JOIN up b ON b.event_type = q.event_type AND b.j = q.j + 1), e AS (SELECT event_type, arg_min(y, x) AS first FROM q GROUP BY 1)
SELECT i.event_type, i.tick, round(CASE WHEN o.x IS NULL THEN e.first WHEN o.x1 IS NULL THEN o.y ELSE (o.m * (o.x1 - i.i) ** 3 + o.m1 * (i.i - o.x) ** 3) / (6.0::DOUBLE * (o.x1 - o.x)) + (o.y / (o.x1 - o.x) - o.m * (o.x1 - o.x) / 6.0::DOUBLE) * (o.x1 - i.i) + (o.y1 / (o.x1 - o.x) - o.m1 * (o.x1 - o.x) / 6.0::DOUBLE) * (i.i - o.x) END, 6) AS filled
FROM i JOIN e USING (event_type) ASOF LEFT JOIN o ON i.event_type = o.event_type AND i.i >= o.x""")
def spline_fill(t):
    g = series.fill_gaps(hourly(t), "event_type", "tick", "v", 3600)
    return series.spline_fill(g, "event_type", "tick", "v").select("event_type", "tick", F.round("filled", 6).alias("filled"))


@query(f"""WITH RECURSIVE {_PLACED}, q AS (SELECT event_type, i, v, v - lag(v) OVER (PARTITION BY event_type ORDER BY i) AS step FROM i WHERE v IS NOT NULL), z AS MATERIALIZED (SELECT event_type, arg_min(v, i) AS first, greatest(CASE WHEN count(*) > 2 THEN var_pop(step) ELSE 1.0::DOUBLE END, 1e-12) / 2.5::DOUBLE AS r FROM q GROUP BY 1),
a AS MATERIALIZED (SELECT i.*, first, r, 0.5::DOUBLE * r AS q FROM i JOIN z USING (event_type)),
down AS (SELECT event_type, 0::BIGINT AS i, first AS m, 2.5e6::DOUBLE * r AS p, q, r FROM a WHERE i = 1 UNION ALL SELECT a.event_type, a.i, CASE WHEN a.v IS NULL THEN down.m ELSE down.m + (down.p + a.q) / (down.p + a.q + a.r) * (a.v - down.m) END, CASE WHEN a.v IS NULL THEN down.p + a.q ELSE (1 - (down.p + a.q) / (down.p + a.q + a.r)) * (down.p + a.q) END, a.q, a.r FROM down JOIN a ON a.event_type = down.event_type AND a.i = down.i + 1),
s AS MATERIALIZED (SELECT *, max(i) OVER (PARTITION BY event_type) AS last FROM down WHERE i > 0), up AS (SELECT event_type, i, m FROM s WHERE i = last UNION ALL SELECT s.event_type, s.i, s.m + s.p / (s.p + s.q) * (up.m - s.m) FROM up JOIN s ON s.event_type = up.event_type AND s.i = up.i - 1)
SELECT event_type, tick, round(coalesce(v, m), 6) AS filled FROM i JOIN up USING (event_type, i)""")
def level_fill(t):
    g = series.fill_gaps(hourly(t), "event_type", "tick", "v", 3600)
    return series.level_fill(g, "event_type", "tick", "v").select("event_type", "tick", F.round("filled", 6).alias("filled"))


def _between_sql(rows: str, value: str, tag: str) -> str:
    """The rows with ``filled{tag}``: the value, or linear by place between the known ones beside it."""
    place, ahead = "PARTITION BY event_type ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "PARTITION BY event_type ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    known = f"SELECT event_type, tick, {value} AS v, row_number() OVER (PARTITION BY event_type ORDER BY tick) AS i FROM {rows}"
    beside = f"SELECT *, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM ({known}) WINDOW b AS ({place}), a AS ({ahead})"
    return f"SELECT event_type, tick, {_BETWEEN} AS filled{tag} FROM ({beside})"


_RAW = """h AS (SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS tick, avg(value) AS v FROM events GROUP BY 1, 2), l AS (SELECT *, lead(tick) OVER (PARTITION BY event_type ORDER BY tick) AS nx FROM h),
f AS (SELECT event_type, unnest(generate_series(tick, CASE WHEN nx - tick > 3601 THEN nx - 1 ELSE tick END, 3600)) AS tick, tick AS a, CASE WHEN abs(v) <= 80 THEN v END AS v FROM l), g AS (SELECT event_type, tick, CASE WHEN tick = a THEN v END AS v FROM f)"""


@query(f"WITH {_RAW}, x AS ({_between_sql('g', 'v', '_1')}), y AS ({_between_sql('x', 'CASE WHEN NOT filled_1 > 60 THEN filled_1 END', '')}) SELECT event_type, tick, round(filled, 6) AS filled FROM y")
def prepared_series(t):
    h = t.events.groupBy("event_type", F.unix_timestamp(F.date_trunc("hour", "ts").cast("timestamp")).alias("tick")).agg(F.avg("value").alias("v"))
    return series.prepare(h, "event_type", "tick", "v", 3600, 80.0, "linear", lambda c: c > 60).select("event_type", "tick", F.round("filled", 6).alias("filled"))


@query()
def kernel_margin(t):
    o = t.orders.select("o_orderkey", (F.col("o_totalprice") / 100000).alias("p"), (F.col("o_custkey") % 7).cast("double").alias("c"), (F.col("o_totalprice") + 30000 * (F.col("o_custkey") % 7) > 300000).cast("double").alias("label"))
    w = splits.balanced_weights(o, "label")
    return models.kernel_margin(w, ["p", "c"], "label", "weight").groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query()
def word_vectors(t):
    from ..operators import text

    return text.word_vectors(t.documents, "text", 8)


@query("""SELECT round(x, 6) AS x, round(y, 6) AS y FROM (SELECT i / 10.0::DOUBLE AS x FROM range(11) t(i)), (SELECT j / 10.0::DOUBLE AS y FROM range(11) u(j))""")
def decision_mesh(t):
    from ..sources.generators import mesh

    return mesh(t.spark, 0.0, 1.0, 10).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
