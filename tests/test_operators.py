import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import scalar
from tidemark.operators import anomaly, binning, cluster, evaluate, itemsets, linalg, models, profile, recode, relate, series, signal, splits, summary, text, trends
from tidemark.sources import files, generators
from tidemark.streaming import windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_moments_of_a_small_column(spark):
    r = summary.moments(table(spark, [(v,) for v in (1, 2, 2, 9)], "x int"), "x").first()
    assert (r.skew, r.excess_kurtosis, r.std) == (1.097025, -0.705532, 3.201562)
    q = dict(rows(summary.quantiles(table(spark, [(v,) for v in (1, 2, 2, 9)], "x int"), "x", [0.25, 0.5, 0.75])))
    assert q == {0.25: 1.75, 0.5: 2.0, 0.75: 3.75}


def test_pairwise_correlation_skips_nulls(spark):
    m = rows(summary.correlation_matrix(table(spark, [(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 5.0)], "a double, b double"), ["a", "b"]))
    assert ("a", "b", 0.944911) in m


def test_modes(spark):
    df = table(spark, [("g", 3, 1), ("g", 1, 2), ("g", 3, 3), ("g", 1, 4)], "g string, v int, i int")
    assert rows(summary.mode_smallest(df, "v", ["g"])) == [("g", 1)]
    assert rows(summary.mode_first_seen(df, "v", "i", ["g"])) == [("g", 3)]


def test_top_k_and_other(spark):
    df = table(spark, [(v,) for v in "aaabbcd"], "v string")
    assert rows(profile.top_k_other(df, "v", 2)) == [("a", 3), ("b", 2), ("other", 2)]
    assert rows(profile.top_k_other(df, "v", 4)) == [("a", 3), ("b", 2), ("c", 1), ("d", 1)]
    assert rows(profile.top_k_other(df, "v", 1, drop_other=True)) == [("a", 3)]
    assert rows(profile.top_k_other(df.filter("false"), "v", 2)) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_histogram_counts_add_up(spark, values):
    df = table(spark, [(float(v),) for v in values], "v double")
    for h in (binning.sturges_histogram(df, "v"), binning.closed_histogram(df, "v", 7), binning.floor_width_histogram(df, "v", 5), binning.sturges_histogram(df, "v", log=True)):
        assert sum(r.n for r in h.collect()) == len(values)


def test_sturges_bins(spark):
    assert binning.sturges_histogram(spark.range(1000), "id").count() == 10


def test_half_open_labels(spark):
    df = table(spark, [(v,) for v in (-1.0, 0.0, 9.9, 10.0, 40.0)], "x double")
    assert [r[0] for r in df.select(binning.half_open_label(F.col("x"), 10, 40)).collect()] == [None, 0, 0, 1, None]


def test_scaling_and_imputing(spark):
    df = table(spark, [(float(v),) for v in range(10)], "x double")
    z = [r.x_z for r in recode.zscore(df, ["x"]).collect()]
    assert np.allclose([np.mean(z), np.std(z)], [0, 1])
    assert recode.zscore(table(spark, [(1.0,), (1.0,)], "x double"), ["x"]).first().x_z is None
    assert rows(recode.impute_mean(table(spark, [(1.0,), (None,), (4.0,)], "x double"), ["x"], whole=True)) == [(1.0,), (3.0,), (4.0,)]
    assert {r.x: r.code for r in recode.label_encode(table(spark, [("b",), ("a",), (None,)], "x string"), "x").collect()} == {None: None, "a": 0, "b": 1}


def test_parsing(spark):
    df = table(spark, [("?",), (" 2.5 ",), ("///",), ("nan",), ("x1",)], "s string")
    assert [r[0] for r in df.select(scalar.number(F.col("s"))).collect()] == [None, 2.5, None, None, None]
    c = table(spark, [("N",), ("北北東",), ("calm",), (None,)], "s string").select(scalar.compass_degrees(F.col("s")))
    assert [r[0] for r in c.collect()] == [0.0, 22.5, -1.0, -1.0]
    late = table(spark, [("2024-02-28", "24:00")], "d string, h string").select(scalar.hour24(F.col("d").cast("date"), F.col("h")).cast("string"))
    assert late.first()[0] == "2024-02-29 00:00:00"


def test_gaps_filling_interpolation(spark):
    df = table(spark, [("s", t, v) for t, v in ((0, None), (60, 1.0), (240, 4.0), (300, None))], "s string, t long, v double")
    assert rows(series.gaps(df, "s", "t", 60)) == [("s", 60, 240, 2)]
    full = series.fill_gaps(df, "s", "t", "v", 60)
    assert [r.t for r in full.orderBy("t").collect()] == [0, 60, 120, 180, 240, 300]
    assert [r.filled for r in series.interpolate(full, "s", "t", "v").orderBy("t").collect()] == [1, 1, 2, 3, 4, 4]


def test_daily_change_is_clamped_and_dated_at_the_earlier_row(spark):
    df = table(spark, [("a", "2024-01-01", 10.0), ("a", "2024-01-03", 14.0), ("a", "2024-01-04", 12.0)], "e string, d string, v double").withColumn("d", F.to_date("d"))
    assert [r.change for r in trends.daily_change(df, "e", "d", "v").orderBy("d").collect()] == [2.0, 0.0]


def test_row_index_numbers_all_rows_in_order(spark):
    got = relate.row_index(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), "v", partitions=5)
    assert all(r.v == r.row_index for r in got.collect())


def test_close_pairs_equal_those_of_all_pairs(spark):
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(1).uniform(0, 20, (80, 2)))]
    got = {(r.a, r.b) for r in relate.close_pairs(table(spark, pts, "k long, x double, y double"), "k", "x", "y", 2.5).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(pts, 2) if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 6.25}
    assert got == want


def test_miners_agree_and_support_falls_with_size(spark):
    b = table(spark, [(1, ["1", "2", "3"]), (2, ["1", "2", "3"]), (3, ["1", "2"]), (4, ["4"])], "basket int, items array<string>")
    a = {tuple(r["items"]): r.n for r in itemsets.apriori(b, 2).collect()}
    assert a == {("1",): 3, ("2",): 3, ("3",): 2, ("1", "2"): 3, ("1", "3"): 2, ("2", "3"): 2, ("1", "2", "3"): 2}
    assert a == {tuple(r["items"]): r.n for r in itemsets.fp_growth(b, 2, 4).collect()}
    assert all(a[s[:i] + s[i + 1 :]] >= n for s, n in a.items() if len(s) > 1 for i in range(len(s)))
    r = itemsets.rules(itemsets.apriori(b, 2), 4).collect()
    assert len(r) == 12 and all(0 <= x.confidence <= 1 for x in r)


def test_itemsets_of_all_sizes(spark, tmp_path):
    b = table(spark, [(i, list("abcdefg")) for i in range(3)] + [(9, ["a", "z"])], "basket int, items array<string>")
    want = {c: 4 if c == ("a",) else 3 for k in range(1, 8) for c in itertools.combinations("abcdefg", k)}
    assert {tuple(r["items"]): r.n for r in itemsets.apriori(b, 3).collect()} == want
    assert {tuple(r["items"]): r.n for r in itemsets.fp_growth(b, 3, 4).collect()} == want
    assert max(len(r["items"]) for r in itemsets.apriori(b, 3, 4).collect()) == 4
    table(spark, [(p, f"type {p}") for p in range(5)], "p_partkey long, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2000).selectExpr("id div 5 as l_orderkey", "id % 5 as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    sizes = [1, 2, 3, 4, 5]
    for name in ("apriori_all_sizes", "fpgrowth_all_sizes"):
        got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
        assert [sum(r["items"].count("|") + 1 == k for r in got) for k in sizes] == [math.comb(5, k) for k in sizes] and {r.n for r in got} == {400}
    assert catalog.QUERIES["association_rules_all_sizes"](spark, str(tmp_path)).count() == sum(math.comb(5, k) * (2**k - 2) for k in sizes)


def test_tokens_and_contexts(spark):
    t = text.tokens(table(spark, [(1, "The cat, the\nhat.")], "k int, t string"), "k", "t")
    assert [r.token for r in t.orderBy("pos").collect()] == ["the", "cat", ",", "the", "hat", "."]
    assert {r.token: r.id for r in text.vocabulary(t, "k").collect()} == {"the": 0, "cat": 1, ",": 2, "hat": 3, ".": 4}
    assert text.contexts(t, "k", 2).count() == 2


def test_table_rows(spark):
    h = "<table><tr><th>h</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>"
    assert text.table_rows(table(spark, [(1, h)], "k int, h string"), "k", "h", 1).first().cells == ["1", "2"]


def test_fft_and_determinant(spark):
    x = np.random.default_rng(2).normal(size=64)
    assert np.allclose(linalg.fft(x), np.fft.fft(x)) and np.allclose(linalg.inverse_fft(linalg.fft(x)), x)
    assert np.allclose(linalg.fft([1, 0, 0, 0]), 1)
    with pytest.raises(ValueError):
        linalg.fft([1, 2, 3])
    m = table(spark, [([[1.0, 2.0], [3.0, 4.0]],)], "m array<array<double>>")
    assert m.select(linalg.determinant(F.col("m"))).first()[0] == pytest.approx(-2)
    assert m.select(scalar.determinant(F.col("m"), 2)).first()[0] == -2


def test_chi_square_quantiles():
    assert linalg.chi2_quantile(0.95, 1) == pytest.approx(3.841458820694, abs=1e-6)
    assert linalg.chi2_quantile(0.995, 18) == pytest.approx(37.156451, abs=1e-4)


def test_periodogram_finds_a_line_and_keeps_the_variance(spark):
    x = [("s", i, float(np.sin(2 * np.pi * i / 12) + 0.01 * ((i * 7919) % 13))) for i in range(240)]
    df = table(spark, x, "s string, t long, v double")
    p = signal.periodogram(df, "s", "t", "v", 1.0)
    assert p.orderBy(F.desc("psd")).first().period_hours == pytest.approx(12)
    r = signal.parseval(df, p, "s", "v").first()
    assert r.variance == pytest.approx(r.power)
    assert signal.spectral_peaks(p, "s").filter("rank = 1").first().period_hours == pytest.approx(12)


def test_spectral_peaks_beyond_many_strong_lines_of_one_period(spark):
    psd = [("s", k, 1000.0 + k / 100, 1000.0 + k if k % 4 == 0 else 1.0) for k in range(1, 4001)] + [("s", 5000 + k, 10.0 + k, 500.0 if k == 50 else 1.0) for k in range(100)]
    got = signal.spectral_peaks(table(spark, psd, "s string, k long, period_hours double, psd double"), "s")
    assert [(r.rank, r.period_hours) for r in got.orderBy("rank").collect()] == [(1, 1040.0), (2, 60.0)]


def test_weibull(spark):
    x = 3.0 * np.random.default_rng(3).weibull(1.7, 4000)
    fit = signal.weibull_fit(table(spark, [("s", float(v)) for v in x], "s string, v double"), "s", "v").first()
    assert fit["shape"] == pytest.approx(1.7, rel=0.05) and fit["scale"] == pytest.approx(3.0, rel=0.05)


def test_roc_is_the_same_for_monotone_scores(spark):
    df = table(spark, [(i, float((i * 37) % 50), i % 3 == 0) for i in range(150)], "i int, s double, y boolean")
    a = evaluate.auc(df, F.col("s"), F.col("y")).first()[0]
    assert a == pytest.approx(evaluate.auc(df, F.exp(F.col("s") / 10), F.col("y")).first()[0])
    pos, neg = [r.s for r in df.filter("y").collect()], [r.s for r in df.filter("not y").collect()]
    assert a == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))


def test_impurity_gains(spark):
    df = table(spark, [(0.0, 0), (0.1, 0), (0.9, 1), (1.0, 1)], "x double, y int")
    r = splits.best_split(df, ["x"], "y").first()
    assert r.gini_gain == pytest.approx(0.5) and r.entropy_gain == pytest.approx(1.0) and 0.1 <= r.threshold < 0.9


def test_smote_stays_between_neighbours(spark):
    df = table(spark, [(i, float(i), 2.0 * i) for i in range(6)], "k int, x double, y double")
    new = splits.smote(df, "k", ["x", "y"], F.lit(True), 3, 2)
    assert new.count() == 18 and all(abs(r.y - 2 * r.x) < 1e-9 and 0 <= r.x <= 5 for r in new.collect())


def test_nearest_equals_brute_force(spark):
    x = np.random.default_rng(4).normal(size=(60, 3))
    got = cluster.nearest(table(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "k int, x array<double>"), "k", "x", 4)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for r in got.collect():
        assert r.mean_distance == pytest.approx(np.sort(d[r.k])[:4].mean())


def test_components_of_rings(spark):
    links = table(spark, [(1, 2), (2, 3), (5, 4), (7, 7)], "a long, b long")
    nodes = table(spark, [(i,) for i in range(1, 8)], "k long")
    assert rows(cluster.connected(links, nodes, "k")) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7)]


def test_isolation_forest_finds_far_rows(spark):
    g = generators.gaussians(spark, [(0.0, 0.0)], [300]).select("id", "x", "y").unionByName(table(spark, [(1000 + i, 9.0 + i, -9.0) for i in range(3)], "id long, x double, y double"))
    f = anomaly.IsolationForest(30).fit(g, "id", ["x", "y"])
    assert {r.id for r in f.score(g).orderBy(F.desc("score")).limit(3).collect()} == {1000, 1001, 1002}
    assert anomaly.path_length(1) == 0 and anomaly.path_length(2) == pytest.approx(2 * 0.5772156649 - 1)


def test_linear_leaves_fit_a_kinked_line(spark):
    df = table(spark, [(i, i / 100.0, abs(i / 100.0 - 1.0)) for i in range(200)], "k long, x double, y double")
    out = models.linear_leaf_forest(df, "k", ["x"], "y", 2, 200)
    assert evaluate.regression_report(out, "y", "prediction").first().r2 > 0.99


def leaf_tree(x, y, depth=4):
    """A plain tree with linear leaves; its predictions."""
    line = lambda a, b: np.linalg.lstsq(np.c_[a, np.ones(len(a))], b, rcond=None)[0]
    rss = lambda a, b: float(((np.c_[a, np.ones(len(a))] @ line(a, b) - b) ** 2).sum())
    best = (np.inf,)
    for f in range(x.shape[1] if depth else 0):
        for t in np.linspace(x[:, f].min(), x[:, f].max(), 102)[1:-1]:
            left = x[:, f] <= t
            if 10 <= left.sum() <= len(x) - 10:
                best = min(best, (rss(x[left], y[left]) + rss(x[~left], y[~left]), f, t))
    if best[0] >= 0.9 * rss(x, y):
        w = line(x, y)
        return lambda v: np.c_[v, np.ones(len(v))] @ w
    _, f, t = best
    a, b = (leaf_tree(x[m], y[m], depth - 1) for m in (x[:, f] <= t, x[:, f] > t))
    return lambda v: np.where(v[:, f] <= t, a(v), b(v))


def test_linear_leaf_forest_equals_plain_trees_on_all_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 10, (600, 2))
    y = np.where(x[:, 0] < 4, 3 * x[:, 1], 50 - 2 * x[:, 0]) + np.where(x[:, 1] > 7, 9.0, 0.0) + rng.normal(size=600)
    df = table(spark, [(i, *map(float, v), float(z)) for i, (v, z) in enumerate(zip(x, y))], "k long, a double, b double, y double").repartition(5)
    steps = np.cumsum([np.exp(-1) / math.factorial(i) for i in range(9)])
    want = 0
    for t in range(2):
        u = np.array([r.h for r in df.select("k", F.pmod(F.xxhash64(F.lit(1000 + t), "k"), F.lit(1_000_003)).alias("h")).orderBy("k").collect()])
        at = np.repeat(np.arange(600), np.searchsorted(steps, (u + 0.5) / 1_000_003))
        want = want + leaf_tree(x[at], y[at])(x) / 2
    got = models.linear_leaf_forest(df, "k", ["a", "b"], "y", 2).orderBy("k").toPandas().prediction
    assert np.allclose(got, want)


def test_linear_leaves_learn_from_large_keys(spark):
    df = table(spark, [(i, i % 50 / 10.0, 1.0 if i < 3000 else 9.0) for i in range(6000)], "k long, x double, y double")
    for got in (models.linear_leaf_forest(df, "k", ["x"], "y", 2), models.linear_leaf_forest(df, "k", ["x"], "y", 2, 300)):
        assert got.agg(F.avg("prediction")).first()[0] == pytest.approx(5, abs=0.5)
    odd = table(spark, [(1, 2.0, 3.0), (2, None, 1.0), (3, 1.0, None)], "k long, x double, y double")
    assert models.linear_leaf_forest(odd, "k", ["x"], "y").count() == 3
    assert models.linear_leaf_forest(odd.filter("false"), "k", ["x"], "y").count() == 0


def test_files(spark, tmp_path):
    files.write_csv(table(spark, [("a", "1.5"), ("b", "?")], "k string, v string"), f"{tmp_path}/c", 1)
    assert rows(files.read_dirty_csv(spark, f"{tmp_path}/c", ["v"])) == [("a", 1.5), ("b", None)]
    (tmp_path / "w1.txt").write_text(" x  1\n y 2 3\n")
    (tmp_path / "w2.txt").write_text("z 4\n")
    assert rows(files.read_whitespace(spark, [f"{tmp_path}/w1.txt", f"{tmp_path}/w2.txt"], ["a", "b"])) == [("x", "1"), ("y", "2"), ("z", "4")]
    cat = table(spark, [("one", f"{tmp_path}/w1.txt"), ("two", f"{tmp_path}/w2.txt")], "code string, path string")
    assert sorted(r.code for r in files.read_entities(spark, cat, ["a", "b"]).collect()) == ["one", "one", "two"]
    assert files.read_lines(spark, f"{tmp_path}/w1.txt", ["y"]).count() == 1
    assert files.read_or_empty(spark, f"{tmp_path}/none", "k string").count() == 0
    files.append(table(spark, [(1,)], "k int"), f"{tmp_path}/p")
    files.append(table(spark, [(2,)], "k int"), f"{tmp_path}/p")
    assert rows(files.read_or_empty(spark, f"{tmp_path}/p", "k int")) == [(1,), (2,)]
    assert files.date_range(spark, "2024-02-27", "2024-03-01").count() == 4


def test_stream_equals_batch(spark, tmp_path):
    df = table(spark, [(i, f"2024-01-01 00:{i % 60:02d}:00", float(i)) for i in range(100)], "k int, t string, v double").withColumn("t", F.to_timestamp("t")).withColumn("g", F.lit("g"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    s = windows.tumbling(windows.stream_parquet(spark, f"{tmp_path}/in", df.schema, "t"), "t", "10 minutes", ["g"], "v", "1 hour")
    q = s.writeStream.format("memory").queryName("out").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("out")) == rows(windows.tumbling(df, "t", "10 minutes", ["g"], "v"))


def test_fills_keep_known_values(spark):
    v = [None, 1.0, None, 3.0, 4.0, None, 6.0, None]
    df = table(spark, [("s", i, x) for i, x in enumerate(v)], "s string, t long, v double")
    for name, fill in series.FILLS.items():
        got = [r.filled for r in fill(df, "s", "t", "v").orderBy("t").collect()]
        assert all(g == x for g, x in zip(got, v) if x is not None), name
        assert got[2] == pytest.approx(2, abs=1.6), name
    assert [r.filled for r in series.spline_fill(df, "s", "t", "v").orderBy("t").collect()] == pytest.approx([1, 1, 2, 3, 4, 5, 6, 6])
    cubic = table(spark, [("s", i, None if i == 4 else float((i - 4) ** 3)) for i in range(9)], "s string, t long, v double")
    assert series.spline_fill(cubic, "s", "t", "v").filter("t = 4").first().filled == pytest.approx(0, abs=1e-9)


def test_prepared_series(spark):
    df = table(spark, [("s", t, v) for t, v in ((0, 1.0), (60, 900.0), (120, 3.0), (240, 5.0), (300, 50.0), (360, 7.0))], "s string, t long, v double")
    lin = series.prepare(df, "s", "t", "v", 60, 100.0, "linear", lambda c: c > 20)
    assert [r.filled for r in lin.orderBy("t").collect()] == [1, 2, 3, 4, 5, 6, 7]
    assert series.prepare(df, "s", "t", "v", 60, 100.0, "skip").count() == 5


def test_kernel_margin_beats_a_line_on_rings(spark):
    a = generators.ring(spark, 150, 1.0, 0.05).withColumn("label", F.lit(0.0))
    b = generators.ring(spark, 150, 3.0, 0.05, 9).withColumn("label", F.lit(1.0))
    out = models.kernel_margin(a.unionByName(b), ["x", "y"], "label")
    assert out.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] > 0.95
