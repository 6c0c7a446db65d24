"""Basket sets, running sums by range, curves and splits over one large group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, itemsets, relate, splits


@pytest.mark.parametrize("sizes", [(3, 5), (3, 9000), (6000, 9000), (4096, 4097), (0, 10)])
def test_packed_sets_meet_as_plain_ones(sizes):
    rng = np.random.default_rng(1)
    a, b = (np.sort(rng.choice(itemsets.RANGE, n, replace=False)) for n in sizes)
    x, y = itemsets.pack_tids(a), itemsets.pack_tids(b)
    both, n = itemsets.meet_tids(x, y)
    want = sorted(set(a.tolist()) & set(b.tolist()))
    assert itemsets.unpack_tids(both).tolist() == want and n == len(want) and max(map(len, (x, y, both))) <= 8193
    assert itemsets.unpack_tids(x).tolist() == a.tolist()


def test_vertical_mining_equals_apriori(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "RANGE", 256)
    monkeypatch.setattr(itemsets, "SPARSE", 16)
    rng = random.Random(2)
    rows = [(k, [i for i in "abcdefgh" if rng.random() < {"a": 0.9, "b": 0.7, "h": 0.01}.get(i, 0.4)]) for k in range(900)]
    b = spark.createDataFrame([(k, sorted(v)) for k, v in rows], "basket long, items array<string>")
    got, want = ({tuple(r["items"]): r["n"] for r in f(b, 60).collect()} for f in (itemsets.vertical, itemsets.apriori))
    assert got == want and max(map(len, got)) >= 4
    assert all(n == sum(set(s) <= set(v) for _, v in rows) for s, n in got.items())
    assert itemsets.vertical(b.limit(0), 1).count() == 0 and {len(r["items"]) for r in itemsets.vertical(b, 60, 2).collect()} == {1, 2}


def test_running_sums_by_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), k, rng.randint(0, 9)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    for order, sign in ((F.col("k"), 1), (F.desc("k"), -1)):
        got = {r.k: (r.run, r.n) for r in relate.running_sums(df, {"run": F.col("v"), "n": F.lit(1)}, ["g"], order).collect()}
        for g in ("hot", "a", None):
            total = 0
            for i, (_, k, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: sign * r[1])):
                total += v
                assert got[k] == (total, i + 1)


def plans(df):
    return df._jdf.queryExecution().toString()


def test_no_window_over_all_rows(spark):
    df = spark.range(3000).select((F.rand(1)).alias("s"), (F.rand(2) > 0.5).alias("y"), F.col("id").alias("k"), F.lit("one").alias("g"))
    s, y = F.col("s"), F.col("y")
    for out in (evaluate.roc_curve(df, s, y), evaluate.auc(df, s, y), evaluate.pr_curve(df, s, y), evaluate.average_precision(df, s, y)):
        assert "Window" not in plans(out) or "_part" in plans(out)
    assert splits.folds(df, "k", "g", 3).groupBy("fold").count().select("count").distinct().first()[0] == 1000
    assert splits.stratified_split(df, "k", "g", 0.7).filter("is_train").count() == 2100
    rows = df.collect()
    pos = sorted(r.s for r in rows if r.y)
    neg = sorted(r.s for r in rows if not r.y)
    want = sum(np.searchsorted(neg, v) for v in pos) / len(pos) / len(neg)
    assert evaluate.auc(df, s, y).first()[0] == pytest.approx(want)
