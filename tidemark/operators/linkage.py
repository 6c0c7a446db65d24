"""Agglomerative clustering in rounds: no task holds all rows.

Single linkage is the minimum spanning tree, found by Boruvka's rounds over reference balls, without a table of pairs.
Complete, average and Ward linkage merge, in each round, all pairs of clusters that are each other's nearest; as merging
two clusters never brings either nearer to a third, these are the merges that the nearest pair at a time would make. Their
distances follow from those of the merged by one grouping. That table has a row a pair of clusters: quadratic, as these
linkages are, but spread over the tasks, and a quarter of it is left each time half of the clusters are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .balls import Balls, _look, _visits, build
from .cluster import _blocks, connected
from .relate import row_index

METHODS = ("single", "complete", "average", "ward")
#: So many clusters or fewer are merged to the end in one task: 131,000 pairs at most.
FINISH = 512


def spanning_tree(points: DataFrame) -> DataFrame:
    """a, b, d: the edges of the least spanning tree of ``points`` (pid, x; different finite vectors), a < b.

    In a round each component takes its shortest edge to another one; the order by length and ids makes equal lengths safe.
    A component's shortest edge so far bounds the balls that its points look in, and a ball all its own is never visited.
    """
    balls = build(points)
    part = stored(balls.points.select("pid", F.col("pid").alias("own")))
    left, edges = part.count(), None
    while left > 1:
        here = Balls(stored(balls.points.join(part, "pid").select("pid", "x", "ball", "own")), balls.centres, balls.radius)
        pure = here.points.groupBy("ball").agg(F.min("own").alias("whose"), F.max("own").alias("_high")).filter("whose = _high")
        pure = F.broadcast(stored(pure.select("ball", "whose")))  # a row a ball, 8,192 at most
        best = None
        for step in ("home", "near", "rest"):
            rows = here.points.select("pid", "x", F.col("ball").alias("home"), "own")
            if best is None:
                rows = rows.withColumn("ub", F.lit(math.inf))
            else:
                rows = rows.join(best.select("own", F.col("e.d").alias("_d")), "own", "left").withColumn("ub", F.coalesce("_d", F.lit(math.inf))).drop("_d")
            visits = _visits(here, rows, step, "own")
            visits = visits.join(pure.select(F.col("ball").alias("_b"), "whose"), (F.col("ball") == F.col("_b")) & (F.col("own") == F.col("whose")), "left_anti")
            found = _look(here, stored(visits), 1, "own").join(part, "pid")
            found = found.select("own", F.struct("d", F.least("pid", "other").alias("a"), F.greatest("pid", "other").alias("b")).alias("e"))
            both = found if best is None else found.unionByName(best)
            best = stored(both.groupBy("own").agg(F.min("e").alias("e")))
        new = stored(best.select("e.*").distinct())
        edges = new if edges is None else stored(edges.unionByName(new))
        ends = new.join(part.select(F.col("pid").alias("a"), F.col("own").alias("u")), "a").join(part.select(F.col("pid").alias("b"), F.col("own").alias("v")), "b")
        grown = connected(ends.select(F.col("u").alias("a"), F.col("v").alias("b")), part.select("own").distinct(), "own")
        part = stored(part.join(grown, "own").select("pid", F.col("component").alias("own")))
        left = part.select("own").distinct().count()
    return edges if edges is not None else balls.points.sparkSession.createDataFrame([], "d double, a long, b long")


def _height(method: str, v: Column, na: Column, nb: Column) -> Column:
    return F.sqrt(2 * na * nb / (na + nb) * v) if method == "ward" else v


def _pairs(groups: DataFrame, method: str) -> DataFrame:
    """a, b, v, na, nb: distances (Ward: squared) of all pairs of points (pid, x, n), block by block."""

    def between(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        x, y, d = np.stack(p.x.to_numpy()), np.stack(q.x.to_numpy()), np.zeros((len(p), len(q)))
        for k in range(x.shape[1]):
            d += (x[:, k, None] - y[None, :, k]) ** 2
        i, j = np.nonzero(p.id.to_numpy()[:, None] < q.id.to_numpy()[None])
        v = d[i, j] if method == "ward" else np.sqrt(d[i, j])
        return pd.DataFrame({"a": p.id.to_numpy()[i], "b": q.id.to_numpy()[j], "v": v, "na": p.n.to_numpy()[i], "nb": q.n.to_numpy()[j]})

    return _blocks(groups.select(F.col("pid").alias("id"), "x", F.col("n").cast("double").alias("n")), between, "a long, b long, v double, na double, nb double")


def _last_merges(pairs: DataFrame, method: str, nth: int) -> DataFrame:
    """a, b, d, nth: the merges of the FINISH clusters or fewer that are left, the nearest pair (first of equals) at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[pdf.a, pdf.b])
        i, j = np.searchsorted(ids, pdf.a), np.searchsorted(ids, pdf.b)
        v, size, out = np.full((len(ids), len(ids)), np.inf), np.ones(len(ids)), []
        v[i, j] = v[j, i] = pdf.v
        size[i], size[j] = pdf.na, pdf.nb
        height = lambda v, a, b: np.sqrt(2 * a * b / (a + b) * v) if method == "ward" else v
        d = height(v, size[:, None], size[None])
        for k in range(len(ids) - 1):
            i, j = sorted(divmod(int(d.argmin()), len(ids)))
            out.append((ids[i], ids[j], d[i, j], nth + k))
            a, b = size[i], size[j]
            if method == "complete":
                new = np.maximum(v[i], v[j])
            else:
                new = (a * v[i] + b * v[j]) / (a + b)
                if method == "ward":
                    new = np.maximum(new - a * b / (a + b) ** 2 * v[i, j], 0)
            size[i] += b
            v[i], v[:, i], v[j], v[:, j], v[i, i] = new, new, np.inf, np.inf, np.inf
            v[i, j] = v[j, i] = np.inf
            d[i] = d[:, i] = height(v[i], size[i], size)
            d[j] = d[:, j] = np.inf
        return pd.DataFrame(out, columns=["a", "b", "d", "nth"])

    return pairs.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "a long, b long, d double, nth long")


def merges(groups: DataFrame, method: str, finish: int = FINISH) -> DataFrame:
    """a, b, d, nth: the whole hierarchy of points (pid, x, n rows each) for complete, average or Ward linkage.

    A cluster is named by its least id; d is the distance at which a and b merge, nth the round. At ``finish`` clusters the
    rest is merged in one task.
    """
    left, nth, out = groups.count(), 0, None
    pairs = stored(_pairs(groups, method))
    while left > max(1, finish):
        edge = F.struct("d", "a", "b", "v", "na", "nb")
        far = pairs.withColumn("d", _height(method, F.col("v"), F.col("na"), F.col("nb")))
        best = far.select(F.explode(F.array("a", "b")).alias("c"), edge.alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        mutual = stored(best.groupBy("e").agg(F.count("*").alias("n")).filter("n = 2").select("e.*"))
        n = F.col("na") + F.col("nb")
        inside = F.col("na") * F.col("nb") / (n * n) * F.col("v") if method == "ward" else F.lit(0.0)
        new = stored(mutual.select(F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("new"), n.alias("n"), inside.alias("w")))
        one, two = (new.select(*[F.col(c).alias(f"{c}{s}") for c in new.columns]) for s in (1, 2))
        p = pairs.join(one, F.col("a") == F.col("c1"), "left").join(two, F.col("b") == F.col("c2"), "left")
        u, w = F.coalesce("new1", "a"), F.coalesce("new2", "b")
        nu, nw = F.coalesce("n1", "na"), F.coalesce("n2", "nb")
        p = p.select(
            F.least(u, w).alias("a"), F.greatest(u, w).alias("b"), F.when(u < w, nu).otherwise(nw).alias("na"), F.when(u < w, nw).otherwise(nu).alias("nb"),
            "v", (F.col("na") * F.col("nb") * F.col("v")).alias("nnv"), (F.coalesce("w1", F.lit(0.0)) + F.coalesce("w2", F.lit(0.0))).alias("w"),
        ).filter("a <> b")
        v = F.max("v") if method == "complete" else F.greatest(F.sum("nnv") / (F.max("na") * F.max("nb")) - F.max("w"), F.lit(0.0))
        pairs = stored(p.groupBy("a", "b").agg(v.alias("v"), F.max("na").alias("na"), F.max("nb").alias("nb")))
        step = mutual.select("a", "b", "d", F.lit(nth).cast("long").alias("nth"))
        out = step if out is None else out.unionByName(step)
        left, nth = left - mutual.count(), nth + 1
    if left > 1:
        rest = _last_merges(pairs, method, nth)
        out = rest if out is None else out.unionByName(rest)
    return stored(out) if out is not None else groups.sparkSession.createDataFrame([], "a long, b long, d double, nth long")


def linkage(df: DataFrame, key: str, array: str, clusters: int, method: str = "complete", finish: int = FINISH) -> DataFrame:
    """key, cluster: ``clusters`` clusters by agglomeration, numbered from 0 by their least keys. Keys are whole numbers, each once.

    ``method``: single, complete, average or ward. Equal vectors are one point that weighs as many rows, so that there are
    no more clusters than different vectors. Rows without a finite vector have cluster null. Of merges at equal distance the
    one of lower keys comes first. An empty table gives an empty result.
    """
    if method not in METHODS or clusters < 1:
        raise ValueError(f"method {method!r}, {clusters} clusters: take one of {METHODS} and 1 cluster or more")
    rows = stored(df.select(F.col(key).cast("long").alias("id"), F.col(array).cast("array<double>").alias("x")))
    fit = rows.filter(F.col("x").isNotNull() & F.forall("x", lambda v: F.coalesce(F.abs(v) < math.inf, F.lit(False))))
    groups = stored(fit.groupBy("x").agg(F.min("id").alias("pid"), F.count("*").alias("n")))
    tree = spanning_tree(groups.select("pid", "x")).withColumn("nth", F.lit(0)) if method == "single" else merges(groups, method, finish)
    # The tree without its clusters - 1 longest merges.
    gone = tree.orderBy(F.desc("d"), F.desc("nth"), F.desc("a"), F.desc("b")).limit(clusters - 1).select("a", "b")
    of = connected(tree.join(gone, ["a", "b"], "left_anti"), groups, "pid")
    number = row_index(of.select("component").distinct(), "component", out="cluster")
    of = of.join(number, "component").select("pid", "cluster")
    of = fit.join(groups.select("x", "pid"), "x").join(of, "pid").select("id", "cluster")
    return rows.select("id").join(of, "id", "left").select(F.col("id").alias(key), "cluster")
