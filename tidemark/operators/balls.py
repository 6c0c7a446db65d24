"""Exact nearest neighbours by reference balls.

Points belong to the ball of their nearest reference point. A ball whose centre is further from a row than its radius and
the distance that the row's k-th neighbour so far has can't hold a nearer one, by the triangle inequality. A row looks
in its own ball, then in the few nearest others, and then only where that bound leaves room. Where it leaves room nearly
everywhere, as in many dimensions, the rows meet in pairs of blocks instead: all pairs, but in bounded memory.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import blocks
from .blocks import spans as _spans
from .blocks import squares
from .blocks import stack as _stack
from .relate import running_sums

#: Reference points at most, and their bytes; balls that are looked in before bounds decide; rows that visit a ball in one task.
MOST_BALLS, BALL_BYTES = 8192, 32 << 20
PROBES = 4
BLOCK = 4096
#: Bytes of visits that a task hands over at once, and relative slack of bounds for rounding.
VISIT_BYTES = 8 << 20
SLACK = 1e-7


@dataclass
class Balls:
    """points: pid, x, ball (and others given); centres; each ball's radius."""

    points: DataFrame
    centres: np.ndarray
    radius: np.ndarray


def build(points: DataFrame) -> Balls:
    """``points``: pid, x (different vectors of one length), and more. Reference points are those of the least hashes, about the root of their number."""
    points = cut(points)
    n = points.count()
    if not n:
        return Balls(points.withColumn("ball", F.lit(0)), np.empty((0, 1)), np.empty(0))
    dims = len(points.select("x").first()[0])
    m = max(1, min(math.isqrt(n), MOST_BALLS, BALL_BYTES // (8 * max(1, dims))))
    chosen = points.select("x", F.xxhash64(F.lit(1), "x").alias("h")).orderBy("h", "x").limit(m).collect()
    centres = np.array([r.x for r in chosen], float).reshape(len(chosen), dims)
    names = points.columns

    def assign(batches):
        for batch in batches:
            x = _stack(batch.column("x"))
            ball, r = np.zeros(len(x), np.int32), np.zeros(len(x))
            for s in _spans(len(x), len(centres)):
                ball[s] = squares(x[s], centres).argmin(1)
                r[s] = np.sqrt(((x[s] - centres[ball[s]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(r)], names=[*names, "ball", "r"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    dealt = cut(points.mapInArrow(assign, kinds + ", ball int, r double"))
    radius = np.full(len(centres), -math.inf)
    for b, r in dealt.groupBy("ball").agg(F.max("r")).collect():  # a row a reference point
        radius[b] = r
    return Balls(dealt.drop("r"), centres, radius)


def _visits(balls: Balls, rows: DataFrame, part: str, own: str | None) -> DataFrame:
    """pid, x, ub, (own,) ball: where each of ``rows`` (pid, x, ub, home) looks. ``part``: 'home', 'near' (PROBES balls) or 'rest';
    with 'tally', n: the number of the rest, in parts."""
    centres, radius, names = balls.centres, balls.radius, ["pid", "x", "ub"] + ([own] if own else [])
    if part == "home":
        return rows.select(*names, F.col("home").alias("ball"))

    def run(batches):
        for batch in batches:
            x, ub, home = _stack(batch.column("x")), batch.column("ub").to_numpy(), batch.column("home").to_numpy()
            for s in _spans(len(x), len(centres)):
                far = np.sqrt(squares(x[s], centres))
                low = np.maximum(far - radius[None] - SLACK * (far + 1), 0)
                low[np.arange(low.shape[0]), home[s]] = math.inf
                low[:, ~np.isfinite(radius)] = math.inf  # balls without points
                order = np.argsort(low, 1, kind="stable")
                ok = np.take_along_axis(low, order, 1) <= ub[s][:, None] * (1 + SLACK)
                ok &= np.isfinite(np.take_along_axis(low, order, 1))
                ok[:, PROBES:] &= part != "near"
                ok[:, :PROBES] &= part == "near"
                if part == "tally":
                    yield pa.RecordBatch.from_arrays([pa.array([int(ok.sum())])], names=["n"])
                    continue
                i, j = np.nonzero(ok)
                step = max(1, VISIT_BYTES // (8 * (x.shape[1] + 4)))
                for at in range(0, len(i), step):
                    take, ball = pa.array(i[at : at + step] + s.start), order[i[at : at + step], j[at : at + step]].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in names], pa.array(ball)], names=[*names, "ball"])

    if part == "tally":
        return rows.mapInArrow(run, "n long")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, kinds + ", ball int")


def _nearest_of(out: tuple[list, list, list], k: int) -> pa.Table:
    """pid, other, d: the ``k`` nearest of each row among those found."""
    cols = [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(out, (np.int64, np.int64, float), strict=True)]
    if len(cols[0]):
        order = np.lexsort((cols[1], cols[2], cols[0]))
        cols = [c[order] for c in cols]
        first = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        cols = [c[place < k] for c in cols]
    return pa.table({"pid": pa.array(cols[0], pa.int64()), "other": pa.array(cols[1], pa.int64()), "d": pa.array(cols[2], pa.float64())})


def _meet(state: DataFrame, k: int, nb: int) -> DataFrame:
    """pid, other, d: for each row (pid, x, ub) the nearest ``k`` within ub in each block, itself among them."""

    def add(out, ids, others, x, y, ub, d, margin):
        limit = (ub * (1 + SLACK)) ** 2
        if not np.isfinite(limit).all() and k < d.shape[1]:
            limit = np.minimum(limit, np.partition(d, k - 1, 1)[:, k - 1])
        i, j = np.nonzero(d <= limit[:, None] + margin)
        for t in _spans(len(i), x.shape[1]):
            out[0].append(ids[i[t]])
            out[1].append(others[j[t]])
            out[2].append(np.sqrt(((x[i[t]] - y[j[t]]) ** 2).sum(1)))

    def run(a: pa.Table, b: pa.Table | None) -> pa.Table:
        out = ([], [], [])
        p = a if b is None else b
        x, y = _stack(a.column("x")), _stack(p.column("x"))
        ids, others = a.column("pid").to_numpy(), p.column("pid").to_numpy()
        near, far = a.column("ub").to_numpy(), p.column("ub").to_numpy()
        size = (y * y).sum(1)
        for s in _spans(len(x), len(y)) if len(y) else []:
            d = squares(x[s], y)
            margin = SLACK * ((x[s] * x[s]).sum(1)[:, None] + size[None])
            add(out, ids[s], others, x[s], y, near[s], d, margin)
            if b is not None:
                add(out, others, ids[s], y, x[s], far, d.T, margin.T)
        return _nearest_of(out, k)

    return blocks.meet(state.select("pid", "x", "ub"), "pid", nb, run, "pid long, other long, d double")


def _look(balls: Balls, visits: DataFrame, k: int, own: str | None) -> DataFrame:
    """pid, other, d: for each visit the nearest ``k`` points of the ball within ub. With ``own``, only points of another ``own``."""
    share = visits.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slots"))  # a row a ball
    share = F.broadcast(cut(share))
    asked = visits.join(share, "ball").withColumn("slot", F.pmod(F.xxhash64("pid"), F.col("slots")).cast("int")).drop("slots")
    held = balls.points.join(share, "ball").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    held = held.toDF(*held.columns)  # columns of its own beside those of the visits

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        out = ([], [], [])
        if q.num_rows and p.num_rows:
            x, y = _stack(q.column("x")), _stack(p.column("x"))
            ids, others, ub = q.column("pid").to_numpy(), p.column("pid").to_numpy(), q.column("ub").to_numpy()
            size = (y * y).sum(1)
            for s in _spans(len(x), len(y)):
                d = squares(x[s], y)
                margin = SLACK * ((x[s] * x[s]).sum(1)[:, None] + size[None])
                if own:
                    d[q.column(own).to_numpy()[s][:, None] == p.column(own).to_numpy()[None]] = math.inf
                limit = np.minimum((ub[s] * (1 + SLACK)) ** 2, np.partition(d, k - 1, 1)[:, k - 1] if k < d.shape[1] else math.inf)
                i, j = np.nonzero((d <= limit[:, None] + margin) & np.isfinite(d))
                for t in _spans(len(i), x.shape[1]):
                    out[0].append(ids[s][i[t]])
                    out[1].append(others[j[t]])
                    out[2].append(np.sqrt(((x[s][i[t]] - y[j[t]]) ** 2).sum(1)))
        return _nearest_of(out, k)

    return asked.groupBy("ball", "slot").cogroup(held.groupBy("ball", "slot")).applyInArrow(run, "pid long, other long, d double")


def search(balls: Balls, k: int, count: list | None = None) -> DataFrame:
    """pid, near (array of d, other): the ``k`` nearest points of every point, itself among them, by distance and pid.

    ``count`` gets the pairs of rows and points of each step.
    """
    points = balls.points.select("pid", "x", F.col("ball").alias("home"))
    none = F.array().cast("array<struct<d: double, other: bigint>>")
    state = points.select("pid", "x", "home", F.lit(math.inf).alias("ub"), none.alias("near"))
    sizes = balls.points.groupBy("ball").agg(F.count("*").alias("size"))
    best = lambda c: F.slice(F.array_sort(c), 1, k)
    for part in ("home", "near", "rest"):
        rows = state.select("pid", "x", "ub", "home")
        if part == "rest":
            n = state.count()
            nb = blocks.number(n, balls.centres.shape[1])
            if (_visits(balls, rows, "tally", None).agg(F.sum("n")).first()[0] or 0) > n * nb:  # more rows to move than all pairs of blocks take
                if count is not None:
                    count.append(n * (n + 1) // 2)
                return _meet(state, k, nb).groupBy("pid").agg(best(F.collect_list(F.struct("d", "other"))).alias("near"))
        visits = cut(_visits(balls, rows, part, None))
        if count is not None:
            count.append(visits.groupBy("ball").agg(F.count("*").alias("n")).join(sizes, "ball").agg(F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()[0])
        found = _look(balls, visits, k, None).groupBy("pid").agg(best(F.collect_list(F.struct("d", "other"))).alias("new"))
        both = state.join(found, "pid", "left")
        near = F.when(F.col("new").isNull(), F.col("near")).otherwise(best(F.concat("near", "new")))
        state = both.select("pid", "x", "home", near.alias("near"))
        state = cut(state.select("pid", "x", "home", F.when(F.size("near") >= k, F.element_at("near", k)["d"]).otherwise(math.inf).alias("ub"), "near"))
    return state.select("pid", "near")


def nearest(df: DataFrame, key: str, array: str, k: int, include_self: bool = False, count: list | None = None) -> DataFrame:
    """key, mean_distance, nearest: the k nearest other rows, exact; ties go to the lower key. Keys are whole numbers, each once.

    Equal vectors are one point with its k + 1 least keys, however many they are. A row without a finite vector has
    no neighbours and is none. Fewer than k other rows: all of them. A row that is alone: null and an empty array.
    """
    x = F.col(array) if df.schema[array].dataType.simpleString() == "array<float>" else F.col(array).cast("array<double>")  # floats are half as much to move
    rows = df.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(F.col("x").isNotNull() & F.forall("x", lambda v: F.coalesce(F.abs(v) < math.inf, F.lit(False))))
    rows = cut(rows)
    groups = rows.groupBy("x").agg(F.min("id").alias("pid"), F.count("*").alias("n"))
    many = groups.filter("n > 1").select("x", "pid")
    copies = cut(running_sums(rows.join(many, "x").select("id", "pid"), {"nth": F.lit(1)}, ["pid"], "id"))
    heads = copies.filter(F.col("nth") <= k + 1).groupBy("pid").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    balls = build(groups.select("pid", "x"))
    near = search(balls, k + 1, count).select("pid", F.inline("near"))
    # Points back to keys: the k + 1 least by distance and key.
    ids = near.join(heads.select(F.col("pid").alias("other"), "ids"), "other", "left").select("pid", "d", F.explode(F.coalesce("ids", F.array("other"))).alias("id"))
    lists = ids.groupBy("pid").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("near"))
    of = rows.select("id").join(copies.select("id", F.col("pid").alias("p")), "id", "left").select("id", F.coalesce("p", "id").alias("pid"))
    own = of.join(lists, "pid")
    kept = F.slice("near" if include_self else F.filter("near", lambda v: v["id"] != F.col("id")), 1, k)
    own = own.select("id", kept.alias("n"))
    mean = F.aggregate("n", F.lit(0.0), lambda s, v: s + v["d"]) / F.nullif(F.size("n"), F.lit(0))
    return own.select(F.col("id").alias(key), mean.alias("mean_distance"), F.transform("n", lambda v: v["id"]).alias("nearest"))
