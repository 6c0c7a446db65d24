"""Trees grown level by level from histograms: second-order boosting, and forests on even or random thresholds.

A level is one pass over the rows. Every input partition adds its rows up by node, feature and bin, and only these sums
are shuffled: rows are never copied for a tree or a feature. What reaches the driver is the model, a row a node. A row's
node isn't stored either; it follows from the splits found so far.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: Bin of a missing value (a bin is one byte), and the digits to which equal gains are ties.
MISSING, DIGITS = 255, 9
#: Boosted trees between two writes of the rows' margins.
REFRESH = 10
#: Nodes of all trees of a level at most: the sums of a task are so many times features times bins.
MOST_NODES = 1 << 16


@dataclass
class Tree:
    """splits: node -> (feature, threshold, nulls go left, gain); values: node -> value of a leaf. Children of n are 2n and 2n + 1; the root is 1."""

    splits: dict[int, tuple[int, float, bool, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The node of each row of x (nan: missing), at the depth reached so far. Parents come before their children."""
        node = np.ones(len(x), np.int64)
        for n in sorted(self.splits):
            f, at, left, _ = self.splits[n]
            here = np.flatnonzero(node == n)
            v = x[here, f]
            node[here] = 2 * n + np.where(np.isnan(v), not left, v > at)
        return node

    def apply(self, x: np.ndarray) -> np.ndarray:
        node = self.route(x)
        ids, inverse = np.unique(node, return_inverse=True)
        return np.array([self.values.get(int(n), 0.0) for n in ids])[inverse]


def table(spark: SparkSession, trees: list[Tree], names: list[str]) -> DataFrame:
    """tree, node, feature, threshold, nulls_left, gain, value: a row a node; inner nodes have no value, leaves no feature."""
    rows = [(t, n, names[f], float(a), bool(m), float(g), None) for t, x in enumerate(trees) for n, (f, a, m, g) in x.splits.items()]
    rows += [(t, n, None, None, None, None, float(v)) for t, x in enumerate(trees) for n, v in x.values.items()]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[:2]), "tree int, node long, feature string, threshold double, nulls_left boolean, gain double, value double")


def gains(trees: list[Tree], names: list[str]) -> dict[str, float]:
    """Each feature's share of all gain, the most important first."""
    total = dict.fromkeys(names, 0.0)
    for x in trees:
        for f, _, _, g in x.splits.values():
            total[names[f]] += g
    whole = sum(total.values()) or 1.0
    return dict(sorted(((n, v / whole) for n, v in total.items()), key=lambda r: (-r[1], r[0])))


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1).astype(float) if batch.num_rows else np.empty((0, len(names)))


def _features(columns: list[str]) -> list:
    """The features as double columns x0, x1, ...; values that aren't finite count as missing."""
    each = [F.col(c).cast("double") for c in columns]
    return [F.when(F.abs(x) < float("inf"), x).alias(f"x{i}") for i, x in enumerate(each)]


def bin_edges(df: DataFrame, columns: list[str], bins: int = 64, accuracy: int = 1_000_000) -> list[np.ndarray]:
    """Distinct quantiles of each column, at most ``bins`` - 1, from one pass of sketches. A value's bin is the number of edges below it."""
    if not 2 <= bins < MISSING:
        raise ValueError("bins must be from 2 to 254")
    shares = [k / bins for k in range(1, bins)]
    row = df.select(_features(columns)).agg(*[F.percentile_approx(f"x{i}", shares, accuracy).alias(f"q{i}") for i in range(len(columns))]).first()
    return [np.unique(np.array(q or [], float)) for q in row]


# ---- second-order boosting


@dataclass
class Boosted:
    trees: list[Tree]
    columns: list[str]
    objective: str

    def predict(self, df: DataFrame, out: str = "margin") -> DataFrame:
        """``df`` with the margin and, for the logistic objective, ``probability``."""
        names, trees = [f.name for f in df.schema], self.trees
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        xs = [f"_x{i}" for i in range(len(self.columns))]
        ready = df.withColumns({x: c for x, c in zip(xs, _features(self.columns), strict=True)})

        def run(batches):
            for batch in batches:
                x = _matrix(batch, xs)
                m = np.sum([t.apply(x) for t in trees], 0) if trees else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.broadcast_to(m, len(x)).astype(float))], names=[*names, out])

        got = ready.mapInArrow(run, f"{kinds}, `{out}` double")
        return got.withColumn("probability", 1 / (1 + F.exp(-F.col(out)))) if self.objective == "logistic" else got

    def table(self, spark: SparkSession) -> DataFrame:
        return table(spark, self.trees, self.columns)


def boost(
    df: DataFrame, columns: list[str], label: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, *, objective: str = "logistic",
    l2: float = 1.0, min_gain: float = 0.0, min_hessian: float = 1.0, leaves: int | None = None, bins: int = 64, positive_weight: float | None = 1.0,
) -> Boosted:
    """Trees fitted to gradients and Hessians of the loss: 'logistic' (labels 0 and 1) or 'squared'.

    A split's gain is half of GL^2/(HL + l2) + GR^2/(HR + l2) - G^2/(H + l2), and must be over ``min_gain``; either side
    has a Hessian of ``min_hessian`` at least. Thresholds are quantiles, taken once. Missing values, of which each split
    says where they go, are tried on both sides; a threshold of infinity parts them from all others. With ``leaves`` the splits of the most gain are kept, level by level,
    until a tree has so many. ``positive_weight`` weighs label 1; None balances the classes. Rows without a label don't
    count. Ties go to the first feature, the lower threshold, and nulls to the left. No rows: no trees.
    """
    if objective not in ("logistic", "squared"):
        raise ValueError(objective)
    if 2**depth > MOST_NODES:
        raise ValueError(f"2 ** depth may be {MOST_NODES} at most")
    y = F.col(label).cast("double")
    known = df.filter(F.abs(y) < float("inf"))
    edges = bin_edges(known, columns, bins)
    d, width = len(columns), MISSING + 1
    if positive_weight is None:
        n, pos = known.agg(F.count("*"), F.sum(y)).first()
        positive_weight = (n - pos) / pos if pos else 1.0
    logistic = objective == "logistic"
    names = [f"x{i}" for i in range(d)]

    def binned(batches):
        for batch in batches:
            x = _matrix(batch, names)
            b = np.full(x.shape, MISSING, np.uint8)
            for f in range(d):
                ok = ~np.isnan(x[:, f])
                b[ok, f] = np.searchsorted(edges[f], x[ok, f], "left")
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(np.zeros(len(x))), pa.array([r.tobytes() for r in b], pa.binary(d))], names=["y", "margin", "bins"])

    schema = "y double, margin double, bins binary"
    fixed = lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.binary())], names=["y", "margin", "bins"])
    rows = cut(known.select(y.alias("y"), *_features(columns)).mapInArrow(lambda bs: (fixed(b) for b in binned(bs)), schema))

    def as_bins(batch: pa.RecordBatch) -> np.ndarray:
        """Bins as doubles, missing ones nan, so that trees on bin numbers route them."""
        b = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, d).astype(float)
        b[b == MISSING] = np.nan
        return b

    def margins(batch: pa.RecordBatch, b: np.ndarray, since: list[Tree]) -> np.ndarray:
        m = batch.column("margin").to_numpy()
        return m + np.sum([t.apply(b) for t in since], 0) if since else m

    def refreshed(since: list[Tree]):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(margins(batch, as_bins(batch), since)), batch.column("bins")], names=["y", "margin", "bins"])

        return run

    def sums(since: list[Tree], tree: Tree, open_nodes: list[int]):
        """node, f, bin, g, h, n of the open nodes, each task's rows added up."""
        place = {n: i for i, n in enumerate(open_nodes)}
        weight = positive_weight

        def run(batches):
            total = np.zeros((len(place), d, width, 3))
            for batch in batches:
                if not batch.num_rows:
                    continue
                b, t = as_bins(batch), batch.column("y").to_numpy()
                m = margins(batch, b, since)
                p = 1 / (1 + np.exp(-m)) if logistic else m
                w = np.where(t == 1, weight, 1.0) if logistic else 1.0
                g, h = (p - t) * w, (p * (1 - p) * w if logistic else np.ones(len(t)))
                node = tree.route(b)
                at = np.array([place.get(int(n), -1) for n in range(int(node.max()) + 1)])[node]
                here = at >= 0
                at, g, h = at[here], g[here], h[here]
                b = np.where(np.isnan(b[here]), MISSING, b[here]).astype(np.int64)
                for f in range(d):
                    cell = at * width + b[:, f]
                    for k, v in enumerate((g, h, None)):
                        total[:, f, :, k] += np.bincount(cell, v, len(place) * width).reshape(-1, width)
            i, f, b = np.nonzero(total[..., 2])
            got = total[i, f, b]
            ids = np.array(open_nodes, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(f), pa.array(b), *[pa.array(got[:, k]) for k in range(3)]], names=["node", "f", "bin", "g", "h", "n"])

        return run

    trees: list[Tree] = []  # thresholds are bin numbers until the end
    since: list[Tree] = []
    for _ in range(rounds):
        tree, totals, open_nodes = Tree(), {}, [1]
        for _ in range(depth):
            s = rows.mapInArrow(sums(since, tree, open_nodes), "node long, f long, bin long, g double, h double, n double")
            found = _best_splits(s.groupBy("node", "f", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]), l2, min_hessian).collect()
            for r in found:
                totals[r.node] = (r.g, r.h)
            good = sorted((r for r in found if r.gain is not None and r.gain > min_gain), key=lambda r: (-round(r.gain, DIGITS), r.node))
            if leaves is not None:
                good = good[: max(0, leaves - 1 - len(tree.splits))]
            for r in good:
                tree.splits[r.node] = (r.f, float(r.bin), r.nulls_left, r.gain)
                totals[2 * r.node], totals[2 * r.node + 1] = (r.gl, r.hl), (r.g - r.gl, r.h - r.hl)
            open_nodes = sorted(n for r in good for n in (2 * r.node, 2 * r.node + 1))
            if not open_nodes:
                break
        if not totals:
            break
        tree.values = {n: -rate * g / (h + l2) for n, (g, h) in totals.items() if n not in tree.splits and h + l2 > 0}
        trees.append(tree)
        since.append(tree)
        if len(since) == REFRESH:
            rows, since = cut(rows.mapInArrow(refreshed(since), schema)), []
    real = [Tree({n: (f, float([*edges[f], math.inf][int(b)]), m, g) for n, (f, b, m, g) in t.splits.items()}, t.values) for t in trees]
    return Boosted(real, list(columns), objective)


def _best_splits(s: DataFrame, l2: float, min_hessian: float) -> DataFrame:
    """node, g, h and its best split (f, bin, nulls_left, gain, gl, hl; null if there is none) from sums by node, f and bin."""
    lost = F.col("bin") == MISSING
    all_ = Window.partitionBy("node", "f")
    upto = all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most 256 bins
    c = s.select(
        "node", "f", "bin",
        *[F.sum(x).over(all_).alias(x) for x in "ghn"],
        *[F.sum(F.when(~lost, F.col(x)).otherwise(0.0)).over(upto).alias(f"{x}0") for x in "ghn"],
        *[F.sum(F.when(lost, F.col(x)).otherwise(0.0)).over(all_).alias(f"{x}m") for x in "ghn"],
    )
    nodes = c.groupBy("node").agg(F.max_by("g", -F.col("f")).alias("g"), F.max_by("h", -F.col("f")).alias("h"))
    side = lambda left: F.struct(F.lit(left).alias("nulls_left"), *[(F.col(f"{x}0") + F.col(f"{x}m") if left else F.col(f"{x}0")).alias(f"{x}l") for x in "ghn"])
    c = c.filter(~lost).select("node", "f", "bin", "g", "h", "n", F.inline(F.array(side(True), side(False))))
    score = lambda g, h: g * g / (h + l2)
    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    gain = 0.5 * (score(F.col("gl"), F.col("hl")) + score(gr, hr) - score(F.col("g"), F.col("h")))
    c = c.filter((F.col("nl") > 0) & (F.col("nl") < F.col("n")) & (F.col("hl") >= min_hessian) & (hr >= min_hessian)).withColumn("gain", gain)
    order = F.struct(F.round("gain", DIGITS).alias("a"), (-F.col("f")).alias("b"), (-F.col("bin")).alias("c"), F.col("nulls_left").alias("d"))
    best = c.groupBy(F.col("node").alias("of")).agg(F.max_by(F.struct("f", "bin", "nulls_left", "gain", "gl", "hl"), order).alias("best"))
    return nodes.join(best, F.col("node") == F.col("of"), "left").select("node", "g", "h", "best.*")


# ---- forests


@dataclass
class Forest:
    trees: list[Tree]
    columns: list[str]
    seed: int
    bagged: bool

    def votes(self, df: DataFrame, key: str, label: str | None = None, soft: bool = False) -> DataFrame:
        """key, (label,) prediction, out_of_bag: the class most trees vote for, and that of the trees that didn't have the row.

        Ties go to the lower class. Without a bag, or for rows in every bag, out_of_bag is null.
        """
        trees, seed, bagged, xs = self.trees, self.seed, self.bagged, [f"x{i}" for i in range(len(self.columns))]
        rows = df.select(F.col(key).alias("k"), *([F.col(label).cast("long").alias("y")] if label else []), F.xxhash64(F.lit(seed), F.col(key)).alias("hash"), *_features(self.columns))
        kept = ["k", "y"] if label else ["k"]
        classes = np.array(sorted({int(c) for t in trees for v in t.values.values() for c in (v if soft else [v])}), np.int64)
        at = {int(c): i for i, c in enumerate(classes)}

        def run(batches):
            for batch in batches:
                x = _matrix(batch, xs)
                count, out = (np.zeros((len(x), max(1, len(classes)))) for _ in range(2))
                weights = _weights(batch.column("hash").to_numpy(), len(trees)) if bagged else None
                for t, tree in enumerate(trees):
                    node = tree.route(x)
                    ids, inverse = np.unique(node, return_inverse=True)
                    vote = np.zeros((len(ids), count.shape[1]))
                    for i, n in enumerate(ids):
                        for c, p in (tree.values[int(n)] if soft else {tree.values[int(n)]: 1.0}).items():
                            vote[i, at[int(c)]] = p
                    count += vote[inverse]
                    if bagged:
                        out += vote[inverse] * (weights[:, t] == 0)[:, None]
                best = lambda c: classes[np.round(c, DIGITS).argmax(1)] if len(classes) else np.zeros(len(c), np.int64)
                mask = out.sum(1) == 0
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(best(count)), pa.array(best(out), mask=mask)], names=[*kept, "prediction", "out_of_bag"])

        kinds = f"k {rows.schema['k'].dataType.simpleString()}, " + ("y long, " if label else "")
        got = rows.mapInArrow(run, kinds + "prediction long, out_of_bag long")
        return got.withColumnsRenamed({"k": key} | ({"y": label} if label else {}))

    def table(self, spark: SparkSession) -> DataFrame:
        return table(spark, self.trees, self.columns)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix generator."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _weights(hashes: np.ndarray, trees: int) -> np.ndarray:
    """Poisson(1) draws, a row's and a tree's always the same."""
    with np.errstate(over="ignore"):
        u = _mix(hashes.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(steps, (u >> np.uint64(11)).astype(float) / (1 << 53), "right")


def forest(
    df: DataFrame, key: str, columns: list[str], label: str, trees: int = 10, depth: int = 6, *, least: int = 1, points: int = 100, features: int | None = None,
    criterion: str = "gini", bagged: bool = True, random: bool = False, soft: bool = False, seed: int = 1,
) -> Forest:
    """Classification trees (labels are whole numbers) that all grow together, a level at a time.

    A node's thresholds are ``points`` even steps from the least to the largest value of its rows in each of
    ``features`` columns drawn for it (all: None); with ``random`` it is one random point (extremely randomised trees).
    Rows up to a threshold go left. The split of the most gain by ``criterion`` ('gini' or 'entropy') is taken unless a
    side has fewer than ``least`` rows. With ``bagged`` a row's weight in a tree is a Poisson(1) draw by a hash of its
    key. A leaf's value is its most frequent class (ties: the lowest), or with ``soft`` the share of each. A level takes
    two passes: the ends of the nodes, then their counts by feature, step and class. Rows with a missing feature or
    label don't take part in growing; when voting, missing values go right. No rows: trees without nodes.
    """
    if trees * 2**depth > MOST_NODES:
        raise ValueError(f"trees * 2 ** depth may be {MOST_NODES} at most")
    d, xs = len(columns), [f"x{i}" for i in range(len(columns))]
    rows = df.select(F.xxhash64(F.lit(seed), F.col(key)).alias("hash"), F.col(label).cast("long").alias("y"), *_features(columns))
    rows = cut(rows.dropna())
    classes = np.array(sorted(r.y for r in rows.select("y").distinct().collect()), np.int64)  # the model's own
    grown = [Tree() for _ in range(trees)]
    if not len(classes):
        return Forest(grown, list(columns), seed, bagged)
    draws = np.random.default_rng(seed)
    take = d if features is None else min(d, features)

    def passes(open_nodes: dict[tuple[int, int], list[int]], one):
        """Rows of each open node: one(i, x, class codes, weights) for the i-th (tree, node)."""

        def over(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = _matrix(batch, xs), np.searchsorted(classes, batch.column("y").to_numpy())
                weights = _weights(batch.column("hash").to_numpy(), trees) if bagged else None
                node_of = {t: grown[t].route(x) for t in {t for t, _ in open_nodes}}
                for i, (t, n) in enumerate(open_nodes):
                    here = node_of[t] == n
                    if bagged:
                        here &= weights[:, t] > 0
                    if here.any():
                        one(i, x[here], y[here], weights[here, t] if bagged else np.ones(int(here.sum()), np.int64))

        return over

    def ends_of(open_nodes):
        m = len(open_nodes)

        def run(batches):
            low, high = np.full((m, d), np.inf), np.full((m, d), -np.inf)

            def one(i, x, y, w):
                np.minimum(low[i], x.min(0), out=low[i])
                np.maximum(high[i], x.max(0), out=high[i])

            passes(open_nodes, one)(batches)
            i, f = np.nonzero(np.isfinite(low))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(f), pa.array(low[i, f]), pa.array(high[i, f])], names=["i", "f", "a", "b"])

        got = rows.mapInArrow(run, "i long, f long, a double, b double").groupBy("i", "f").agg(F.min("a"), F.max("b")).collect()
        low, high = np.full((m, d), np.inf), np.full((m, d), -np.inf)
        for i, f, a, b in got:
            low[i, f], high[i, f] = a, b
        return low, high

    def counts_of(open_nodes, grids):
        shape = (d, grids.shape[2] + 1, len(classes))

        def run(batches):
            held: dict[int, np.ndarray] = {}

            def one(i, x, y, w):
                total = held.setdefault(i, np.zeros(shape, np.int64))
                for f in range(d):
                    if np.isfinite(grids[i, f, 0]):
                        cell = np.searchsorted(grids[i, f], x[:, f], "left") * len(classes) + y
                        total[f] += np.bincount(cell, w, shape[1] * shape[2]).astype(np.int64).reshape(shape[1:])

            passes(open_nodes, one)(batches)
            for i, total in held.items():
                f, b, c = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), i)), pa.array(f), pa.array(b), pa.array(c), pa.array(total[f, b, c])], names=["i", "f", "bin", "c", "n"])

        return rows.mapInArrow(run, "i long, f long, bin long, c long, n long").groupBy("i", "f", "bin", "c").agg(F.sum("n").alias("n"))

    open_nodes = {(t, 1): list(range(d)) for t in range(trees)}
    for level in range(depth + 1):
        low, high = ends_of(open_nodes)
        grids = np.full((len(open_nodes), d, 1 if random else points), np.inf)
        for i, _ in enumerate(open_nodes):
            chosen = sorted(draws.choice(d, take, replace=False))
            for f in chosen:
                if np.isfinite(low[i, f]):
                    grids[i, f] = low[i, f] + (high[i, f] - low[i, f]) * (draws.random() if random else np.arange(points) / (points - 1))
        # Each node's classes, and its best split.
        n = cut(counts_of(open_nodes, grids))
        first = n.groupBy("i").agg(F.min("f").alias("f0"))
        own = n.join(F.broadcast(first), "i").filter("f = f0").groupBy("i", "c").agg(F.sum("n").alias("n")).collect()
        tally: dict[int, dict[int, int]] = {}
        for r in own:
            tally.setdefault(r.i, {})[int(classes[r.c])] = r.n
        found = {r.i: r for r in _best_gains(n, criterion, least).collect()} if level < depth else {}
        following = {}
        for i, (t, k) in enumerate(open_nodes):
            if i in found and (sum(tally[i].values()) > least or least <= 1):
                r = found[i]
                grown[t].splits[k] = (r.f, float(grids[i, r.f, r.bin]), False, r.gain)
                following |= {(t, 2 * k): [], (t, 2 * k + 1): []}
            elif i in tally:
                whole = sum(tally[i].values())
                grown[t].values[k] = {c: v / whole for c, v in tally[i].items()} if soft else max(tally[i], key=lambda c: (tally[i][c], -c))
        open_nodes = following
        if not open_nodes:
            break
    return Forest(grown, list(columns), seed, bagged)


def _best_gains(n: DataFrame, criterion: str, least: int) -> DataFrame:
    """i, f, bin, gain: the best split of each node from counts by feature, step and class; steps up to ``bin`` go left."""
    steps = n.groupBy("i", "f").agg(F.collect_set("bin").alias("bins"))
    classes = n.groupBy("i", "f", "c").agg(F.sum("n").alias("t"))
    # A class has no row for a step it doesn't reach: its counts are filled up over the node's steps.
    grid = classes.join(steps, ["i", "f"]).select("i", "f", "c", "t", F.explode("bins").alias("bin"))
    upto = Window.partitionBy("i", "f", "c").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = grid.join(n, ["i", "f", "bin", "c"], "left").select("i", "f", "bin", "c", "t", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("l"))
    sides = sides.withColumn("r", F.col("t") - F.col("l"))
    x = lambda c: F.col(c).cast("double")
    one = (lambda c: x(c) * x(c)) if criterion == "gini" else (lambda c: F.when(x(c) > 0, x(c) * F.log2(x(c))).otherwise(0.0))
    g = sides.groupBy("i", "f", "bin").agg(*[F.sum(c).alias(f"n{c}") for c in "tlr"], *[F.sum(one(c)).alias(f"s{c}") for c in "tlr"])
    g = g.filter((F.col("nl") >= max(1, least)) & (F.col("nr") >= max(1, least)))
    pure = (lambda c: 1 - F.col(f"s{c}") / (x(f"n{c}") * x(f"n{c}"))) if criterion == "gini" else (lambda c: F.log2(x(f"n{c}")) - F.col(f"s{c}") / x(f"n{c}"))
    g = g.withColumn("gain", F.round(pure("t") - (x("nl") * pure("l") + x("nr") * pure("r")) / x("nt"), DIGITS)).filter("gain > 0")
    order = F.struct(F.col("gain").alias("a"), (-F.col("f")).alias("b"), (-F.col("bin")).alias("c"))
    return g.groupBy("i").agg(F.max_by(F.struct("f", "bin", "gain"), order).alias("best")).select("i", "best.*")
