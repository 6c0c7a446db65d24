"""Embedding near-duplicates with a pivot-permutation index.

A vector is described by its nearest reference points in order. It is posted in the lists of the first few of
them; two vectors in one list are candidates if they share enough reference points among the first ``DEPTH``, and
each candidate's cosine is computed in double precision. Equal vectors are one class throughout, so a vector that
occurs a million times is posted once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, staged
from .components import components

LEAST_COSINE = 0.93
#: Reference points: about the root of the number of classes, between these and of so many bytes at the most; drawn
#: from a sample of twice as many classes. Lists then grow with the root, too, while the points do: up to 10 ** 9 classes of
#: 128 numbers (32,768 points), 1.2 * 10 ** 8 of 384 (10,922), 3 * 10 ** 7 of 768 (5,461), 1.7 * 10 ** 7 of 1,024 (4,096).
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES = 32, 32768, 32 << 20
#: Lengths of vectors that have reference points of their own, the most frequent first; each rarer one has a single list.
MOST_LENGTHS = 64
#: Lists that a vector is posted in, reference points compared, and how many of those a candidate shares.
POSTED, DEPTH, SHARED = 5, 8, 2
#: Beyond so many reference points the first of two near vectors agree less often: lists and points compared there.
FEW_PIVOTS, MORE_POSTED, MORE_DEPTH = 1024, 8, 12
#: A longer list is cut into blocks of about so many, and each pair of blocks is a group of its own.
BLOCK = 2048
#: Different reference points of a list up to which sharing is counted with a matrix of them.
DENSE = 1024
#: Lists up to which their sizes are broadcast (24 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 250_000


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) with node null where a vector can't link, and one row a class (node, label, v, m, least)."""
    v = F.col("embedding")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    ok = finite & F.col("label").isNotNull()
    # Single precision travels as it is; everything is computed in double precision.
    kept = v if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else v.cast("array<double>")
    keyed = vectors.select("vec_id", F.xxhash64("label").alias("label"), kept.alias("v"), F.when(ok, F.xxhash64("label", "embedding")).alias("node"))
    classes = keyed.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    return staged(keyed.select("vec_id", "node"), "vectors"), staged(classes, "vector-classes")


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(classes: DataFrame, most: int = MOST_PIVOTS, most_bytes: int = PIVOT_BYTES) -> dict[int, np.ndarray]:
    """Reference points by length of vectors, from samples of the classes of that length, the same in every run.

    The more frequent lengths come first and may take what ``most_bytes`` has left.
    """
    lengths = classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MOST_LENGTHS).collect()
    out: dict[int, np.ndarray] = {}
    for dim, n in lengths:
        want = min(most, max(LEAST_PIVOTS, 1 << round(math.log2(n) / 2)), most_bytes // (8 * dim))
        if want > 0:
            rows = classes.filter(F.size("v") == dim).orderBy(F.xxhash64("node"), "node").limit(2 * want).select("v").toArrow()
            out[dim] = _unit(_matrix(rows.column("v")))[:want]
            most_bytes -= out[dim].nbytes
    return out


def reach(pivots: int) -> tuple[int, int]:
    """Lists that a vector is posted in and reference points compared, with so many reference points."""
    return (POSTED, DEPTH) if pivots <= FEW_PIVOTS else (MORE_POSTED, MORE_DEPTH)


def permutations(x: np.ndarray, pivots: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each row, its nearest reference points in order (ties: the first), some rows at a time."""
    depth, out = min(depth, len(pivots)), []
    for s in range(0, len(x), step := max(1, (1 << 22) // len(pivots))):
        far = -(x[s : s + step] @ pivots.T)
        if len(pivots) > 4 * depth:  # sort the few that are near enough only
            edge = np.partition(far, depth - 1, axis=1)[:, depth - 1 : depth]
            row, at = np.nonzero(far <= edge)
            order = np.lexsort((at, far[row, at], row))
            row, at = row[order], at[order]
            first = np.searchsorted(row, np.arange(len(far)))
            out.append(at[first[:, None] + np.arange(depth)])
        else:
            out.append(np.argsort(far, axis=1, kind="stable")[:, :depth])
    return np.concatenate(out).astype(np.int32) if out else np.zeros((0, depth), np.int32)


def post(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The inverted lists: list, node, label, dim, and the class's permutation, vector and size."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                rows = b.filter(pa.array(sizes == dim))
                raw = _matrix(rows.column("v"))
                x = _unit(raw)
                posted, depth = reach(len(pivots[dim])) if dim in pivots else (1, 1)
                perm = permutations(x, pivots[dim], depth) if dim in pivots else np.zeros((len(x), 1), np.int32)
                for k in range(min(posted, perm.shape[1])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(perm[:, k].astype(np.int32)), rows.column("node"), rows.column("label"), pa.array(np.full(len(x), dim, np.int32)), pa.array([p.tobytes() for p in perm], pa.binary()), pa.array([r.tobytes() for r in raw], pa.binary()), rows.column("m")],
                        names=["list", "node", "label", "dim", "perm", "x", "m"],
                    )

    return classes.select("node", "label", "v", "m").mapInArrow(run, "list int, node long, label long, dim int, perm binary, x binary, m long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links a-b between n nodes a spanning forest needs."""
    root = list(range(n))
    use = np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i != j:
            root[max(i, j)] = min(i, j)
            use[k] = True
    return use


def _shares(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """How many reference points each row of a has in common with each row of b; negative entries are none."""
    if count <= DENSE:
        marks = []
        for p in (a, b):
            m = np.zeros((len(p), count + 1), np.float32)
            np.put_along_axis(m, p, 1, 1)
            marks.append(m[:, :count])  # the last column takes what is none
        return marks[0] @ marks[1].T
    out = np.zeros((len(a), len(b)), np.int8)
    for k in range(a.shape[1]):
        for j in range(b.shape[1]):
            out += (a[:, k, None] == b[None, :, j]) & (a[:, k, None] >= 0)
    return out


def join_list(which: int, perm: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, least: float, posted: int, shared: int):
    """Pairs (i in left, j in right) that this list is the first to hold and whose cosine is high enough."""
    number, local = np.unique(perm, return_inverse=True)
    local = local.reshape(perm.shape)
    earlier = np.where(perm[:, :posted] < which, local[:, :posted], -1)
    need, count = min(shared, perm.shape[1]), len(number)
    found = []
    for s in range(0, len(left), 512):
        rows = left[s : s + 512]
        ok = (_shares(local[rows], local[right], count) >= need) & (_shares(earlier[rows], earlier[right], count) == 0)
        i, j = np.nonzero(ok)
        i, j = rows[i], right[j]
        if same:
            i, j = i[up := i < j], j[up]
        for t in range(0, len(i), 1 << 17):
            a, b = i[t : t + (1 << 17)], j[t : t + (1 << 17)]
            good = np.einsum("ij,ij->i", x[a], x[b]) >= least
            found.append(np.stack([a[good], b[good]]))
    return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)


def link(postings: DataFrame, least: float, posted: dict[int, int], shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """node, n (linked vectors found in a group), other (a link of the group's spanning forest, or null). ``posted``: lists of a vector by length."""
    counts = postings.groupBy("label", "dim", "list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    counts = staged(counts.select(F.col("label").alias("c_label"), F.col("dim").alias("c_dim"), F.col("list").alias("c_list"), "blocks"), "vector-lists")
    n = counts.count()
    rows = postings.join(F.broadcast(counts) if n <= BROADCAST_ROWS else counts, (F.col("label") == F.col("c_label")) & (F.col("dim") == F.col("c_dim")) & (F.col("list") == F.col("c_list")))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    rows = rows.select("list", "label", "dim", "node", "perm", "x", "m", "mine", F.inline(pairs))

    def run(key, table):
        _, which, _, dim, i, j = (k.as_py() for k in key)
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        node, m, mine = (table.column(c).to_numpy()[order] for c in ("node", "m", "mine"))
        perms = table.column("perm").to_pylist()
        xs = table.column("x").to_pylist()
        perm = np.stack([np.frombuffer(perms[k], np.int32) for k in order])
        kind = np.float64 if len(xs[0]) == 8 * dim else np.float32
        x = _unit(np.stack([np.frombuffer(xs[k], kind) for k in order]))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        a, b = join_list(which, perm, x, left, right, i == j, least, posted.get(dim, 1), shared)
        n = np.bincount(a, m[b], len(node)) + np.bincount(b, m[a], len(node))
        use = _forest(a, b, len(node))
        got = np.flatnonzero(n)
        ends = np.r_[np.full(len(got), -1), b[use]]
        return pa.table({
            "node": node[np.r_[got, a[use]].astype(np.int64)], "n": np.r_[n[got].astype(np.int64), np.zeros(use.sum(), np.int64)],
            "other": pa.array(node[ends.astype(np.int64)] if len(ends) else np.zeros(0, np.int64), mask=ends < 0),
        })

    # A key of their own, so that the pairs of blocks of one list are dealt out rather than left where the list was.
    rows = rows.withColumn("group", F.xxhash64("list", "label", "dim", "i", "j"))
    return rows.groupBy("group", "list", "label", "dim", "i", "j").applyInArrow(run, "node long, n long, other long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link within a label only. Null, empty, zero or non-finite vectors and null labels link with nothing
    and are their own component. Repeated rows are vectors of their own that link with each other; with repeated
    ids each row counts. An empty table gives an empty result. The index finds pairs by shared reference points,
    so near the threshold a few may be missed; none below it is reported. A vector of any length is used whole; those
    of another than the usual length meet in a list of their own length.
    """
    rows, classes = _classes(pick(vectors, vec_id=id_col, embedding=vector_col, label=label_col))
    pivots = choose_pivots(classes)
    posted = {dim: reach(len(p))[0] for dim, p in pivots.items()}
    found = staged(link(post(classes, pivots), least, posted), "vector-links")
    parts = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    own = classes.select("node", "m", "least").join(links, "node", "left").join(parts, "node", "left")
    own = own.select("node", "m", "least", "n", F.coalesce("component", "node").alias("part"))
    least_of = own.groupBy(F.col("part").alias("p")).agg(F.min("least").alias("component_id"))
    own = own.join(least_of, F.col("part") == F.col("p")).select(F.col("node").alias("o"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "component_id")
    out = rows.join(own, F.col("node") == F.col("o"), "left")
    part = F.when(F.col("o").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), F.col("vec_id").eqNullSafe(part).alias("kept"))
