"""N-gram Jaccard join with signature trees, complete for every link between different texts.

1. Every text becomes a set of hashed word shingles; equal sets are one class. Hashes order all shingles alike.
2. Two sets with Jaccard J share many of their first shingles. Shingles of these prefixes meet by hash in buckets;
   a text too few of whose prefix shingles occur in another text can't have a partner and leaves. (A shingle that
   occurs twice in one batch of texts is known as shared there and is sent on once, so frequent passages are cheap.)
3. Of the rest, texts with a common minimum of a permutation are compared with the least such text. Links found
   so join most near copies into components, with a few comparisons for each text.
4. What remains is a partner in another component with a common prefix shingle, the frequent shingles being last in
   order. Texts that share such shingles form groups, one for each least component among them, and a signature tree
   is built over a group: leaves and inner nodes hold OR-combined bitmaps of shingles, ranges of set sizes and the
   component if it is one. A dual traversal drops node pairs whose largest possible overlap is too small, or that
   are one component already; pairs of texts that are left are verified on whole sets, unless links found meanwhile
   join their components. So a group yields fewer links than it has components, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, pick, small_batches, staged, text_steps
from .components import components

#: Shingle length; two sets link when DEN * overlap >= NUM * (sum of sizes), which is J >= 0.8.
WORDS, NUM, DEN = 5, 4, 9
#: Permutations for the first links; least and most bits of a signature; texts in a leaf and children of a node.
PERMUTATIONS, LEAST_BITS, MOST_BITS, LEAF, FAN = 4, 1024, 16384, 32, 8
#: The most frequent prefix shingles, which come last in order: so many at most, each in so many texts of a bucket.
MOST_FREQUENT, FREQUENT = 1_000_000, 32
#: Rows (up to 32 bytes each) and single keys (8 bytes) up to which a table is broadcast; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_KEYS = 250_000, 4_000_000
#: Prefix shingles in a bucket, about; texts and shingles in a block of a large group; shingles that one task takes at
#: a time, about.
PER_BUCKET, BLOCK, BLOCK_SHINGLES, PER_TASK = 1_000_000, 2048, 1_000_000, 2_000_000
#: Buckets grow with the text, to 2 ** 30 (16 petabytes), where a bucket and 32 more bits leave two bits of a hash.
MOST_BUCKET_BITS = 30
#: Texts that are dealt to a place beside their leader's set.
PER_PLACE = 64
#: Text bytes that are hashed at a time.
STEP_BYTES = 2 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_C = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], known: _Hashes) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles (all words as one if they are too few)."""
    words = [t.translate(_LOWER).split() for t in texts]
    flat = np.fromiter((known[w] for ws in words for w in ws), np.uint64, sum(map(len, words)))
    n = len(flat)
    run = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        run = run * _C + flat[k : k + len(run)]
    run, out, at = _mix(run), [], 0
    for ws in words:
        if len(ws) >= WORDS:
            out.append(np.unique(run[at : at + len(ws) - WORDS + 1]))
        elif ws:
            h = np.array([len(ws)], np.uint64)
            for k in range(len(ws)):
                h = h * _C + flat[at + k : at + k + 1]
            out.append(_mix(h + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(ws)
    return out


def class_of(s: np.ndarray) -> int:
    """A number that stands for the set."""
    return int(_mix(np.array([_mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0].astype(np.int64))


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares with any partner at the least: ceil(0.8 n)."""
    return -(-4 * n // 5)


def extra(n: int) -> int:
    """How many common shingles the prefixes of step 2 are made to show."""
    return max(1, n // 5)


def prefix_length(n: int, show: int = 1) -> int:
    """So many first shingles of a set of n have ``show`` in common with those of any partner that shows as many."""
    return min(n, n - least_overlap(n) + show)


_FIRST = "doc_id {}, key long, n long, node long, bucket int, tok binary, owner binary, short long, shared long"
#: Classes are told apart by so many bits in the buckets; a class that shares them with its only partner would be lost
#: once in 2 ** 40 pairs. The last number stands for several classes of a batch.
SHORT_BITS = 40
SEVERAL = (1 << SHORT_BITS) - 1


def _pack(owner: np.ndarray) -> bytes:
    return owner.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<i8").ravel()


def first_pass(docs: DataFrame, buckets: int) -> DataFrame:
    """Three kinds of rows: of each text (key, n, node); of each bucket of a batch (tok, owner); of classes with
    shingles that several classes of the batch have (short, shared)."""
    names = [c.split()[0] for c in _FIRST.split(", ")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    mask, bits = np.uint64(buckets - 1), np.uint64(_bits(buckets))

    def table(ids, **cols):
        n = len(next(iter(cols.values())))
        types = {"bucket": pa.int32(), "tok": pa.binary(), "owner": pa.binary()}
        made = {"doc_id": ids if "key" in cols else pa.nulls(n, ids.type)}
        made |= {c: pa.array(cols[c], types.get(c, pa.int64())) if c in cols else pa.nulls(n, types.get(c, pa.int64())) for c in names[1:]}
        return pa.RecordBatch.from_arrays([made[c] for c in names], names=names)

    def run(batches):
        known = _Hashes()
        for batch in batches:
            for part, texts in text_steps(batch, STEP_BYTES):
                sets = shingle_sets(texts, known)
                node = [class_of(s) if len(s) else None for s in sets]
                ids = part.column("doc_id")
                yield table(ids, key=part.column("key"), n=[len(s) for s in sets], node=node)
                distinct = list({v: s for v, s in zip(node, sets, strict=True) if v is not None}.items())
                if not distinct:
                    continue
                short = np.array([v & SEVERAL for v, _ in distinct], np.int64)
                cut = [prefix_length(len(s), extra(len(s))) for _, s in distinct]
                tok = np.concatenate([s[:k] for (_, s), k in zip(distinct, cut, strict=True)])
                owner = np.repeat(np.arange(len(distinct)), cut)
                order = np.argsort(tok, kind="stable")
                tok, owner = tok[order], owner[order]
                new = np.r_[True, tok[1:] != tok[:-1]]
                group = np.cumsum(new) - 1
                twice = np.bincount(group)[group] > 1
                shared = np.bincount(owner[twice], minlength=len(distinct))
                hit = np.flatnonzero(shared)
                yield table(ids, short=short[hit], shared=shared[hit])
                owner, tok = np.where(twice, SEVERAL, short[owner])[new], tok[new]
                b = (tok & mask).astype(np.int64)
                order = np.argsort(b, kind="stable")
                tok, owner, b = (tok[order] >> bits).astype(np.uint32), owner[order], b[order]
                full, start = np.unique(b, return_index=True)
                edges = [*start.tolist(), len(b)]
                yield table(ids, bucket=full, tok=[tok[x:y].tobytes() for x, y in zip(edges, edges[1:], strict=False)], owner=[_pack(owner[x:y]) for x, y in zip(edges, edges[1:], strict=False)])

    return docs.mapInArrow(run, _FIRST.format(kind))


def meet(first: DataFrame, buckets: int) -> DataFrame:
    """In each bucket, how many prefix shingles of a class another one has: short, shared; or token, times of frequent ones."""
    bits = _bits(buckets)

    def run(key, table):
        tok = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("tok").to_pylist()])
        short = np.concatenate([_unpack(x) for x in table.column("owner").to_pylist()])
        order = np.lexsort((short, tok))
        tok, short = tok[order], short[order]
        keep = np.r_[True, (tok[1:] != tok[:-1]) | (short[1:] != short[:-1]) | (short[1:] == SEVERAL)]  # copies in other batches
        tok, short = tok[keep], short[keep]
        new = np.r_[True, tok[1:] != tok[:-1]]
        group = np.cumsum(new) - 1
        times = np.bincount(group, np.where(short == SEVERAL, 2, 1)).astype(np.int64)
        v, n = np.unique(short[(times[group] > 1) & (short != SEVERAL)], return_counts=True)
        often = np.flatnonzero(times >= FREQUENT)
        bucket, none = key[0].as_py(), np.zeros(len(often), np.int64)
        give_back()
        return pa.table({
            "short": pa.array(np.r_[v, none], mask=np.r_[np.zeros(len(v), bool), np.ones(len(often), bool)]), "shared": np.r_[n, none],
            "token": np.r_[np.zeros(len(v), np.int64), (tok[new][often].astype(np.int64) << bits) | bucket], "times": np.r_[np.zeros(len(v), np.int64), times[often]],
        })

    return first.filter("bucket is not null").select("bucket", "tok", "owner").groupBy("bucket").applyInArrow(run, "short long, shared long, token long, times long")


def _bits(buckets: int) -> int:
    return buckets.bit_length() - 1


def _tokens(s: np.ndarray, buckets: int) -> np.ndarray:
    """The short form of shingles that meet() gives its frequent ones in: the bucket's bits and 32 more."""
    return (s & np.uint64((buckets << 32) - 1)).astype(np.int64)


def whole_sets(docs: DataFrame) -> DataFrame:
    """node, n, set (sorted hashes), minima of rows (text)."""
    mult = [np.uint64(2 * x + 1) for x in range(0x51ED27, 0x51ED27 + PERMUTATIONS)]

    def run(batches):
        known = _Hashes()
        for batch in batches:
            for _, texts in text_steps(batch, STEP_BYTES):
                sets = [s for s in shingle_sets(texts, known) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([[int(_mix(s * m).min().astype(np.int64)) for m in mult] for s in sets], pa.list_(pa.int64()))],
                    names=["node", "n", "set", "minima"],
                )

    return docs.select("text").mapInArrow(run, "node long, n long, set binary, minima array<long>")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words a set; wide enough for the largest set to leave bits free, within limits."""
    width = LEAST_BITS
    while width < MOST_BITS and width < 2 * max(map(len, sets)):
        width *= 2
    out = np.zeros((len(sets), width // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):
        bits = np.zeros(width, np.uint8)
        bits[(s >> np.uint64(7)) & np.uint64(width - 1)] = 1
        row[:] = np.packbits(bits)
    return out.view(np.uint64)


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= (BROADCAST_KEYS if len(df.columns) == 1 else BROADCAST_ROWS) else df


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose whole sets link.

    The sets of the many a's travel to the set of their b, which comes first and is the only one kept in memory;
    a b with very many a's is dealt out over several places.
    """
    pairs = staged(pairs, "jaccard-pairs")
    places = pairs.groupBy("b").agg(F.ceil(F.count("*") / PER_PLACE).cast("int").alias("places"))
    left = pairs.join(places, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("places")).cast("int").alias("place"))
    right = places.select("b", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    wanted = staged(left.select(F.col("a").alias("v"), "b", "place", F.lit(1).alias("turn")).unionByName(right.select(F.col("b").alias("v"), "b", "place", F.lit(0).alias("turn"))), "jaccard-wanted")
    rows = sets.select("node", "set").join(_near(wanted, wanted.count()), F.col("node") == F.col("v"))

    def run(batches):
        now, held = None, None
        for batch in batches:
            out = []
            for v, b, turn, s in zip(*(batch.column(c).to_pylist() for c in ("v", "b", "turn", "set")), strict=True):
                if turn == 0:
                    now, held = b, np.frombuffer(s, np.uint64)
                elif now == b:
                    if linked(held, np.frombuffer(s, np.uint64)):
                        out.append((v, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    dealt = rows.select("v", "b", "place", "turn", "set").repartition("b", "place").sortWithinPartitions("b", "place", "turn")
    return dealt.mapInArrow(run, "a long, b long")


def first_links(sets: DataFrame) -> DataFrame:
    """Links of texts to the least text with the same minimum of a permutation."""
    minima = sets.select("node", F.posexplode("minima").alias("k", "minimum"))
    least = staged(minima.groupBy("k", "minimum").agg(F.min("node").alias("b"), F.count("*").alias("c")).filter("c > 1"), "jaccard-least")
    pairs = minima.join(_near(least, least.count()), ["k", "minimum"]).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return verify(pairs, sets)


class Tree:
    """A signature tree over texts sorted by size: levels from the leaves to the root."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, label: np.ndarray):
        pop = np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = []
        low, high, slack, one, same = sizes, sizes, sizes - pop, label, np.ones(len(label), bool)
        width = LEAF
        while True:
            at = np.arange(0, len(low), width)
            # A parent is one component if its children are and agree; a mixed only child gives it no component.
            same = np.logical_and.reduceat(same, at) & (np.minimum.reduceat(one, at) == np.maximum.reduceat(one, at))
            bits = np.bitwise_or.reduceat(bits, at, axis=0)
            low, high, slack, one = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), np.where(same, one[at], np.arange(len(at)) - (1 << 62))
            self.levels.append((bits, low, high, slack, one, same))
            width = FAN
            if len(at) == 1:
                break


def may_link(low_a, high_a, slack_a, low_b, high_b, slack_b, common):
    """Whether sets in these size ranges can link. slack: the most shingles of a set beyond its bits; each bit of a
    set that the other side lacks stands for a shingle that the other side lacks."""
    return (5 * high_a >= 4 * low_b) & (5 * high_b >= 4 * low_a) & (DEN * (np.minimum(slack_a, slack_b) + common) >= NUM * (low_a + low_b))


def tree_join(sizes: np.ndarray, bits: np.ndarray, label: np.ndarray, side: np.ndarray | None = None):
    """Arrays of pairs (i, j) of texts with different labels that may link, a pair of leaves at a time, the most common
    bits first; with ``side`` only pairs of unlike sides. ``label`` may change meanwhile: equal labels are left out."""
    order = np.lexsort((sizes, label))  # texts of a component are alike in size and bits
    n = sizes[order]
    bits = bits[order]
    tree = Tree(n, bits, label[order])
    slack = n - np.bitwise_count(bits).sum(1, dtype=np.int64)
    a = b = np.zeros(1, np.int64)
    for level in range(len(tree.levels) - 1, -1, -1):
        sig, low, high, most, one, same = tree.levels[level]
        keep = []
        for s in range(0, len(a), 1 << 12):
            x, y = a[s : s + (1 << 12)], b[s : s + (1 << 12)]
            common = np.bitwise_count(sig[x] & sig[y]).sum(1, dtype=np.int64)
            keep.append(may_link(low[x], high[x], most[x], low[y], high[y], most[y], common) & ~(same[x] & same[y] & (one[x] == one[y])))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        a, b = a[keep], b[keep]
        if not level or not len(a):
            break
        below = len(tree.levels[level - 1][1])
        i = (a[:, None] * FAN + np.arange(FAN)).repeat(FAN, 1)
        j = np.tile(b[:, None] * FAN + np.arange(FAN), (1, FAN))
        ok = (i < below) & (j < below) & (i <= j)
        a, b = i[ok], j[ok]
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        i, j = np.arange(p * LEAF, min(len(n), (p + 1) * LEAF)), np.arange(q * LEAF, min(len(n), (q + 1) * LEAF))
        ok = (label[order[i]][:, None] != label[order[j]][None]) & (i[:, None] < j[None])
        if side is not None:
            ok &= side[order[i]][:, None] != side[order[j]][None]
        if not ok.any():
            continue
        common = np.bitwise_count(bits[i][:, None] & bits[j][None]).sum(2, dtype=np.int64)
        ok &= may_link(n[i][:, None], n[i][:, None], slack[i][:, None], n[j][None], n[j][None], slack[j][None], common)
        x, y = np.nonzero(ok)
        best = np.argsort(NUM * (n[i[x]] + n[j[y]]) - DEN * common[x, y], kind="stable")
        yield np.stack([order[i[x[best]]], order[j[y[best]]]], 1)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges the two runs
    return DEN * int((both[1:] == both[:-1]).sum()) >= NUM * len(both)


def join_group(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between texts of different labels that join all the components which the group's links join.

    A link makes its two labels one at once, so later pairs of theirs aren't looked at.
    """
    label, out = label.copy(), []
    for pairs in tree_join(np.array([len(s) for s in sets], np.int64), bitmaps(sets), label, side):
        for i, j in pairs.tolist():
            u, v = label[i], label[j]
            if u != v and linked(sets[i], sets[j]):
                label[label == max(u, v)] = min(u, v)
                out.append((i, j))
    return out


def _deal(some: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """low, node, label, n, mine, i, j: the members (low, node, label, n) of groups in the pairs of blocks they belong to.

    A group of one block is that. A larger one is cut by size first: sets of n and m shingles can't link unless
    4 m <= 5 n, so that classes of sizes in steps of 5 / 4 meet themselves and the next one only. Blocks of a class are
    numbered on from those of the classes below.
    """
    group = some.groupBy(F.col("low").alias("of")).agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_shingles)).cast("int").alias("all"))
    group = staged(group, "jaccard-blocks")
    few = group.count()
    some = some.join(_near(group, few), F.col("low") == F.col("of")).drop("of")
    # A hair more than 5 / 4 a step: two sets that link are never two classes apart.
    step = F.floor(F.log(F.col("n").cast("double")) / (math.log(1.25) + 1e-9)).cast("int")
    some = some.withColumn("c", F.when(F.col("all") > 1, step).otherwise(0))
    large = some.filter(F.col("all") > 1).groupBy("low", "c").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    large = staged(large, "jaccard-classes-of-size")
    # At most 50 classes a group, each a row here.
    mine = Window.partitionBy("low").orderBy("c")
    beside = lambda df: F.when(df == F.col("c") + 1, F.lead("blocks").over(mine))
    large = large.select(
        F.col("low").alias("g"), F.col("c").alias("gc"), "blocks",
        F.coalesce(F.sum("blocks").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("base"),
        F.coalesce(beside(F.lead("c").over(mine)), F.lit(0)).alias("above"),
        F.when(F.lag("c").over(mine) == F.col("c") - 1, F.lag("blocks").over(mine)).otherwise(0).alias("below"),
    )
    large = staged(large, "jaccard-sizes")
    some = some.join(_near(large, large.count()), (F.col("low") == F.col("g")) & (F.col("c") == F.col("gc")) & (F.col("all") > 1), "left")
    base, blocks = F.coalesce("base", F.lit(0)), F.coalesce("blocks", F.lit(1))
    some = some.withColumn("mine", (base + F.pmod(F.xxhash64("node"), blocks)).cast("int"))
    first = base - F.coalesce("below", F.lit(0))
    last = base + blocks + F.coalesce("above", F.lit(0)) - 1
    ij = F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    return some.select("low", "node", "label", "n", "mine", F.inline(ij))


def other_links(sets: DataFrame, parts: DataFrame, frequent: np.ndarray, times: np.ndarray, buckets: int) -> DataFrame:
    """Links between texts of different components, by signature trees over the texts of each prefix shingle."""
    spark = sets.sparkSession
    hot = spark.sparkContext.broadcast((frequent, times))

    def prefixes(batches):
        often, count = hot.value
        for batch in batches:
            node, tok, n = [], [], []
            for v, s in zip(batch.column("node").to_pylist(), batch.column("set").to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint64)
                t = _tokens(s, buckets)
                if len(often):
                    at = np.minimum(np.searchsorted(often, t), len(often) - 1)
                    rank = np.where(often[at] == t, count[at], 0)
                    s = s[np.lexsort((s, rank))]
                s = s[: prefix_length(len(s))]
                tok.append(s.astype(np.int64))
                node.append(np.full(len(s), v, np.int64))
            if tok:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node)), pa.array(np.concatenate(tok))], names=["node", "tok"])

    known = parts.select(F.col("node").alias("p"), "component")
    rows = sets.select("node", "set").mapInArrow(prefixes, "node long, tok long").join(_near(known, known.count()), F.col("node") == F.col("p"), "left")
    rows = staged(rows.select("tok", "node", F.coalesce("component", "node").alias("label")), "jaccard-prefixes")
    groups = rows.groupBy("tok").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    groups = staged(groups.select(F.col("tok").alias("g"), "low"), "jaccard-groups")
    some = rows.join(groups, F.col("tok") == F.col("g")).select("low", "node", "label").distinct()
    some = staged(some.join(sets.select(F.col("node").alias("s"), "n"), F.col("node") == F.col("s")).drop("s"), "jaccard-members")
    some = staged(_deal(some), "jaccard-dealt")
    n, total = some.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    some = some.withColumn("bin", F.pmod(F.xxhash64("low", "i", "j"), F.lit(max(1, total // PER_TASK)))).drop("n")
    some = sets.select("set", F.col("node").alias("s")).join(_near(some, n), F.col("node") == F.col("s")).drop("s")

    def run(key, table):
        low, node, label, i, j, mine = (table.column(c).to_numpy() for c in ("low", "node", "label", "i", "j", "mine"))
        held = table.column("set")
        order = np.lexsort((node, j, i, low))
        same = (low[order][1:] == low[order][:-1]) & (i[order][1:] == i[order][:-1]) & (j[order][1:] == j[order][:-1])
        edges = np.r_[0, np.flatnonzero(~same) + 1, len(order)]
        a, b = [], []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = order[s:e]
            if e - s > 1:
                got = join_group([np.frombuffer(held[int(k)].as_py(), np.uint64) for k in at], label[at], None if i[at[0]] == j[at[0]] else mine[at])
                a += [int(node[at[x]]) for x, _ in got]
                b += [int(node[at[y]]) for _, y in got]
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return some.groupBy("bin").applyInArrow(run, "a long, b long").distinct()


def classify(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n, node) of rows (doc_id, text), and (node, best): of each class, the row (doc_id, key) that
    stands for its component, the least. Texts without shingles have no node."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(6, min(MOST_BUCKET_BITS, math.ceil(math.log2(max(1, size / 15 / PER_BUCKET)))))
    first = staged(first_pass(docs, buckets), "jaccard-first")
    met = staged(meet(first, buckets), "jaccard-met")
    shared = met.filter("short is not null").select("short", "shared").unionByName(first.filter("short is not null").select("short", "shared"))
    shared = shared.groupBy(F.col("short").alias("s")).agg(F.sum("shared").alias("shared"))
    rows = first.filter("key is not null").select("doc_id", "key", "n", "node")
    # One row stands for its class.
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    classes = staged(rows.filter("node is not null").groupBy("node").agg(F.min(row).alias("best"), F.max("n").alias("n")), "jaccard-classes")
    least = F.floor((4 * F.col("n") + 4) / 5)  # least_overlap(n)
    need = F.greatest(F.lit(1), F.floor(least / 5))  # extra(least_overlap(n))
    enough = classes.join(shared, F.col("node").bitwiseAND(F.lit(SEVERAL)) == F.col("s")).filter(F.col("shared") >= need)
    stand = staged(enough.select(F.col("best.key").alias("stand")), "jaccard-stand")
    sets = docs.join(_near(stand, stand.count()), F.col("key") == F.col("stand"), "left_semi")
    sets = staged(whole_sets(sets), "jaccard-sets")
    often = met.filter("times > 0").orderBy(F.desc("times"), "token").limit(MOST_FREQUENT).select("token", "times").toArrow()
    token, times = (often.column(c).to_numpy() for c in ("token", "times"))
    order = np.argsort(token)
    links = staged(first_links(sets), "jaccard-links")
    more = staged(other_links(sets, components(links), token[order], times[order], buckets), "jaccard-more")
    parts = components(links.unionByName(more)).select(F.col("node").alias("p"), "component")
    grown = staged(classes.join(parts, F.col("node") == F.col("p")).select("node", "component", "best"), "jaccard-grown")
    least = grown.groupBy(F.col("component").alias("c")).agg(F.min("best").alias("least"))
    grown = grown.join(least, F.col("component") == F.col("c")).select(F.col("node").alias("p"), "least")
    return rows, classes.join(grown, F.col("node") == F.col("p"), "left").select("node", F.coalesce("least", "best").alias("best"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id that links reach, its own included).

    Null texts and texts without words have no shingles, link with nothing and are their own component. Repeated
    rows are copies of each other; a null id is a document, but no component's least id unless it is alone. An empty
    table gives an empty result.
    """
    rows, best = classify(pick(docs, doc_id=id_col, text=text_col))
    best = best.select(F.col("node").alias("v"), "best")
    rows = rows.join(staged(best, "jaccard-best"), F.col("node") == F.col("v"), "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each component: that of the least id, then key.

    Rows without shingles link with nothing, so all of them stay. Of rows equal in id and text one stays.
    """
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    rows, best = classify(flat.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")))
    best = staged(best.select(F.col("node").alias("v"), F.col("best.key").alias("stays")), "jaccard-best")
    marked = staged(rows.join(best, F.col("node") == F.col("v")).select("key", "stays"), "jaccard-marked")
    gone = staged(marked.filter("key <> stays").select(F.col("key").alias("gone")).distinct(), "jaccard-gone")
    twice = staged(marked.filter("key = stays").groupBy(F.col("key").alias("twice")).count().filter("count > 1").select("twice"), "jaccard-twice")
    keyed = flat.withColumn("key", F.xxhash64(ident, text))
    kept = keyed.join(_near(gone, gone.count()), F.col("key") == F.col("gone"), "left_anti")
    n = twice.count()
    if n:
        again = kept.join(_near(twice, n), F.col("key") == F.col("twice"), "left_semi").dropDuplicates(["key"])
        kept = kept.join(_near(twice, n), F.col("key") == F.col("twice"), "left_anti").unionByName(again)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
