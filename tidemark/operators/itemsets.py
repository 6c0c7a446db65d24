"""Frequent itemsets and association rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .relate import row_index


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """basket, items: the sorted distinct items of each basket."""
    return df.filter(F.col(item).isNotNull()).groupBy(F.col(basket).alias("basket")).agg(F.array_sort(F.collect_set(item)).alias("items"))


def order_by_frequency(b: DataFrame) -> DataFrame:
    """The baskets with items from the most to the least frequent (ties by item)."""
    rows = b.select("basket", F.explode("items").alias("item"))
    freq = rows.groupBy(F.col("item").alias("_i")).agg(F.count("*").alias("_n"))
    pairs = rows.join(freq, F.col("item") == F.col("_i")).groupBy("basket").agg(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "item"))).alias("s"))
    return pairs.select("basket", F.transform("s", lambda x: x["item"]).alias("items"))


def _candidates(level: DataFrame, k: int) -> DataFrame:
    """items: sets of k + 1 ranks from frequent sets of k with the same prefix, all of whose subsets are frequent."""
    prefix = lambda c: F.slice(c, 1, k - 1) if k > 1 else F.array()
    a = level.select(F.col("items").alias("a"), prefix(F.col("items")).cast("array<int>").alias("p"))
    z = level.select(F.element_at("items", -1).alias("last"), prefix(F.col("items")).cast("array<int>").alias("p"))
    cand = a.join(z, "p").filter(F.element_at("a", -1) < F.col("last")).select(F.array_append("a", F.col("last")).alias("items"))
    if k == 1:
        return cand
    subsets = cand.select("items", F.explode(F.transform(F.col("items"), lambda x: F.array_remove(F.col("items"), x))).alias("s"))
    return subsets.join(level.select(F.col("items").alias("s")), "s", "left_semi").groupBy("items").agg(F.count("*").alias("c")).filter(F.col("c") == k + 1).select("items")


def _named(sets: DataFrame, names: DataFrame) -> DataFrame:
    """Ranks back to items, sorted."""
    named = sets.select("items", "n", F.explode("items").alias("r")).join(names.select("item", "r"), "r")
    return named.groupBy("items", "n").agg(F.array_sort(F.collect_list("item")).alias("named")).select(F.col("named").alias("items"), "n")


def apriori(b: DataFrame, least: int, longest: int | None = None) -> DataFrame:
    """items, n: every itemset in at least ``least`` baskets, level by level until one has fewer than two, or to
    ``longest`` items.

    Items become ranks, the rarest first, and baskets shrink to the frequent ones. Candidates of a level come from
    pairs with the same prefix, and only those all of whose subsets are frequent are counted, with one join on the
    candidate's rarest item, so that a basket meets few candidates through a frequent item.
    """
    rows = b.select("basket", F.explode("items").alias("item"))
    frequent = rows.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    names = cut(row_index(frequent, "n", "item", out="_r").select("item", "n", F.col("_r").cast("int").alias("r")))
    level = names.select(F.array("r").alias("items"), "n")
    slim = cut(rows.join(names.select("item", "r"), "item").groupBy("basket").agg(F.array_sort(F.collect_set("r")).alias("items")))
    out, k = level, 1
    while (longest is None or k < longest) and level.count() > 1:
        cand = _candidates(level, k)
        cand = cand.select("items", F.col("items")[0].alias("item"))
        holds = slim.filter(F.size("items") > k).select(F.col("items").alias("have"), F.explode("items").alias("item"))
        hit = holds.join(cand, "item").filter(F.size(F.array_except("items", "have")) == 0)
        level = cut(hit.groupBy("items").agg(F.count("*").alias("n")).filter(F.col("n") >= least))
        out, k = out.unionByName(level), k + 1
    return _named(out, names)


#: Baskets of a range, and the most of them that a list of places holds in less room than a bitmap.
RANGE, SPARSE = 1 << 16, 1 << 12


def pack_tids(places: np.ndarray) -> bytes:
    """Sorted places in a range: 16 bits each, or from SPARSE on a bit for every place of the range."""
    if len(places) <= SPARSE:
        return b"\0" + places.astype("<u2").tobytes()
    bits = np.zeros(RANGE, bool)
    bits[places] = True
    return b"\1" + np.packbits(bits).tobytes()


def unpack_tids(packed: bytes) -> np.ndarray:
    if packed[0] == 0:
        return np.frombuffer(packed, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1)))


def meet_tids(a: bytes, b: bytes) -> tuple[bytes, int]:
    """What two sets have in common, and how many."""
    if a[0] and b[0]:
        both = np.frombuffer(a, np.uint8, offset=1) & np.frombuffer(b, np.uint8, offset=1)
        n = int(np.bitwise_count(both).sum())
        return (b"\1" + both.tobytes(), n) if n > SPARSE else (pack_tids(np.flatnonzero(np.unpackbits(both))), n)
    if a[0]:
        a, b = b, a
    x = unpack_tids(a)
    if b[0]:
        common = x[(np.frombuffer(b, np.uint8, offset=1)[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1]
    else:
        common = np.intersect1d(x, unpack_tids(b), assume_unique=True)
    return pack_tids(common), len(common)


def tid_sets(b: DataFrame) -> DataFrame:
    """item, range, tids, n: for each item and range of RANGE baskets, numbered in order, the baskets that hold it, packed.

    A row has 8 KB at most, however frequent its item.
    """
    numbered = row_index(b, "basket", out="_tid")
    places = numbered.select(F.explode("items").alias("item"), F.floor(F.col("_tid") / RANGE).cast("int").alias("range"), (F.col("_tid") % RANGE).cast("int").alias("place"))
    lists = places.groupBy("item", "range").agg(F.array_sort(F.collect_list("place")).alias("places"))

    def run(batches):
        for batch in batches:
            lists = [np.array(x, np.int64) for x in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("range"), pa.array([pack_tids(x) for x in lists], pa.binary()), pa.array([len(x) for x in lists], pa.int64())], names=["item", "range", "tids", "n"])

    kind = lists.schema["item"].dataType.simpleString()
    return lists.mapInArrow(run, f"item {kind}, range int, tids binary, n long")


def vertical(b: DataFrame, least: int, longest: int | None = None) -> DataFrame:
    """items, n: the itemsets of apriori(), found by intersecting the basket sets of two sets that differ in the last item.

    Candidates never meet baskets: a set of k + 1 items joins those of its two parts range by range, and only the
    packed sets that remain frequent go on to the next level.
    """
    sets = cut(tid_sets(b))
    frequent = sets.groupBy("item").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    names = cut(row_index(frequent, "n", "item", out="_r").select("item", "n", F.col("_r").cast("int").alias("r")))
    level = names.select(F.array("r").alias("items"), "n")
    held = cut(sets.join(names.select("item", "r"), "item").select(F.array("r").alias("items"), "range", "tids"))
    out, k = level, 1

    def run(batches):
        for batch in batches:
            met = [meet_tids(x, y) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
            kept = pa.array([n > 0 for _, n in met], pa.bool_())
            whole = pa.RecordBatch.from_arrays([batch.column("items"), batch.column("range"), pa.array([x for x, _ in met], pa.binary()), pa.array([n for _, n in met], pa.int64())], names=["items", "range", "tids", "n"])
            yield whole.filter(kept)

    while (longest is None or k < longest) and level.count() > 1:
        cand = _candidates(level, k)
        parts = cand.select("items", F.slice("items", 1, k).alias("a"), F.concat(F.slice("items", 1, k - 1), F.slice("items", k + 1, 1)).alias("z") if k > 1 else F.slice("items", 2, 1).alias("z"))
        left = parts.join(held.select(F.col("items").alias("a"), "range", F.col("tids").alias("left")), "a")
        both = left.join(held.select(F.col("items").alias("z"), "range", F.col("tids").alias("right")), ["z", "range"]).select("items", "range", "left", "right")
        met = cut(both.mapInArrow(run, "items array<int>, range int, tids binary, n long"))
        level = cut(met.groupBy("items").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
        held = met.drop("n").join(level.select("items"), "items", "left_semi")
        out, k = out.unionByName(level), k + 1
    return _named(out, names)


def fp_growth(b: DataFrame, least: int, n_baskets: int) -> DataFrame:
    """items, n by MLlib's parallel FP-growth; the same itemsets as apriori()."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n_baskets), minConfidence=1.0).fit(b)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n"))


def rules(itemsets: DataFrame, n_baskets: int, min_confidence: float = 0.0, min_lift: float = 0.0) -> DataFrame:
    """Rules with any split of an itemset into antecedent and consequent, and their measures.

    support, confidence, lift, leverage, conviction (null where infinite) and Zhang's metric.
    """
    total = F.lit(float(n_baskets))
    sets = itemsets.filter(F.size("items") > 1)
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size("items")) - 2).cast("int"))
    pick = lambda on: F.filter("items", lambda x, i: F.getbit(F.col("m"), i) == on)
    split = sets.select("items", F.col("n").alias("nxy"), F.explode(masks).alias("m")).select("nxy", pick(1).alias("antecedent"), pick(0).alias("consequent"))
    one = itemsets.select(F.col("items").alias("antecedent"), F.col("n").alias("nx"))
    two = itemsets.select(F.col("items").alias("consequent"), F.col("n").alias("ny"))
    r = split.join(one, "antecedent").join(two, "consequent")
    s, x, y = F.col("nxy") / total, F.col("nx") / total, F.col("ny") / total
    conf = F.col("nxy") / F.col("nx")
    lev = s - x * y
    zhang = lev / F.nullif(F.greatest(s * (1 - x), x * (y - s)), F.lit(0.0))
    r = r.select("antecedent", "consequent", s.alias("support"), x.alias("antecedent_support"), y.alias("consequent_support"), conf.alias("confidence"), (conf / y).alias("lift"), lev.alias("leverage"), F.when(conf < 1, (1 - y) / F.nullif(1 - conf, F.lit(0.0))).alias("conviction"), zhang.alias("zhang"))
    return r.filter((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
