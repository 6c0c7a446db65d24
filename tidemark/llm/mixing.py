"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source has a target number of words. A document's expected number of copies is its source's rate times a
weight that falls slowly with its length class, 3 at most; its whole part is taken for certain. The rest is its
inclusion probability p, and documents are ranked by random odds u / (1 - u) over inclusion odds p / (1 - p): the
first of that order are taken until the source's words are spent (a sample of fixed size in words). Only the few
documents round that point are sorted; for all others a histogram of the ranks decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, staged

#: Weights of the sources in order, and the most copies of a document.
WEIGHTS = (1, 2, 3)
MOST = 3
#: Documents for each bin of a source's histogram of ranks, and the most bins.
PER_BIN, MOST_BINS = 256, 1 << 16
#: A document of twice the length gets 2 ** -DAMP times the rate.
DAMP = 0.125
#: Times that the words left over are offered to the next documents that fit.
FILLS = 4
#: Source and length-class rows up to which their table is broadcast (under 20 MB); beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 (52 bits, neither of them) that depends on the parts only; a null counts as empty."""
    text = F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target. Sources in code-point order (null last) weigh 1, 2, 3, repeating.

    A target is level * weight, or MOST times the source's size where that is less; the level makes them add up
    to all words. With sources sorted by the level at which each is full, one running sum finds the level.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("full_at", MOST * F.col("source_size") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("before", MOST * F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("after", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("full", F.coalesce("before", F.lit(0)) + F.col("full_at") * F.col("after") <= F.col("total"))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), MOST * F.col("source_size"))).over(everything), F.lit(0)))
    s = s.withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
    target = F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(F.col("left") * F.col("weight") / F.col("open"))
    return s.select("source", "source_size", target.alias("target"))


def rates(sizes: DataFrame) -> DataFrame:
    """Per source and length class: whole copies, inclusion probability p, and the source's bins and words left."""
    classes = sizes.filter("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    c = classes.join(targets(sizes.select("source", "size")).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    damp = F.pow(F.lit(2.0), -DAMP * F.col("class"))
    mine = Window.partitionBy("source")
    shorter = mine.orderBy("class")  # the shorter, the higher the rate: those reach MOST first
    c = c.withColumn("damp", damp)
    c = c.withColumn("before", MOST * F.coalesce(F.sum("words").over(shorter.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("after", F.sum(F.col("damp") * F.col("words")).over(shorter.rowsBetween(0, Window.unboundedFollowing)))
    c = c.withColumn("full", F.col("before") + MOST / F.col("damp") * F.col("after") <= F.col("target") * (1 + 1e-12))
    c = c.withColumn("left", F.col("target") - F.coalesce(F.sum(F.when(F.col("full"), MOST * F.col("words"))).over(mine), F.lit(0)))
    c = c.withColumn("open", F.sum(F.when(~F.col("full"), F.col("damp") * F.col("words"))).over(mine))
    copies = F.when(F.col("full"), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.col("left") * F.col("damp") / F.col("open")))
    c = c.withColumn("copies", copies)
    c = c.withColumn("whole", F.floor(F.col("copies") + 1e-9))
    c = c.withColumn("p", F.when(F.col("copies") - F.col("whole") > 1e-9, F.least(F.col("copies") - F.col("whole"), F.lit(1 - 1e-9))).otherwise(0.0))
    c = c.withColumn("room", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(mine))
    bins = F.greatest(F.lit(1), F.least(F.lit(MOST_BINS), F.floor(F.sum("docs").over(mine) / PER_BIN)))
    return c.select("source", "class", "whole", "p", "room", bins.alias("bins"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", *, text_col: str = "text", size_col: str | None = None, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` (all columns) with _size, _source_size, _target and _copies (0 to 3; some may be 0).

    The size is the number of words of ``text_col``, or ``size_col``. Sizes of null or empty texts are 0 and so
    are their copies. A null source is a source, the last. Repeated rows are documents like others. The random
    numbers come from id, size and seed, so reruns agree; equal ranks sort by size, id and a hash of the row, so only rows
    equal in all columns are interchangeable. Long texts only count. An empty table gives an empty
    result. Words taken of a source never exceed its target, and fall short by less than the shortest document
    that was offered the words left over and didn't fit.
    """
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    raw = docs.toDF(*at.values())
    raw = raw.withColumn("size", F.col(at[size_col]) if size_col else word_count(F.col(at[text_col])))
    keyed = raw.withColumns({
        "class": F.when(F.col("size") > 0, F.length(F.bin("size")) - 1).otherwise(-1).cast("int"),
        "u": uniform(F.lit(seed), F.col(at[id_col]), F.col("size")),
    })
    slim = staged(keyed.select(F.col(at[source_col]).alias("source"), "size", "class", "u"), "mix-sizes")
    table = staged(rates(slim), "mix-rates")
    few = table.count() <= BROADCAST_ROWS

    def rated(df: DataFrame, source: str) -> DataFrame:
        t = table.select(*[F.col(c).alias(f"r_{c}") for c in table.columns])
        df = df.join(F.broadcast(t) if few else t, F.col(source).eqNullSafe(F.col("r_source")) & (F.col("class") == F.col("r_class")), "left")
        odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("r_p")) / F.col("r_p")
        rank = F.when(F.col("r_p") > 0, odds / (1 + odds))
        df = df.withColumn("rank", rank)
        return df.withColumn("bin", F.when(F.col("rank").isNotNull(), F.least(F.floor(F.col("rank") * F.col("r_bins")), F.col("r_bins") - 1)))

    # The bin of each source in which its words run out, and the words before it.
    sums = rated(slim, "source").filter("bin is not null").groupBy("source", "bin", "r_room").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    cut = sums.filter("upto > r_room").groupBy("source").agg(F.min("bin").alias("at"), F.min("upto").alias("upto"), F.min_by("words", "bin").alias("words"))
    cut = staged(cut.select(F.col("source").alias("k_source"), F.col("at").alias("k_at"), (F.col("upto") - F.col("words")).alias("k_before")), "mix-cuts")
    full = rated(keyed, at[source_col])
    full = full.join(F.broadcast(cut) if few else cut, F.col(at[source_col]).eqNullSafe(F.col("k_source")), "left")
    at_cut = F.coalesce(F.col("bin") == F.col("k_at"), F.lit(False))
    sure = full.filter(~at_cut).withColumn("extra", F.when(F.col("bin").isNotNull() & (F.col("k_at").isNull() | (F.col("bin") < F.col("k_at"))), 1).otherwise(0))
    near = full.filter(at_cut).withColumn("room", F.col("r_room") - F.col("k_before")).withColumn("extra", F.lit(0))
    hashed = [f.name for f in raw.schema if not re.search("map<|variant", f.dataType.simpleString())]  # those have no order
    near = near.withColumn("tie", F.xxhash64(*hashed))
    mine = Window.partitionBy(at[source_col])
    for _ in range(FILLS):
        fits = (F.col("extra") == 0) & (F.col("size") <= F.col("room"))
        near = near.withColumn("offer", F.when(fits, F.col("size")).otherwise(0))
        near = near.withColumn("run", F.sum("offer").over(mine.orderBy("rank", "size", at[id_col], "tie").rowsBetween(Window.unboundedPreceding, 0)))
        near = near.withColumn("extra", F.when(fits & (F.col("run") <= F.col("room")), 1).otherwise(F.col("extra")))
        near = near.withColumn("room", F.col("r_room") - F.col("k_before") - F.sum(F.col("extra") * F.col("size")).over(mine))
    done = sure.select(*raw.columns, "r_whole", "extra").union(near.select(*raw.columns, "r_whole", "extra"))
    # A document without words has no class, so these come by source.
    shown = targets(slim).select(F.col("source").alias("q_source"), F.col("source_size").alias("q_size"), F.col("target").alias("q_target"))
    shown = staged(shown, "mix-targets") if few else shown
    done = done.join(F.broadcast(shown) if few else shown, F.col(at[source_col]).eqNullSafe(F.col("q_source")), "left")
    return done.select(
        *[F.col(at[c]).alias(c) for c in names],
        F.col("size").alias("_size"),
        F.col("q_size").alias("_source_size"),
        F.col("q_target").alias("_target"),
        F.when(F.col("size") > 0, F.coalesce("r_whole", F.lit(0)) + F.col("extra")).otherwise(0).cast("long").alias("_copies"),
    )


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as mix() takes it, with the same columns."""
    mixed = mix(docs, id_col, source_col, **how)
    n = len(docs.columns)
    flat = mixed.toDF(*[f"c{i}" for i in range(n)], "size", "source_size", "target", "copies").filter("copies > 0")
    flat = flat.select(*[f"c{i}" for i in range(n)], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return flat.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that mix() takes of each document."""
    sized = pick(docs, doc_id="doc_id", source="source", text="text").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    m = mix(staged(sized, "sizes"), size_col="size")
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))
