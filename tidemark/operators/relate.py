"""Lookups, positional joins, dense domains, sets and replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of running_sums()' offsets that are broadcast at most.
SENT = 200_000


def lookup_zero_fill(dim: DataFrame, key: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """Each row of the dimension with n, the facts of its key, 0 where there are none. Facts are counted before the join."""
    counts = facts.groupBy(F.col(fact_key).alias("_k")).agg(F.count("*").alias("_n"))
    return dim.join(counts, F.col(key) == F.col("_k"), "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_k", "_n")


def strict_lookup(df: DataFrame, column: str, dim: DataFrame, dim_key: str, values: list[str]) -> DataFrame:
    """Inner join on the case-folded key."""
    d = dim.select(F.lower(dim_key).alias("_k"), *values)
    return df.join(d, F.lower(column) == F.col("_k")).drop("_k")


def lookup_audit(df: DataFrame, column: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """Keys of ``df`` that the dimension lacks, with their number of rows."""
    d = dim.select(F.lower(dim_key).alias("_k"))
    return df.join(d, F.lower(column) == F.col("_k"), "left_anti").groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among those already processed."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def row_index(df: DataFrame, *order: Column | str, out: str = "row_index", partitions: int | None = None) -> DataFrame:
    """Number all rows from 0 in a given order, without sorting them in one task.

    Rows are dealt out by range and numbered in each range; the ranges' counts, one row each, give the offsets.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))  # one row a range, whatever the table's size
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    return local.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn(out, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_p", "_at", "_before")


def running_sum(df: DataFrame, value: str, *order: Column | str, out: str = "running") -> DataFrame:
    """The sum of a column over all rows up to each one in a given order, by ranges and their totals as in row_index()."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    local = dealt.withColumn("_sum", F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = dealt.groupBy("_part").agg(F.sum(value).alias("_total"))  # one row a range
    before = F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(F.col("_part").alias("_p"), before.alias("_before"))
    return local.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn(out, F.col("_before") + F.col("_sum")).drop("_part", "_p", "_sum", "_before")


def running_sums(df: DataFrame, values: dict[str, Column], group: list[str], *order: Column | str) -> DataFrame:
    """``df`` with a running sum of each of ``values`` within its group (null is one), up to each row in a given order.

    Rows are dealt out by ranges of group and order, so that a large group isn't one task; sums of the ranges, a row for each
    range and group in it, go before them. Up to SENT of these are broadcast, so that the rows aren't shuffled once more.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    dealt = cut(df.repartitionByRange(n, *[F.col(c) for c in group], *order).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({k: F.sum(f"_v_{k}").over(upto) for k in values})
    totals = cut(dealt.groupBy("_part", *group).agg(*[F.sum(f"_v_{k}").alias(k) for k in values]))
    before = Window.partitionBy(*group, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    names = {c: f"_g{i}" for i, c in enumerate(group)}
    offsets = totals.select(F.col("_part").alias("_p"), *[F.col(c).alias(g) for c, g in names.items()], *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_b_{k}") for k in values])
    same = F.col("_part") == F.col("_p")
    for c, g in names.items():
        same = same & F.col(c).eqNullSafe(F.col(g))
    out = local.join(F.broadcast(offsets) if totals.count() <= SENT else offsets, same).withColumns({k: F.col(k) + F.col(f"_b_{k}") for k in values})
    return out.drop("_part", "_p", *names.values(), *[f"{x}{k}" for k in values for x in ("_v_", "_b_")])


def positional_zip(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of two tables side by side by their place in a given order, as far as the shorter goes."""
    x, y = row_index(a, order_a, out="_i"), row_index(b, order_b, out="_j")
    return x.join(y, F.col("_i") == F.col("_j")).drop("_i", "_j")


def dense_domain(df: DataFrame, column: str) -> DataFrame:
    """value, n for each whole number from the least to the largest value."""
    v = F.col(column).cast("long")
    ends = df.agg(F.min(v).alias("a"), F.max(v).alias("b")).filter("a is not null")
    domain = ends.select(F.explode(F.sequence("a", "b")).alias("value"))
    counts = df.groupBy(v.alias("v")).agg(F.count("*").alias("c"))
    return domain.join(counts, F.col("value") == F.col("v"), "left").select("value", F.coalesce("c", F.lit(0)).alias("n"))


def oversample(df: DataFrame, rare: Column, extra_copies: int) -> DataFrame:
    """Rows for which ``rare`` holds come 1 + extra_copies times; copy numbers them from 0."""
    times = F.when(rare, F.lit(extra_copies)).otherwise(F.lit(0))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), times)))


def close_pairs(df: DataFrame, key: str, x: str, y: str, eps: float) -> DataFrame:
    """a < b of points within ``eps``: points meet in square cells, each in its own and the eight round it."""
    cell = lambda c: F.floor(F.col(c) / eps)
    own = df.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), cell(x).alias("i"), cell(y).alias("j"))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = df.select(F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), F.explode(F.transform(step, lambda d: cell(x) + d)).alias("i"), cell(y).alias("cj"))
    near = near.select("b", "bx", "by", "i", F.explode(F.transform(step, lambda d: F.col("cj") + d)).alias("j"))
    d2 = F.pow(F.col("ax") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("ay") - F.col("by"), F.lit(2.0))
    return own.join(near, ["i", "j"]).filter((F.col("a") < F.col("b")) & (d2 <= eps * eps)).select("a", "b", F.sqrt(d2).alias("distance"))


def set_algebra(a: Column, b: Column) -> list[Column]:
    return [F.array_sort(F.array_intersect(a, b)).alias("both"), F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_union(a, b)).alias("either")]
