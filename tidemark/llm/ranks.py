"""Numbering rows within groups by ranges, so that no group has to fit in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows of (range, group) up to which their table is broadcast (under 64 MB for keys of 200 bytes); beyond it the join shuffles.
BROADCAST_HEADS = 250_000
_ROW_BITS = 33  # of monotonically_increasing_id(): the row's place in its partition; the partition stands above


def numbered(df: DataFrame, group: list[str], order: list[str], out: str = "index", name: str = "numbered") -> DataFrame:
    """``df`` with each row's number from 0 within its group (null is a group), in a given order, null first.

    Rows are dealt out by ranges of group and order, so a hot group covers many ranges; in a range the sorted rows
    number themselves, and a small table of (range, group) has where a group begins there and how many of its rows
    earlier ranges hold. Rows equal in ``order`` get different numbers; name a column that differs to make them repeatable.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = staged(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", at), name)
    dealt = dealt.withColumn("_part", F.shiftrightunsigned("_at", _ROW_BITS)).withColumn("_at", F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1))
    heads = dealt.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    before = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_before")
    heads = staged(heads.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], before), f"{name}-heads")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    few = heads.count() <= BROADCAST_HEADS
    return dealt.join(F.broadcast(heads) if few else heads, same).select(*df.columns, (F.col("_at") + F.col("_before")).alias(out))
