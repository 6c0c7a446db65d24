"""Yearly and daily trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relate import row_index, running_sum


def conditional_sums(df: DataFrame, by: Column, value: str, first: Column) -> DataFrame:
    """Total, the sum where ``first`` holds and that of all others, by a key; null values are skipped."""
    other = ~F.coalesce(first, F.lit(False))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return df.groupBy(by).agg(zero(value).alias("total"), zero(F.when(~other, F.col(value))).alias("first"), zero(F.when(other, F.col(value))).alias("rest"))


def last_row_wins(df: DataFrame, by: Column, column: str, value: str, order_col: str, values: list) -> DataFrame:
    """A row per key and a column per group holding the value of its last row in ``order_col``."""
    return df.groupBy(by).pivot(column, values).agg(F.max_by(value, order_col))


def per_population(df: DataFrame, value: Column, population: Column, per: float = 100_000.0) -> DataFrame:
    return df.withColumn("rate", value / F.nullif(population.cast("double"), F.lit(0.0)) * per)


def daily_change(df: DataFrame, entity: str, day: str, value: str, keep_null: bool = False) -> DataFrame:
    """(next - this) / days between, at the earlier row, not below 0; the last row of an entity has none.

    A missing change counts as 0 unless ``keep_null``.
    """
    w = Window.partitionBy(entity).orderBy(day)
    days = F.datediff(F.lead(day).over(w), F.col(day))
    d = (F.lead(value).over(w) - F.col(value)) / F.nullif(days, F.lit(0))
    change = F.when(d < 0, 0.0).otherwise(d) if keep_null else F.coalesce(F.greatest(F.lit(0.0), d), F.lit(0.0))
    return df.withColumns({"_n": F.lead(day).over(w), "change": change}).filter("_n is not null").drop("_n")


def pareto(freq: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Frequencies (a row a category) from the largest with running total and percent; sorted and summed by range."""
    total = freq.agg(F.sum(n).alias("_total"))
    out = running_sum(freq, n, F.desc(n), key, out="running").crossJoin(F.broadcast(total))
    return out.withColumn("percent", F.round(100.0 * F.col("running") / F.col("_total"), 6)).drop("_total")


def relabel_by_size(df: DataFrame, label: str, out: str = "new_label") -> DataFrame:
    """Labels 0, 1, ... from the largest group to the smallest (ties by label)."""
    sizes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    new = row_index(sizes, F.desc("_n"), "_l", out=out).drop("_n")
    return df.join(new, F.col(label).eqNullSafe(F.col("_l"))).drop("_l")
