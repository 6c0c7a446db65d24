"""Frequencies and profiles of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stack(row: DataFrame, names: list[str], value: str) -> DataFrame:
    """One wide row as rows (column_name, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("long").alias(value)) for c in names]))
    return row.select(pairs.alias("p")).select("p.*")


def frequency(df: DataFrame, column: str) -> DataFrame:
    """value, n: how often each value occurs, as text; null counts as 'nan'."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")).agg(F.count("*").alias("n"))


def top_k_other(df: DataFrame, column: str, k: int, other: str = "other", drop_other: bool = False) -> DataFrame:
    """The k most frequent values (ties by value), and the rest as one row if there is any.

    The first k come from a bounded heap in each task; no window over all values is sorted.
    """
    freq = frequency(df, column)
    top = freq.orderBy(F.desc("n"), "value").limit(k)
    if drop_other:
        return top
    rest = freq.agg(F.sum("n").alias("n")).unionAll(top.agg((-F.sum("n")).alias("n"))).agg(F.sum("n").alias("n")).filter("n > 0")
    return top.unionByName(rest.select(F.lit(other).alias("value"), "n"))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or df.columns
    return _stack(df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names]), names, "n_null")


def distinct_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or df.columns
    return _stack(df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in names]), names, "n_distinct")


def type_profile(df: DataFrame) -> DataFrame:
    """column_name, data_type: a row for each column."""
    return df.sparkSession.createDataFrame([(c, t) for c, t in df.dtypes], "column_name string, data_type string")


def shape_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def incomplete_span(df: DataFrame, date_col: str, columns: list[str]) -> DataFrame:
    """First, last and number of days of the rows with a null in any of the columns."""
    bad = df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))
    day = F.col(date_col).cast("date")
    return bad.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_distinct(day).alias("n_days"), F.count("*").alias("n_rows"))


def char_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(F.split(column, "")).alias("value")).filter("value <> ''").groupBy("value").agg(F.count("*").alias("n"))


def length_frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.length(column).cast("long").alias("length")).agg(F.count("*").alias("n"))


def zero_filled_counts(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """value, n for each whole number from low to high, 0 where none occurs."""
    domain = df.sparkSession.range(low, high + 1).select(F.col("id").alias("value"))
    counts = df.groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("c"))
    return domain.join(counts, F.col("value") == F.col("v"), "left").select("value", F.coalesce("c", F.lit(0)).alias("n"))


def basic_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def null_matrix(df: DataFrame, columns: list[str], *order: str, buckets: int = 20) -> DataFrame:
    """bucket (rows in a given order, in ``buckets`` runs of like length), n, and each column's number of nulls."""
    from .relate import row_index

    total = df.agg(F.count("*").alias("_n"))
    rows = row_index(df, *order, out="_i").crossJoin(F.broadcast(total))
    bucket = F.floor(F.col("_i") * buckets / F.col("_n")).cast("int")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
