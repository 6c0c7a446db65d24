"""Recoding, imputing and scaling of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recode(column: Column, mapping: dict, default: Column | None = None) -> Column:
    """Values by a small table; others stay, or become ``default``."""
    out = F.lit(None)
    case = None
    for old, new in mapping.items():
        case = F.when(column == old, F.lit(new)) if case is None else case.when(column == old, F.lit(new))
    out = column if default is None else default
    return out if case is None else case.otherwise(out)


def one_hot(df: DataFrame, column: str, levels: list, drop_first: bool = False, prefix: str | None = None) -> DataFrame:
    """A 0/1 column for each level (sorted); with ``drop_first`` the first is implied. Null gives zeros."""
    use = sorted(levels)[1 if drop_first else 0 :]
    return df.withColumns({f"{prefix or column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in use})


def label_encode(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """A dense number for each value in sorted order, from 0. Only distinct values are sorted, by range; null has no code."""
    from .relate import row_index

    codes = row_index(df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct(), "_value", out=out)
    return df.join(codes, F.col(column) == F.col("_value"), "left").drop("_value")


def _with_stats(df: DataFrame, aggs: list[Column]) -> DataFrame:
    """Each row beside one row of statistics, which is broadcast: no window over the whole table."""
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population spread as <column>_z; null where the spread is 0."""
    stats = [a for c in columns for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    out = _with_stats(df, stats).withColumns({f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns})
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range as <column>_r."""
    stats = [F.percentile(F.col(c).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}") for c in columns]
    out = _with_stats(df, stats).withColumns({f"{c}_r": (F.col(c) - F.col(f"_q_{c}")[1]) / F.nullif(F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0], F.lit(0.0)) for c in columns})
    return out.drop(*[f"_q_{c}" for c in columns])


def minmax_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = [a for c in columns for a in (F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_b_{c}"))]
    out = _with_stats(df, stats).withColumns({f"{c}_m": (F.col(c) - F.col(f"_a_{c}")) / F.nullif((F.col(f"_b_{c}") - F.col(f"_a_{c}")).cast("double"), F.lit(0.0)) for c in columns})
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ab"])


def center(df: DataFrame, columns: list[str]) -> DataFrame:
    out = _with_stats(df, [F.avg(c).alias(f"_m_{c}") for c in columns]).withColumns({f"{c}_c": F.col(c) - F.col(f"_m_{c}") for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns])


def impute_mean(df: DataFrame, columns: list[str], whole: bool = False) -> DataFrame:
    """Nulls become the column's mean (rounded with ``whole``)."""
    out = _with_stats(df, [F.avg(c).alias(f"_m_{c}") for c in columns])
    mean = lambda c: F.round(f"_m_{c}") if whole else F.col(f"_m_{c}")
    return out.withColumns({c: F.coalesce(F.col(c), mean(c)) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def fill_date_after_max(df: DataFrame, column: str, days: int = 31) -> DataFrame:
    """Null dates become the latest date plus ``days``."""
    out = _with_stats(df, [F.max(column).alias("_latest")])
    return out.withColumn(column, F.coalesce(F.col(column), F.date_add("_latest", days))).drop("_latest")


def point_update(df: DataFrame, key: str, column: str, values: dict) -> DataFrame:
    """Set the column in the rows of given keys."""
    return df.withColumn(column, recode(F.col(key), values, F.col(column)))


def columns_of_type(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns whose type starts with one of ``kinds``."""
    return [c for c, t in df.dtypes if t.startswith(kinds)]
