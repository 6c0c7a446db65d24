"""Histograms and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _range(df: DataFrame, x: Column) -> DataFrame:
    """One row: n, low, high."""
    return df.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))


def _counts(df: DataFrame, x: Column, stats: DataFrame, bins: Column, high: Column, width: Column) -> DataFrame:
    """bin, low_edge, high_edge, n of the bins that hold values. ``stats`` is one row, so it is broadcast."""
    rows = df.select(x.alias("x")).filter("x is not null").crossJoin(F.broadcast(stats.withColumns({"bins": bins, "top": high}).withColumn("width", width)))
    place = F.greatest(F.lit(0), F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")), F.col("bins") - 1)).cast("long")
    got = rows.groupBy(F.when(F.col("width") > 0, place).otherwise(0).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("width").alias("width"))
    return got.select("bin", F.round(F.col("low") + F.col("bin") * F.col("width"), 6).alias("low_edge"), F.round(F.col("low") + (F.col("bin") + 1) * F.col("width"), 6).alias("high_edge"), "n")


def sturges_histogram(df: DataFrame, column: str, log: bool = False) -> DataFrame:
    """1 + floor(log2 n) left-closed bins whose last edge is one above the maximum; empty bins are left out.

    With ``log`` values below 1 count as 1 and the bins are of log10.
    """
    x = F.col(column).cast("double")
    x = F.log10(F.greatest(x, F.when(x.isNotNull(), F.lit(1.0)))) if log else x
    bins = (1 + F.floor(F.log2(F.col("n").cast("double")))).cast("long")
    return _counts(df, x, _range(df, x), bins, F.col("high") + 1, (F.col("top") - F.col("low")) / F.col("bins"))


def closed_histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal bins over low .. high, the last closed on the right; Sturges' number of bins if none is given."""
    x = F.col(column).cast("double")
    n = F.lit(bins).cast("long") if bins else (1 + F.floor(F.log2(F.col("n").cast("double")))).cast("long")
    return _counts(df, x, _range(df, x), n, F.col("high"), (F.col("top") - F.col("low")) / F.col("bins"))


def floor_width_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Bins of a whole width, floor(range / bins) or 1; what lies beyond the last counts there."""
    x = F.col(column).cast("double")
    width = F.greatest(F.floor((F.col("top") - F.col("low")) / F.col("bins")), F.lit(1)).cast("double")
    return _counts(df, x, _range(df, x), F.lit(bins).cast("long"), F.col("high"), width)


def explicit_edges(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bin, low_edge, high_edge, n with given edges, the last bin closed; values outside are left out."""
    x = F.col(column).cast("double")
    last = len(edges) - 2
    place = F.lit(None).cast("long")
    for i in range(last, -1, -1):
        inside = (x >= edges[i]) & ((x <= edges[i + 1]) if i == last else (x < edges[i + 1]))
        place = F.when(inside, i).otherwise(place)
    got = df.groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n")).filter("bin is not null")
    low, high = F.array(*map(F.lit, map(float, edges[:-1]))), F.array(*map(F.lit, map(float, edges[1:])))
    return got.select("bin", low[F.col("bin")].alias("low_edge"), high[F.col("bin")].alias("high_edge"), "n")


def half_open_label(x: Column, width: float, limit: float) -> Column:
    """floor(x / width) for 0 <= x < limit, else null."""
    return F.when((x >= 0) & (x < limit), F.floor(x / width).cast("long"))


def binned_statistics(df: DataFrame, column: str) -> DataFrame:
    """Statistics of a log histogram's bins as if each value lay midway to the next bin that isn't empty.

    The last bin has no next and is left out, as in the published table this follows.
    """
    from pyspark.sql import Window

    h = sturges_histogram(df, column, log=True)
    nxt = F.lead("low_edge").over(Window.orderBy("bin"))  # a row a bin: a few dozen rows
    mid = h.select(((F.col("low_edge") + nxt) / 2).alias("mid"), "n").filter("mid is not null")
    mean = F.sum(F.col("mid") * F.col("n")) / F.sum("n")
    m = mid.crossJoin(F.broadcast(mid.agg(mean.alias("mean"), F.sum("n").alias("total"))))
    power = lambda k: F.sum(F.pow(F.col("mid") - F.col("mean"), F.lit(float(k))) * F.col("n")) / F.first("total")
    s = m.agg(F.first("mean").alias("mean"), power(2).alias("m2"), power(3).alias("m3"), power(4).alias("m4"), F.max_by("mid", F.struct("n", (-F.col("mid")).alias("k"))).alias("mode"))
    return s.select(F.round("mean", 6).alias("mean"), F.round("m2", 6).alias("variance"), F.round(F.col("m3") / F.pow("m2", F.lit(1.5)), 5).alias("skew"), F.round(F.col("m4") / F.pow("m2", F.lit(2.0)) - 3, 5).alias("excess_kurtosis"), F.round("mode", 6).alias("mode"))
