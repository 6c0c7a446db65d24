"""Event-time windows, for batch tables and for streams. (An extension: the surveyed programs have no streams.)"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, at: str, width: str, by: list[str], value: str, watermark: str | None = None) -> DataFrame:
    """Count and sum by window and keys. On a stream, ``watermark`` bounds how late a row may be."""
    df = df.withWatermark(at, watermark) if watermark else df
    g = df.groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sliding(df: DataFrame, at: str, width: str, step: str, by: list[str], value: str, watermark: str | None = None) -> DataFrame:
    df = df.withWatermark(at, watermark) if watermark else df
    g = df.groupBy(F.window(at, width, step), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return g.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def sessions(df: DataFrame, at: str, gap: str, by: list[str], watermark: str | None = None) -> DataFrame:
    """Runs of rows of a key that are less than ``gap`` apart."""
    df = df.withWatermark(at, watermark) if watermark else df
    g = df.groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))
    return g.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def stream_parquet(spark, path: str, schema, at: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream, with the time column as a timestamp."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn(at, F.col(at).cast("timestamp"))
