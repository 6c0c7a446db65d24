"""Seeded test data made by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ring(spark: SparkSession, n: int, radius: float = 1.0, noise: float = 0.1, seed: int = 1) -> DataFrame:
    """id, x, y round a circle."""
    a = 2 * F.pi() * F.rand(seed)
    r = radius + noise * F.randn(seed + 1)
    return spark.range(n).select("id", a.alias("a"), r.alias("r")).select("id", (F.col("r") * F.cos("a")).alias("x"), (F.col("r") * F.sin("a")).alias("y"))


def gaussians(spark: SparkSession, centers: list[tuple[float, float]], sizes: list[int], spread: float = 1.0, seed: int = 1) -> DataFrame:
    """id, label, x, y of several round clouds."""
    out = None
    for k, ((cx, cy), n) in enumerate(zip(centers, sizes, strict=True)):
        one = spark.range(n).select((F.col("id") + sum(sizes[:k])).alias("id"), F.lit(k).alias("label"), (cx + spread * F.randn(seed + 2 * k)).alias("x"), (cy + spread * F.randn(seed + 2 * k + 1)).alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


def uniform_ints(spark: SparkSession, rows: int, columns: int, high: int, seed: int = 1) -> DataFrame:
    return spark.range(rows).select("id", *[F.floor(F.rand(seed + i) * high).cast("int").alias(f"c{i}") for i in range(columns)])


def mesh(spark: SparkSession, low: float, high: float, steps: int) -> DataFrame:
    """x, y of a square grid of (steps + 1) ** 2 points."""
    at = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: low + i * (high - low) / steps)
    return spark.range(1).select(F.explode(at).alias("x")).withColumn("y", F.explode(at))
