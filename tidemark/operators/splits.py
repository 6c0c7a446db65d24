"""Impurities, best splits, weights and sampling for supervised learning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relate import running_sums


def impurity(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """entropy (base 2) and gini of the labels."""
    by = by or []
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    t = n.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nlogn"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    return t.select(*by, (F.log2(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")).alias("entropy"), (1 - F.col("n2") / F.pow(F.col("total").cast("double"), F.lit(2.0))).alias("gini"))


def best_split(df: DataFrame, features: list[str], label: str, points: int = 100) -> DataFrame:
    """feature, threshold, gini_gain, entropy_gain of the best of ``points`` evenly spaced thresholds of each feature.

    Rows are put in a cell of the grid once and counted; running counts over the cells give both sides of every
    threshold, so the data are read twice whatever the number of thresholds.
    """
    ends = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("a"), F.max(F.col(c).cast("double")).alias("b")).alias(f"_{c}") for c in features])
    rows = df.crossJoin(F.broadcast(ends))
    step = lambda c: (F.col(f"_{c}.b") - F.col(f"_{c}.a")) / (points + 1)
    # threshold k = a + k * step, k = 1 .. points; x <= threshold k goes left
    cell = lambda c: F.when(step(c) > 0, F.least(F.greatest(F.ceil((F.col(c).cast("double") - F.col(f"_{c}.a")) / step(c)), F.lit(1)), F.lit(points + 1))).otherwise(1)
    each = F.array(*[F.struct(F.lit(c).alias("feature"), cell(c).cast("int").alias("cell"), F.col(f"_{c}.a").alias("low"), step(c).alias("step")) for c in features])
    n = rows.select(F.col(label).alias("y"), F.inline(each)).groupBy("feature", "cell", "y").agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("step").alias("step"))
    grid = n.select("feature", "low", "step").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(points))))
    sides = grid.join(n.select(F.col("feature").alias("f"), "cell", "y", "n"), F.col("feature") == F.col("f"))
    sides = sides.groupBy("feature", "k", "low", "step", "y").agg(F.sum(F.when(F.col("cell") <= F.col("k"), F.col("n")).otherwise(0)).alias("l"), F.sum("n").alias("t"))
    nl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c).cast("double"))).otherwise(0.0)
    s = sides.withColumn("r", F.col("t") - F.col("l")).groupBy("feature", "k", "low", "step").agg(*[F.sum(c).alias(f"n{c}") for c in "lrt"], *[F.sum(nl(c)).alias(f"e{c}") for c in "lrt"], *[F.sum(F.col(c).cast("double") * F.col(c)).alias(f"s{c}") for c in "lrt"])
    s = s.filter((F.col("nl") > 0) & (F.col("nr") > 0))
    ent = lambda c: F.log2(F.col(f"n{c}").cast("double")) - F.col(f"e{c}") / F.col(f"n{c}")
    gini = lambda c: 1 - F.col(f"s{c}") / F.pow(F.col(f"n{c}").cast("double"), F.lit(2.0))
    gain = lambda m: m("t") - (F.col("nl") * m("l") + F.col("nr") * m("r")) / F.col("nt")
    s = s.select("feature", (F.col("low") + F.col("k") * F.col("step")).alias("threshold"), gain(gini).alias("gini_gain"), gain(ent).alias("entropy_gain"), "k")
    return s.groupBy("feature").agg(F.max_by(F.struct("threshold", "gini_gain", "entropy_gain"), F.struct(F.round("gini_gain", 12).alias("g"), (-F.col("k")).alias("k"))).alias("b")).select("feature", "b.*")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (classes * n of the class). Only the counts by class are joined back."""
    n = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))))
    return df.join(n.select("_l", (F.col("_t") / (F.col("_k") * F.col("_n"))).alias(out)), F.col(label) == F.col("_l")).drop("_l")


def fuzzy_weights(df: DataFrame, columns: list[str], label: str, least: float = 1e-3, out: str = "weight") -> DataFrame:
    """1 - the distance to the class's centre, min-max scaled over all rows, clipped to ``least`` .. 1."""
    c = df.groupBy(F.col(label).alias("_l")).agg(*[F.avg(x).alias(f"_c_{x}") for x in columns])
    d = df.join(c, F.col(label) == F.col("_l")).withColumn("_d", F.sqrt(sum((F.pow(F.col(x) - F.col(f"_c_{x}"), F.lit(2.0)) for x in columns[1:]), F.pow(F.col(columns[0]) - F.col(f"_c_{columns[0]}"), F.lit(2.0)))))
    d = d.crossJoin(F.broadcast(d.agg(F.min("_d").alias("_a"), F.max("_d").alias("_b"))))
    w = 1 - (F.col("_d") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))
    return d.withColumn(out, F.greatest(F.lit(least), F.least(F.lit(1.0), w))).drop("_l", "_d", "_a", "_b", *[f"_c_{x}" for x in columns])


def _rank(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """_rank: from 1 within the label, by a hash of key and seed, numbered by ranges."""
    by_hash = df.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(key)))
    return running_sums(by_hash, {"_rank": F.lit(1)}, [label], "_hash", key).drop("_hash")


def stratified_split(df: DataFrame, key: str, label: str, fraction: float, seed: int = 0) -> DataFrame:
    """is_train: floor(fraction * n) rows of each class, those with the least hash of key and seed."""
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size"))
    ranked = _rank(df, key, label, seed).join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    return ranked.withColumn("is_train", F.col("_rank") <= F.floor(F.col("_size") * fraction)).drop("_rank", "_label", "_size")


def folds(df: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """fold: 0 .. k - 1, even within each class."""
    return _rank(df, key, label, seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def smote(df: DataFrame, key: str, columns: list[str], minority, per_row: int = 1, k: int = 5, seed: int = 0) -> DataFrame:
    """New rows between each minority row and one of its k nearest minority rows; draws hash key and number.

    Neighbours are exact, found by reference balls (see balls.nearest), so no task sees all pairs. Keys are numbers.
    """
    from .balls import nearest

    m = df.filter(minority).select(F.col(key).cast("long").alias("a"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    ids = nearest(m, "a", "x", k).select("a", F.posexplode("nearest").alias("rank", "b"))
    pairs = ids.join(m.select(F.col("a").alias("b"), F.col("x").alias("y")), "b")
    near = pairs.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("rank", "b", "y"))).alias("near")).join(m, "a")
    drawn = near.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(per_row))))
    u = lambda s: F.conv(F.substring(F.md5(F.concat_ws(" ", F.lit(seed + s), "a", "i")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    one = F.element_at("near", (F.floor(u(1) * F.size("near")) + 1).cast("int"))
    new = drawn.withColumn("z", F.zip_with("x", one["y"], lambda p, q: p + (q - p) * u(2)))
    return new.select(F.col("a").alias("origin"), "i", *[F.col("z")[j].alias(c) for j, c in enumerate(columns)])
