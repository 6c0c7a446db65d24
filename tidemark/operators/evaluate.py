"""Classifier and regression evaluation. Scores are columns; curves come from counts per distinct score."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relate import running_sums


def _by_score(df: DataFrame, score: Column, positive: Column, by: list[str]) -> DataFrame:
    """One row a distinct score, with counts and running counts from the highest score down, within ``by``, by ranges of scores."""
    g = df.groupBy(*by, score.alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    totals = g.groupBy(*[F.col(c).alias(f"_t_{c}") for c in by]).agg(F.sum("p").alias("pos"), F.sum("q").alias("neg"))
    sums = running_sums(g, {"tp": F.col("p"), "fp": F.col("q")}, by, F.desc("score"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by], F.lit(True))
    # Without ``by`` the totals are one row.
    return sums.join(totals if by else F.broadcast(totals), same).select(*by, "score", "p", "q", "tp", "fp", "pos", "neg")


def roc_curve(df: DataFrame, score: Column, positive: Column, by: list[str] | None = None) -> DataFrame:
    """score, fpr, tpr at each distinct score, from the highest."""
    c = _by_score(df, score, positive, by or [])
    return c.select(*(by or []), "score", (F.col("fp") / F.nullif("neg", F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif("pos", F.lit(0))).alias("tpr"))


def auc(df: DataFrame, score: Column, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids over distinct scores; ties count half."""
    c = _by_score(df, score, positive, by or [])
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0)) / F.nullif(F.first("pos") * F.first("neg"), F.lit(0))
    return c.groupBy(*(by or [])).agg(area.alias("auc"))


def pr_curve(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    c = _by_score(df, score, positive, [])
    return c.select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.nullif("pos", F.lit(0))).alias("recall"))


def average_precision(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """Sum of precision times the step in recall."""
    c = _by_score(df, score, positive, [])
    return c.agg((F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.first("pos"), F.lit(0))).alias("average_precision"))


def one_vs_rest(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """Rows class, score, positive: each row once a class. ``scores``: class -> score column."""
    each = F.array(*[F.struct(F.lit(str(k)).alias("class"), s.cast("double").alias("score"), (F.col(label).cast("string") == str(k)).alias("positive")) for k, s in scores.items()])
    return df.select(F.inline(each))


def macro_micro_auc(ovr: DataFrame, grid: int = 100) -> DataFrame:
    """kind, auc: 'micro' over all rows together; 'macro' of the mean curve of the classes on an even grid of fpr."""
    micro = auc(ovr, F.col("score"), F.col("positive")).select(F.lit("micro").alias("kind"), "auc")
    roc = roc_curve(ovr, F.col("score"), F.col("positive"), ["class"])
    start = roc.select("class").distinct().select("class", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    pts = roc.select("class", "fpr", "tpr").unionByName(start).groupBy("class", "fpr").agg(F.max("tpr").alias("high"), F.min("tpr").alias("low"))
    w = Window.partitionBy("class").orderBy("fpr")
    seg = pts.select("class", "fpr", "high", F.lead("fpr").over(w).alias("next"), F.lead("low").over(w).alias("next_low"))
    xs = F.transform(F.sequence(F.ceil(F.col("fpr") * grid).cast("int"), F.coalesce(F.ceil(F.col("next") * grid).cast("int") - 1, F.lit(grid))), lambda i: i)
    safe = F.ceil(F.col("fpr") * grid).cast("int") <= F.coalesce(F.ceil(F.col("next") * grid).cast("int") - 1, F.lit(grid))
    at = seg.filter(safe).select("class", "fpr", "high", "next", "next_low", F.explode(xs).alias("i"))
    x = F.col("i") / float(grid)
    y = F.when(F.col("next").isNull() | (x == F.col("fpr")), F.col("high")).otherwise(F.col("high") + (F.col("next_low") - F.col("high")) * (x - F.col("fpr")) / (F.col("next") - F.col("fpr")))
    mean = at.groupBy("i").agg(F.avg(y).alias("y"))
    wi = Window.orderBy("i")  # grid + 1 rows
    macro = mean.select(((F.col("y") + F.lag("y").over(wi)) / 2 / grid).alias("a")).agg(F.sum("a").alias("auc")).select(F.lit("macro").alias("kind"), "auc")
    return micro.unionByName(macro)


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support of each class that is a label or a prediction."""
    each = F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("is_label"), (F.col(label) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("is_label"), F.lit(0).alias("hit")))
    g = df.select(F.inline(each)).groupBy("class").agg(F.sum("hit").alias("tp"), F.sum("is_label").alias("support"), F.count_if(F.col("is_label") == 0).alias("predicted"))
    z = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return g.select("class", z("tp", F.col("predicted")).alias("precision"), z("tp", F.col("support")).alias("recall"), F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("support") + F.col("predicted"), F.lit(0)), F.lit(0.0)).alias("f1"), "support")


def accuracy(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def regression_report(df: DataFrame, y: str, predicted: str) -> DataFrame:
    """mse, r2, rss, tss."""
    e = F.pow(F.col(y).cast("double") - F.col(predicted), F.lit(2.0))
    tss = F.var_pop(F.col(y).cast("double")) * F.count(y)
    return df.agg(F.avg(e).alias("mse"), (1 - F.sum(e) / tss).alias("r2"), F.sum(e).alias("rss"), tss.alias("tss"))


def bic(log_likelihood: float, parameters: int, n: int) -> float:
    from math import log

    return parameters * log(n) - 2 * log_likelihood
