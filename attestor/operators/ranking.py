"""Tie-aware ranking statistics of scored binary targets, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _distinct_scores(df: DataFrame, by: list[str], score: str, target: Column) -> DataFrame:
    """A row per group and score: n rows, pos of them targets. All rank statistics follow from it, after a map-side sum."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").cast("double").alias("n"), F.sum(target.cast("double")).alias("pos"))


def mid_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, mid): the mean rank of each distinct value, from running counts over one row per value."""
    d = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return d.select(*by, value, (F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / F.lit(2.0)).alias("mid"))


def auroc(df: DataFrame, by: list[str], score: str, target: Column) -> DataFrame:
    """Area under the ROC curve from the rank sum, ties at their mid rank; null without both classes."""
    d = _distinct_scores(df, by, score, target)
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = d.withColumn("ranks", F.col("pos") * (below + (F.col("n") + 1) / 2))
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return d.groupBy(*by).agg(F.when((p > 0) & (n > 0), (F.sum("ranks") - p * (p + 1) / 2) / (p * n)).alias("auroc"))


def average_precision(df: DataFrame, by: list[str], score: str, target: Column) -> DataFrame:
    """Precision at each distinct score, descending, weighted by the recall it adds; null without targets."""
    d = _distinct_scores(df, by, score, target)
    down = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("term", F.col("pos") * F.sum("pos").over(down) / F.sum("n").over(down))
    p = F.sum("pos")
    return d.groupBy(*by).agg(F.when(p > 0, F.sum("term") / p).alias("auprc"))


def spearman(df: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Pearson correlation of mid ranks; 0 where one side doesn't vary."""
    pairs = df.groupBy(*by, left, right).agg(F.count("*").cast("double").alias("w"))  # one row per pair of values
    r = pairs.join(mid_ranks(df, by, left).withColumnRenamed("mid", "a"), [*by, left]).join(mid_ranks(df, by, right).withColumnRenamed("mid", "b"), [*by, right])
    n, a, b, w = F.sum("w"), F.col("a"), F.col("b"), F.col("w")
    mean = lambda x: F.sum(w * x) / n
    va, vb = mean(a * a) - mean(a) * mean(a), mean(b * b) - mean(b) * mean(b)
    return r.groupBy(*by).agg(F.when(va * vb <= 1e-12, 0.0).otherwise((mean(a * b) - mean(a) * mean(b)) / F.sqrt(va * vb)).alias("spearman"))


def mass_concentration(df: DataFrame, by: list[str], score: str, target: Column) -> DataFrame:
    """The share of the score's mass that lies on targets; 0 without mass."""
    total = F.sum(score)
    return df.groupBy(*by).agg(F.when(total <= 1e-12, 0.0).otherwise(F.sum(F.when(target, F.col(score)).otherwise(0.0)) / total).alias("mass"))


def overlap(df: DataFrame, by: list[str], predicted: Column, actual: Column, strict: bool = False) -> DataFrame:
    """tp, fp, fn and dice, iou, precision, recall of boolean columns.

    Undefined ratios are 1 in the lenient rule. In the strict one they are 1 where both sides are empty and 0 where one is.
    """
    n = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("double")
    c = df.groupBy(*by).agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    none = F.when(tp + fp + fn == 0, 1.0).otherwise(0.0) if strict else F.lit(1.0)
    ratio = lambda a, b: F.when(b == 0, none).otherwise(a / b)
    return c.select("*", ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), ratio(tp, tp + fp + fn).alias("iou"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))
