"""Bootstrap intervals whose resamples are drawn by hash, so that they are the same on any cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bootstrap_median(deltas: DataFrame, node: str, value: str, iterations: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """One row: estimate, lower, upper, n, iterations. The median of paired deltas, resampled by md5(seed:iteration:draw).

    Draws are spread over the cluster: iterations * n rows, aggregated per iteration. n is the number of samples of one
    comparison; the values are joined by their ordinal.
    """
    ordered = deltas.select(F.col(value).alias("v"), (F.row_number().over(Window.orderBy(node)) - 1).alias("i"))
    n = deltas.count()
    if n < 2 or iterations < 100:
        raise ValueError("a bootstrap needs two samples and a hundred iterations at least")
    spark = deltas.sparkSession
    draws = spark.range(iterations * n).select(F.floor(F.col("id") / n).alias("iteration"), (F.col("id") % n).alias("draw"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("iteration").cast("string"), F.col("draw").cast("string")))
    draws = draws.withColumn("i", (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n).cast("int"))
    medians = draws.join(ordered, "i").groupBy("iteration").agg(F.expr("percentile(v, 0.5D)").alias("m"))
    tail = (1 - confidence) / 2
    interval = medians.agg(F.expr(f"percentile(m, {tail}D)").alias("lower"), F.expr(f"percentile(m, {1 - tail}D)").alias("upper"), F.count("*").cast("int").alias("iterations"))
    estimate = deltas.agg(F.expr(f"percentile({value}, 0.5D)").alias("estimate"), F.count("*").cast("int").alias("n"))
    return estimate.join(F.broadcast(interval.withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).drop("one")  # one row each


def numpy_bootstrap_median(values: np.ndarray, iterations: int = 2000, seed: int = 204, confidence: float = 0.95) -> dict[str, float]:
    """The same statistic with NumPy's own generator, for values in one place."""
    values = np.asarray(values, np.float64)
    if len(values) < 2 or iterations < 100:
        raise ValueError("a bootstrap needs two samples and a hundred iterations at least")
    rng = np.random.default_rng(seed)
    medians = np.array([np.median(values[rng.integers(0, len(values), len(values))]) for _ in range(iterations)])
    tail = (1 - confidence) / 2
    return {"estimate": float(np.median(values)), "lower": float(np.quantile(medians, tail)), "upper": float(np.quantile(medians, 1 - tail))}
