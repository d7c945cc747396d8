"""A saliency prior: a forest on superpixels, scored out of fold by group, and the threshold that its scores are cut at."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import kernels, regions
from attestor.sources import artifacts

from . import forest as trees

#: The forest's parameters, the thresholds that are tried, and what a threshold must keep to in every condition.
FOREST = {"numTrees": 96, "maxDepth": 12, "minInstancesPerNode": 3, "featureSubsetStrategy": "0.75", "subsamplingRate": 0.65, "seed": 205, "maxMemoryInMB": 512, "cacheNodeIds": True}
GRID = [0.01, 0.02, 0.03, 0.04] + [round(0.05 + 0.025 * i, 3) for i in range(19)]
LEAST_COVERAGE, MOST_SUPPORT = 0.97, 0.60


def region_rows(images: DataFrame, height: int, width: int, many: int, views: tuple[str, ...] = ("clean", "gaussian_noise")) -> DataFrame:
    """(id, group_key, view, region, features, n, inside) of images (id, group_key, pixels: 3 levels a pixel, mask: 0 and 1), once for each view.

    features: regions.NAMES of each superpixel; n: its pixels, inside: those of the mask. Images whose arrays have another
    length, or are null, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, group, pixels, mask in zip(*(c.to_pylist() for c in b.columns), strict=True):
                image, inside = np.array(pixels, np.uint8).reshape(height, width, 3), np.array(mask).reshape(-1) > 0
                for view in views:
                    seen = image if view == "clean" else kernels.corrupt(image, view, i & 0xFFFFFFFF)
                    label = regions.superpixels(seen, many)
                    n, hit = np.bincount(label.ravel()), np.bincount(label.ravel(), inside).astype(int)
                    rows += [(i, group, view, k, x, int(n[k]), int(hit[k])) for k, x in enumerate(regions.described(seen, label).tolist())]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "group_key", "view", "region", "features", "n", "inside"])

    whole = (F.size("pixels") == height * width * 3) & (F.size("mask") == height * width)
    rows = images.where(whole).select(F.col("id").cast("long"), F.col("group_key").cast("string"), "pixels", F.col("mask").cast("array<int>"))
    return rows.mapInArrow(run, "id long, group_key string, view string, region int, features array<double>, n long, inside long")


def _vectors(rows: DataFrame) -> DataFrame:
    columns = [F.col("features")[i].alias(f"f{i}") for i in range(len(regions.NAMES))]
    out = rows.select(*(x for x in rows.columns if x != "features"), *columns, (F.col("inside") / F.col("n")).alias("label"))
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(regions.NAMES))], outputCol="features").transform(out).drop(*(f"f{i}" for i in range(len(regions.NAMES))))


def fit(rows: DataFrame, **forest) -> RandomForestRegressionModel:
    """The forest of all rows; parameters are FOREST's unless named."""
    return RandomForestRegressor(**(FOREST | forest)).fit(_vectors(rows))


def out_of_fold(rows: DataFrame, folds: int = 5, **forest) -> DataFrame:
    """The rows with `score`: what a forest of the other folds predicts. A group is in one fold, by its hash.

    Forests of all folds are grown at once, by forest.scored: MLlib's figures of all nodes (18 kB each, of each part of the rows,
    in each pass) are many times these rows.
    """
    data = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).withColumn("label", F.col("inside") / F.col("n"))
    data = data.withColumn("fold", F.pmod(F.xxhash64("group_key"), F.lit(folds)).cast("int"))
    shape = {k: v for k, v in (FOREST | forest).items() if k not in ("maxMemoryInMB", "cacheNodeIds")}
    return trees.scored(data, ["id", "view", "region"], "features", "label", "fold", folds, len(regions.NAMES), **shape).drop("features", "label", "fold")


def thresholds(scored: DataFrame, grid: list[float] | None = None, least: float = LEAST_COVERAGE, most: float = MOST_SUPPORT) -> DataFrame:
    """(threshold, coverage, support, dice, feasible, selected) of scored regions, each figure that of the worst view.

    A region is on at a score of the threshold or more. Medians over the images of a view: coverage, the share of the mask that
    is on (images without a mask take no part in it); support, the share of the image; Dice. The selected threshold is the feasible
    one of the best Dice, or the best of all if none is; ties go to the smaller.
    """
    on = F.col("score") >= F.col("threshold")
    each = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, grid or GRID))))
    total = lambda x, only=None: F.sum(F.when(only, F.col(x)).otherwise(0) if only is not None else F.col(x))
    each = each.groupBy("threshold", "view", "id").agg(total("n").alias("pixels"), total("inside").alias("mask"), total("n", on).alias("on"), total("inside", on).alias("hit"))
    each = each.select("threshold", "view", F.when(F.col("mask") > 0, F.col("hit") / F.col("mask")).alias("coverage"), (F.col("on") / F.col("pixels")).alias("support"), F.when(F.col("mask") + F.col("on") > 0, 2 * F.col("hit") / (F.col("mask") + F.col("on"))).otherwise(1.0).alias("dice"))
    by_view = each.groupBy("threshold", "view").agg(*(F.expr(f"percentile({x}, 0.5D)").alias(x) for x in ("coverage", "support", "dice")))
    worst = by_view.groupBy("threshold").agg(F.min("coverage").alias("coverage"), F.max("support").alias("support"), F.min("dice").alias("dice"))
    worst = worst.withColumn("feasible", F.coalesce((F.col("coverage") >= least) & (F.col("support") <= most), F.lit(False)))
    best = worst.agg(F.max(F.struct("feasible", "dice", (-F.col("threshold")).alias("t"))).alias("b"))  # a row for each threshold of the grid
    return worst.join(F.broadcast(best), F.lit(True)).select(*worst.columns, (F.col("threshold") == -F.col("b.t")).alias("selected"))


def release(model: Model, chosen: dict, path: str) -> dict:
    """Writes the model below `path`; the record that load() wants has its digest, the features' names and the chosen threshold with its figures."""
    return {"schema_version": "prior.v1", "features": list(regions.NAMES), "threshold": chosen["threshold"], "figures": chosen, "digest": artifacts.save_model(model, f"{path}/model")}


def load(spark: SparkSession, path: str, record: str) -> tuple[RandomForestRegressionModel, float]:
    """The model and its threshold by a record (JSON); ValueError if anything isn't what it was when released."""
    r = json.loads(record)
    if r.get("schema_version") != "prior.v1" or r.get("features") != list(regions.NAMES):
        raise ValueError("the record is of another kind of prior")
    if not (isinstance(r.get("threshold"), float) and 0 < r["threshold"] < 1):
        raise ValueError("no threshold between 0 and 1")
    return artifacts.load_model(spark, f"{path}/model", RandomForestRegressionModel, r.get("digest", ""), len(regions.NAMES)), r["threshold"]
