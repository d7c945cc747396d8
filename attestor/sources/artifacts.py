"""Artifacts that are pinned by a digest: folders, models and bundles."""

from __future__ import annotations

from pyspark.ml.base import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import audits

from . import readers


def folder_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted names (below the folder) and digests of all its files; hashing runs on the executors.

    Names and digests of one artifact come to one task, contents do not. Marks of the writer (hidden files) don't count.
    """
    files = readers.snapshots(spark, path).select(F.regexp_replace("path", "^.*?" + _quoted(path), "").alias("name"), "digest")
    lines = files.where(~F.element_at(F.split("name", "/"), -1).rlike(r"^[._]")).select(F.concat_ws(":", "name", "digest").alias("line"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256)).first()[0]


def _quoted(path: str) -> str:
    return r"\Q" + path.split(":")[-1].rstrip("/") + r"\E/"


def save_model(model: Model, path: str) -> str:
    """Writes a fitted model and returns the digest that load_model() wants; an existing artifact is an error."""
    model.write().save(path)
    return folder_digest(SparkSession.getActiveSession(), path)


def load_model(spark: SparkSession, path: str, kind: type, digest: str, features: int | None = None) -> Model:
    """The model, if its folder still has the pinned digest and it takes as many features as expected."""
    if (found := folder_digest(spark, path)) != digest.strip().lower():
        raise ValueError(f"the artifact has digest {found}, not the pinned one")
    model = kind.load(path)
    if features is not None and model.numFeatures != features:
        raise ValueError(f"the model takes {model.numFeatures} features, not {features}")
    return model


def verify_bundle(spark: SparkSession, folder: str, pinned: DataFrame) -> DataFrame:
    """(name, state) of the files of a folder against pinned (name, digest); names in lower case."""
    return audits.drift(readers.file_index(spark, folder).select("name", "digest"), pinned.select(F.lower("name").alias("name"), "digest"))
