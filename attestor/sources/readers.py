"""Scans with explicit schemas; what they reject becomes rows, not exceptions, except where nothing can be read."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def manifest(spark: SparkSession, path: str, columns: list[str], required: tuple[str, ...] = ("split",)) -> DataFrame:
    """A CSV manifest, all columns strings, never inferred. A header that lacks a required column, or no rows, is an error."""
    header = spark.read.text(path).limit(1).collect()
    names = [x.strip().strip('"').lstrip("﻿") for x in header[0][0].split(",")] if header else []
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"the manifest lacks {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    if df.isEmpty():
        raise ValueError("the manifest has no rows")
    return df.select(*(F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns)) if columns else df


def file_index(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, path, length, digest) of files below a folder; name is the last part in lower case, digest SHA-256 of the same read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"), "path", "length", F.sha2("content", 256).alias("digest"))


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, digest): bytes and digest from one read of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.sha2("content", 256).alias("digest"))


def index_rows(spark: SparkSession, path: str, row: str, split: str | None = None) -> DataFrame:
    """Rows of a JSON index {rows: [...]} by a fixed row schema; the split filter runs before anything is joined."""
    df = spark.read.schema(f"schema_version string, rows array<struct<{row}>>").json(path, multiLine=True).select(F.explode("rows").alias("r")).select("r.*")
    return df.where(F.col("split") == split) if split else df


def receipts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of a folder by a fixed schema; malformed ones keep their text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path, multiLine=True).withColumn("path", F.input_file_name())


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, content) of all members of zip archives, by last part of their name."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for archive, content in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"archive": [archive], "name": [info.filename.rsplit("/", 1)[-1]], "content": [z.read(info)]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(unpack, "archive string, name string, content binary")


def selected_members(members: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, missing, ambiguous) for wanted (name): a name must be in exactly one archive once."""
    counts = members.groupBy("name").agg(F.count("*").alias("n"))
    known = wanted.join(counts, "name", "left")
    found = members.join(known.where("n = 1").select("name"), "name", "left_semi")
    return found, known.where("n is null").select("name"), known.where("n > 1").select("name", "n")


def tex_rows(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """The groups of each match of a pattern in text files, as columns."""
    text = spark.read.text(path, wholetext=True)
    hits = text.select(F.posexplode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("pos", "hit"))
    return hits.select("pos", *(F.trim(F.regexp_extract("hit", pattern, i + 1)).alias(n) for i, n in enumerate(names)))


def required_files(rows: DataFrame) -> DataFrame:
    """The distinct images and masks that each source must provide."""
    return rows.groupBy("source").agg(F.array_sort(F.collect_set("image")).alias("images"), F.array_sort(F.collect_set("mask")).alias("masks"))


def merged_masks(masks: DataFrame, key: str, mode: str) -> DataFrame:
    """(key, y, x, value) of several annotators' pixels: 'mean' is soft, 'union' takes any over a half."""
    value = F.avg("value") if mode == "mean" else F.when(F.max("value") > 0.5, 1.0).otherwise(0.0)
    return masks.groupBy(key, "y", "x").agg(value.alias("value"))
