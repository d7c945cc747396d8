"""Kernels over raster columns: Arrow batches in, one row per image out, no shuffle but that which deals the images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by these columns over all cores: a small table in one file, or a result that was coalesced, is else one task's work."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def measure(df: DataFrame, key: str, values: str, height: int, width: int, kernel: Callable[[np.ndarray], dict], schema: str, channels: int = 1) -> DataFrame:
    """kernel(image) -> a value for each column of the schema, for rows whose array has height * width * channels numbers.

    Other rows (null or of another size) are left out.
    """
    shape = (height, width) if channels == 1 else (height, width, channels)
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if part.split()[1] == "string" else pa.float64() if part.split()[1] == "double" else pa.int64() for part in schema.split(",")]
        for b in batches:
            flat = np.asarray(b.column(1).flatten()).reshape(b.num_rows, *shape)
            rows = [kernel(x) for x in flat]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], names=[key, *names])

    good = F.size(values) == int(np.prod(shape))
    kind = df.schema[key].dataType.simpleString()
    return spread(df.where(good).select(key, values), key).mapInArrow(run, f"{key} {kind}, {schema}")


def byte_levels(values: Column) -> Column:
    """Numbers around [-1, 1] as levels 0 to 255."""
    return F.transform(values, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1.0) * 127.5).cast("int"))))
