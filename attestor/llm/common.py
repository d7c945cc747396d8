"""What the training-data operators share: table access, shared-folder materialisation, sizing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside join keys; no real id may be Long.MIN_VALUE.
NULL_KEY = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, as in local tests) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if "local-cluster" in spark.sparkContext.master or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = _local_dir()
    return where.rstrip("/")


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="attestor-"))
    return f"file://{_LOCAL[0]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestor-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _TO_DROP:
        atexit.unregister(drop_materialised)
        atexit.register(drop_materialised)  # after the gateway's own, so it runs before it
    _TO_DROP.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out._jdf] = path
    return out


_PATHS: WeakKeyDictionary[object, str] = WeakKeyDictionary()


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise() early: only where nothing that is still to be computed reads it."""
    path = _PATHS.pop(df._jdf)
    _TO_DROP.remove(path)
    _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)  # nothing happens if it is gone already


_TO_DROP: list[str] = []


def drop_materialised() -> None:
    """Deletes what materialise() wrote; at the end of the process, or before, once no result that reads those files is needed."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    while _TO_DROP:
        _delete(spark, _TO_DROP.pop())


@atexit.register
def _clean() -> None:
    import shutil

    for d in _LOCAL:
        shutil.rmtree(d, ignore_errors=True)


def row_key() -> list[Column]:
    """Identifies a document row by content: equal keys mean the same doc_id and (up to a 64-bit hash) the same text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("dkey"), F.xxhash64("text").alias("rid")]


def groups_for(total: int, per_group: int) -> int:
    """How many groups hold `total` units at about `per_group` units each."""
    return max(1, -(-int(total or 0) // per_group))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches of `rows` rows at most, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
