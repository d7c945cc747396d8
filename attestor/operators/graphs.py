"""Connected components of rows that share keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """Uses spark.checkpoint.dir; sets a temporary folder only where it is unset in local mode, as in tests."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and ("local-cluster" in sc.master or not sc.master.startswith("local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or f"file://{tempfile.mkdtemp(prefix='attestor-cp-')}")


def stars(links: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v): every node u of the links (u, v) that isn't the least of its component, with that least node v.

    Large-star and small-star steps alternate until the links are stars, which they often are at first. Each only takes least
    neighbours (with map-side minima) and joins them back, so no node's links are ever gathered in one place. `cut` stores the
    edges of a round and cuts their lineage. Links to oneself are ignored.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return edges


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of distinct links (u, v), v < u, either has one link down and none up, or only links up: then all that meet there are joined."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return ends.agg(F.coalesce(F.max(F.col("down") + F.col("up")), F.lit(1))).first()[0] <= 1


def shared_key_components(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """(node, component): rows that share a non-blank value of one of the keys, directly or through others, get the least node.

    A value links its rows to the least of them, so no pairs are made; rounds of star steps are checkpointed.
    """
    ensure_checkpoint_dir(rows)
    long = rows.select(F.col(node).alias("n"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.trim(F.col(k).cast("string")).alias("v")) for k in keys))).alias("key"))
    long = long.where(F.col("key.v") != "").select("n", "key.k", "key.v")
    least = long.groupBy("k", "v").agg(F.min("n").alias("m"))
    edges = stars(long.join(least, ["k", "v"]).select(F.col("n").alias("u"), F.col("m").alias("v")), lambda e: e.checkpoint())
    return rows.select(F.col(node)).join(edges.select(F.col("u").alias(node), F.col("v").alias("component")), node, "left").withColumn("component", F.coalesce("component", node))
