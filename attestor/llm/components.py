"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.graphs import stars

from . import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that a link (u, v) names; component: the least node that can be reached.

    The edges of each round of star steps are written to the shared folder. Links to oneself are ignored.
    """
    edges = stars(links, lambda e: common.materialise(e, "edges"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
