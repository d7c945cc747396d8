"""How plan modules register queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the tables that the text names."""
    import re

    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def portable(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose text both engines read, or nearly (then oracle is the other's)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, text)

    run.__name__ = name
    query(oracle or text)(run)
