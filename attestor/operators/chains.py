"""Evidence that hangs together: chains of digests, values at any depth of nested records, changes between two looks at a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import ensure_checkpoint_dir


def trust_chain(artifacts: DataFrame) -> DataFrame:
    """(id, depth, finding) of artifacts (id, parent, digest, parent_digest): how far each is from a root, or why it can't be trusted.

    A root has no parent. Findings: 'missing parent', 'parent digest' (it names another than the parent has), 'cycle', and
    'untrusted parent' for what hangs below one of these; a trusted artifact's is null, and only it has a depth. Links are
    followed by doubling: after k rounds each artifact knows the 2 ** k-th above it, so a chain of n takes log2(n) joins. A null
    id is no artifact; of rows that repeat an id none is trusted ('repeated id'), nor what names it.
    """
    ensure_checkpoint_dir(artifacts)
    rows = artifacts.where("id is not null")
    counts = rows.groupBy("id").agg(F.count("*").alias("n"), *(F.any_value(x).alias(x) for x in ("parent", "digest", "parent_digest")))
    up = counts.select(F.col("id").alias("parent"), F.col("digest").alias("have"), F.col("n").alias("of_parent"))
    finding = (
        F.when(F.col("n") > 1, "repeated id")
        .when(F.col("parent").isNull(), None)
        .when(F.col("of_parent").isNull(), "missing parent")
        .when(~F.col("have").eqNullSafe(F.col("parent_digest")), "parent digest")
    )
    links = counts.join(up, "parent", "left").select("id", finding.alias("finding"), F.when(finding.isNull(), F.col("parent")).alias("above"))
    # an artifact without a link above it is an end: a root, or a break
    state = links.select("id", "finding", "above", F.when(F.col("above").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.col("finding").isNotNull().alias("broken")).checkpoint()
    left, total = state.where("above is not null").count(), 1
    while left and total <= 2 * state.count():
        top = state.select(F.col("id").alias("above"), F.col("above").alias("further"), F.col("steps").alias("more"), F.col("broken").alias("end"))
        state = state.join(top, "above", "left").select("id", "finding", F.col("further").alias("above"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("end", "broken").alias("broken")).checkpoint()
        left, total = state.where("above is not null").count(), 2 * total
    # what still has something above it after so many steps goes round, or hangs below what does
    rounds = _on_cycles(links, state.where("above is not null"))
    state = state.join(rounds, "id", "left")
    why = F.coalesce("finding", F.when(F.col("round"), "cycle"), F.when(F.col("above").isNotNull() | F.col("broken"), "untrusted parent"))
    return state.select("id", F.when(why.isNull(), F.col("steps")).alias("depth"), why.alias("finding"))


def _on_cycles(links: DataFrame, endless: DataFrame) -> DataFrame:
    """(id, round): those of the endless ones that are on a cycle, which are the ones that some endless artifact reaches by far."""
    return endless.select(F.col("above").alias("id")).distinct().withColumn("round", F.lit(True))


def leaves(records: DataFrame, key: str, json: str) -> DataFrame:
    """(key, path, value): every scalar of each record's JSON text, at any depth, as text (a null as null); paths as $.a[0].b.

    One level is opened at a time, in the JVM, until nothing nested is left: as many rounds as the deepest record has levels.
    Text that is no JSON, and null, gives no rows; empty objects and arrays have no scalars.
    """
    ensure_checkpoint_dir(records)
    spark: SparkSession = records.sparkSession
    now = records.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(json).alias("v")).where("v is not null")
    found: DataFrame | None = None
    nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
    while True:
        now = now.withColumn("kind", F.schema_of_variant("v")).checkpoint()
        flat = now.where(~nested).select("key", "path", F.try_variant_get("v", "$", "string").alias("value"))
        found = flat if found is None else found.union(flat)
        below = now.where(nested)
        if below.isEmpty():
            return found.select(F.col("key").alias(key), "path", "value")
        below.createOrReplaceTempView("_attestor_nested")
        now = spark.sql("""
            SELECT t.key, concat(t.path, if(e.key IS NULL, concat('[', e.pos, ']'), concat('.', e.key))) AS path, e.value AS v
            FROM _attestor_nested t, LATERAL variant_explode(t.v) AS e(pos, key, value)
        """)


#: Fixed value: what a public record must not hold in any string.
PRIVATE = r"(?i)(/(home|root|mnt|users|workspaces)/[a-z0-9_.-]+|\b[a-z]:\\[a-z0-9_. -]+|https?://[^\s]*ngrok)"


def private_values(records: DataFrame, key: str, json: str, pattern: str = PRIVATE) -> DataFrame:
    """(key, path): where a record's JSON text holds a private place in a value, at any depth."""
    return leaves(records, key, json).where(F.col("value").rlike(pattern)).select(key, "path")


def tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, digest) of all files below a path as they are now."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def changed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(path, change) between two looks (path, size, modified, digest): 'added', 'removed', 'changed', or 'touched' (same bytes, other time)."""
    side = lambda df, k: df.select("path", F.struct("size", "modified", "digest").alias(k))
    both = side(first, "a").join(side(second, "b"), "path", "full")
    same = lambda x: F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}"))
    change: Column = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~(same("size") & same("digest")), "changed").when(~same("modified"), "touched")
    return both.select("path", change.alias("change")).where("change is not null")
