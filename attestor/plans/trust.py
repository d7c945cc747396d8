"""Chains of evidence, nested records and changes of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import chains

from .base import query, table

c = F.col

#: Artifacts: each document names the one with half its id as parent, and its digest. Some name none that exists, some another digest, some are their own grandparents.
ARTIFACTS = """SELECT doc_id AS id, CASE WHEN doc_id = 0 THEN NULL WHEN doc_id % 97 = 50 THEN -1 - doc_id WHEN doc_id % 83 = 41 AND doc_id * 2 < (SELECT max(doc_id) FROM documents) THEN doc_id * 2 ELSE {half} END AS parent FROM documents"""


@query(f"""
WITH RECURSIVE p AS ({ARTIFACTS.format(half="doc_id // 2")}),
d AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS digest FROM documents),
a AS (SELECT p.id, p.parent, d.digest, CASE WHEN p.id % 61 = 30 THEN 'other' ELSE u.digest END AS parent_digest, u.digest AS have FROM p JOIN d ON p.id = d.id LEFT JOIN d u ON u.id = p.parent),
own AS (SELECT *, CASE WHEN parent IS NULL THEN NULL WHEN have IS NULL THEN 'missing parent' WHEN have IS DISTINCT FROM parent_digest THEN 'parent digest' END AS finding FROM a),
down AS (SELECT id, 0 AS depth FROM own WHERE parent IS NULL AND finding IS NULL UNION ALL SELECT o.id, depth + 1 FROM own o JOIN down w ON o.parent = w.id WHERE o.finding IS NULL),
walk AS (SELECT id AS start, parent AS cur, 1 AS n FROM own WHERE finding IS NULL AND parent IS NOT NULL UNION ALL SELECT start, o.parent, n + 1 FROM walk JOIN own o ON o.id = walk.cur WHERE o.finding IS NULL AND o.parent IS NOT NULL AND cur <> start AND n < 64),
round AS (SELECT DISTINCT start AS id FROM walk WHERE cur = start)
SELECT o.id, w.depth, CASE WHEN o.finding IS NOT NULL THEN o.finding WHEN r.id IS NOT NULL THEN 'cycle' WHEN w.id IS NULL THEN 'untrusted parent' END AS finding
FROM own o LEFT JOIN down w ON w.id = o.id LEFT JOIN round r ON r.id = o.id
""")
def trust_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents, as artifacts that name the digests of their parents, lead to the first one by sound links."""
    docs = table(spark, sf, "documents")
    docs.createOrReplaceTempView("documents")
    digest = docs.select(c("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    rows = spark.sql(ARTIFACTS.format(half="doc_id div 2")).join(digest, "id")
    named = digest.select(c("id").alias("parent"), c("digest").alias("parent_digest"))
    rows = rows.join(named, "parent", "left").withColumn("parent_digest", F.when(c("id") % 61 == 30, "other").otherwise(c("parent_digest")))
    return chains.trust_chain(rows).withColumn("depth", c("depth").cast("int"))


#: A nested record of each customer: objects, arrays and nulls four levels deep, with a private place in some.
RECORD = "named_struct('id', c_custkey, 'meta', named_struct('name', c_name, 'tags', array(c_mktsegment, if(c_custkey % 5 = 0, '/home/me/x', 'ok'))), 'runs', array(named_struct('cfg', named_struct('out', if(c_custkey % 7 = 0, 'see /mnt/d/run', 'none'), 'n', c_nationkey)), named_struct('cfg', named_struct('out', c_name, 'n', c_nationkey))))"
DUCK = "{'id': c_custkey, 'meta': {'name': c_name, 'tags': [c_mktsegment, if(c_custkey % 5 = 0, '/home/me/x', 'ok')]}, 'runs': [{'cfg': {'out': if(c_custkey % 7 = 0, 'see /mnt/d/run', 'none'), 'n': c_nationkey}}, {'cfg': {'out': c_name, 'n': c_nationkey}}]}"


@query(f"SELECT c_custkey, fullkey AS path, atom ->> '$' AS value FROM (SELECT c_custkey, to_json({DUCK}) AS j FROM customer), json_tree(j) WHERE type NOT IN ('OBJECT', 'ARRAY')")
def nested_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return chains.leaves(table(spark, sf, "customer").select("c_custkey", F.expr(f"to_json({RECORD})").alias("j")), "c_custkey", "j")


@query(f"SELECT c_custkey, fullkey AS path FROM (SELECT c_custkey, to_json({DUCK}) AS j FROM customer), json_tree(j) WHERE type = 'VARCHAR' AND regexp_matches(atom ->> '$', '/(home|root|mnt|users|workspaces)/[a-zA-Z0-9_.-]+')")
def private_values(spark: SparkSession, sf: str) -> DataFrame:
    """Private places in nested records, whatever their depth."""
    return chains.private_values(table(spark, sf, "customer").select("c_custkey", F.expr(f"to_json({RECORD})").alias("j")), "c_custkey", "j")


@query("""
WITH a AS (SELECT p_partkey AS k, p_size AS size, p_name AS t FROM part WHERE p_partkey % 11 <> 3),
b AS (SELECT p_partkey AS k, p_size AS size, CASE WHEN p_partkey % 13 = 5 THEN p_brand ELSE p_name END AS t, p_partkey % 17 = 2 AS later FROM part WHERE p_partkey % 19 <> 4)
SELECT 'f' || coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN md5(a.t) <> md5(b.t) THEN 'changed' ELSE 'touched' END AS change
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.t <> b.t OR later
""")
def tree_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Files that came, went or changed between two looks at a tree; parts stand for files."""
    part = table(spark, sf, "part")
    look = lambda text, time: [F.concat(F.lit("f"), c("p_partkey")).alias("path"), c("p_size").alias("size"), time.alias("modified"), F.sha2(text, 256).alias("digest")]
    first = part.where("p_partkey % 11 <> 3").select(*look(c("p_name"), F.lit(0)))
    second = part.where("p_partkey % 19 <> 4").select(*look(F.when(c("p_partkey") % 13 == 5, c("p_brand")).otherwise(c("p_name")), F.when(c("p_partkey") % 17 == 2, 1).otherwise(0)))
    return chains.changed(first, second)
