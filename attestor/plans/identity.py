"""Identity, projection and predicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import digests, scalars
from attestor.operators import findings

from .base import query, table

c = F.col


@query("""
SELECT o_orderkey, round(CAST(('0x' || substr(sha256('1729::' || CAST(o_custkey AS VARCHAR)), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE, 9) AS fraction
FROM orders
""")
def stable_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(digests.stable_fraction(1729, c("o_custkey")), 9).alias("fraction"))


@query("""
SELECT doc_id, sha256('204::row::' || trim(source) || '::' || trim(coalesce(lang, ''))) AS digest FROM documents
""")
def stable_digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", digests.stable_digest(204, F.lit("row"), c("source"), c("lang")).alias("digest"))


@query("""
SELECT event_id, CAST(CAST(('0x' || substr(sha256('protocol|' || user_id || '|' || event_id || '|' || event_type), 1, 16)) AS UBIGINT) AS VARCHAR) AS seed FROM events
""")
def condition_seeds(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.lit("protocol"), c("user_id").cast("string"), c("event_id").cast("string"), c("event_type")]
    return table(spark, sf, "events").select("event_id", digests.condition_seed(*parts).cast("string").alias("seed"))


@query("""
WITH m AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END AS a, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE ' ' || lang END AS b,
         'data/' || lang || '/doc_' || doc_id || '.txt' AS path FROM documents)
SELECT doc_id, coalesce(nullif(trim(a), ''), nullif(trim(coalesce(b, '')), ''), 'doc_' || doc_id) AS sample_id FROM m
""")
def id_fallback(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").select(
        "doc_id",
        F.when(c("doc_id") % 3 == 0, "  ").otherwise(c("source")).alias("a"),
        F.when(c("doc_id") % 5 != 0, F.concat(F.lit(" "), "lang")).alias("b"),
        F.concat(F.lit("data/"), "lang", F.lit("/doc_"), c("doc_id").cast("string"), F.lit(".txt")).alias("path"),
    )
    return m.select("doc_id", scalars.sample_id(c("path"), c("a"), c("b")).alias("sample_id"))


@query("""
WITH m AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'g' || o_custkey ELSE '' END AS g,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS p, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS l,
         CASE WHEN o_orderkey % 5 = 0 THEN 'd' || o_custkey END AS d FROM orders)
SELECT o_orderkey, CASE WHEN g <> '' THEN g WHEN p <> '' THEN 'patient:' || p WHEN l <> '' THEN 'lesion:' || l
  ELSE 'duplicate:' || CASE WHEN d <> '' THEN d ELSE CAST(o_orderkey AS VARCHAR) END END AS split_group FROM m
""")
def group_identifier(spark: SparkSession, sf: str) -> DataFrame:
    k, cust = c("o_orderkey"), c("o_custkey").cast("string")
    group = scalars.split_group(
        F.when(k % 7 == 0, F.concat(F.lit("g"), cust)).otherwise(""),
        F.when(k % 3 == 0, cust),
        F.when(k % 2 == 0, c("o_orderstatus")).otherwise(""),
        F.when(k % 5 == 0, F.concat(F.lit("d"), cust)),
        F.lit(None).cast("string"),
        k.cast("string"),
    )
    return table(spark, sf, "orders").select("o_orderkey", group.alias("split_group"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'exact:' || sha256(text) WHEN doc_id % 3 = 0 THEN 'isic:' || source ELSE 'record:' || doc_id END AS grp FROM documents
""")
def record_group_key(spark: SparkSession, sf: str) -> DataFrame:
    d = c("doc_id")
    key = scalars.record_group(F.when(d % 2 == 0, F.sha2("text", 256)), F.when(d % 3 == 0, c("source")).otherwise(""), d.cast("string"))
    return table(spark, sf, "documents").select("doc_id", key.alias("grp"))


@query(f"SELECT turn, conv_id, regexp_replace(coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE chr(9) || ' ' || role || chr(160) || chr(10) END, ''), '{digests.ENDS}', '', 'g') AS role FROM conversations")
def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(c("turn") % 3 != 0, F.concat(F.lit("\t "), "role", F.lit("\u00a0\n")))
    return table(spark, sf, "conversations").select("turn", "conv_id", digests.clean_text(role).alias("role"))


@query("""
SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(trim(p_brand || '-/' || p_type || '_')), '[-/_]'), lambda x: x <> ''), '_') AS tokens FROM part
""")
def source_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", scalars.source_tokens(F.concat("p_brand", F.lit("-/"), "p_type", F.lit("_"))).alias("tokens"))


SPLIT = "CASE doc_id % 6 WHEN 0 THEN 'train' WHEN 1 THEN ' Test-V3' WHEN 2 THEN 'PH2' WHEN 3 THEN 'my-ph2-copy' WHEN 4 THEN chr(9) || 'val' || chr(10) ELSE 'Train ' END"


@query(f"""
WITH m AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace({SPLIT}, '{digests.ENDS}', '', 'g')), '[-/_]'), lambda x: x <> ''), '_') AS s FROM documents)
SELECT doc_id, s AS split FROM m
WHERE NOT (s IN ('val','validation','test','test_v3','ph2','external','external_audit') OR list_contains(string_split(s, '_'), 'ph2'))
""")
def protected_filter(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "documents").select("doc_id", F.expr(SPLIT).alias("s"))
    return m.where(~scalars.is_protected(c("s"))).select("doc_id", scalars.source_tokens(c("s")).alias("split"))


ROWS = """SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN 'val' ELSE 'Train' END AS split, CASE WHEN doc_id % 40 = 3 THEN 'ph2' ELSE source END AS dataset,
 CASE WHEN doc_id % 60 = 5 THEN 'dup' ELSE CAST(doc_id AS {s}) END AS sample_id, CASE WHEN doc_id % 70 = 6 THEN ' ' ELSE lang END AS mask_path,
 CASE WHEN doc_id % 80 = 7 THEN NULL ELSE lang END AS grp FROM documents"""


@query(f"""
WITH m AS ({ROWS.format(s='VARCHAR')}), d AS (SELECT sample_id FROM m GROUP BY sample_id HAVING count(*) > 1)
SELECT doc_id, 'split' AS rule FROM m WHERE lower(trim(split)) <> 'train'
UNION ALL SELECT doc_id, 'protected' FROM m WHERE dataset = 'ph2'
UNION ALL SELECT doc_id, 'duplicate' FROM m WHERE sample_id IN (SELECT sample_id FROM d)
UNION ALL SELECT doc_id, 'path' FROM m WHERE trim(mask_path) = ''
UNION ALL SELECT doc_id, 'group' FROM m WHERE grp IS NULL
""")
def train_only_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each rule that a manifest row breaks; an empty result means the manifest may be used for training."""
    table(spark, sf, "documents").createOrReplaceTempView("documents_manifest")
    m = spark.sql(ROWS.format(s="STRING").replace("FROM documents", "FROM documents_manifest"))
    blank = lambda x: digests.clean_text(c(x)) == ""
    rules = F.array(
        F.when(F.lower(digests.clean_text(c("split"))) != "train", "split"),
        F.when(scalars.is_protected(c("split"), c("dataset")) & ~c("split").isin("val"), "protected"),
        F.when(blank("mask_path"), "path"),
        F.when(blank("grp"), "group"),
    )
    own = m.select("doc_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    twice = m.groupBy("sample_id").count().where("count > 1").select("sample_id")
    return own.union(m.join(twice, "sample_id", "left_semi").select("doc_id", F.lit("duplicate")))


@query("""
WITH seg AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN 'ST' ELSE 'A1' END AS annotator FROM lineitem),
img AS (SELECT p_partkey, CASE WHEN p_size < 25 THEN 'CC-0' WHEN p_size < 40 THEN 'CC-BY' ELSE 'other' END AS license FROM part WHERE p_partkey % 11 <> 0)
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 = 0 THEN 'blocked_existing_id' WHEN coalesce(license, '') NOT IN ('CC-0', 'CC-BY') THEN 'unaccepted_image_license' ELSE 'candidate' END AS verdict
FROM seg LEFT JOIN img ON l_partkey = p_partkey WHERE annotator = 'ST'
""")
def license_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates and exclusions with their reason: a left lookup, a blocked set and an accepted set."""
    seg = table(spark, sf, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_partkey")
    size = c("p_size")
    img = table(spark, sf, "part").where("p_partkey % 11 <> 0").select("p_partkey", F.when(size < 25, "CC-0").when(size < 40, "CC-BY").otherwise("other").alias("license"))
    joined = seg.join(img, c("l_partkey") == c("p_partkey"), "left")
    verdict = F.when(c("l_partkey") % 13 == 0, "blocked_existing_id").when(~F.coalesce("license", F.lit("")).isin("CC-0", "CC-BY"), "unaccepted_image_license").otherwise("candidate")
    return joined.select("l_orderkey", "l_linenumber", verdict.alias("verdict"))


@query("""
WITH m AS (SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > (vec_id % 20 - 5) / 20.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 'avg') AS area FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN 'shape_mismatch' WHEN area = 0 THEN 'empty_mask' WHEN area < 0.02 THEN 'mask_too_small' WHEN area > 0.5 THEN 'mask_too_large' ELSE 'ok' END AS class FROM m
""")
def mask_validity(spark: SparkSession, sf: str) -> DataFrame:
    cut = (c("vec_id") % 20 - 5) / F.lit(20.0)
    area = F.aggregate(F.transform("embedding", lambda x: F.when(x.cast("double") > cut, 1.0).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / F.size("embedding")
    m = table(spark, sf, "embeddings").select("vec_id", area.alias("area"))
    a = c("area")
    verdict = F.when(c("vec_id") % 17 == 0, "shape_mismatch").when(a == 0, "empty_mask").when(a < 0.02, "mask_too_small").when(a > 0.5, "mask_too_large").otherwise("ok")
    return m.select("vec_id", verdict.alias("class"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 5 < 122 AND l_quantity < 10 THEN 'low_brightness' WHEN l_discount >= 0.08 THEN 'blocky' WHEN l_tax < 0.02 THEN 'low_contrast' ELSE 'clean' END AS class FROM lineitem
""")
def quality_class(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that holds names the class."""
    q = c("l_quantity")
    ladder = F.when((q * 5 < 122) & (q < 10), "low_brightness").when(c("l_discount") >= 0.08, "blocky").when(c("l_tax") < 0.02, "low_contrast").otherwise("clean")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ladder.alias("class"))


@query("""
SELECT s_suppkey, 'dice' AS name, CAST(s_suppkey AS DOUBLE) / 8 AS bound FROM supplier UNION ALL SELECT s_suppkey, 'iou', CAST(s_nationkey AS DOUBLE) / 4 FROM supplier
""")
def threshold_spec(spark: SparkSession, sf: str) -> DataFrame:
    """Specs like 'dice:0.5,iou:0.25' as rows."""
    spec = F.concat(F.lit("dice:"), (c("s_suppkey") / 8).cast("string"), F.lit(",iou:"), (c("s_nationkey") / 4).cast("string"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.str_to_map(spec, F.lit(","), F.lit(":"))).alias("name", "bound"))
    return s.withColumn("bound", c("bound").cast("double"))


@query("SELECT doc_id, doc_id % 4 NOT IN (1, 2, 3) AS valid FROM documents")
def digest_format(spark: SparkSession, sf: str) -> DataFrame:
    h = F.sha2("text", 256)
    k = c("doc_id") % 4
    value = F.when(k == 1, F.upper(F.concat(F.lit("ab"), F.substring(h, 3, 62)))).when(k == 2, F.substring(h, 1, 63)).when(k == 3, F.lit(None)).otherwise(h)
    return table(spark, sf, "documents").select("doc_id", digests.is_sha256(value).alias("valid"))


@query("SELECT c_custkey, c_custkey % 4 = 0 AS valid FROM customer")
def canonical_id(spark: SparkSession, sf: str) -> DataFrame:
    k = c("c_custkey").cast("string")
    value = F.element_at(F.array(F.concat(F.lit("case-"), k), F.concat(F.lit("case-|"), k), F.concat(F.lit("case-é"), k), F.concat(F.lit("x-"), k)), (c("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", scalars.is_canonical_id(value, "case-").alias("valid"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey > 0 AND o_totalprice > 1000.0 AND lower(o_orderpriority) NOT LIKE '%urgent%'
""")
def row_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """A conjunction that reaches the scan, but for the last part."""
    o = table(spark, sf, "orders")
    return o.where(c("o_orderstatus").isin("F", "O") & (c("o_custkey") > 0) & (c("o_totalprice") > 1000.0) & ~F.lower("o_orderpriority").contains("urgent")).select("o_orderkey")


@query("""
SELECT o_orderkey, o_custkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS INTEGER) AS pos FROM orders WHERE o_orderstatus = 'P' ORDER BY o_custkey, o_orderkey LIMIT 76
""")
def holdout_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The first 76 held-out rows by group and sample; a top-k report."""
    from pyspark.sql import Window

    top = table(spark, sf, "orders").where("o_orderstatus = 'P'").orderBy("o_custkey", "o_orderkey").limit(76)
    return top.select("o_orderkey", "o_custkey", F.row_number().over(Window.orderBy("o_custkey", "o_orderkey")).alias("pos"))


@query("SELECT event_id, event_id % 5 NOT IN (1, 2, 3) AS finite FROM events")
def finite_check(spark: SparkSession, sf: str) -> DataFrame:
    k = c("event_id") % 5
    v = F.when(k == 1, float("nan")).when(k == 2, float("-inf")).when(k == 3, F.lit(None)).otherwise(c("value"))
    return table(spark, sf, "events").select("event_id", scalars.is_finite(v).alias("finite"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'not computable' ELSE printf('%.0f', floor(o_totalprice)) END AS shown FROM orders")
def numeric_display(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(c("o_orderkey") % 9 == 0, float("inf")).otherwise(F.floor("o_totalprice").cast("double"))
    return table(spark, sf, "orders").select("o_orderkey", scalars.shown_number(v, 0).alias("shown"))


@query("SELECT s_suppkey, sha256('{\"name\":\"' || s_name || '\",\"nation\":' || s_nationkey || '}') AS family FROM supplier")
def config_family(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a configuration without its seed and run id, keys in order."""
    config = F.struct(c("s_name").alias("name"), c("s_nationkey").alias("nation"), c("s_suppkey").alias("seed"))
    return table(spark, sf, "supplier").select("s_suppkey", F.sha2(F.to_json(config.dropFields("seed")), 256).alias("family"))


@query("SELECT page_id, regexp_matches(html, '/(home|root|mnt|users|Users)/[A-Za-z0-9_.-]+') OR regexp_matches(html, 'https?://[^ ]*ngrok') AS private FROM pages")
def private_path(spark: SparkSession, sf: str) -> DataFrame:
    html = c("html")
    return table(spark, sf, "pages").select("page_id", (html.rlike("/(home|root|mnt|users|Users)/[A-Za-z0-9_.-]+") | html.rlike("https?://[^ ]*ngrok")).alias("private"))


#: Path forms that documents are given by their id.
PATHS = ["concat('Runs/a', doc_id, '.txt')", "'src/m.PTH'", "'docs/x.tar.gz'", "'out/run.log'", "'a/raw_receipt.json'", "'.pytest_cache/x'", "'x/.dg-1/uploads/disk.vhdx'", "'src/ok.py'", "'a/x.bz2'",
         "'Demo/Data/r_evidence_registry.json'", "'demo/data/other.json'", "'bin/cloudflared-linux'", "'docs/job-receipts.v2.md'", "'src/.pt'", "'notes/run.log.txt'", "'a\\\\tmp\\\\b.Onnx.md'"]


@query(f"""
WITH p AS (SELECT doc_id, lower(replace(CASE doc_id % {len(PATHS)} {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(PATHS))} END, '\\', '/')) AS path FROM documents),
q AS (SELECT doc_id, path, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM p),
r AS (SELECT *, list_transform(string_split(ltrim(name, '.'), '.')[2:], lambda x: '.' || x) AS suffixes FROM q)
SELECT doc_id, 'forbidden path segment' AS finding FROM r
WHERE list_has_any(parts, ['.artifacts', 'checkpoints', 'demo_runtime', 'logs', 'masks', 'raw_receipt', 'raw_receipts', 'receipts', 'runs', 'tmp', 'uploads', 'weights'])
  OR list_contains(parts, 'data') AND NOT (path LIKE 'demo/data/%' AND path LIKE '%evidence\\_registry.json' ESCAPE '\\')
UNION ALL SELECT doc_id, 'model weight' FROM r WHERE list_has_any(suffixes, ['.ckpt', '.engine', '.mmap', '.onnx', '.pt', '.pth', '.safetensors'])
UNION ALL SELECT doc_id, 'binary archive' FROM r WHERE list_has_any(suffixes, ['.7z', '.bz2', '.docker', '.img', '.ova', '.rar', '.tar', '.tgz', '.vhd', '.vhdx', '.xz', '.zip'])
UNION ALL SELECT doc_id, 'runtime log' FROM r WHERE suffixes[-1] = '.log' OR name LIKE 'cloudflared%'
UNION ALL SELECT doc_id, 'raw receipt' FROM r WHERE contains(path, 'raw_receipt') OR regexp_matches(name, '(^|[._-])(raw[._-]?)?receipts?($|[._-])')
UNION ALL SELECT doc_id, 'scratch path' FROM r WHERE len(list_filter(parts, lambda x: regexp_matches(x, '^([.]dg-.+|[.]pt.*|[.]pytest([-_].*)?|[.]task.*|[.]p7.*)$'))) > 0
""")
def path_findings(spark: SparkSession, sf: str) -> DataFrame:
    path = F.expr(f"CASE doc_id % {len(PATHS)} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(PATHS))} END")
    return table(spark, sf, "documents").select("doc_id", F.explode(findings.path_findings(path)).alias("finding"))


@query(
    " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS finding FROM documents WHERE regexp_matches(text, '{pattern}')"
        for name, pattern in (("tunnel URL", findings.TUNNEL), ("tunnel host", findings.HOST), ("private absolute path", findings.PRIVATE), ("secret-like material", findings.SECRET))
    ).replace("\"'<>]", "\"''<>]")
    + " UNION ALL SELECT doc_id, 'oversized' FROM documents WHERE strlen(text) > 20000"
)
def content_findings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.explode(findings.content_findings(c("text"), 20000)).alias("finding"))
