"""Evidence, contract, text-audit, source and stream queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import scalars
from attestor.operators import evidence
from attestor.streaming import journal

from .base import portable, query, table

c = F.col


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    x = F.abs("s_acctbal") / 10000.0
    metrics = F.struct(*((x / (i + 1)).alias(m) for i, m in enumerate(evidence.METRICS)))
    return s.select(F.to_json(F.struct(c("s_name").alias("id"), F.lit("candidate").alias("role"), c("s_nationkey").alias("rows"), metrics.alias("metrics"))).alias("report"))


@query("SELECT s_name AS id, m AS metric, round(abs(s_acctbal) / 10000.0::DOUBLE / k, 9) AS value FROM supplier, (SELECT unnest(['dice','iou','precision','recall','boundary_f1']) AS m, unnest([1,2,3,4,5]) AS k)")
def registry_observations(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.observations(_reports(spark, sf)).select("id", "metric", F.round("value", 9).alias("value"))


@query("SELECT a.s_name AS first, b.s_name AS second, m AS metric, round((abs(b.s_acctbal) - abs(a.s_acctbal)) / 10000.0::DOUBLE / k, 9) AS delta FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1, (SELECT unnest(['dice','iou','precision','recall','boundary_f1']) AS m, unnest([1,2,3,4,5]) AS k)")
def registry_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    pairs = s.select(c("s_name").alias("first"), (c("s_suppkey") + 1).alias("k")).join(s.select(c("s_suppkey").alias("k"), c("s_name").alias("second")), "k").drop("k")
    return evidence.comparisons(evidence.observations(_reports(spark, sf)), pairs).withColumn("delta", F.round("delta", 9))


@query("""
SELECT event_id, 'finite' AS rule FROM events WHERE event_id % 50 = 0
UNION ALL SELECT event_id, 'interval' FROM events WHERE event_id % 50 <> 0 AND event_id % 40 = 1
UNION ALL SELECT event_id, 'contains' FROM events WHERE event_id % 50 = 0 AND event_id % 3 <> 0 OR event_id % 50 <> 0 AND event_id % 40 = 1 AND event_id % 3 <> 0
UNION ALL SELECT event_id, 'interval' FROM events WHERE event_id % 50 = 0 AND event_id % 3 <> 0
""")
def registry_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Values that aren't finite, intervals that are reversed or only half there, values outside theirs."""
    k = c("event_id")
    v = F.when(k % 50 == 0, float("nan")).otherwise(c("value"))
    none = (k % 3 == 0) & ((k % 50 == 0) | (k % 40 == 1))
    low = F.when(none, None).when((k % 50 != 0) & (k % 40 == 1), c("value") + 2).otherwise(F.when(k % 50 == 0, float("nan")).otherwise(c("value") - 1))
    high = F.when((k % 50 != 0) & (k % 40 == 1), c("value") + 1).when(none, None).otherwise(c("value") + 1)
    e = table(spark, sf, "events").select("event_id", v.alias("v"), low.alias("lo"), high.alias("hi"))
    return evidence.violations(e, "event_id", evidence.registry_rules("v", "lo", "hi"))


portable("contract_status", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unresolved_blocked' WHEN o_totalprice < 2000 THEN 'missing_index' WHEN o_orderpriority LIKE '1%' THEN 'missing_artifact' ELSE 'ready' END AS status FROM orders
""")


@query("""
SELECT o_orderkey, 'price' AS rule FROM orders WHERE o_totalprice >= 150000 UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderpriority LIKE '5%'
""")
def protocol_contract(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.violations(table(spark, sf, "orders"), "o_orderkey", {"price": c("o_totalprice") < 150000, "priority": ~c("o_orderpriority").startswith("5")})


portable("candidate_manifest_rules", """
WITH m AS (SELECT doc_id AS idx, source AS grp, lang AS view FROM documents), d AS (SELECT grp, view, count(*) AS n FROM m GROUP BY grp, view)
SELECT 'repeated_key' AS rule, count(*) AS broken FROM d WHERE n > 20 UNION ALL SELECT 'gap', CAST(max(idx) - min(idx) + 1 - count(*) AS BIGINT) FROM m UNION ALL SELECT 'unknown_view', count(*) FROM m WHERE view NOT IN ('en', 'de')
""")

portable("artifact_chain", """
WITH a AS (SELECT doc_id, md5(text) AS digest FROM documents), pinned AS (SELECT doc_id, CASE WHEN doc_id % 33 = 0 THEN md5('other') ELSE md5(text) END AS expected FROM documents WHERE doc_id % 44 <> 1)
SELECT a.doc_id, CASE WHEN expected IS NULL THEN 'not_pinned' WHEN expected <> digest THEN 'drift' ELSE 'intact' END AS state FROM a LEFT JOIN pinned ON a.doc_id = pinned.doc_id
""")

portable("handoff_packet", """
SELECT count(CASE WHEN role = 'user' THEN 1 END) > 0 AND count(CASE WHEN role = 'assistant' THEN 1 END) > 0 AS complete, conv_id FROM conversations GROUP BY conv_id
""")

portable("release_projection", """
SELECT n.n_name AS model, r.r_name AS family, count(s.s_suppkey) AS artifacts, min(s.s_suppkey) AS first_artifact FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name, r.r_name
""")

portable("case_key", """
SELECT doc_id, sha2(concat_ws(chr(31), concat(CAST(length(source) AS STRING), ':', source), concat(CAST(length(lang) AS STRING), ':', lang)), 256) AS case_key FROM documents
""", "SELECT doc_id, sha256(concat_ws(chr(31), length(source) || ':' || source, length(lang) || ':' || lang)) AS case_key FROM documents")

portable("gate_audit", """
WITH g AS (SELECT 'a' AS gate, 50000.0D AS required UNION ALL SELECT 'b', 100000.0D UNION ALL SELECT 'z', 1.0D), o AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS gate, avg(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT g.gate, round(v, 4) AS observed, CASE WHEN v IS NULL THEN 'blocked' WHEN v >= required THEN 'passed' ELSE 'failed' END AS status FROM g LEFT JOIN o ON g.gate = o.gate
""", """
WITH g AS (SELECT 'a' AS gate, 50000.0::DOUBLE AS required UNION ALL SELECT 'b', 100000.0::DOUBLE UNION ALL SELECT 'z', 1.0::DOUBLE), o AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'b' END AS gate, avg(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT g.gate, round(v, 4) AS observed, CASE WHEN v IS NULL THEN 'blocked' WHEN v >= required THEN 'passed' ELSE 'failed' END AS status FROM g LEFT JOIN o ON g.gate = o.gate
""")

# text audit


@query("SELECT item_id, len(list_filter(regexp_split_to_array(text, '[.;!?]\\s+'), lambda x: trim(x) <> ''))::BIGINT AS clauses FROM benchmark")
def clause_counts(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    found = evidence.clauses(b, "item_id", "text").groupBy("item_id").agg(F.count("*").alias("clauses"))
    return b.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("clauses", F.lit(0)).alias("clauses"))


@query("SELECT p_partkey, unnest(regexp_extract_all('cost ' || p_retailprice || ' and ' || (p_size + 0.5), '[-+]?[0-9]+\\.[0-9]+')) AS token FROM part")
def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("cost "), c("p_retailprice").cast("string"), F.lit(" and "), (c("p_size") + F.lit(0.5)).cast("string"))
    return evidence.numbers(table(spark, sf, "part").select("p_partkey", text.alias("text")), ["p_partkey"], "text")


portable("regex_extraction", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1) AS digits FROM customer")


@query("SELECT page_id, lower(split_part(url, '/', -1)) AS name, trim(regexp_replace(lower(html), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS phrase FROM pages")
def phrases(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", scalars.basename(c("url")).alias("name"), scalars.phrase(c("html")).alias("phrase"))


@query("SELECT n_nationkey, replace(replace('50% & ' || n_name || '_$#', '&', '\\&'), '%', '\\%') AS part, 0 AS zero FROM nation")
def tex_escapes(spark: SparkSession, sf: str) -> DataFrame:
    text = scalars.tex_escape(F.concat(F.lit("50% & "), "n_name", F.lit("_$#")))
    plain = F.replace(F.replace(F.replace(text, F.lit("\\_"), F.lit("_")), F.lit("\\$"), F.lit("$")), F.lit("\\#"), F.lit("#"))
    return table(spark, sf, "nation").select("n_nationkey", plain.alias("part"), F.lit(0).alias("zero"))


# scalar functions

portable("nested_access", "SELECT event_id, get_json_object(to_json(named_struct('a', named_struct('v', event_type))), '$.a.v') AS kind FROM events", "SELECT event_id, event_type AS kind FROM events")


@query("SELECT event_id, map_extract_value(MAP {'value': round(value, 3), 'user': user_id::DOUBLE}, 'user') AS user_value FROM events")
def map_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.element_at(F.create_map(F.lit("value"), F.round("value", 3), F.lit("user"), c("user_id").cast("double")), "user").alias("user_value"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_discount * 255.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS half_up, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS half_even, round(1 / (1 + exp(-greatest(-80, least(80, l_tax * 10)))), 9) AS squashed FROM lineitem")
def rounding_rules(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", scalars.quantized(c("l_discount")).alias("half_up"), F.rint(c("l_quantity") / 2).cast("int").alias("half_even"), F.round(scalars.sigmoid(c("l_tax") * 10), 9).alias("squashed"))


portable("deep_overlay", "SELECT s_suppkey, map_zip_with(map('a', 1, 'b', s_nationkey), map('b', 7), (k, x, y) -> coalesce(y, x))['a'] AS a, map_zip_with(map('a', 1, 'b', s_nationkey), map('b', 7), (k, x, y) -> coalesce(y, x))['b'] AS b FROM supplier", "SELECT s_suppkey, 1 AS a, 7 AS b FROM supplier")
portable("base64_envelope", "SELECT n_nationkey, base64(CAST(n_name AS BINARY)) AS envelope FROM nation", "SELECT n_nationkey, to_base64(n_name::BLOB) AS envelope FROM nation")
portable("iso_time", "SELECT event_id, date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS at FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
portable("interval_format", "SELECT s_suppkey, format_string('[%.2f, %.2f]', s_acctbal - 1, s_acctbal + 1) AS shown FROM supplier", "SELECT s_suppkey, printf('[%.2f, %.2f]', s_acctbal - 1, s_acctbal + 1) AS shown FROM supplier")


@query("SELECT n_nationkey, sha256(n_name || 'x' || n_regionkey || 'x3|') AS a FROM nation")
def image_digests(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", F.sha2(F.concat(F.concat("n_name", F.lit("x"), c("n_regionkey").cast("string"), F.lit("x3|")).cast("binary"), F.lit("").cast("binary")), 256).alias("a"))


# sources and merges

portable("required_files", "SELECT source, array_join(array_sort(collect_set(lang)), ',') AS needs FROM documents GROUP BY source", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS needs FROM documents GROUP BY source")


@query("SELECT vec_id, CASE WHEN max(v) > 0.2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS any_hit, round(avg(v), 6) AS soft FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) x GROUP BY vec_id")
def merged_annotations(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.when(F.array_max("v") > 0.2, 1.0).otherwise(0.0).alias("any_hit"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), 6).alias("soft"))


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'en'")
def manifest_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """CSV lines by an explicit all-string schema, then cast."""
    lines = table(spark, sf, "documents").select(F.to_csv(F.struct("doc_id", "source", "lang")).alias("line"))
    r = lines.select(F.from_csv("line", "doc_id string, source string, lang string").alias("r")).select("r.*")
    return r.where("lang = 'en'").withColumn("doc_id", c("doc_id").cast("long"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, round(CAST(embedding[64] AS DOUBLE), 6) AS last_value FROM embeddings")
def packed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first_value"), F.round(F.get("embedding", F.lit(63)).cast("double"), 6).alias("last_value"))


# streams


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s
""")
def session_batches(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    return journal.sessions(e).select("user_id", F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n", F.round("total", 4).alias("total"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def tumbling_days(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    return journal.tumbling(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def session_latest(spark: SparkSession, sf: str) -> DataFrame:
    return journal.latest(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY event_type")
def journal_latest(spark: SparkSession, sf: str) -> DataFrame:
    return journal.latest(table(spark, sf, "events").select("event_type", "ts"), "event_type", "ts").select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, turn // 2 AS g, max(turn // 2) OVER (PARTITION BY conv_id) AS m FROM conversations) x WHERE g = m")
def current_generation(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "conversations").select("conv_id", "turn", F.floor(c("turn") / 2).alias("g"))
    return journal.current_generation(r, "conv_id", "g").select("conv_id", "turn")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A real stream over the events file, run until it has read all there is."""
    import uuid

    name = f"events_{uuid.uuid4().hex}"
    source = spark.readStream.schema(journal.EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events*")
    q = source.groupBy("event_type").agg(F.count("*").alias("n")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.table(name)


@query()
def region_forest(spark: SparkSession, sf: str) -> DataFrame:
    """A random forest on grid-region features, scored out of five folds by group; tree parameters as in production.

    Features are found once. They lie in one part a core: each pass over them yields the figures of all nodes for each part.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from attestor.operators.graphs import ensure_checkpoint_dir

    from .pixels import grids

    p = grids(spark, sf).repartition(spark.sparkContext.defaultParallelism, "vec_id").select("vec_id", F.posexplode("g").alias("i", "g"))
    region = (F.floor(c("i") / 32) * 2 + F.floor((c("i") % 8) / 4)).cast("int")
    f = p.groupBy("vec_id", region.alias("region")).agg(F.avg("g").alias("m"), F.stddev_pop("g").alias("s"), F.max("g").alias("hi"), F.avg((c("g") > 140).cast("double")).alias("label"))
    data = VectorAssembler(inputCols=["m", "s", "hi"], outputCol="features").transform(f).withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(5)))
    ensure_checkpoint_dir(data)
    data = data.sortWithinPartitions("vec_id", "region").checkpoint()
    parts = []
    for fold in range(5):
        model = RandomForestRegressor(numTrees=96, maxDepth=12, minInstancesPerNode=3, featureSubsetStrategy="0.75", subsamplingRate=0.65, seed=205, maxMemoryInMB=512, cacheNodeIds=True).fit(data.where(c("fold") != fold))
        parts.append(model.transform(data.where(c("fold") == fold)))
    out = reduce(DataFrame.union, parts)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg((c("prediction") - c("label")) ** 2)).alias("rmse"))


