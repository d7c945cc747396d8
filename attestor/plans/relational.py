"""Joins, aggregates, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions import digests, scalars
from attestor.operators import gates, graphs, ranking, resampling, splits

from .base import portable, query, table

c = F.col

# joins

portable("unique_name_join", """
WITH want AS (SELECT doc_id, lower(concat('DOC_', CAST(doc_id % 700 AS STRING), '.PNG')) AS name FROM documents),
have AS (SELECT lower(concat('doc_', CAST(doc_id % 800 AS STRING), '.png')) AS name, max(doc_id) AS file_id, count(*) AS files FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN files IS NULL THEN 'missing' WHEN files > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN files = 1 THEN file_id END AS file_id
FROM want LEFT JOIN have ON want.name = have.name
""".replace("AS STRING", "AS VARCHAR(20)"))

portable("exact_text_leakage", """
SELECT count(*) AS shared_texts FROM (
  SELECT md5(text) AS h FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT md5(text) AS h FROM documents WHERE doc_id % 5 <> 0) x
""")

FRACTION = "CAST(('0x' || substr(sha256('1729::' || o_custkey), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE"


@query(f"""
WITH r AS (SELECT o_orderkey, o_custkey, {FRACTION} AS f, o_orderkey % 97 = 0 AS moved FROM orders),
s AS (SELECT *, CASE WHEN moved THEN 'val' WHEN f < 0.7 THEN 'train' WHEN f < 0.85 THEN 'val' ELSE 'test' END AS split FROM r),
g AS (SELECT o_custkey, count(DISTINCT split) AS splits, count(*) AS n FROM s GROUP BY o_custkey)
SELECT splits, count(*) AS groups_found, CAST(sum(n) AS BIGINT) AS rows_found FROM g GROUP BY splits
""")
def leakage_audit_groups(spark: SparkSession, sf: str) -> DataFrame:
    f = digests.stable_fraction(1729, c("o_custkey"))
    s = table(spark, sf, "orders").select("o_custkey", F.when(c("o_orderkey") % 97 == 0, "val").when(f < 0.7, "train").when(f < 0.85, "val").otherwise("test").alias("split"))
    g = s.groupBy("o_custkey").agg(F.countDistinct("split").alias("splits"), F.count("*").alias("n"))
    return g.groupBy("splits").agg(F.count("*").alias("groups_found"), F.sum("n").alias("rows_found"))


portable("composite_lookup", """
SELECT e.event_id, m.n AS matched, round(e.value - m.mean, 6) AS delta
FROM events e JOIN (SELECT user_id, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY user_id, event_type) m ON e.user_id = m.user_id AND e.event_type = m.event_type
""")

portable("row_equality", """
SELECT 'left' AS side, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey AS k FROM customer) a
UNION ALL SELECT 'right', count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier) b
""")

portable("holdout_parity", """
WITH h AS (SELECT doc_id, md5(text) AS d FROM documents WHERE doc_id % 3 = 0), k AS (SELECT doc_id, CASE WHEN doc_id % 30 = 0 THEN 'changed' ELSE md5(text) END AS d FROM documents WHERE doc_id % 90 <> 3)
SELECT count(*) AS expected, count(k.doc_id) AS matched, count(CASE WHEN h.d <> k.d THEN 1 END) AS mismatched FROM h LEFT JOIN k ON h.doc_id = k.doc_id
""")

portable("role_equality", """
SELECT a.conv_id, count(*) AS turns, count(CASE WHEN a.role = b.role THEN 1 END) AS repeated_roles
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY a.conv_id
""")

portable("paired_arms", """
SELECT l_orderkey, round(avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) - avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END), 4) AS delta
FROM lineitem GROUP BY l_orderkey HAVING count(CASE WHEN l_linestatus = 'O' THEN 1 END) > 0 AND count(CASE WHEN l_linestatus = 'F' THEN 1 END) > 0
""")

portable("comparison_consistency", """
WITH o AS (SELECT event_type AS id, avg(value) AS v FROM events GROUP BY event_type)
SELECT a.id AS first_id, b.id AS second_id, round(a.v - b.v, 6) AS delta FROM o a JOIN o b ON a.id < b.id
""")

portable("undefined_keys", """
SELECT doc_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.doc_id % 7 <> 0)
""")

portable("unused_entries", "SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 20", "SELECT p_partkey FROM part ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 20")

portable("fk_violations", """
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)
""")


@query("""
WITH m AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at, role FROM conversations),
p AS (SELECT a.conv_id, a.turn, b.turn AS mention, rank() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS r
      FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.role = 'user' WHERE a.role <> 'user')
SELECT conv_id, turn, mention FROM p WHERE r = 1
""")
def nearest_mention(spark: SparkSession, sf: str) -> DataFrame:
    """For each other turn the closest user turn before it: a running maximum instead of a range join."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    m = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.max(F.when(c("role") == "user", c("turn"))).over(before).alias("mention"))
    return m.where((c("role") != "user") & c("mention").isNotNull()).select("conv_id", "turn", "mention")


@query("""
WITH w AS (SELECT DISTINCT round(ps, 2) AS token FROM (SELECT p_retailprice AS ps FROM part)), k AS (SELECT DISTINCT c_acctbal AS v FROM customer)
SELECT token, count(v) > 0 AS supported FROM w LEFT JOIN k ON abs(token) = abs(v) OR round(abs(token), 4) = round(abs(v), 4) GROUP BY token
""")
def number_support(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a number is known, up to its sign and to four digits: an equi-join on the rounded absolute value."""
    w = table(spark, sf, "part").select(F.round("p_retailprice", 2).alias("token")).distinct()
    k = table(spark, sf, "customer").select(F.round(F.abs("c_acctbal"), 4).alias("v")).distinct()
    return w.join(k, F.round(F.abs("token"), 4) == c("v"), "left").select("token", c("v").isNotNull().alias("supported"))


portable("row_number_lookup", """
SELECT d.doc_id, length(t.line) AS length FROM documents d JOIN (SELECT doc_id, split_part(text, chr(10), 2) AS line FROM documents) t ON d.doc_id = t.doc_id WHERE length(t.line) > 0
""")

# aggregates

portable("metric_means", "SELECT event_type, round(avg(value), 6) AS mean_value, round(avg(CAST(user_id AS DOUBLE)), 6) AS mean_user, count(*) AS n FROM events GROUP BY event_type")

portable("median_by_condition", "SELECT event_type, round(percentile(value, 0.5D), 8) AS median_value FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 8) AS median_value FROM events GROUP BY event_type")

portable("p95_by_condition", "SELECT event_type, round(percentile(value, 0.95D), 8) AS p95 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.95), 8) AS p95 FROM events GROUP BY event_type")

portable("flag_rate", "SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0D ELSE 0.0D END), 9) AS rate FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS rate FROM lineitem GROUP BY l_returnflag")

portable("screen_summary", """
SELECT coalesce(event_type, 'overall') AS scope, count(*) AS n, round(avg(value), 6) AS mean_value, round(percentile(value, 0.5D), 6) AS median_value
FROM events GROUP BY GROUPING SETS ((event_type), ())
""", """
SELECT coalesce(event_type, 'overall') AS scope, count(*) AS n, round(avg(value), 6) AS mean_value, round(quantile_cont(value, 0.5), 6) AS median_value
FROM events GROUP BY GROUPING SETS ((event_type), ())
""")

portable("nested_median", "SELECT round(percentile(m, 0.5D), 6) AS median_of_means FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id) x", "SELECT round(quantile_cont(m, 0.5), 6) AS median_of_means FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id) x")

portable("worst_group", "SELECT round(min(m), 6) AS least, round(max(m), 6) AS greatest FROM (SELECT event_type, percentile(value, 0.5D) AS m FROM events GROUP BY event_type) x", "SELECT round(min(m), 6) AS least, round(max(m), 6) AS greatest FROM (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY event_type) x")

portable("count_equality", """
WITH h AS (SELECT r_regionkey AS k, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey)
SELECT k, n, n = 5 AS as_expected FROM h
""")

portable("uniqueness", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders_seen, count(*) = count(DISTINCT l_orderkey) AS is_unique FROM lineitem")

portable("consensus_check", "SELECT l_suppkey, count(DISTINCT l_linestatus) = 1 AS agreed, min(l_linestatus) AS first_status FROM lineitem GROUP BY l_suppkey")

portable("view_completeness", """
SELECT user_id, count(DISTINCT event_type) AS views, count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AS complete FROM events GROUP BY user_id
""")

portable("contiguous_index", """
SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY l_orderkey
""")

MASKS = """WITH px AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings),
prs AS (SELECT a.vec_id, a.i, CAST(a.v AS DOUBLE) > 0.1::DOUBLE AS p, CAST(b.v AS DOUBLE) > 0.1::DOUBLE AS q FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.i = b.i),
k AS (SELECT vec_id, sum(CASE WHEN p AND q THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN p AND NOT q THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN q AND NOT p THEN 1 ELSE 0 END)::DOUBLE AS fn FROM prs GROUP BY vec_id)
"""


def mask_pairs(spark: SparkSession, sf: str, threshold: float) -> DataFrame:
    """Pixels of each 8 x 8 grid and of the next one: vec_id, i, p, q."""
    e = table(spark, sf, "embeddings")
    a = e.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    b = e.select((c("vec_id") - 1).alias("vec_id"), F.posexplode("embedding").alias("i", "w"))
    return a.join(b, ["vec_id", "i"]).select("vec_id", "i", (c("v").cast("double") > threshold).alias("p"), (c("w").cast("double") > threshold).alias("q"))


@query(MASKS + """SELECT vec_id, tp, fp, fn, round(CASE WHEN 2*tp+fp+fn = 0 THEN 1 ELSE 2*tp/(2*tp+fp+fn) END, 9) AS dice, round(CASE WHEN tp+fp+fn = 0 THEN 1 ELSE tp/(tp+fp+fn) END, 9) AS iou,
 round(CASE WHEN tp+fp = 0 THEN 1 ELSE tp/(tp+fp) END, 9) AS precision, round(CASE WHEN tp+fn = 0 THEN 1 ELSE tp/(tp+fn) END, 9) AS recall FROM k""")
def mask_confusion(spark: SparkSession, sf: str) -> DataFrame:
    o = ranking.overlap(mask_pairs(spark, sf, 0.1), ["vec_id"], c("p"), c("q"))
    return o.select("vec_id", "tp", "fp", "fn", *(F.round(x, 9).alias(x) for x in ("dice", "iou", "precision", "recall")))


@query(MASKS.replace("0.1::DOUBLE", "0.32::DOUBLE") + """SELECT vec_id, round(CASE WHEN 2*tp+fp+fn = 0 THEN 1 ELSE 2*tp/(2*tp+fp+fn) END, 9) AS dice,
 round(CASE WHEN tp+fp = 0 THEN CASE WHEN fn = 0 THEN 1 ELSE 0 END ELSE tp/(tp+fp) END, 9) AS precision, round(CASE WHEN tp+fn = 0 THEN CASE WHEN fp = 0 THEN 1 ELSE 0 END ELSE tp/(tp+fn) END, 9) AS recall FROM k""")
def strict_confusion(spark: SparkSession, sf: str) -> DataFrame:
    o = ranking.overlap(mask_pairs(spark, sf, 0.32), ["vec_id"], c("p"), c("q"), strict=True)
    return o.select("vec_id", *(F.round(x, 9).alias(x) for x in ("dice", "precision", "recall")))


portable("ordered_digest", "SELECT conv_id, sha2(array_join(sort_array(collect_list(concat(lpad(CAST(turn AS STRING), 6, '0'), '|', role, chr(10)))), ''), 256) AS digest FROM conversations GROUP BY conv_id",
    "SELECT conv_id, sha256(string_agg(lpad(CAST(turn AS VARCHAR), 6, '0') || '|' || role || chr(10), '' ORDER BY lpad(CAST(turn AS VARCHAR), 6, '0') || '|' || role || chr(10))) AS digest FROM conversations GROUP BY conv_id")

portable("row_list_digest", "SELECT o_custkey, sha2(concat('[', array_join(sort_array(collect_list(CAST(o_orderkey AS STRING))), ','), ']'), 256) AS digest FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, sha256('[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) || ']') AS digest FROM orders GROUP BY o_custkey")

portable("best_of", """
SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey
""", """
SELECT o_custkey, o_orderkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS r FROM orders) x WHERE r = 1
""")

portable("first_findings", """
SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY source
""")

# windows and orderings

SCORED = "SELECT l.doc_id, d.lang, CAST(d.n_chars AS DOUBLE) AS s, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", c("n_chars").cast("double").alias("s")), "doc_id")


@query(f"WITH x AS ({SCORED}) SELECT doc_id, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS mid FROM x")
def mid_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Mid ranks of all rows: one row per distinct score is ranked and joined back."""
    x = scored(spark, sf).withColumn("all", F.lit(1))
    return x.join(ranking.mid_ranks(x, ["all"], "s"), ["all", "s"]).select("doc_id", "mid")


@query(f"""
WITH x AS ({SCORED}), r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0::DOUBLE AS mid FROM x),
a AS (SELECT lang, sum(CASE WHEN quality = 1 THEN mid ELSE 0 END) AS rs, sum(quality)::DOUBLE AS p, count(*) - sum(quality)::DOUBLE AS n FROM r GROUP BY lang)
SELECT lang, round(CASE WHEN p > 0 AND n > 0 THEN (rs - p * (p + 1) / 2) / (p * n) END, 9) AS auroc FROM a
""")
def auroc_ties(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.auroc(scored(spark, sf), ["lang"], "s", c("quality") == 1).select("lang", F.round("auroc", 9).alias("auroc"))


@query(f"""
WITH x AS ({SCORED}), d AS (SELECT lang, s, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS pos FROM x GROUP BY lang, s),
w AS (SELECT lang, pos, sum(pos) OVER v AS tp, sum(n) OVER v AS al FROM d WINDOW v AS (PARTITION BY lang ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, round(sum(pos * tp / al) / sum(pos), 9) AS auprc FROM w GROUP BY lang
""")
def auprc_ties(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.average_precision(scored(spark, sf), ["lang"], "s", c("quality") == 1).select("lang", F.round("auprc", 9).alias("auprc"))


@query(f"""
WITH x AS ({SCORED}), r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2.0::DOUBLE AS b FROM x)
SELECT lang, round(CASE WHEN var_pop(a) * var_pop(b) <= 1e-12 THEN 0 ELSE corr(a, b) END, 8) AS spearman FROM r GROUP BY lang
""")
def spearman_ties(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.spearman(scored(spark, sf), ["lang"], "s", "quality").select("lang", F.round("spearman", 8).alias("spearman"))


@query(f"WITH x AS ({SCORED}) SELECT lang, round(sum(CASE WHEN quality = 1 THEN s ELSE 0 END) / sum(s), 9) AS mass FROM x GROUP BY lang")
def mass_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.mass_concentration(scored(spark, sf), ["lang"], "s", c("quality") == 1).select("lang", F.round("mass", 9).alias("mass"))


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('204::row::' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, source FROM r WHERE r = 1 ORDER BY sha256('204::group::' || source), doc_id LIMIT 256
""")
def sample_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """One row per group by least digest (map-side minima, no window), then the first 256 groups by digest."""
    key = F.struct(digests.stable_digest(204, F.lit("row"), c("doc_id")), c("doc_id"))
    one = table(spark, sf, "documents").groupBy("source").agg(F.min_by("doc_id", key).alias("doc_id"))
    return one.orderBy(digests.stable_digest(204, F.lit("group"), c("source")), "doc_id").limit(256).select("doc_id", "source")


@query("""
WITH p AS (SELECT doc_id, sha256(text) AS h, CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END AS prio FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY prio DESC, CAST(doc_id AS VARCHAR) DESC) AS r FROM p)
SELECT doc_id, CASE WHEN r = 1 THEN 'kept' ELSE 'duplicate_lower_priority' END AS outcome FROM r
""")
def dedupe_winner(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal texts the one of highest source priority, then of greatest id: a grouped maximum joined back."""
    prio = F.when(c("source") == "src0", 3).when(c("source") == "src1", 2).otherwise(1)
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.struct(prio, c("doc_id").cast("string")).alias("rank"))
    best = rows.groupBy("h").agg(F.max("rank").alias("best"))
    return rows.join(best, "h").select("doc_id", F.when(c("rank") == c("best"), "kept").otherwise("duplicate_lower_priority").alias("outcome"))


@query("""
WITH RECURSIVE k AS (SELECT doc_id AS n, 'h' || sha256(text) AS v FROM documents UNION ALL SELECT doc_id, 'c' || lang || n_chars FROM documents WHERE n_chars > 2000),
e AS (SELECT DISTINCT a.n AS u, b.n AS v FROM k a JOIN k b ON a.v = b.v), c AS (SELECT n, n AS l FROM (SELECT DISTINCT n FROM k) x UNION SELECT e.v, c.l FROM c JOIN e ON c.n = e.u AND c.l < e.v)
SELECT n AS doc_id, min(l) AS component FROM c GROUP BY n
""")
def duplicate_components(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.when(c("n_chars") > 2000, F.concat("lang", c("n_chars").cast("string"))).alias("size"))
    return graphs.shared_key_components(rows, "doc_id", ["h", "size"])


@query()
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "orders").groupBy(c("o_custkey").cast("string").alias("grp")).agg(F.count("*").alias("n"))
    return splits.split_groups(sizes, {"train": 0.7, "val": 0.15, "test": 0.15}, 42)


@query()
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "orders").groupBy(c("o_custkey").cast("string").alias("grp")).agg(F.count("*").alias("n"))
    return splits.fold_groups(sizes, 5, 205)


portable("running_ordinal", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) - 1 AS BIGINT) AS ordinal FROM orders")

portable("neighbour_differences", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice), 4) AS jump FROM lineitem")

portable("percentile_stretch", """
WITH b AS (SELECT event_type, percentile(value, 0.01D) AS lo, percentile(value, 0.99D) AS hi FROM events GROUP BY event_type)
SELECT event_id, round(greatest(0.0D, least(1.0D, (value - lo) / (hi - lo))), 6) AS stretched FROM events JOIN b ON events.event_type = b.event_type
""", """
WITH b AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY event_type)
SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - lo) / (hi - lo))), 6) AS stretched FROM events JOIN b ON events.event_type = b.event_type
""")

portable("top_samples", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 256")

portable("groups_by_size", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, md5(CAST(o_custkey AS VARCHAR(20))) LIMIT 100")

portable("config_ranking", "SELECT s_nationkey, round(sum(s_acctbal), 2) AS score, rank() OVER (ORDER BY sum(s_acctbal) DESC) AS place FROM supplier GROUP BY s_nationkey")

portable("sorted_observations", "SELECT n_name, n_regionkey FROM nation ORDER BY n_name")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS r, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, CASE WHEN r = 1 THEN 'first' WHEN r = n // 2 + 1 THEN 'middle' ELSE 'last' END AS place FROM r WHERE r IN (1, n // 2 + 1, n)
""")
def first_middle_last(spark: SparkSession, sf: str) -> DataFrame:
    """Three rows of a sorted universe; the count comes from a plain aggregate, the places from a sorted limit."""
    rows = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    n = rows.count()
    numbered = rows.orderBy("o_custkey", "o_orderkey").limit(n // 2 + 1).withColumn("r", F.row_number().over(Window.orderBy("o_custkey", "o_orderkey")))
    last = rows.orderBy(F.desc("o_custkey"), F.desc("o_orderkey")).limit(1).select("o_orderkey", F.lit("last").alias("place"))
    head = numbered.where(c("r").isin(1, n // 2 + 1)).select("o_orderkey", F.when(c("r") == 1, "first").otherwise("middle").alias("place"))
    return head.union(last)


@query("""
WITH d AS (SELECT p_partkey, abs(p_size - 10) AS a, abs(p_size - 35) AS b FROM part)
SELECT p_partkey, CASE WHEN a <= b THEN 'small' ELSE 'large' END AS nearest, abs(a - b) AS margin FROM d
""")
def nearest_centroid(spark: SparkSession, sf: str) -> DataFrame:
    near = F.sort_array(F.array(F.struct(F.abs(c("p_size") - 10).alias("d"), F.lit(0).alias("i"), F.lit("small").alias("name")), F.struct(F.abs(c("p_size") - 35).alias("d"), F.lit(1).alias("i"), F.lit("large").alias("name"))))
    p = table(spark, sf, "part").select("p_partkey", near.alias("near"))
    return p.select("p_partkey", c("near")[0]["name"].alias("nearest"), (c("near")[1]["d"] - c("near")[0]["d"]).alias("margin"))


# sets

portable("set_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
portable("set_equality", "SELECT (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation) a) = 0 AND (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region) b) = 0 AS same")
portable("set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
portable("union_by_reason", "SELECT doc_id, CAST(NULL AS VARCHAR(20)) AS reason FROM documents WHERE n_chars >= 200 UNION ALL SELECT doc_id, 'too_short' FROM documents WHERE n_chars < 200")
portable("distinct_in_order", "SELECT source, min(doc_id) AS first_id, row_number() OVER (ORDER BY min(doc_id)) AS place FROM documents GROUP BY source")

# statistics

BOOT = """
, o AS (SELECT k, v, row_number() OVER (ORDER BY k) - 1 AS i FROM d), n AS (SELECT count(*) AS n FROM d),
r AS (SELECT t.it, CAST(('0x' || substr(md5('{seed}:' || t.it || ':' || g.dr), 1, 8)) AS UBIGINT) % n.n AS i FROM n, range(0, {it}) t(it), (SELECT unnest(range(0, (SELECT n FROM n))) AS dr) g),
m AS (SELECT it, quantile_cont(v, 0.5) AS m FROM r JOIN o USING (i) GROUP BY it)
SELECT (SELECT round(quantile_cont(v, 0.5), 6) FROM d) AS estimate, (SELECT CAST(n AS INTEGER) FROM n) AS n, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper, CAST(count(*) AS INTEGER) AS iterations FROM m
"""
ROUNDED = ["estimate", "n", "lower", "upper", "iterations"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(x, 6).alias(x) if x in ("estimate", "lower", "upper") else c(x) for x in ROUNDED))


@query("WITH d AS (SELECT user_id AS k, avg(CASE WHEN event_type = 'click' THEN value END) - avg(CASE WHEN event_type = 'view' THEN value END) AS v FROM events GROUP BY user_id HAVING v IS NOT NULL)" + BOOT.format(seed=204, it=2000))
def paired_bootstrap_hash(spark: SparkSession, sf: str) -> DataFrame:
    arm = lambda x: F.avg(F.when(c("event_type") == x, c("value")))
    d = table(spark, sf, "events").groupBy("user_id").agg((arm("click") - arm("view")).alias("v")).where("v is not null")
    return _rounded(resampling.bootstrap_median(d, "user_id", "v", 2000, 204))


@query("WITH p AS (SELECT user_id, event_type, avg(value) AS x FROM events GROUP BY user_id, event_type), d AS (SELECT user_id AS k, avg(x) AS v FROM p GROUP BY user_id)" + BOOT.format(seed=206, it=2000))
def cluster_bootstrap_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The mean over a sample's views first, then the median over samples."""
    d = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("x")).groupBy("user_id").agg(F.avg("x").alias("v"))
    return _rounded(resampling.bootstrap_median(d, "user_id", "v", 2000, 206))


@query("""
WITH g AS (SELECT unnest([0.01, 0.02, 0.03, 0.04]) AS t UNION ALL SELECT round(0.05 + 0.025 * i, 3) FROM range(0, 19) x(i)),
px AS (SELECT vec_id, vec_id % 3 AS cond, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings),
k AS (SELECT g.t, cond, vec_id, sum(CASE WHEN v >= t AND i % 8 >= 4 THEN 1 ELSE 0 END) / 32.0 AS coverage, sum(CASE WHEN v >= t THEN 1 ELSE 0 END) / 64.0 AS support,
  2.0 * sum(CASE WHEN v >= t AND i % 8 >= 4 THEN 1 ELSE 0 END) / (32 + sum(CASE WHEN v >= t THEN 1 ELSE 0 END)) AS dice FROM px, g GROUP BY g.t, cond, vec_id),
m AS (SELECT t, cond, quantile_cont(coverage, 0.5) AS coverage, quantile_cont(support, 0.5) AS support, quantile_cont(dice, 0.5) AS dice FROM k GROUP BY t, cond)
SELECT t AS threshold, round(min(coverage), 6) AS min_coverage, round(max(support), 6) AS max_support, round(max(dice), 6) AS best_dice, min(coverage) >= 0.3 AND max(support) <= 0.65 AS feasible FROM m GROUP BY t
""")
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Each of 23 thresholds by condition: exact medians, worst condition, feasibility. The grid is a fixed literal array."""
    grid = [0.01, 0.02, 0.03, 0.04] + [round(0.05 + 0.025 * i, 3) for i in range(19)]
    e = table(spark, sf, "embeddings").select("vec_id", (c("vec_id") % 3).alias("cond"), "embedding", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    hit = lambda v, i: v.cast("double") >= c("threshold")
    flags = F.transform("embedding", hit)
    right = F.filter("embedding", lambda v, i: hit(v, i) & (i % 8 >= 4))
    n = F.size(F.filter(flags, lambda x: x))
    k = e.select("threshold", "cond", (F.size(right) / 32.0).alias("coverage"), (n / 64.0).alias("support"), (2.0 * F.size(right) / (32 + n)).alias("dice"))
    m = k.groupBy("threshold", "cond").agg(*(F.expr(f"percentile({x}, 0.5D)").alias(x) for x in ("coverage", "support", "dice")))
    worst = m.groupBy("threshold").agg(F.min("coverage").alias("a"), F.max("support").alias("b"), F.max("dice").alias("d"))
    return worst.select("threshold", F.round("a", 6).alias("min_coverage"), F.round("b", 6).alias("max_support"), F.round("d", 6).alias("best_dice"), ((c("a") >= 0.3) & (c("b") <= 0.65)).alias("feasible"))


@query("""
WITH m AS (SELECT s_nationkey AS config, round(avg(s_acctbal), 6) AS score, min(s_acctbal) > -900 AS feasible FROM supplier GROUP BY s_nationkey),
r AS (SELECT *, row_number() OVER (ORDER BY feasible DESC, score DESC, config DESC) AS r FROM m)
SELECT config, score, feasible, r = 1 AS selected FROM r
""")
def best_config(spark: SparkSession, sf: str) -> DataFrame:
    """The best feasible configuration, or the best of all if none is; ties by name."""
    m = table(spark, sf, "supplier").groupBy(c("s_nationkey").alias("config")).agg(F.round(F.avg("s_acctbal"), 6).alias("score"), (F.min("s_acctbal") > -900).alias("feasible"))
    best = m.agg(F.max(F.struct("feasible", "score", "config")).alias("b"))
    return m.join(F.broadcast(best), F.lit(True)).select("config", "score", "feasible", (c("config") == c("b.config")).alias("selected"))  # one row


@query("""
WITH s AS (SELECT event_type AS scope, 'median' AS metric, quantile_cont(value, 0.5) AS value FROM events GROUP BY event_type UNION ALL SELECT 'overall', 'median', quantile_cont(value, 0.5) FROM events
 UNION ALL SELECT 'overall', 'p95', quantile_cont(value, 0.95) FROM events)
SELECT 'each_low' AS gate, '>=' AS comparison, 30.0::DOUBLE AS required, round((SELECT min(value) FROM s WHERE metric = 'median' AND scope <> 'overall'), 6) AS observed, CASE WHEN (SELECT min(value) FROM s WHERE metric = 'median' AND scope <> 'overall') >= 30 THEN 'passed' ELSE 'failed' END AS status
UNION ALL SELECT 'overall_p95', '<=', 100.0::DOUBLE, round((SELECT value FROM s WHERE metric = 'p95'), 6), CASE WHEN (SELECT value FROM s WHERE metric = 'p95') <= 100 THEN 'passed' ELSE 'failed' END
UNION ALL SELECT 'runtime', '<=', 1.5::DOUBLE, NULL, 'blocked'
""")
def gate_results(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    half = F.expr("percentile(value, 0.5D)")
    s = e.groupBy(c("event_type").alias("scope")).agg(half.alias("value")).select("scope", F.lit("median").alias("metric"), "value")
    s = s.union(e.agg(half.alias("v")).select(F.lit("overall"), F.lit("median"), "v")).union(e.agg(F.expr("percentile(value, 0.95D)").alias("v")).select(F.lit("overall"), F.lit("p95"), "v"))
    wanted = spark.createDataFrame([("each_low", "median", "each", ">=", 30.0), ("overall_p95", "p95", "overall", "<=", 100.0), ("runtime", "runtime_median", "overall", "<=", 1.5)], "gate string, metric string, scope string, comparison string, required double")
    return gates.evaluate(s, wanted).withColumn("observed", F.round("observed", 6))


ALL_GATES = [row for name in gates.PROTOCOLS for row in gates.protocol(name)]
#: What a summary holds before the rules; nobody measured the 95th percentile of the runtime.
METRICS = ["median_auroc_delta", "bootstrap_lower", "median_coverage", "median_support_area_ratio", "fallback_rate", "invalid_border_rate", "median_mass_concentration_delta", "median_auroc", "median_spearman_vs_old_proxy", "fallback_baseline", "median_auprc_delta", "median_boundary_f1_delta", "median_dice_delta", "runtime_median_seconds", "median_precision_delta", "median_recall_delta", "max_auroc_regression", "max_auprc_regression", "median_assd_relative_improvement", "median_hd95_relative_regression"]
SUMMARY = """
WITH g(gate, metric, scope, comparison, required) AS (VALUES
  ('screen.median_auroc_delta', 'median_auroc_delta', 'overall', '>=', 0.03::DOUBLE), ('screen.paired_auroc_delta_ci_lower', 'bootstrap_lower', 'overall', '>', 0.0::DOUBLE), ('screen.coverage_each_corruption', 'median_coverage', 'each', '>=', 0.97::DOUBLE),
  ('screen.support_area_ratio', 'median_support_area_ratio', 'overall', '<=', 0.65::DOUBLE), ('screen.fallback_each_corruption', 'fallback_over_limit', 'each', '<=', 0.0::DOUBLE), ('screen.invalid_border', 'invalid_border_rate', 'overall', '<=', 0.05::DOUBLE),
  ('screen.mass_concentration_delta', 'median_mass_concentration_delta', 'overall', '>=', 0.08::DOUBLE), ('screen.corruption_auroc_regression', 'auroc_regression', 'each', '<=', 0.05::DOUBLE), ('screen.old_proxy_redundancy', 'redundant', 'overall', '<=', 0.0::DOUBLE),
  ('ranking.coverage_each_corruption', 'median_coverage', 'each', '>=', 0.97::DOUBLE), ('ranking.overall_auroc_delta', 'median_auroc_delta', 'overall', '>=', 0.04::DOUBLE), ('ranking.auroc_delta_each_corruption', 'median_auroc_delta', 'each', '>=', 0.02::DOUBLE),
  ('ranking.paired_auroc_delta_ci_lower', 'bootstrap_lower', 'overall', '>', 0.0::DOUBLE), ('ranking.overall_auprc_delta', 'median_auprc_delta', 'overall', '>=', 0.03::DOUBLE), ('ranking.gaussian_noise_auprc_delta', 'median_auprc_delta', 'gaussian_noise', '>=', 0.02::DOUBLE),
  ('ranking.support_area_ratio_overall', 'median_support_area_ratio', 'overall', '<=', 0.60::DOUBLE), ('ranking.support_area_ratio_each_corruption', 'median_support_area_ratio', 'each', '<=', 0.65::DOUBLE), ('ranking.fallback_each_corruption', 'fallback_rate', 'each', '<=', 0.35::DOUBLE),
  ('ranking.clean_to_noise_auroc_degradation', 'auroc_regression', 'gaussian_noise', '<=', 0.06::DOUBLE), ('ranking.boundary_f1_delta', 'median_boundary_f1_delta', 'overall', '>=', 0.025::DOUBLE), ('ranking.dice_delta', 'median_dice_delta', 'overall', '>=', 0.015::DOUBLE),
  ('ranking.invalid_border', 'invalid_border_rate', 'overall', '<=', 0.05::DOUBLE), ('ranking.runtime_median', 'runtime_median_seconds', 'overall', '<=', 1.5::DOUBLE), ('ranking.runtime_p95', 'runtime_p95_seconds', 'overall', '<=', 3.0::DOUBLE),
  ('contour.bf1_delta_overall', 'median_boundary_f1_delta', 'overall', '>=', 0.040::DOUBLE), ('contour.bf1_delta_each_corruption', 'median_boundary_f1_delta', 'each', '>=', 0.020::DOUBLE), ('contour.bootstrap_bf1_lower', 'bootstrap_lower', 'overall', '>', 0.0::DOUBLE),
  ('contour.dice_delta', 'median_dice_delta', 'overall', '>=', -0.010::DOUBLE), ('contour.precision_delta', 'median_precision_delta', 'overall', '>=', 0.020::DOUBLE), ('contour.recall_delta', 'median_recall_delta', 'overall', '>=', -0.015::DOUBLE),
  ('contour.probability_ranking', 'max_auroc_regression', 'overall', '<=', 0.010::DOUBLE), ('contour.probability_ranking', 'max_auprc_regression', 'overall', '<=', 0.010::DOUBLE), ('contour.fallback_each_corruption', 'fallback_rate', 'each', '<=', 0.25::DOUBLE),
  ('contour.invalid_border_each_corruption', 'invalid_border_rate', 'each', '<=', 0.05::DOUBLE), ('contour.assd_relative_improvement', 'median_assd_relative_improvement', 'overall', '>=', 0.10::DOUBLE), ('contour.hd95_relative_regression', 'median_hd95_relative_regression', 'overall', '<=', 0.02::DOUBLE),
  ('contour.runtime_median', 'runtime_median_seconds', 'overall', '<=', 1.0::DOUBLE), ('contour.runtime_p95', 'runtime_p95_seconds', 'overall', '<=', 2.0::DOUBLE)),
m(metric, i) AS (VALUES ('median_auroc_delta', 0), ('bootstrap_lower', 1), ('median_coverage', 2), ('median_support_area_ratio', 3), ('fallback_rate', 4), ('invalid_border_rate', 5), ('median_mass_concentration_delta', 6), ('median_auroc', 7), ('median_spearman_vs_old_proxy', 8), ('fallback_baseline', 9), ('median_auprc_delta', 10), ('median_boundary_f1_delta', 11), ('median_dice_delta', 12), ('runtime_median_seconds', 13), ('median_precision_delta', 14), ('median_recall_delta', 15), ('max_auroc_regression', 16), ('max_auprc_regression', 17), ('median_assd_relative_improvement', 18), ('median_hd95_relative_regression', 19)),
e AS (SELECT CASE event_type WHEN 'click' THEN 'gaussian_noise' WHEN 'view' THEN 'clean' ELSE event_type END AS scope, avg(value) AS v FROM events GROUP BY 1 UNION ALL SELECT 'overall', avg(value) FROM events),
b AS (SELECT scope, metric, v / 50 - 0.0713::DOUBLE * i AS value FROM e, m),
k AS (SELECT max(value) FILTER (WHERE scope = 'clean' AND metric = 'median_auroc') AS clean, max(value) FILTER (WHERE scope = 'overall' AND metric = 'fallback_baseline') AS baseline,
  max(value) FILTER (WHERE scope = 'overall' AND metric = 'median_spearman_vs_old_proxy') AS correlation, max(value) FILTER (WHERE scope = 'overall' AND metric = 'median_auroc_delta') AS auroc,
  max(value) FILTER (WHERE scope = 'overall' AND metric = 'median_mass_concentration_delta') AS mass FROM b),
s AS (SELECT * FROM b UNION ALL SELECT scope, 'auroc_regression', clean - value FROM b, k WHERE metric = 'median_auroc' AND scope NOT IN ('overall', 'clean')
  UNION ALL SELECT scope, 'fallback_over_limit', CASE WHEN baseline - 0.15::DOUBLE >= 0 THEN value - least(0.45::DOUBLE, baseline - 0.15::DOUBLE) ELSE 'inf'::DOUBLE END FROM b, k WHERE metric = 'fallback_rate' AND scope <> 'overall'
  UNION ALL SELECT 'overall', 'redundant', CASE WHEN correlation > 0.95 AND auroc <= 0 AND mass <= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM k),
o AS (SELECT gate, comparison, required, CASE WHEN comparison LIKE '>%' THEN min(value) ELSE max(value) END AS observed FROM g LEFT JOIN s ON g.metric = s.metric AND (g.scope = s.scope OR g.scope = 'each' AND s.scope <> 'overall') GROUP BY gate, g.metric, comparison, required),
t AS (SELECT *, CASE WHEN observed IS NULL THEN 'blocked' WHEN comparison = '>=' AND observed >= required OR comparison = '>' AND observed > required OR comparison = '<=' AND observed <= required THEN 'passed' ELSE 'failed' END AS status FROM o)
"""


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    """All gates of all protocols against a summary of events by condition."""
    scope = F.when(c("event_type") == "click", "gaussian_noise").when(c("event_type") == "view", "clean").otherwise(c("event_type"))
    e = table(spark, sf, "events").select("value", scope.alias("scope"))
    e = e.groupBy("scope").agg(F.avg("value").alias("v")).union(e.agg(F.avg("value").alias("v")).select(F.lit("overall"), "v"))
    names = F.posexplode(F.array(*map(F.lit, METRICS))).alias("i", "metric")
    s = e.select("scope", "v", names).select("scope", "metric", (c("v") / 50 - F.lit(0.0713) * c("i")).alias("value"))
    return gates.evaluate(gates.derived(s), spark.createDataFrame(ALL_GATES, "gate string, metric string, scope string, comparison string, required double"))


@query(SUMMARY + "SELECT gate, comparison, required, round(observed, 6) AS observed, status FROM t")
def all_gates(spark: SparkSession, sf: str) -> DataFrame:
    return _gates(spark, sf).withColumn("observed", F.round("observed", 6))


@query(SUMMARY + """
, w AS (SELECT split_part(gate, '.', 1) AS protocol, gate, max(CASE status WHEN 'blocked' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END) AS worst FROM t GROUP BY 1, 2)
SELECT protocol, count(*) AS gates, count(*) FILTER (WHERE worst = 1) AS failed, count(*) FILTER (WHERE worst = 2) AS blocked, max(worst) = 0 AS passed FROM w GROUP BY protocol
""")
def gate_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Nine, fifteen and thirteen gates; a protocol passes if all of its do."""
    return gates.verdicts(_gates(spark, sf))


@query(f"""
WITH r AS (SELECT o_orderkey, o_custkey, md5(CAST(o_totalprice AS VARCHAR)) AS h, {FRACTION} AS f FROM orders), s AS (SELECT *, f < 0.7 AS train FROM r)
SELECT (SELECT count(*) FROM s WHERE train) AS train_rows, (SELECT count(*) FROM s WHERE NOT train) AS validation_rows,
 (SELECT count(*) FROM (SELECT o_custkey FROM s WHERE train INTERSECT SELECT o_custkey FROM s WHERE NOT train) a) AS group_leaks,
 (SELECT count(*) FROM (SELECT o_totalprice FROM orders JOIN s USING (o_orderkey) WHERE train INTERSECT SELECT o_totalprice FROM orders JOIN s USING (o_orderkey) WHERE NOT train) b) AS exact_leaks
""")
def leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: sizes of a group-safe split and what still crosses it, by group and by exact content."""
    train = digests.stable_fraction(1729, c("o_custkey")) < 0.7
    s = table(spark, sf, "orders").select("o_custkey", "o_totalprice", train.alias("train"))
    crossing = lambda key, name: s.groupBy(key).agg(F.bool_or("train").alias("a"), F.bool_or(~c("train")).alias("b")).where("a and b").agg(F.count("*").alias(name))
    sizes = s.agg(F.count_if("train").alias("train_rows"), F.count_if(~c("train")).alias("validation_rows"))
    return sizes.join(crossing("o_custkey", "group_leaks"), F.lit(True)).join(crossing("o_totalprice", "exact_leaks"), F.lit(True))  # one row each


@query("""
WITH g AS (SELECT conv_id, count(DISTINCT role) AS roles, count(DISTINCT md5(text)) AS texts, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n < 2 THEN 'too_few' WHEN texts = n THEN 'all_differ' WHEN texts = 1 THEN 'deterministic' ELSE 'diverges' END AS verdict FROM g
""")
def determinism_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the repetitions of a label gave one digest."""
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.countDistinct(F.md5("text")).alias("texts"), F.count("*").alias("n"))
    return g.select("conv_id", F.when(c("n") < 2, "too_few").when(c("texts") == c("n"), "all_differ").when(c("texts") == 1, "deterministic").otherwise("diverges").alias("verdict"))


portable("job_grid_missing", """
SELECT e.event_type AS arm, s.seed FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN (SELECT 206 AS seed UNION ALL SELECT 1206 UNION ALL SELECT 2206) s
WHERE NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = e.event_type AND v.event_id % 3000 = s.seed)
""")


@query("""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'bad_schema' WHEN 1 THEN 'bad_hash' WHEN 2 THEN 'bad_metric' ELSE 'ok' END AS k FROM orders)
SELECT o_orderkey, k = 'ok' AS valid FROM x
""")
def receipt_validity(spark: SparkSession, sf: str) -> DataFrame:
    """JSON receipts against a fixed schema: version, digests, finite metrics in range."""
    k = c("o_orderkey") % 6
    body = F.to_json(F.struct(F.when(k == 0, "other.v2").otherwise("job_receipt.v1").alias("schema_version"), F.when(k == 1, "zz").otherwise(F.sha2(c("o_orderkey").cast("string"), 256)).alias("config_sha256"), F.struct(F.when(k == 2, 1.5).otherwise(0.5).alias("dice"), F.lit(3.0).alias("hd95")).alias("metrics")))
    r = table(spark, sf, "orders").select("o_orderkey", F.from_json(body, "schema_version string, config_sha256 string, metrics struct<dice:double,hd95:double>").alias("r"))
    m = c("r.metrics")
    ok = (c("r.schema_version") == "job_receipt.v1") & digests.is_sha256(c("r.config_sha256")) & scalars.is_finite(m["dice"]) & m["dice"].between(0.0, 1.0) & scalars.is_finite(m["hd95"]) & (m["hd95"] >= 0.0)
    return r.select("o_orderkey", F.coalesce(ok, F.lit(False)).alias("valid"))

