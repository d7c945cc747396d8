"""Audit queries: paths, manifests, caches, indexes, quality branches, refinement."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import kernels as k
from attestor.operators import audits

from .base import ORACLE_SQL, query, table
from .pixels import PX, grids, over

c = F.col

PATHS = "CASE doc_id % 7 WHEN 0 THEN concat('a/', source) WHEN 1 THEN concat('../', lang) WHEN 2 THEN concat('a/../b/', doc_id) WHEN 3 THEN 'a/../../a/b' WHEN 4 THEN concat('/', lang) WHEN 5 THEN '' ELSE concat('./x//', lang, '/..') END"


@query(f"""
WITH p AS (SELECT doc_id, {PATHS} AS path FROM documents),
s AS (SELECT doc_id, path, unnest(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.'))) AS step, generate_subscripts(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), 1) AS i FROM p),
d AS (SELECT doc_id, sum(CASE WHEN step = '..' THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM s),
low AS (SELECT doc_id, min(depth) AS low FROM d GROUP BY doc_id)
SELECT p.doc_id, path, path <> '' AND path[1] <> '/' AND coalesce(low, 0) >= 0 AS contained FROM p LEFT JOIN low ON p.doc_id = low.doc_id
""")
def path_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Names that leave their root, by a running depth inside the row."""
    p = table(spark, sf, "documents").select("doc_id", F.expr(PATHS).alias("path"))
    return p.withColumn("contained", audits.contained(c("path")))


@query("""
SELECT 'p/' || p_partkey AS name, CASE WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 7 = 0 THEN 'not_pinned' WHEN p_partkey % 5 = 0 THEN 'drift' ELSE 'intact' END AS state
FROM part WHERE NOT (p_partkey % 11 = 0 AND p_partkey % 7 = 0)
""")
def manifest_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Files against pinned digests: gone, changed, not pinned or intact."""
    key = c("p_partkey")
    p = table(spark, sf, "part").select(key, F.concat(F.lit("p/"), key.cast("string")).alias("name"), F.sha2(c("p_name"), 256).alias("digest"))
    pinned = p.where(key % 7 != 0).withColumn("digest", F.when(key % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.upper("digest")))
    return audits.drift(p.where(key % 11 != 0), pinned)


ARMS = """WITH a AS (SELECT event_id - (SELECT min(event_id) FROM events) AS idx, user_id, event_type FROM events),
z AS (SELECT idx, user_id, CASE WHEN idx % 37 = 0 THEN 'other' ELSE event_type END AS event_type FROM a WHERE idx % 101 <> 5)
"""


@query(ARMS + """
SELECT 'candidate_gap' AS rule, CAST(max(idx) + 1 - count(DISTINCT idx) AS BIGINT) AS broken FROM a
UNION ALL SELECT 'zero_gap', CAST(max(idx) + 1 - count(DISTINCT idx) AS BIGINT) FROM z
UNION ALL SELECT 'candidate_repeated_key', count(*) FROM (SELECT user_id, event_type FROM a GROUP BY ALL HAVING count(*) > 1) x
UNION ALL SELECT 'zero_repeated_key', count(*) FROM (SELECT user_id, event_type FROM z GROUP BY ALL HAVING count(*) > 1) x
UNION ALL SELECT 'only_candidate', count(*) FROM (SELECT user_id, event_type FROM a EXCEPT ALL SELECT user_id, event_type FROM z) x
UNION ALL SELECT 'only_zero', count(*) FROM (SELECT user_id, event_type FROM z EXCEPT ALL SELECT user_id, event_type FROM a) x
""")
def cache_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms of a cache against their contract."""
    e = table(spark, sf, "events")
    first = e.agg(F.min("event_id").alias("first"))
    a = e.join(first, F.lit(True)).select((c("event_id") - c("first")).alias("idx"), "user_id", "event_type")  # one row
    z = a.where("idx % 101 <> 5").withColumn("event_type", F.when(c("idx") % 37 == 0, "other").otherwise(c("event_type")))
    return audits.cache_problems(a, z, "idx", ["user_id", "event_type"], ["user_id", "event_type"])


@query("""
WITH r AS (SELECT doc_id, lang, source, doc_id % 4 AS fold FROM documents), want(scope, expected) AS (VALUES ('en', 1::BIGINT), ('xx', 3::BIGINT))
SELECT CASE WHEN expected IS NULL THEN 'unknown_role' ELSE 'count' END AS rule, coalesce(n.lang, scope) AS scope, coalesce(found, 0) AS found, coalesce(expected, 0) AS expected
FROM (SELECT lang, count(*) AS found FROM r GROUP BY lang) n FULL JOIN want ON n.lang = scope WHERE coalesce(found, 0) <> coalesce(expected, 0)
UNION ALL SELECT 'split_group', source, count(DISTINCT fold), 1 FROM r GROUP BY source HAVING count(DISTINCT fold) > 1
UNION ALL SELECT 'empty_fold', CAST(f AS VARCHAR), 0, 1 FROM (SELECT unnest(range(0, 5)) AS f) x WHERE f NOT IN (SELECT fold FROM r)
""")
def dataset_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index against pinned counts, roles and folds."""
    r = table(spark, sf, "documents").select("lang", "source", (c("doc_id") % 4).alias("fold"))
    return audits.index_problems(r, "lang", "source", "fold", {"en": 1, "xx": 3}, 5)


@query(PX + f""", s AS (SELECT vec_id, avg(CASE WHEN g >= 235 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS specular FROM px GROUP BY vec_id)
SELECT vec_id, CASE WHEN mean < 122 THEN 'low_brightness' WHEN blockiness >= 0.02 THEN 'jpeg_compression' WHEN std < 13 THEN 'low_contrast' ELSE 'clean' END AS quality,
CASE WHEN specular >= 0.005 OR laplacian <= 2000 THEN 'specular_or_blur' ELSE 'clean' END AS policy
FROM s JOIN ({ORACLE_SQL['luminance_stats']}) a USING (vec_id) JOIN ({ORACLE_SQL['blockiness8']}) b USING (vec_id) JOIN ({ORACLE_SQL['laplacian_variance']}) d USING (vec_id)
""")
def quality_branches(spark: SparkSession, sf: str) -> DataFrame:
    """The branches that quality picks; features of an image come from one pass over its batch."""

    def features(g):
        mean, std = k.luminance_stats(g)
        return {"mean": mean, "std": std, "blockiness": k.blockiness(g, 4), "laplacian": k.laplacian_variance(g), "specular": float((g >= 235).mean())}

    f = over(spark, sf, features, "mean double, std double, blockiness double, laplacian double, specular double")
    return f.select("vec_id", audits.quality_branch(c("mean"), c("std"), c("blockiness")).alias("quality"), audits.policy_branch(c("specular"), c("laplacian"), most_blur=2000.0).alias("policy"))


@query(PX + """, m AS (SELECT a.vec_id, a.y, a.x, a.g >= 120 AS base, a.g >= 135 AS fine, b.g >= 128 AS target FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.i = CASE WHEN a.i % 2 = 0 THEN a.i ELSE 63 - a.i END),
n AS (SELECT vec_id, sum((base AND target)::INT)::DOUBLE AS tb, sum(base::INT)::DOUBLE AS b, sum((fine AND target)::INT)::DOUBLE AS tf, sum(fine::INT)::DOUBLE AS f, sum(target::INT)::DOUBLE AS t,
 sum(CASE WHEN fine AND (y IN (0, 7) OR x IN (0, 7)) THEN 1 ELSE 0 END) / 28.0::DOUBLE AS border FROM m GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN f + t = 0 THEN 1 ELSE 2 * tf / (f + t) END - CASE WHEN b + t = 0 THEN 1 ELSE 2 * tb / (b + t) END, 9) AS dice_delta,
 round(CASE WHEN f + t - tf = 0 THEN 1 ELSE tf / (f + t - tf) END - CASE WHEN b + t - tb = 0 THEN 1 ELSE tb / (b + t - tb) END, 9) AS iou_delta,
 round(CASE WHEN f = 0 THEN 1 ELSE tf / f END - CASE WHEN b = 0 THEN 1 ELSE tb / b END, 9) AS precision_delta,
 round(CASE WHEN t = 0 THEN 1 ELSE tf / t END - CASE WHEN t = 0 THEN 1 ELSE tb / t END, 9) AS recall_delta,
 round(border, 9) AS invalid_border_fraction, border > 0.5 AS invalid_border FROM n WHERE t > 0 AND t < 64
""")
def refinement_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Gains of a refined mask over its baseline, inside the row; targets without both classes take no part."""
    over_ = lambda level: lambda v: v >= level
    other = F.transform("g", lambda v, i: F.when(i % 2 == 0, v).otherwise(F.get("g", F.lit(63) - i)) >= 128)
    m = grids(spark, sf).select("vec_id", F.transform("g", over_(120)).alias("base"), F.transform("g", over_(135)).alias("fine"), other.alias("target"))
    m = m.where(F.exists("target", lambda x: x) & F.exists("target", lambda x: ~x))
    d = audits.refinement_deltas(c("base"), c("fine"), c("target"), 8, 8)
    return m.select("vec_id", *((v if n == "invalid_border" else F.round(v, 9)).alias(n) for n, v in d.items()))


@query(PX + """, a AS (SELECT a.vec_id, a.y, a.x, a.g >= 120 AS base, a.g >= 135 AS fine, b.g >= 128 AS target FROM px a JOIN px b ON a.vec_id = b.vec_id AND b.i = CASE WHEN a.i % 2 = 0 THEN a.i ELSE 63 - a.i END),
m AS (SELECT vec_id, 'base' AS arm, y, x, base AS p FROM a UNION ALL SELECT vec_id, 'fine', y, x, fine FROM a UNION ALL SELECT vec_id, 'target', y, x, target FROM a),
e AS (SELECT p.vec_id, p.arm, p.y, p.x FROM m p JOIN m q ON q.vec_id = p.vec_id AND q.arm = p.arm AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND q.p WHERE p.p GROUP BY p.vec_id, p.arm, p.y, p.x HAVING count(*) < 9),
f AS (SELECT p.vec_id, p.arm, p.y, p.x, t.y AS ty, t.x AS tx, sqrt((p.y - t.y) ** 2 + (p.x - t.x) ** 2) AS d FROM e p JOIN e t ON p.vec_id = t.vec_id AND t.arm = 'target' WHERE p.arm <> 'target'),
d AS (SELECT vec_id, arm, 'p' AS side, min(d) AS d FROM f GROUP BY vec_id, arm, y, x UNION ALL SELECT vec_id, arm, 't', min(d) FROM f GROUP BY vec_id, arm, ty, tx),
s AS (SELECT vec_id, arm, avg((d <= 1)::INT::DOUBLE) FILTER (WHERE side = 'p') AS p, avg((d <= 1)::INT::DOUBLE) FILTER (WHERE side = 't') AS r, quantile_cont(d, 0.95) AS hd95, avg(d) AS assd FROM d GROUP BY vec_id, arm),
w AS (SELECT vec_id, arm, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1, hd95, assd FROM s)
SELECT b.vec_id, round(f.f1 - b.f1, 8) AS boundary_f1_delta, CASE WHEN b.assd > 0 THEN round((b.assd - f.assd) / b.assd, 8) END AS assd_relative_improvement, CASE WHEN b.hd95 > 0 THEN round((f.hd95 - b.hd95) / b.hd95, 8) END AS hd95_relative_regression
FROM w b JOIN w f ON b.vec_id = f.vec_id AND b.arm = 'base' AND f.arm = 'fine'""")
def refinement_distances(spark: SparkSession, sf: str) -> DataFrame:
    """What a refined mask gains on its baseline by boundary F1 (tolerance 1), mean surface distance and 95th percentile distance.

    Images without a boundary in one of the masks take no part; a relative figure is null where the baseline's is 0.
    """

    def scores(g):
        flat = g.ravel()
        at = np.arange(64)
        target = (np.where(at % 2 == 0, flat, flat[63 - at]) >= 128).reshape(8, 8)
        base, fine = (k.boundary_scores(g >= level, target, 1.0) for level in (120, 135))
        every = all(m.any() for m in (g >= 120, g >= 135, target))
        gain = {"boundary_f1_delta": fine["boundary_f1"] - base["boundary_f1"], "base_assd": base["assd"], "fine_assd": fine["assd"], "base_hd95": base["hd95"], "fine_hd95": fine["hd95"]}
        return gain | {"every": int(every)}

    f = over(spark, sf, scores, "boundary_f1_delta double, base_assd double, fine_assd double, base_hd95 double, fine_hd95 double, every long").where("every = 1")
    relative = lambda x, sign: F.when(c(f"base_{x}") > 0, F.round(sign * (c(f"base_{x}") - c(f"fine_{x}")) / c(f"base_{x}"), 8))
    return f.select("vec_id", F.round("boundary_f1_delta", 8).alias("boundary_f1_delta"), relative("assd", 1).alias("assd_relative_improvement"), relative("hd95", -1).alias("hd95_relative_regression"))
