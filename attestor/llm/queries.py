"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, binary_codes, bpe, common, exact_dedup, mixing, periodic, secrets, simhash, substring_dedup, suffix_dedup, token_counts, topk, toxicity


def _vocabulary() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _vocabulary()
    out = bpe.decode(bpe.encode(common.table(spark, sf_dir, "documents"), path, pattern), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents are written; then each gets the edits of a production revision and is counted again."""
    trees = common.materialise(token_counts.plant(common.table(spark, sf_dir, "documents"), *_vocabulary()), "trees")
    return token_counts.revise(trees.withColumn("edits", token_counts.revision_edits()), *_vocabulary(), keep=False)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_words(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The target mixture, in shares; sources that are not named share one.
WEIGHTS = {"src0": 6, "src1": 4, "src2": 4, "src3": 3, "src4": 3, "src5": 2, "src6": 2, "src7": 2, "src8": 2, "src9": 1, mixing.OTHER: 5}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").alias("text"))  # only for ties
    return mixing.mix(docs, WEIGHTS).drop("text")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(common.table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(common.table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    score = F.col("toxicity")
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    many = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    found = secrets.scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(many, ("assign", "access", "hex")), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    found, _ = alignment.align(common.table(spark, sf_dir, "documents"), *paths, keep=digest)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def with_periods(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents repeat a passage from a word on to their end, by the contract's rule; others stay as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(common.table(spark, sf_dir, "documents"), with_periods)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    line = lambda r: F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op5_token_counts": op5_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op7_topk": op7_topk,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": f"""
        WITH RECURSIVE w(pool, q) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in WEIGHTS.items())}),
        d AS (
            SELECT doc_id, source, pool, row_number() OVER (PARTITION BY pool ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS idx
            FROM (SELECT doc_id, source, coalesce((SELECT pool FROM w WHERE pool = source), '{mixing.OTHER}') AS pool FROM documents)
        ),
        p AS (SELECT d.pool, any_value(q) AS q, CAST(ceil(count(*) / 16.0) AS BIGINT) AS blocks FROM d JOIN w ON d.pool = w.pool GROUP BY d.pool),
        b AS (SELECT DISTINCT v AS first FROM (SELECT 0 AS v UNION ALL SELECT blocks // q FROM p UNION ALL SELECT blocks // q + 1 FROM p)),
        have AS (SELECT first, pool, q, greatest(0, least(q, blocks - q * first)) AS m, least(blocks, q * first) AS before FROM b, p),
        shape AS (SELECT first, CAST(sum(before) AS BIGINT) AS start, CAST(sum(m) AS BIGINT) AS length FROM have GROUP BY first),
        jobs AS (
            SELECT h.first, h.pool, j, CAST(sum(least(o.m * h.q, o.q * (j + 1))) + any_value(h.q) - 1 AS BIGINT) // any_value(h.q) AS due,
                   CAST(sum(least(o.m * h.q, o.q * j)) AS BIGINT) // any_value(h.q) AS released
            FROM (SELECT *, unnest(range(0, CAST(m AS BIGINT))) AS j FROM have) h JOIN have o ON o.first = h.first GROUP BY h.first, h.pool, j
        ),
        edf AS (
            SELECT first, 0 AS t, list({{'due': due, 'pool': pool, 'j': j, 'released': released}} ORDER BY due, pool, j) AS todo,
                   {{'due': CAST(NULL AS BIGINT), 'pool': CAST(NULL AS VARCHAR), 'j': CAST(NULL AS BIGINT), 'released': CAST(NULL AS BIGINT)}} AS pick
            FROM jobs GROUP BY first
            UNION ALL
            SELECT first, t + 1, list_filter(todo, lambda x: x <> p), p
            FROM (SELECT first, t, todo, list_filter(todo, lambda x: x.released <= t)[1] AS p FROM edf WHERE len(todo) > 0)
        ),
        r AS (SELECT d.*, idx // 16 AS block, (idx // 16) // q AS period, (idx // 16) % q AS j FROM d JOIN p ON d.pool = p.pool),
        f AS (SELECT r.*, (SELECT max(first) FROM b WHERE first <= period) AS first FROM r),
        s AS (
            SELECT doc_id, source, f.pool, block, idx, start + (period - f.first) * length + edf.t - 1 AS slot
            FROM f JOIN shape ON shape.first = f.first JOIN edf ON edf.first = f.first AND edf.pick.pool = f.pool AND edf.pick.j = f.j
        )
        SELECT doc_id, source, pool, block, slot, row_number() OVER (ORDER BY slot, idx) - 1 AS position FROM s
    """,
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS hit FROM h),
        c AS (SELECT DISTINCT doc_id, i + k AS j FROM f, range(0, 50) t(k) WHERE hit),
        u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
        k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.j) FILTER (WHERE c.j IS NULL) AS kept, count(c.j) AS n FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.j = c.j GROUP BY u.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op10_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        h AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS i FROM d WHERE len(x) >= 400)),
        f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) > 1 AS hit FROM h) WHERE hit),
        g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS jump FROM f),
        r AS (SELECT doc_id, i, sum(CASE WHEN jump <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM r GROUP BY doc_id, run),
        e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM s),
        k AS (
            SELECT d.doc_id, count(a) AS n_spans, coalesce(sum(b - a), 0) AS n_removed,
                   coalesce(string_agg(substr(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a), '') || substr(any_value(x), 2 * coalesce(max(b), 0) + 1) AS kept
            FROM d LEFT JOIN e ON d.doc_id = e.doc_id GROUP BY d.doc_id
        )
        SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k ON d.doc_id = k.doc_id
    """,
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op11_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), near AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.95
        ), reached AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, n.v FROM reached r JOIN near n ON r.v = n.u),
        low AS (SELECT u, min(v) AS component_id FROM reached GROUP BY u),
        many AS (SELECT u, count(*) AS n FROM near GROUP BY u)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN low ON low.u = vec_id LEFT JOIN many ON many.u = vec_id
    """,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
