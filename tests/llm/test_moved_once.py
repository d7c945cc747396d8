"""What the pipeline's stages shuffle, keep on disk and run in Python."""

import re

import public_tokenizers
import pytest

import corpus_pipeline
from attestor.llm import bpe, common, exact_dedup, simhash

WORDS = [f"w{i}" for i in range(60)]
DOCS = [(i, " ".join([*WORDS[: 50 + i % 5], f"end{i // 5}"]), f"src{i % 7}") for i in range(40)]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_shuffled_once(spark, docs):
    """The join with what is kept and the choice of one row share their partitions: an exchange for each side of the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = exact_dedup.digested(docs).select("doc_id", "digest")
        twice = spark.createDataFrame(DOCS + DOCS, docs.schema)
        rows = corpus_pipeline._one_of_each(twice, kept.where("doc_id % 2 = 0"))
        assert len(re.findall(r"Exchange hashpartitioning", plan(rows))) == 2
        assert sorted(tuple(r) for r in rows.collect()) == [x for x in DOCS if x[0] % 2 == 0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_near_dedup_leaves_no_texts(spark, docs):
    """Texts and pairs of a round go when its links are known, and marks are kept once."""
    before = set(common._TO_DROP)
    found = simhash.similar_texts(docs)
    left = {re.search(r"attestor-(.*)-[0-9a-f]{32}$", x)[1] for x in set(common._TO_DROP) - before}
    assert "nodes" in left and "by-bits" in left
    assert not left & {"marks", "by-bits-texts", "few-texts", "nearest-texts", "rest-texts"}
    assert found.count() == len(DOCS)


def test_tokens_take_one_worker(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    once = bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)
    twice = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    assert once.schema == twice.schema and sorted(once.collect()) == sorted(twice.collect())
    docs.write.parquet(f"{tmp_path}/docs")
    assert plan(corpus_pipeline.tokenize(spark, spark.read.parquet(f"{tmp_path}/docs"), "")).count("MapInArrow") == 1
