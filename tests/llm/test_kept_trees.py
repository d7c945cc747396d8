"""Trees that are written, read and revised: counts and leaves like those of a fresh count, and little encoded again."""

import public_tokenizers
import regex
from pyspark.sql import functions as F

from attestor.llm import token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_revised_trees_are_fresh_ones(spark, hard, tmp_path):
    docs = hard.select("doc_id", "text", "n")
    token_counts.plant(docs, PATH, PATTERN).write.parquet(f"{tmp_path}/0")
    first = spark.read.parquet(f"{tmp_path}/0")
    assert {len(r.chars) == len(regex.findall(PATTERN, r.text)) for r in first.collect()} == {True}
    token_counts.revise(first.withColumn("edits", token_counts.revision_edits()), PATH, PATTERN).write.parquet(f"{tmp_path}/1")
    second = spark.read.parquet(f"{tmp_path}/1")
    fresh = token_counts.plant(second.select("doc_id", "text"), PATH, PATTERN)
    assert second.select(fresh.columns).exceptAll(fresh).count() == 0 and second.count() == docs.count()
    for r in second.collect():
        assert r.n_tokens_edited == sum(r.tokens) and len(r.text) == sum(r.chars) and r.n_reencoded < 60
    again = second.select(fresh.columns).where("doc_id % 7 = 0").withColumn("edits", F.array(F.struct(F.lit(3).alias("start"), F.lit(9).alias("stop"), F.lit(" et al.").alias("insert"))))
    third = token_counts.revise(again, PATH, PATTERN)
    fresh = token_counts.plant(third.select("doc_id", "text"), PATH, PATTERN)
    assert third.select(fresh.columns).exceptAll(fresh).count() == 0 and 0 < third.count() < docs.count()
