"""The order of the mixing stage shows in the pipeline's result."""

import corpus_pipeline
from attestor.llm import mixing
from attestor.llm.queries import WEIGHTS


def test_result_has_the_mixtures_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}", f"src{i % 7}") for i in range(500)], "doc_id long, text string, source string")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    mixed.repartition(5).write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.tokenize(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    order = [r.doc_id for r in mixed.collect()]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == order
    assert sorted(r.position for r in got) == list(range(500))
    assert {r.doc_id: r.position for r in got} == {r.doc_id: r.position for r in mixing.mix(docs, WEIGHTS).collect()}
