"""The pipeline's stages, each on the one before, and all of them on hard rows."""

import os

import corpus_pipeline
from attestor.llm import mixing, toxicity

from .test_overlap import shingles


def test_pipeline(spark, hard_rows, tmp_path):
    sf = str(tmp_path)
    docs = spark.createDataFrame(hard_rows + [(900 + i, f"you are a horrid thing number {i}", "en", "src1", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 900)) for i in [*range(40), *range(900, 920)]], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    current, sizes = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = current
        stage(spark, current, sf).write.parquet(f"{sf}/{i}")
        current = spark.read.parquet(f"{sf}/{i}")
        if i < 4:
            assert current.columns == docs.columns, name
        sizes.append(current.count())
        rows = [(r.doc_id, r.text) for r in current.select("doc_id", "text").collect()] if i < 4 else []
        if name == "toxicity":
            assert not any("horrid" in (t or "") for _, t in rows) and len(rows) >= 0.7 * len(hard_rows)  # so few labels teach little
            model = toxicity.learn(before.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
            assert sorted(map(repr, rows)) == sorted(repr((r.doc_id, r.text)) for r in before.collect() if model.score(r.text or "") < 0.5)
        if name == "exact_dedup":
            texts = [t or "" for _, t in rows]
            assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in before.collect()}
        if name == "simhash_dedup":
            sets = [shingles(t) for _, t in rows]
            assert all(5 * len(a & b) < 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    # each document keeps the position that the mixing stage gave it, over several files
    mixed = spark.read.parquet(f"{sf}/2")
    corpus_pipeline.mix_sources(spark, mixed, sf).write.option("maxRecordsPerFile", 7).parquet(f"{sf}/several")
    want = sorted((r.position, r.doc_id is None, r.doc_id or 0) for r in mixing.mix(mixed, corpus_pipeline.WEIGHTS).collect())
    for folder in ("3", "several"):
        out = corpus_pipeline.tokenize(spark, spark.read.parquet(f"{sf}/{folder}"), sf).collect()
        assert sorted((r.position, r.doc_id is None, r.doc_id or 0) for r in out) == want
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] == sizes[4]
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]
    assert os.path.exists(f"{sf}/4")
