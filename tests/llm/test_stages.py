"""What the stages keep: every column, whatever its name; one row of a group, whatever its ids; nothing of an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import SCHEMA

NAMES = ["_digest", "_toxicity", "score", "row", "a.b", "c d", "digest", "_doc", "component", "kept_id"]
LONG = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    texts = [(None, LONG), (None, LONG.replace("w7", "W7")), (5, LONG.upper()), (3, LONG + " more"), (None, "on its own here"), (None, "on its own here"), (3, "another text of id three"), (9, None), (9, ""), (9, "")]
    df = spark.createDataFrame([(d, t, "en", "src1", 1) for d, t in texts], SCHEMA)
    for n, name in enumerate(NAMES):
        df = df.withColumn(name, F.struct(F.lit(n).alias("in it")) if n % 2 else F.lit(f"extra {n}"))
    sf = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    return df, sf


def plain(row):
    return (row["doc_id"], row["text"])


def test_stages(spark, rows):
    df, sf = rows
    out = {name: stage(spark, df, sf).collect() for name, stage in corpus_pipeline.STAGES[:-1]}
    for name, found in out.items():
        assert all(r.asDict()["_digest"] == "extra 0" and r.asDict()["c d"]["in it"] == 5 and list(r.asDict()) == df.columns for r in found), name
    assert len(out["toxicity"]) == len(out["mixing"]) == 10
    exact = sorted(map(plain, out["exact_dedup"]), key=repr)
    assert exact == sorted([(None, LONG), (None, LONG.replace("w7", "W7")), (5, LONG.upper()), (3, LONG + " more"), (None, "on its own here"), (3, "another text of id three"), next(x for x in exact if x[0] == 9)], key=repr)
    near = sorted(((d, t or "") for d, t in map(plain, out["simhash_dedup"])), key=repr)
    assert near == sorted([(3, LONG + " more"), (None, "on its own here"), (3, "another text of id three"), (9, "")], key=repr)


def test_no_documents(spark, rows):
    df, sf = rows
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), sf).count() == 0, name
