"""A training-data pipeline: documents go through five of the operators, each stage's result being the next one's input."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import bpe, common, exact_dedup, mixing, simhash, toxicity
from attestor.llm.queries import WEIGHTS


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels of this stage's own input scores below 0.5.

    Null text counts as empty; rows are judged one by one, so repeated rows and null ids stay or go by their text; an empty
    table stays empty, and without a toxic label all rows stay. All columns are kept as they are.
    """
    model = toxicity.learn(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(F.struct("*").alias("row"), "text"), model, "score").where("score < 0.5").select("row.*")


def _one_of_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and digest of the text `kept` names, one of those that repeat both.

    Both steps go by the same three columns, so texts are shuffled once.
    """
    key = ["digest", "unknown", "id"]
    named = lambda digest: [digest.alias("digest"), F.col("doc_id").isNull().alias("unknown"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")]
    rows = docs.select(F.struct("*").alias("row"), *named(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return rows.join(kept.select(*named(F.col("digest"))), key, "left_semi").dropDuplicates(key).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; rows that repeat id and text count once.

    Null text equals empty text; a null doc_id is smaller than any other, and of several only one row of a text stays; an
    empty table stays empty. All columns are kept as they are.
    """
    return _one_of_each(docs, exact_dedup.dedup(docs).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; a five-word similarity of 0.8 or more links, nothing else.

    A null doc_id is larger than any other; of rows with one doc_id that with the least digest of its text stays, of rows that
    repeat both one. Texts without words are one group; an empty table stays empty. All columns are kept as they are.
    """
    found = simhash.similar_texts(docs, words=3, radius=2, overlap=5, least=(4, 5))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")).alias("first"))
    return _one_of_each(docs, first.select("first.doc_id", "first.digest"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves the sources to their target weights. Written to files, their order is kept by the files' numbers."""
    return mixing.mixed_order(docs, WEIGHTS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, digests of the ids and of the text they decode to, and its position in the mixture.

    The position is that of mixing.mix(), whatever files hold the documents. It is found without their texts: rows of files are
    known by file and row there; only documents that don't come from files are mixed as a whole.

    Null text counts as empty; rows that repeat a doc_id, or have none, are encoded one by one; an empty table gives none.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    order = None
    try:
        rows = docs.select("doc_id", "text", "source", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
        order = mixing.mix(rows, WEIGHTS, keep=["at"]).select("at.file", "at.row", "position")
    except AnalysisException:
        rows = mixing.mix(docs, WEIGHTS).select("doc_id", "text", F.struct("position").alias("at"))
    out = bpe.encode_and_decode(rows.select(F.struct("doc_id", "at").alias("doc_id"), "text"), path, public_tokenizers.PATTERN)
    out = out.select("doc_id.doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "doc_id.at.*")
    return out if order is None else out.join(order, ["file", "row"]).drop("file", "row")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: SQL can express neither the learned model nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
