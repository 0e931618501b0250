"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again as the next one's input.

toxicity drops documents whose score is TOXIC_AT or more; near_duplicates keeps the smallest doc_id of each group; pii replaces
personal data in texts by the kind in brackets; mixing repeats documents to the target weights, in training order; pieces encodes
what is left. All but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns of any name: null and
empty texts pass toxicity and near_duplicates (each row of them stays) and pii unchanged, and mixing, which counts words, does not take
them. Repeated rows pass toxicity and pii as they are; near_duplicates keeps one. Rows of null doc_id are never removed as copies. An empty table
gives an empty table after every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import mixing, ngram_join, pieces, pii, toxicity
from strandlake.llm.shared import fresh, table

#: Training, links of texts and pieces can't be said in SQL; tests/llm/test_stages.py compares every stage, and the whole run, with small cases.
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC_AT, with all their columns."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = fresh(docs, "own_score")  # a column score of the documents stays what it is
    kept = toxicity.scored(docs.withColumnRenamed("score", own), model).where(F.col("score") < toxicity.TOXIC_AT)
    return kept.select(*[F.col(own).alias(c) if c.lower() == "score" else F.col(c) for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return ngram_join.near_duplicates_removed(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; the last ones of a source may be cut at its target."""
    return mixing.training_order(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_hash and ids of every document in the order in which blocks are written."""
    encoded = pieces.encode(docs.select("doc_id", "text"), pieces.pieces_of(spark))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
