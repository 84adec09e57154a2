"""From raw documents to packed training sequences, in stages that each read the last one's table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm import language, packing, pii, quality, simhash
from driftgrid.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: with a letter, and not under the calibrated
    probability.  The model is trained on a bounded sample of the labelled rows."""
    model = language.learn(docs, F.lit(True))
    predict = language.predictor(docs, model)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    judged = docs.select(row, predict(F.col("text")).alias("found"))
    kept = judged.where(~F.col("found.rejected"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the bounds of their language and source pass."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_copies(docs, similarity=0.8, shingle=5)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for the personal data; ``n_chars`` counts the new text."""
    fresh = pii.pseudonymise(docs)
    if "n_chars" in docs.columns:
        fresh = fresh.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return fresh.select(*(f"`{c}`" for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("PII surrogates", private_data),
    ("best-fit packing", packed),
]

# Learned models, sketches and fingerprints have no SQL; tests hold the stages against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs, name.replace(" ", "-"))
    return docs
