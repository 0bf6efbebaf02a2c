"""A corpus pipeline over the documents table.

language ID -> near-duplicate removal -> benchmark decontamination -> source
mixing -> token output. Every stage takes (spark, docs, sf_dir), works on all
rows that its predecessor kept, and is written as Parquet before the next one
reads it. All stages but the last return the columns of documents.

No stage of it can be said in SQL as a whole (models, hashes, an external
vocabulary), so ORACLE_SQL is None; the tests hold every stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concentra.llm import decontam, jaccard, langid, mixing, tokenout
from concentra.llm.registry import read_table
from concentra.session import scratch_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is not recognised (no letters, or
    text unlike any learned language)."""
    model = langid.fit(langid.training_rows(docs))
    return langid.identify(docs, model).where(~F.col("lang_rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard
    0.8 or more): the one with the smallest id, rows without id last."""
    return jaccard.keep_one(docs, k=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their temperature weights, none repeated more than twice; every
    document is taken once at least, those of small sources again."""
    return mixing.mix(docs).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files, and their digest per document read back from them."""
    return tokenout.digest(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
