"""From raw documents to packed sequences: STAGES, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents, whatever other columns there are. n_chars follows the text where a stage changes it. Null and repeated ids,
null texts and empty inputs go through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentloom.llm import jaccard_join, line_dedup, packing, quality, secret_scan
from rentloom.llm.common import materialize


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go: P(grade >= 1) below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", quality.rating().alias("grade"))
    return quality.score(docs, quality.train(docs, labels)).where("keep").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which nothing is left goes with them."""
    kept = line_dedup.line_dedup(docs).where("n_removed < n_lines")
    return _sized(kept.select(*docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays; rows without words all stay. Rows are judged by
    id and text, so null or repeated ids cost no other text."""
    return jaccard_join.without_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked in the texts; all documents stay."""
    return _sized(secret_scan.mask_secrets(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

# The classifier's training and the tokenizer can't be written in SQL; tests/llm hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
