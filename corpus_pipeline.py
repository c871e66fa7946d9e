"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
the columns of documents; its result is written as Parquet in the shared folder
and read again as the next one's input. The last returns the packed pieces.
Rows that repeat a doc_id and its text are one document and stay or go together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import packing, quality, secrets, suffix
from tidewell.llm.jaccard import jaccard_components
from tidewell.llm.queries import vocabulary
from tidewell.llm.shared import shared_dir


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base limits nor the learned rules reject."""
    rules = quality.fit_list(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.verdicts(docs, rules, keep=tuple(docs.columns)).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, null ids last; of texts with that id one stays."""
    groups = jaccard_components(docs, words=5, percent=80)
    heads = groups.where("component_id <=> doc_id AND group_id IS NOT NULL").select("group_id", "doc_id", "text_id")
    several = heads.groupBy("group_id").agg(F.min("text_id").alias("first_text"), F.max("text_id").alias("last_text")).where("first_text <> last_text")
    also = heads.join(several, "group_id").where("text_id <> first_text").select("doc_id", "text_id")
    later = groups.where("NOT component_id <=> doc_id").select("doc_id", "text_id").union(also)
    later = later.select(F.col("doc_id").alias("__doc_id"), F.col("text_id").alias("__text_id")).distinct()
    return docs.join(later, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__text_id")), "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that come earlier."""
    rest = tuple(c for c in docs.columns if c != "text")
    kept = suffix.without_repeats(docs, 100, rest, as_text=True)
    return _measured(kept.select("row.*", F.col("kept").alias("text")).select(*docs.columns))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret span replaced."""
    return _measured(secrets.redacted(docs, secrets.fit_random_strings(docs)))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"), window=2048, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("secret_scans", secret_scans),
    ("packing", packed_sequences),
]

#: Learned rules, Markov models and tokenizers can't be said in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
