"""A corpus from raw documents: stages that each take the documents the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplevel.llm import bpe, line_dedup, mixing, ngram_join, quality
from snaplevel.llm.common import read, saved
from snaplevel.llm.queries import BYTE_BPE, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that a classifier, learned from the labelled ones among them, accepts."""
    labels = read(spark, folder, "labels").filter(~quality.held_out(F.col("doc_id")))
    return quality.accepted(docs, quality.train(docs, labels)).select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents without repeated lines; those of which no words are left go, n_chars is that of the rest."""
    kept = line_dedup.deduplicate_lines(docs)
    whole = F.col("n_kept") == F.col("n_lines")
    kept = kept.filter(whole | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The ids of every document, and digests of them and of the text that they decode to."""
    return bpe.round_trip(docs, vocabulary(BYTE_BPE)).select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", classify),
    ("line dedup", remove_lines),
    ("n-gram Jaccard join", remove_near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: The quality classifier is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
