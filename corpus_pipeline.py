"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes the documents that the one before it kept, written as Parquet and read again, and
returns documents with the same columns; the last one returns packed pieces. Rows without an id are
judged by their text where a stage needs no id, and stay where it does (near duplicates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentspark.llm import decontaminate, ngram_join, packing, quality, suffix_dedup
from talentspark.llm.queries import load, vocabulary
from talentspark.operators.joins import lookup_join
from talentspark.session import settle_table

# no SQL can express the learned, approximate and packing stages; tests compare them with brute force
ORACLE_SQL = None
# pieces of text whose token ids a packing task remembers: fewer than alone, as the stages share their workers
PIECES = 150_000


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = load(spark, sf_dir, "labels")
    model = quality.fit(quality.labelled_statistics(docs, labels, ~quality.held_out(F.col("doc_id"))))
    return docs.where(quality.score(model, F.col("text")) >= quality.ACCEPT)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity of 0.8): the smallest id."""
    near = ngram_join.classes(docs.select("doc_id", "text"), 5, 80)
    gone = settle_table(near.where("doc_id <> component_id").select("doc_id").distinct(), "near-duplicates")
    return lookup_join(docs, gone, ["doc_id"], "left_anti", spread_by=["doc_id"])


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated passages."""
    return suffix_dedup.clean(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.without(docs, load(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of 1024 tokens."""
    return packing.packed_pieces(docs, vocabulary("byte_bpe_50k.json"), kept=PIECES)


STAGES = [
    ("quality", good), ("near_duplicates", distinct), ("repeated_passages", unrepeated),
    ("decontamination", uncontaminated), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
