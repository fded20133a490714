"""The registered queries of this folder: name -> Spark query, and the SQL that some are checked against."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentspark.llm import (
    chat, decontaminate, language, lm_score, ngram_join, packing, prefix_trie, quality, repair, secrets, suffix_dedup, token_files,
    vectors,
)
from talentspark.session import small_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's vocabulary file, which every node has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_decontaminate")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(load(spark, sf_dir, "documents"))


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(load(spark, sf_dir, "documents"), 3, 90)


@query("op5_chat")
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(turns.unionByName(chat.probe(spark)))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), False)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(load(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = load(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score(load(spark, sf_dir, "documents"), good)


@query("op9_vectors")
def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(load(spark, sf_dir, "embeddings"), 0.98)


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(load(spark, sf_dir, "documents"))


@query("op11_repair")
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(load(spark, sf_dir, "conversations"), repair.damage)


@query("op12_prefix_trie")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.report(load(spark, sf_dir, "conversations"))


@query("op13_secrets")
def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(load(spark, sf_dir, "documents"))
