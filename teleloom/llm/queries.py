"""The registered corpus queries, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleloom.llm import (
    chat_format,
    decontamination,
    exact_dedup,
    hard_negatives,
    language_id,
    lexical_search,
    mixing,
    phrase_dedup,
    quality,
    secret_scan,
    simhash_dedup,
    sql,
    token_counts,
    vector_search,
)
from teleloom.llm.common import table

#: File of the tokenizer that op10 counts with, if the caller names none.
TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def fold(key: str, folds: int) -> Column:
    """The fold of a row, from the checksum of its key's text."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = phrase_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, docs.where(fold("doc_id", 3) != 1))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Attention | None:
    """Learned from the labelled documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & (fold("doc_id", 4) != 2))
    return quality.fit(table(spark, sf_dir, "documents"), labels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.union(probe)))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_phrase_dedup": op2_phrase_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_chat_format": op5_chat_format,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_counts": op10_token_counts,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_search": op12_vector_search,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = sql.ORACLES
